"""lectern TEXT OUT: a script file to verified audio; exit code 1 for failed chunks, 2 for wrong use."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .operators import audio as A
from .operators import report as R
from .operators.config import RenderConfig, SynthConfig
from .operators.segment import checked_reroll, parse_reroll, plan_chunks
from .plans import render as P
from .sources import readers, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lectern", description=__doc__)
    p.add_argument("text", help="script file, paragraphs apart by blank lines")
    p.add_argument("out", help="folder for the WAV file")
    p.add_argument("--lang", default="en")
    p.add_argument("--gap", type=float, default=1.0, help="seconds between paragraphs")
    p.add_argument("--max-chars", type=int, default=250)
    p.add_argument("--takes", help="folder of the take store")
    p.add_argument("--reroll", help="chunks to make anew, counted from 1, such as 2,5")
    p.add_argument("--spell-acronyms", action="store_true")
    p.add_argument("--no-quarantine", action="store_true", help="write the file in spite of failed chunks")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if not os.path.exists(args.text):
            raise ValueError(f"no such file: {args.text}")
        reroll = parse_reroll(args.reroll) if args.reroll is not None else frozenset()
        cfg = RenderConfig(max_chars=args.max_chars, synth=SynthConfig(spell_acronyms=args.spell_acronyms), quarantine=not args.no_quarantine, reroll=reroll)
        spark = spark or SparkSession.builder.appName("lectern").getOrCreate()
        segments = readers.scripts(spark, args.text, args.gap)
        planned = plan_chunks(segments, cfg.max_chars)
        if reroll:
            script = planned.select("script_id").distinct()
            wrong = checked_reroll(planned, script.crossJoin(spark.createDataFrame([(k,) for k in sorted(reroll)], "chunk_idx int"))).collect()
            if wrong:
                raise ValueError(f"no such chunks: {sorted(w['chunk_idx'] + 1 for w in wrong)}")
        chunks = planned.select("script_id", "chunk_idx", "text")
        if args.takes:
            results = P.render_with_store(chunks, args.takes, args.lang, cfg=cfg)
        else:
            results = P.with_audio(P.rendered(chunks, args.lang, cfg=cfg))
        for row in R.summary(R.report(results, ["script_id"])).collect():
            print(f"{row['script_id']}: {row['summary']}")
        if cfg.quarantine:
            R.quarantine(results)
        mixed = A.master(P.mix(results, segments, planned), P.RATE, cfg.master)
        writers.write_wavs(mixed, args.out, P.RATE)
        return 0 if results.where("not ok").isEmpty() else 1
    except R.QuarantinedError as e:
        print(e, file=sys.stderr)
        return 1
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
