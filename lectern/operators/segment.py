"""From texts to chunks of whole sentences, and from scripts to segments.

``chunk_text`` (a vectorised UDF) is the general form; ``packed_sentences`` is the
same as a native fold, for texts without a sentence above the limit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T
from ..functions.scoring import cut_sentences
from .config import MAX_CHARS

MIN_WORDS = 3
#: Texts whose chunks are held at once.
AT_ONCE = 256
REACH = 60
_MARKS = {1.0: (". ", "! ", "? "), 0.9: (": ", "; "), 0.8: (", ",), 0.7: (") ", "] ", " — ", " – ", " - "), 0.5: (" ",)}


def cut_at(text: str, limit: int) -> int:
    """Where to cut a text near the limit, by the worth of the mark and its nearness; -1 if nowhere."""
    best, where = 0.0, -1
    for worth, marks in _MARKS.items():
        for mark in marks:
            found = text.find(mark, 0, limit + len(mark))
            while found >= 0:
                end = found + len(mark)
                value = worth * (1 - abs(limit - end) / REACH)
                if value > best:
                    best, where = value, end
                found = text.find(mark, found + 1, limit + len(mark))
    return where


def pieces(sentence: str, limit: int) -> list[str]:
    """A sentence above the limit in pieces; a single long word stays whole."""
    out, rest = [], sentence
    while len(rest) > limit:
        cut = cut_at(rest, limit)
        if cut <= 0 and (cut := rest.rfind(" ", 0, limit)) <= 0:
            break
        out.append(rest[:cut].strip())
        rest = rest[cut:].strip()
    return [p for p in (*out, rest) if p]


def chunks(text: str, limit: int = MAX_CHARS) -> list[str]:
    """Sentences packed into chunks; runts go to the chunk before them where they fit."""
    full: list[str] = []
    held = ""
    for sentence in cut_sentences(text):
        joined = f"{held} {sentence}" if held else sentence
        if len(sentence) > limit:
            full += pieces(joined, limit)
            held = ""
        elif len(joined) > limit:
            full.append(held)
            held = sentence
        else:
            held = joined
    out: list[str] = []
    for chunk in (c for c in (*full, held) if c):
        if out and len(chunk.split()) < MIN_WORDS and len(out[-1]) + 1 + len(chunk) <= limit:
            out[-1] += " " + chunk
        else:
            out.append(chunk)
    return out


def chunked(parts: Iterable[pd.Series], limit: int = MAX_CHARS) -> Iterator[pd.Series]:
    """Chunks of batches of texts, a few texts at once."""
    for texts in parts:
        for at in range(0, len(texts), AT_ONCE):
            yield texts.iloc[at : at + AT_ONCE].map(lambda t: chunks(t, limit), na_action="ignore")


def chunk_text(text: Column, limit: int = MAX_CHARS) -> Column:
    """Chunks of a text as an array."""

    @F.pandas_udf(ArrayType(StringType()))
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from chunked(parts, limit)

    return cut(text)


def packed_sentences(sentences: Column, limit: int = MAX_CHARS) -> Column:
    """Chunks of sentences that all keep to the limit, by two native folds."""
    empty = F.array().cast("array<string>")

    def add(acc: Column, s: Column) -> Column:
        joined = F.when(acc["held"] == "", s).otherwise(F.concat(acc["held"], F.lit(" "), s))
        over = F.length(joined) > limit
        return F.struct(F.when(over, F.concat(acc["full"], F.array(acc["held"]))).otherwise(acc["full"]).alias("full"), F.when(over, s).otherwise(joined).alias("held"))

    packed = F.aggregate(sentences, F.struct(empty.alias("full"), F.lit("").alias("held")), add, lambda acc: F.filter(F.concat(acc["full"], F.array(acc["held"])), lambda c: c != ""))

    def merge(acc: Column, c: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = last.isNotNull() & (T.word_count(c) < MIN_WORDS) & (F.length(last) + F.length(c) + 1 <= limit)
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, F.lit(" "), c)))).otherwise(F.concat(acc, F.array(c)))

    return F.aggregate(packed, empty, merge)


def chunks_of(text: Column, limit: int = MAX_CHARS) -> Column:
    """Chunks natively; only texts with a sentence above the limit go through the UDF."""
    cut = T.sentences(text)
    long = F.exists(cut, lambda s: F.length(s) > limit)
    return F.when(long, chunk_text(F.when(long, text), limit)).otherwise(packed_sentences(cut, limit))


def parse_script(scripts: DataFrame, gap_s: float = 1.0, id_col: str = "script_id", text_col: str = "text") -> DataFrame:
    """(script_id, seg_no, kind, text, gap_s): paragraphs, with a gap between each two."""
    blocks = F.filter(F.transform(F.split(text_col, "\n\n"), lambda b: T.stripped(F.regexp_replace(b, r"(?U)\s+", " "))), lambda b: b != "")
    rows = scripts.select(F.col(id_col).alias("script_id"), F.posexplode(blocks).alias("p", "text"))
    kinds = F.when(F.col("p") > 0, F.array(F.lit("gap"), F.lit("text"))).otherwise(F.array(F.lit("text")))
    rows = rows.select("script_id", "p", "text", F.explode(kinds).alias("kind"))
    own = F.col("kind") == "text"
    number = F.when(own, 2 * F.col("p")).otherwise(2 * F.col("p") - 1)
    return rows.select("script_id", number.alias("seg_no"), "kind", F.when(own, F.col("text")).alias("text"), F.when(~own, F.lit(float(gap_s))).alias("gap_s"))


def checked_segments(segments: DataFrame) -> DataFrame:
    """The segments; a blank text, or a gap that isn't above 0, is an error when it is met."""
    bad = F.when((F.col("kind") == "text") & (F.coalesce(T.stripped(F.col("text")), F.lit("")) == ""), "a text segment is blank").when((F.col("kind") == "gap") & ~F.coalesce(F.col("gap_s") > 0, F.lit(False)), "a gap must be longer than 0 s")
    return segments.withColumn("kind", F.when(bad.isNull(), F.col("kind")).otherwise(F.raise_error(bad)))


def plan_chunks(segments: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    """(script_id, chunk_idx, seg_no, piece_no, text, voice_id) of the text segments; chunks never cross segments."""
    voice = F.col("voice_id") if "voice_id" in segments.columns else F.lit(None).cast("string")
    texts = segments.where("kind = 'text'").select("script_id", "seg_no", voice.alias("voice_id"), chunk_text(F.col("text"), limit).alias("chunks"))
    rows = texts.select("script_id", "seg_no", "voice_id", F.posexplode("chunks").alias("piece_no", "text"))
    order = Window.partitionBy("script_id").orderBy("seg_no", "piece_no")
    return rows.select("script_id", (F.row_number().over(order) - 1).alias("chunk_idx"), "seg_no", "piece_no", "text", "voice_id")


def with_voices(planned: DataFrame, voices: DataFrame, default_voice: str | None = None) -> DataFrame:
    """Chunks with the columns of their voice; the voices are a small table of the project."""
    named = planned.withColumn("voice_id", F.coalesce("voice_id", F.lit(default_voice)))
    return named.join(voices, "voice_id", "left")


def checked_reroll(planned: DataFrame, reroll: DataFrame) -> DataFrame:
    """(script_id, chunk_idx) of rerolled indices that no chunk has."""
    return reroll.join(planned.select("script_id", "chunk_idx"), ["script_id", "chunk_idx"], "left_anti")


def parse_reroll(given: str) -> frozenset[int]:
    """Indices from 0 of a list like "1,4", counted from 1."""
    try:
        numbers = [int(x) for x in given.split(",") if x.strip()]
    except ValueError as e:
        raise ValueError(f"no list of numbers: {given!r}") from e
    if not numbers or min(numbers) < 1:
        raise ValueError("chunks are counted from 1")
    return frozenset(n - 1 for n in numbers)


def register(spark: SparkSession) -> None:
    """chunk_text(text, limit) and script_segments(text, gap) as SQL table functions."""

    @F.udtf(returnType="piece_no int, chunk string")
    class ChunkText:
        def eval(self, text: str, limit: int):
            for k, c in enumerate(chunks(text or "", limit)):
                yield k, c

    @F.udtf(returnType="seg_no int, kind string, text string, gap_s double")
    class ScriptSegments:
        def eval(self, text: str, gap: float):
            blocks = [b for b in (" ".join(b.split()) for b in (text or "").split("\n\n")) if b]
            for k, b in enumerate(blocks):
                if k:
                    yield 2 * k - 1, "gap", None, float(gap)
                yield 2 * k, "text", b, None

    spark.udtf.register("chunk_text", ChunkText)
    spark.udtf.register("script_segments", ScriptSegments)
