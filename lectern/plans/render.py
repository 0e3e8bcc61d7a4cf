"""Scripts to verified, mixed audio: the whole plan over the simulated engine, or one of your own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..operators import audio as A
from ..operators import ladder as L
from ..operators import segment as G
from ..operators import takes as K
from ..operators.config import RenderConfig

RATE = 16_000
ENGINE, VERIFIER = "simulated-engine/1", "simulated-recogniser/1+coverage/0.9"
Failure = Callable[[], Column]


def no_failure() -> Column:
    return F.lit("none")


def laddered(chunks: DataFrame, lang: T.Lang, failure: Column, cfg: RenderConfig) -> DataFrame:
    """chunks with the column ladder: (chosen, ok, prior_failures, calls, coverage, duration, verdict) of each text's attempts.

    The attempts of a row are columns of it, so that nothing is exchanged or read twice.  They
    are scored in turn up to the first that is ok, since later ones have no part in the outcome.
    """
    numbers = range(1, cfg.synth.max_attempts + 1)
    rows = chunks.withColumn("_words", T.word_count(F.col("text")))
    for n in numbers:
        rows = rows.withColumn("n", F.lit(n)).withColumn(f"_failure{n}", failure)
    rows = rows.withColumns({f"_spoken{n}": L.spoken_by_fake(F.col("text"), F.col(f"_failure{n}")) for n in numbers})
    rows = rows.withColumns({f"_made{n}": L.cheap_checks(F.col("_words"), F.col(f"_spoken{n}"), F.col(f"_failure{n}"), cfg.synth) for n in numbers})
    heard = [F.when(F.col(f"_made{n}.cheap_ok"), L.fake_transcript(F.col(f"_spoken{n}"))) for n in numbers]
    rows = rows.withColumn("_heard", F.array(*heard)).withColumn("_raised", F.array(*(F.col(f"_made{n}.raised") for n in numbers)))
    rows = rows.withColumn("_best", S.ladder_scorer(cfg.synth.lexicon)(F.col("text"), F.col("_heard"), F.col("_raised"), T._lang(lang)))
    best = F.col("_best")
    verdict = S.verdict(best, F.get("_heard", best["chosen"] - 1))
    outcome = F.struct(
        best["chosen"].alias("chosen"),
        best["ok"].alias("ok"),
        F.when(best["chosen"].isNull(), 0).otherwise(best["chosen"] - 1).alias("prior_failures"),  # those before the chosen one failed
        F.when(best["ok"], best["chosen"]).otherwise(cfg.synth.max_attempts).alias("calls"),
        F.coalesce(best["score"], F.lit(0.0)).alias("coverage"),
        F.get(F.array(*(F.col(f"_made{n}.duration") for n in numbers)), best["chosen"] - 1).alias("duration"),
        F.when(best["chosen"].isNotNull(), verdict).alias("verdict"),
    )
    return rows.select(*chunks.columns, F.when(F.col("text").isNotNull(), outcome).alias("ladder"))


def rendered(chunks: DataFrame, lang: T.Lang = "en", failure: Column | None = None, cfg: RenderConfig = RenderConfig()) -> DataFrame:
    """The result of every chunk (script_id, chunk_idx, text): the ladder, then sentence by sentence.

    A failure column may use the columns of chunks, ``n`` and, for sentences, ``sentence_no``
    (-1 for whole chunks).  The chunks are read once.
    """
    fails = F.lit("none") if failure is None else failure
    keys = ["script_id", "chunk_idx"]
    nothing = F.array().cast("array<string>")
    chunks = chunks.repartition(*keys)  # a few long scripts shouldn't be a few tasks
    whole = L.outcome(laddered(chunks.withColumn("sentence_no", F.lit(-1)), lang, fails, cfg).select("*", "ladder.ok", "ladder.prior_failures"))
    verdict = F.col("ladder.verdict")
    result = whole.select(
        *chunks.columns,
        F.coalesce("ok", F.lit(False)).alias("ok"),
        F.coalesce("ladder.calls", F.lit(cfg.synth.max_attempts)).cast("bigint").alias("attempts"),
        F.coalesce("ladder.coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce("ladder.duration", F.lit(0.0)).alias("duration_s"),
        "recovered_by",
        F.coalesce(verdict["dropped_sentence"], F.col("text")).alias("dropped_sentence"),
        F.coalesce(verdict["transcript"], F.lit("")).alias("transcript"),
        F.coalesce(verdict["word_diagnostics"], nothing).alias("word_diagnostics"),
        F.lit(False).alias("reused"),
    )
    names = [*keys, "text", "ok", "attempts", "coverage", "duration_s", "recovered_by", "dropped_sentence", "transcript", "word_diagnostics", "reused"]
    if not cfg.synth.split_sentences:
        return result.select(*names)
    # a row for each sentence of what failed and one for each other chunk; the first row of a chunk holds its result
    cut = result.withColumn("_cut", F.when(~F.col("ok"), T.sentences(F.col("text")))).withColumn("_cut", F.when(F.size("_cut") >= 2, F.col("_cut")))
    held = F.struct(*(F.col(n) for n in names[2:]))
    cut = cut.select(*(c for c in chunks.columns if c != "text"), held.alias("_result"), F.size("_cut").alias("n_sentences"), "_cut")
    parts = cut.select(*(c for c in cut.columns if c not in ("_cut", "_result")), "_result", F.posexplode_outer("_cut").alias("sentence_no", "text"))
    parts = parts.withColumn("n_sentences", F.when(F.col("text").isNotNull(), F.col("n_sentences"))).withColumn("calls_before", F.when(F.col("text").isNotNull(), F.col("_result.attempts")))
    parts = parts.withColumn("_result", F.when(F.coalesce("sentence_no", F.lit(0)) == 0, F.col("_result")))
    tried = laddered(parts, lang, fails, cfg).select(*keys, "_result", "sentence_no", "n_sentences", "calls_before", "ladder.ok", "ladder.calls", "ladder.coverage", "ladder.duration")
    both = L.split_recovery(tried, keys, cfg=cfg.synth, carry="_result")
    own, won = F.col("_result"), F.coalesce(F.col("ok"), F.lit(False))
    return both.select(
        *keys,
        own["text"].alias("text"),
        (own["ok"] | won).alias("ok"),
        F.coalesce(F.col("calls"), own["attempts"]).alias("attempts"),
        F.when(won, F.col("coverage")).otherwise(own["coverage"]).alias("coverage"),
        F.when(won, F.col("duration")).otherwise(own["duration_s"]).alias("duration_s"),
        F.when(won, "sentence-split").otherwise(own["recovered_by"]).alias("recovered_by"),
        F.when(won, "").otherwise(own["dropped_sentence"]).alias("dropped_sentence"),
        F.when(won, "").otherwise(own["transcript"]).alias("transcript"),
        F.when(won, nothing).otherwise(own["word_diagnostics"]).alias("word_diagnostics"),
        own["reused"].alias("reused"),
    )


def keyed(chunks: DataFrame, lang: T.Lang, voice: Column, cfg: RenderConfig) -> DataFrame:
    spoken = T.spoken_form(F.col("text"), lang, list(cfg.synth.lexicon), cfg.synth.spell_acronyms)
    return chunks.withColumn("key", K.take_key(F.col("text"), spoken, voice, F.lit(ENGINE), F.lit(VERIFIER), cfg.synth))


def with_audio(results: DataFrame, rate: int = RATE, level: float = 0.1) -> DataFrame:
    """The simulated engine's waves of the results."""
    return results.withColumn("sample_rate", F.lit(rate)).withColumn("audio", F.when(F.col("duration_s") > 0, A.sine(F.col("duration_s"), F.lit(level), rate, F.col("chunk_idx"))).otherwise(F.array().cast("array<float>")))


def render_with_store(chunks: DataFrame, store: str, lang: T.Lang = "en", failure: Column | None = None, cfg: RenderConfig = RenderConfig(), voice: str = "default") -> DataFrame:
    """Results, where verified takes of the store are reused and new ones are added to it.

    Chunks with the same key are made once; the others reuse that take.
    """
    spark = chunks.sparkSession
    reroll = F.col("chunk_idx").isin(sorted(cfg.reroll)) if cfg.reroll else F.lit(False)
    mine = keyed(chunks, lang, F.lit(voice), cfg)
    hits, misses = K.lookup(mine, K.valid(K.read(spark, store), RATE).where(K.usable_under(cfg.synth)), reroll)
    fresh, copies = K.first_of_key(misses)
    names = ["script_id", "chunk_idx", "text", "key", "ok", "attempts", "coverage", "duration_s", "recovered_by", "dropped_sentence", "transcript", "word_diagnostics", "reused", "sample_rate", "audio"]
    made = with_audio(rendered(fresh, lang, failure, cfg).join(fresh.select("script_id", "chunk_idx", "key"), ["script_id", "chunk_idx"])).select(*names)
    made = made.checkpoint()  # read more than once; an engine must not be asked twice
    hits = hits.select(*(F.col(n).cast("bigint") if n == "attempts" else F.col(n) for n in names)).checkpoint()  # before the store grows
    K.try_put(made, store)
    again = copies.select("script_id", "chunk_idx", "text", "key").join(made.drop("script_id", "chunk_idx", "text", "attempts", "reused"), "key")
    again = again.withColumn("attempts", F.lit(0).cast("bigint")).withColumn("reused", F.col("ok")).select(*names)
    return made.unionByName(hits).unionByName(again)


def mix(results: DataFrame, segments: DataFrame, planned: DataFrame, rate: int = RATE, gain_db: Column | None = None) -> DataFrame:
    """(script_id, audio): chunks and gaps of each script in order."""
    gain = F.lit(0.0) if gain_db is None else gain_db
    pieces = results.where(F.size("audio") > 0).join(planned.select("script_id", "chunk_idx", "seg_no", "piece_no"), ["script_id", "chunk_idx"])
    pieces = A.chunk_chain(pieces.select("script_id", F.struct("seg_no", "piece_no").alias("at"), "audio", gain.alias("gain_db")), F.col("gain_db"), rate).drop("gain_db")
    gaps = segments.where("kind = 'gap'").select("script_id", F.struct(F.col("seg_no"), F.lit(0).alias("piece_no")).alias("at"), A.silence(F.col("gap_s"), rate).alias("audio"))
    return A.joined(pieces.unionByName(gaps), ["script_id"], "at")
