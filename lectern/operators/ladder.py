"""The simulated engine, its cheap checks, and the ladder over several attempts.

Attempts are rows (chunk, n); the ladder is one aggregation over them.  The failure
of a call is a column of the chunk and attempt, not a state of the engine, so
that any order of evaluation gives the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .config import SynthConfig

CFG = SynthConfig()
FPS = 25
FAILURES = ("none", "drop_sentence", "repeat", "truncate", "runaway", "raise")


def frame_cap(words: Column, fps: int = FPS, cfg: SynthConfig = CFG) -> Column:
    seconds = F.greatest(words / F.lit(cfg.words_per_second) * F.lit(cfg.headroom) + F.lit(cfg.headroom_s), F.lit(cfg.least_cap_s))
    return F.floor(seconds * F.lit(fps)).cast("int")


def shortest(words: Column, cfg: SynthConfig = CFG) -> Column:
    return words / F.lit(cfg.floor_wps)


def longest(words: Column, cfg: SynthConfig = CFG) -> Column:
    return F.lit(cfg.ceiling_s) + F.lit(cfg.ceiling_word_s) * words


def spoken_by_fake(text: Column, failure: Column) -> Column:
    """What the simulated engine says of a text under a failure."""
    cut, said = T.sentences(text), T.split_words(text)
    return (
        F.when((failure == "drop_sentence") & (F.size(cut) > 1), F.array_join(F.slice(cut, F.lit(1), F.size(cut) - 1), " "))
        .when((failure == "repeat") & (F.size(cut) > 0), F.array_join(F.array_repeat(F.get(cut, F.lit(0)), F.greatest(F.size(cut), F.lit(3))), " "))
        .when(failure == "truncate", F.array_join(F.slice(said, F.lit(1), F.greatest(F.floor(F.size(said) / 3).cast("int"), F.lit(1))), " "))
        .when(failure == "runaway", F.repeat(F.lit("babble "), 200))
        .when(failure == "raise", F.lit(None))
        .otherwise(text)
    )


def fake_duration(spoken: Column, failure: Column, cap: Column, fps: int = FPS, wps: float = 2.5) -> Column:
    """Seconds of speech, never more than the cap; a runaway goes on to the cap."""
    own, most = T.word_count(spoken) / F.lit(wps), cap / F.lit(float(fps))
    return F.when(failure == "raise", F.lit(None)).when(failure == "runaway", most).otherwise(F.least(own, most))


def fake_transcript(spoken: Column, orthography: list[tuple[str, str]] = (), perfect: bool = True) -> Column:
    """What the simulated recogniser writes down."""
    out = F.coalesce(spoken, F.lit(""))
    for said, written in orthography:
        out = F.regexp_replace(out, rf"(?U)\b\Q{said}\E\b", written.replace("\\", "\\\\").replace("$", "\\$"))
    if perfect:
        return out
    return F.regexp_replace(F.regexp_replace(out, r"(?U)\btwenty\b", "20"), r"(?U)\bne (\w)", "ne$1")


def attempts(chunks: DataFrame, failure: Column, cfg: SynthConfig = CFG, fps: int = FPS, honours_cap: bool = True) -> DataFrame:
    """The chunks times attempts from 1 on, with what the simulated engine made of each and the cheap checks.

    failure may use the columns of chunks and ``n``.
    """
    rows = chunks.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(cfg.max_attempts))))
    words = T.word_count(F.col("text"))
    rows = rows.withColumn("failure", failure).withColumn("words", words).withColumn("cap", frame_cap(F.col("words"), fps, cfg))
    rows = rows.withColumn("spoken", spoken_by_fake(F.col("text"), F.col("failure")))
    rows = rows.withColumn("duration", fake_duration(F.col("spoken"), F.col("failure"), F.col("cap"), fps, cfg.words_per_second))
    hit = (F.col("duration") >= F.col("cap") / F.lit(float(fps)) - F.lit(1e-6)) if honours_cap else F.lit(False)
    fine = F.col("duration").between(shortest(F.col("words"), cfg), longest(F.col("words"), cfg))
    rows = rows.withColumn("raised", F.col("failure") == "raise").withColumn("hit_cap", F.coalesce(hit, F.lit(False)))
    return rows.withColumn("cheap_ok", F.coalesce(fine & ~F.col("hit_cap"), F.lit(False)))


def cheap_checks(words: Column, spoken: Column, failure: Column, cfg: SynthConfig = CFG, fps: int = FPS) -> Column:
    """(duration, raised, cheap_ok) of one attempt, as in ``attempts``."""
    cap = frame_cap(words, fps, cfg)
    duration = fake_duration(spoken, failure, cap, fps, cfg.words_per_second)
    fine = duration.between(shortest(words, cfg), longest(words, cfg)) & (duration < cap / F.lit(float(fps)) - F.lit(1e-6))
    return F.struct(duration.alias("duration"), (failure == "raise").alias("raised"), F.coalesce(fine, F.lit(False)).alias("cheap_ok"))


def ladder(rows: DataFrame, keys: list[str], cfg: SynthConfig = CFG) -> DataFrame:
    """Which attempt each chunk ends with: (keys, chosen, ok, prior_failures, calls, coverage).

    rows: keys, n, raised, ok, cheap_ok, coverage, and delta and wants_rise where a
    rising end is preferred.  The first attempt that is ok (and rises, if it should)
    ends the ladder; else the first that is ok counts, else the best of the others.
    """
    has = set(rows.columns)
    delta = F.col("delta") if "delta" in has else F.lit(None).cast("double")
    wants = F.coalesce(F.col("wants_rise"), F.lit(False)) if "wants_rise" in has else F.lit(False)
    ok = F.coalesce(F.col("ok"), F.lit(False)) & ~F.col("raised")
    stops = ok & (~wants | delta.isNull() | (delta >= cfg.rise_semitones))
    rank = F.struct(F.col("cheap_ok").cast("int").alias("a"), F.coalesce(F.col("coverage"), F.lit(0.0)).alias("b"), (-F.col("n")).alias("c"))
    one = rows.groupBy(*keys).agg(
        F.min(F.when(stops, F.col("n"))).alias("stop_n"),
        F.min(F.when(ok, F.col("n"))).alias("first_ok"),
        F.max(F.when(~F.col("raised"), rank)).alias("best"),
        F.max("n").alias("most"),
        F.sort_array(F.collect_list(F.struct("n", (~ok).alias("bad"), F.coalesce("coverage", F.lit(0.0)).alias("coverage")))).alias("all"),  # max_attempts at most
    )
    chosen = F.coalesce("stop_n", "first_ok", -F.col("best.c"))
    limit = F.coalesce("first_ok", chosen)
    return one.withColumn("chosen", chosen).select(
        *keys,
        "chosen",
        F.col("first_ok").isNotNull().alias("ok"),
        F.size(F.filter("all", lambda x: x["bad"] & (x["n"] < limit))).alias("prior_failures"),
        F.coalesce("stop_n", "most").alias("calls"),
        F.coalesce(F.get(F.filter("all", lambda x: x["n"] == F.col("chosen")), F.lit(0))["coverage"], F.lit(0.0)).alias("coverage"),
    )


def outcome(selected: DataFrame) -> DataFrame:
    """``recovered_by`` is retry where a verified attempt came after failures."""
    return selected.withColumn("recovered_by", F.when(F.col("ok") & (F.col("prior_failures") > 0), "retry").otherwise(""))


def split_recovery(parts: DataFrame, keys: list[str], first_calls: str = "calls_before", cfg: SynthConfig = CFG, carry: str | None = None) -> DataFrame:
    """Failed chunks tried sentence by sentence: (keys, ok, coverage, calls, duration), and of the column to carry the value that isn't null.

    parts: keys, sentence_no from 0, n_sentences, ok, calls, coverage, duration and the
    calls that the whole chunk took.  Sentences after the first failure never happened.
    """
    failed = F.min(F.when(~F.col("ok"), F.col("sentence_no")))
    one = parts.groupBy(*keys).agg(
        failed.alias("failed_at"),
        F.max("n_sentences").alias("n_sentences"),
        F.max(first_calls).alias("before"),
        F.sort_array(F.collect_list(F.struct("sentence_no", "calls", "coverage", "duration"))).alias("all"),
        *([F.first(carry, ignorenulls=True).alias(carry)] if carry else []),
    )
    seen = F.filter("all", lambda x: F.col("failed_at").isNull() | (x["sentence_no"] <= F.col("failed_at")))
    one = one.withColumn("seen", seen)
    ok = F.col("failed_at").isNull() & (F.col("n_sentences") >= 2)
    total = lambda name, kind: F.aggregate("seen", F.lit(0).cast(kind), lambda acc, x: (acc + F.coalesce(x[name], F.lit(0).cast(kind))).cast(kind))
    return one.select(
        *keys,
        ok.alias("ok"),
        F.when(ok, F.array_min(F.transform("seen", lambda x: x["coverage"]))).otherwise(0.0).alias("coverage"),
        (F.col("before") + total("calls", "bigint")).alias("calls"),
        F.when(ok, total("duration", "double") + F.lit(cfg.sentence_gap_s) * (F.col("n_sentences") - 1)).alias("duration"),
        *([carry] if carry else []),
    )


def wants_rise(text: Column, lang: T.Lang, cfg: SynthConfig = CFG) -> Column:
    """The configured policy of rising ends; false without one."""
    if cfg.rising is None:
        return F.lit(False)
    if cfg.rising != "yes_no_question":
        raise ValueError(f"no such policy: {cfg.rising}")
    return F.coalesce(T.yes_no_question(text, lang), F.lit(False))


def cacheable(rows: DataFrame) -> DataFrame:
    """Results that the take store may keep: ok, made anew, at the store's sample rate."""
    return rows.where("ok and not reused and key is not null and sample_rate = store_rate")
