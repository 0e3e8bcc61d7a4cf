"""Evaluation queries: whether the scoring can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCEPT, AGREE = 0.90, 0.80
CORRUPTIONS = ("none", "drop", "duplicate", "truncate", "swap")


def crosscheck_bucket(primary: Column, second: Column, mutual: Column) -> Column:
    """Of a chunk that was rejected: whether recognisers blame the audio, or one another."""
    return F.when((primary >= ACCEPT) & (second >= ACCEPT), "both_fine").when((primary < ACCEPT) & (second < ACCEPT) & (mutual >= AGREE), "audio_wrong").otherwise("asr_unreliable")


def tally(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, percent) of all rows."""
    from pyspark.sql import Window

    counts = rows.groupBy(by).agg(F.count("*").alias("n"))  # a few rows, so that one window is no bottleneck
    return counts.select(by, "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2).alias("percent"))


def headtohead_bucket(first: Column, second: Column, mutual: Column, reached: Column) -> Column:
    a, b = first >= ACCEPT, second >= ACCEPT
    return F.when(~reached, "cheap_fail").when(a & b, "both_accept").when(a, "second_only_reject").when(b, "first_only_reject").when(mutual >= AGREE, "both_reject_agree").otherwise("both_reject_disagree")


def headtohead_totals(rows: DataFrame, scores: list[str], reached: str = "reached") -> DataFrame:
    """Rejections of each recogniser, of it alone and of any, over the rows that came to recognition."""
    kept = rows.where(F.col(reached))
    bad = {s: F.col(s) < ACCEPT for s in scores}
    any_bad = F.greatest(*(b.cast("int") for b in bad.values())) > 0
    count = lambda c, name: F.count_if(c).alias(name)
    out = [F.count("*").alias("rows"), count(any_bad, "any_rejects")]
    for s in scores:
        others = [~b for o, b in bad.items() if o != s]
        alone = bad[s]
        for o in others:
            alone = alone & o
        rescued = bad[s] & (F.greatest(*(F.col(o) for o in scores)) >= ACCEPT)
        out += [count(bad[s], f"{s}_rejects"), count(alone, f"{s}_alone"), count(rescued, f"{s}_rescued"), F.round(100 * F.try_divide(F.count_if(bad[s]), F.count("*")), 2).alias(f"{s}_percent")]
    return kept.agg(*out)


def disagreements(rows: DataFrame, bucket: str = "bucket") -> DataFrame:
    return rows.where(~F.col(bucket).isin("both_accept", "both_reject_agree", "cheap_fail"))


def acceptance_cases(chunks: DataFrame, kinds: tuple[str, ...] = CORRUPTIONS) -> DataFrame:
    """Trusted chunks of two sentences at least, times the corruptions."""
    return chunks.where("trusted and size(sentences) >= 2").withColumn("corruption", F.explode(F.array(*map(F.lit, kinds))))


def acceptance(cases: DataFrame) -> DataFrame:
    """(corruption, n, accepted, rate) with the row all for all corrupted cases; the rate of none is of rejections."""
    counted = cases.withColumn("family", F.when(F.col("corruption") == "none", "none").otherwise("all")).rollup("family", "corruption").agg(F.count("*").alias("n"), F.count_if("ok").alias("accepted")).where("family is not null and not (family = 'none' and corruption is null)")
    wrong = F.when(F.col("family") == "none", F.col("n") - F.col("accepted")).otherwise(F.col("accepted"))
    return counted.select(F.coalesce("corruption", F.lit("all")).alias("corruption"), "n", "accepted", F.round(wrong / F.col("n"), 4).alias("wrong_rate"))


def contour_aggregate(takes: DataFrame, categories: DataFrame) -> DataFrame:
    """Of each category that has takes, in the order of categories (category, ord, expected): verified, contours, match rate."""
    good = F.coalesce(F.col("verified"), F.lit(False))
    own = lambda c: F.count_if(good & (F.col("contour") == c)).alias(c)
    defined = F.count_if(good & (F.col("contour") != "undef"))
    found = takes.join(F.broadcast(categories), "category").groupBy("category", "ord").agg(
        F.count("*").alias("total"), F.count_if(good).alias("verified"), *map(own, ("rise", "flat", "fall", "undef")), F.round(F.try_divide(F.count_if(good & (F.col("contour") == F.col("expected")) & (F.col("contour") != "undef")), defined), 2).alias("match_rate")
    )
    return found


def case_verdict(matches: Column, defined: Column) -> Column:
    return F.when((defined > 0) & (matches == defined), "OK").when(matches > 0, "PARTIAL").otherwise("MISS")


def lexicon_tally(probes: DataFrame) -> DataFrame:
    """(verdict, n) of probes with raw_ok and respelled_ok."""
    from ..functions.text import probe_verdict

    return probes.groupBy(probe_verdict(F.col("raw_ok"), F.col("respelled_ok")).alias("verdict")).agg(F.count("*").alias("n"))


def resume_plan(cases: DataFrame, done: DataFrame, takes: int, case_columns: list[str]) -> DataFrame:
    """(case_id, take) still to be made: stored rows count only if their whole case is unchanged."""
    valid = done.join(cases.select(*case_columns), case_columns, "left_semi").select("case_id", "take")
    every = cases.select("case_id", F.explode(F.sequence(F.lit(1), F.lit(takes))).alias("take"))
    return every.join(valid, ["case_id", "take"], "left_anti")


def compatible(header: DataFrame, stored: DataFrame) -> bool:
    """Whether a stored run began with the same settings; nulls are equal."""
    return header.exceptAll(stored.select(*header.columns)).isEmpty() and stored.select(*header.columns).exceptAll(header).isEmpty()


def real_time_factor(runs: DataFrame) -> DataFrame:
    return runs.withColumn("rtf", F.round(F.try_divide(F.col("synth_s"), F.when(F.col("audio_s") != 0, F.col("audio_s"))), 4))


def scorecard(runs: DataFrame, engines: list[str], value: str = "rtf") -> DataFrame:
    """A row for each input, a column for each engine."""
    return runs.groupBy("input_file").pivot("engine", engines).agg(F.round(F.avg(value), 4))


def unverified(takes: DataFrame) -> DataFrame:
    return takes.where(~F.coalesce(F.col("verified"), F.lit(False)))
