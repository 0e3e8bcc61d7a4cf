"""What came of a rendering: counts, failures, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class QuarantinedError(RuntimeError):
    """Chunks failed, and nothing was written."""


def report(results: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: chunks, failed, recovered, reused, seconds, clean."""
    return results.groupBy(*keys).agg(
        F.count("*").alias("chunks"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.count_if(F.col("recovered_by") != "").alias("recovered"),
        F.count_if("reused").alias("reused"),
        F.coalesce(F.sum("duration_s"), F.lit(0.0)).alias("duration_s"),
        (F.count_if(~F.col("ok")) == 0).alias("clean"),
    )


def failures(results: DataFrame, limit: int = 10) -> DataFrame:
    """The first failures in order of the script."""
    return results.where("not ok").orderBy("script_id", "chunk_idx").limit(limit).select("script_id", "chunk_idx", F.round("coverage", 4).alias("coverage"), "dropped_sentence", F.substring("text", 1, 60).alias("text"))


def one_place(x: Column) -> Column:
    """A number to one place as C prints it: of its exact value, ties to even. Java's format rounds the shortest decimal, ties up."""
    whole = F.floor(F.abs(x))
    eight, two = (F.abs(x) - whole) * 8, (F.abs(x) - whole) * 2
    ten = eight + two
    lost = two - (ten - eight)  # what the sum lost by rounding, exactly
    tenths = F.floor(ten)
    over = ten - tenths - F.lit(0.5)
    up = (over > 0) | ((over == 0) & ((lost > 0) | ((lost == 0) & (tenths % 2 == 1))))
    total = whole * 10 + tenths + up.cast("bigint")
    shown = F.concat(F.when(x < 0, "-").otherwise(""), F.floor(total / 10).cast("string"), F.lit("."), (total % 10).cast("string"))
    return F.when(F.abs(x) < 1e14, shown).otherwise(F.format_string("%.1f", x))


def summary(reports: DataFrame) -> DataFrame:
    return reports.select("*", F.format_string("%d chunks, %s s; %d recovered, %d reused, %d failed", "chunks", one_place(F.col("duration_s")), "recovered", "reused", "failed").alias("summary"))


def progress(results: DataFrame) -> DataFrame:
    """The line of each chunk as it was made."""
    from pyspark.sql import Window

    total = F.count("*").over(Window.partitionBy("script_id"))
    return results.select("script_id", "chunk_idx", F.format_string("[%d/%d] %s", F.col("chunk_idx") + 1, total, F.when(F.col("ok"), "ok").otherwise("FAILED")).alias("line"))


def quarantine(results: DataFrame, limit: int = 10) -> None:
    """Raises if a chunk failed, with the first failures."""
    bad = failures(results, limit).collect()  # limit rows
    if bad:
        lines = "\n".join(f"  {r['script_id']} chunk {r['chunk_idx'] + 1}: {r['coverage']:.2f} {r['dropped_sentence']} | {r['text']}" for r in bad)
        raise QuarantinedError(f"{results.where('not ok').count()} chunks failed:\n{lines}")
