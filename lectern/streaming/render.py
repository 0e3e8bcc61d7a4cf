"""Scripts that arrive as files, rendered as they come; a restart goes on where it stopped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.config import RenderConfig
from ..operators.segment import parse_script, plan_chunks
from ..plans.render import render_with_store


def render_stream(spark: SparkSession, folder: str, store: str, out: str, checkpoint: str, lang: str = "en", failure: Column | None = None, cfg: RenderConfig = RenderConfig(), gap_s: float = 1.0) -> StreamingQuery:
    """Each batch of script files goes through the take store; a batch that is repeated overwrites its own results."""
    files = spark.readStream.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("script_id"), F.col("value").alias("text"))

    def batch(scripts: DataFrame, number: int) -> None:
        chunks = plan_chunks(parse_script(scripts, gap_s), cfg.max_chars).select("script_id", "chunk_idx", "text")
        render_with_store(chunks, store, lang, failure, cfg).drop("audio").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def failure_rate(results: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Windowed share of failed results of a stream with columns ts and ok; what comes later than ``late`` is left out."""
    counted = results.withWatermark("ts", late).groupBy(F.window("ts", window)).agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("failed"))
    return counted.select(F.col("window.start").alias("window_start"), "n", "failed", F.round(F.col("failed") / F.col("n"), 4).alias("rate"))
