"""The corpus pipeline: language ID, line dedup, near duplicates, decontamination, packing.

Every stage takes all that its predecessor kept, as a written table, and its
decisions take effect in the table that it returns.  A table is removed as soon as
the next one is written.

Defined results: documents with a null text or without words go at the first stage;
those with a null id stay through all stages and are packed under the id null (nothing
can point at them, so that no stage removes them); rows that repeat an id are one
document to every decision, and go or stay together; of equal or similar documents
and lines the one of the lowest id stays; an empty table gives no windows; other
columns, clashing names included, are carried as they are up to packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontaminate, language_id, line_dedup, ngram_join, packing
from lectern.llm.common import drop_written, dropped, written

#: A document that loses lines to earlier ones and keeps less of its characters is a shred of a copy.
LEAST_SHARE = 0.2


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words, and those mostly in no language that is known, go."""
    names = docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    at = {name: f"c{names.index(name)}" for name in ("doc_id", "text", "lang")}
    found = language_id.identify(plain, id_col=at["doc_id"], text_col=at["text"], lang_col=at["lang"], keep=tuple(plain.columns))
    return found.where("accepted").select(*plain.columns).toDF(*names)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line resembles go, and documents of which they leave nothing, or less than ``LEAST_SHARE``."""
    return line_dedup.without_lines(docs, line_dedup.removed_lines(docs), LEAST_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the lowest id stays."""
    return dropped(docs, ngram_join.later_copies(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return dropped(docs, decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into training windows."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", languages),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", windows),
]

#: Language ID, decontamination and packing can't be said in SQL; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each on the table that the one before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last: DataFrame | None = None
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
        if last is not None:
            drop_written(last)
        last = docs
    return docs
