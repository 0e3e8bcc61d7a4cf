"""Registered queries against their SQL, on rows that the driver's small tables hold too few of."""

import math
import time

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lectern.operators import audio as A
from lectern.operators import report as R
from lectern.operators import segment as G
from lectern.operators.config import MasterConfig


def _same(spark, tmp_path, name, table, rows, schema):
    """The rows of a query over a table of our own; they must be those of its SQL."""
    path = f"{tmp_path}/{table}.parquet"
    spark.createDataFrame(rows, schema).write.parquet(path)
    got = sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert got == sorted(con.execute(entry.oracle_sql()[name]).fetchall(), key=str)
    return got


def test_lexicon_tally_keeps_punctuation(spark, tmp_path):
    texts = ["one of. the", "one of the", "of\n the", "of\u00a0the", "the\u00e9", "sand", "and", "and_", "OF THE", "the", "", None, "x-and-y", "of\x0bthe"]
    got = _same(spark, tmp_path, "lexicon_tally", "conversations", [(k, 0, "user", t) for k, t in enumerate(texts)], "conv_id long, turn int, role string, text string")
    assert sum(n for _, n in got) == len(texts)


def test_summaries_round_as_printf_does(spark, tmp_path):
    chars = [4, 12, 1, 2, 15, 20, 8 * 16 + 4, 12 + 16 * 10**6, 4 + 16 * 10**9, 0]  # 0.25 s: 0.2, 0.75 s: 0.8
    rows = [(k, "Text.", "en", "web", n) for k, n in enumerate(chars)]
    _same(spark, tmp_path, "script_summaries", "documents", rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_one_place_is_that_of_the_exact_value(spark):
    r = np.random.default_rng(5)
    values = [0.25, 0.35, 0.75, 0.95, 99.95, 0.05, 0.15, 1e13 + 0.25, 123456789.25, 0.0, -0.25, -1.35, *np.round(r.random(300) * 100, 2).tolist(), *(r.random(300) * 1e6).tolist()]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", R.one_place(F.col("x")).alias("s")).collect()
    assert [r["s"] for r in got] == [f"{r['x']:.1f}" for r in got]


def test_soft_limit_is_that_of_the_sql_and_below_the_ceiling(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = [(k, r.uniform(-0.2, 0.2, 64).astype(np.float32).tolist(), 0) for k in range(400)]
    # levels whose limited value lies next to a tie of the four places
    near = [0.08 + 0.02 * np.arctanh((t + 0.00005 - 0.08) / 0.02) for t in np.arange(0.0801, 0.0999, 0.0001)]
    fine = [np.float32(x) + np.float32(k * 2.0**-27) for x in near for k in range(-8, 9)]
    rows += [(400 + k, [float(np.float32(x)) for x in part], 0) for k, part in enumerate(np.array_split(fine, 50))]
    _same(spark, tmp_path, "soft_limited", "embeddings", rows, "vec_id long, embedding array<float>, label int")
    loud = spark.createDataFrame([([0.0, 1.0, -5.0, 1e6],)], "a array<float>")
    for ceiling in (0.1, 0.9, 0.5):
        got = loud.select(A.limited(F.col("a"), ceiling).alias("a")).collect()[0]["a"]
        assert max(map(abs, got)) < ceiling


def test_waves_are_mastered_side_by_side():
    r, cfg = np.random.default_rng(8), MasterConfig(channels=1)
    waves = [(0.1 * r.standard_normal(n)).astype(np.float32) for n in [1920] * 400 + [0, 5, 1599, 1600, 3000, 4100]]
    began = time.time()
    made = {k: m for block in A.blocks([len(x) for x in waves]) for k, m in zip(block, A.mastered_block([waves[k] for k in block], 4000, cfg), strict=True)}
    assert time.time() - began < 20  # a wave at a time took over a minute
    for k in (0, 399, *range(400, 406)):
        y, lufs = A.mastered(waves[k], 4000, cfg)
        assert np.array_equal(y, made[k][0]) and (lufs == made[k][1] or math.isnan(lufs) and math.isnan(made[k][1]))
    assert all(sum(len(waves[k]) for k in b) <= 4000 or len(b) == 1 for b in A.blocks([len(x) for x in waves], 4000))


def test_filters_give_the_same_bits_narrow_or_wide():
    x = np.random.default_rng(2).standard_normal((300, 40))
    wide = A.biquad(x, *A.shelf(4000))
    assert all(np.array_equal(wide[:, k], A.biquad(x[:, k : k + 1], *A.shelf(4000))[:, 0]) for k in range(40))


def test_reports_are_few_files(spark, tmp_path):
    rows = [(k // 3, k % 3, "user", f"turn {k}\nof many" if k % 7 else "") for k in range(900)]
    _same(spark, tmp_path, "rejected_of_reports", "conversations", rows, "conv_id long, turn int, role string, text string")
    files = entry.queries()["rejected_of_reports"](spark, str(tmp_path)).inputFiles()
    assert len(files) <= 8  # was one for each of the 300 conversations


def test_chunks_of_a_batch_are_made_a_few_texts_at_once():
    texts = [f"Text {k} is short. So it is." if k % 5 else None for k in range(1000)]
    out = [*G.chunked([pd.Series(texts), pd.Series([], dtype=object)])]
    assert max(map(len, out)) <= G.AT_ONCE and len(out) >= 3
    assert [c for part in out for c in part] == [None if t is None else G.chunks(t) for t in texts]
