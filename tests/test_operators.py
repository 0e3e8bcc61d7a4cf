"""Segmentation, ladder, take store, audio and whole renderings on small tables."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import audio as A
from lectern.operators import ladder as L
from lectern.operators import report as R
from lectern.operators import segment as G
from lectern.operators.config import MasterConfig, RenderConfig
from lectern.plans import render as P
from lectern.sources import readers, writers


def _texts():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 9)))
    return [" ".join(" ".join(word() for _ in range(r.randint(1, 40))).capitalize() + r.choice(".!?") for _ in range(r.randint(1, 12))) for _ in range(80)]


@pytest.mark.parametrize("limit", [80, 150, 250, 400])
def test_chunks_lose_nothing_and_keep_to_the_limit(limit):
    for text in _texts():
        out = G.chunks(text, limit)
        assert " ".join(out).split() == text.split()
        assert all(c == c.strip() and len(c) <= limit + 2 for c in out)


def test_native_fold_equals_the_udf(spark):
    rows = [(k, t) for k, t in enumerate(_texts())]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("s", T.sentences(F.col("text"))).where("array_max(transform(s, x -> length(x))) <= 250")
    got = df.select("id", G.packed_sentences(F.col("s")).alias("a"), G.chunk_text(F.col("text")).alias("b")).collect()
    assert len(got) > 30 and all(r["a"] == r["b"] for r in got)


def test_closing_quotes_end_a_sentence(spark):
    got = spark.createDataFrame([('He said "go." Then left.',)], "text string").select(T.sentences(F.col("text")).alias("s")).collect()
    assert got[0]["s"] == ['He said "go.', "Then left."]


def test_sql_functions(spark):
    G.register(spark)
    assert [r["chunk"] for r in spark.sql("SELECT * FROM chunk_text('One two three four. Five six seven eight.', 20)").collect()] == ["One two three four.", "Five six seven", "eight."]
    assert spark.sql("SELECT kind FROM script_segments('A b.\n\nC d.', 2.0)").count() == 3


def _eager(rows, wants, most=3):
    """The ladder as a loop."""
    first = best = None
    bad = calls = 0
    for n, (raised, ok, cheap, coverage, delta) in enumerate(rows, 1):
        calls = n
        if raised:
            bad += first is None
            continue
        if ok:
            first = first or n
            if not wants or delta is None or delta >= 1.5:
                return n, True, bad, calls
        elif first is None:
            bad += 1
            if best is None or (cheap, coverage) > best[1]:
                best = (n, (cheap, coverage))
    if first:
        return first, True, bad, calls
    return (best[0] if best else None), False, None, calls


def test_ladder_equals_the_loop(spark):
    r = random.Random(9)
    table, want = [], {}
    for k in range(400):
        wants = r.random() < 0.5
        rows = []
        for n in range(1, 4):
            raised, cheap = r.random() < 0.2, r.random() < 0.7
            ok = cheap and not raised and r.random() < 0.5
            rows.append((raised, ok, cheap, round(r.random(), 1) if cheap else 0.0, r.choice([None, 0.0, 2.0])))
            table.append((k, n, *rows[-1], wants))
        want[k] = _eager(rows, wants)
    df = spark.createDataFrame(table, "k int, n int, raised boolean, ok boolean, cheap_ok boolean, coverage double, delta double, wants_rise boolean")
    for row in L.ladder(df, ["k"]).collect():
        chosen, ok, bad, calls = want[row["k"]]
        assert (row["chosen"], row["ok"], row["calls"]) == (chosen, ok, calls)
        if ok:
            assert row["prior_failures"] == bad


SCRIPT = "The first lamp stands by the door. It burns all night for us."


def _chunks(spark, texts=(SCRIPT,)):
    return spark.createDataFrame([("s", k, t) for k, t in enumerate(texts)], "script_id string, chunk_idx int, text string")


@pytest.mark.parametrize(
    ("failure", "ok", "attempts", "recovered"),
    [("'none'", True, 1, ""), ("if(n = 1, 'runaway', 'none')", True, 2, "retry"), ("if(sentence_no < 0, 'truncate', 'none')", True, 5, "sentence-split"), ("'raise'", False, 6, ""), ("if(n < 3, 'drop_sentence', 'none')", True, 3, "retry")],
)
def test_render_recovers(spark, failure, ok, attempts, recovered):
    got = P.rendered(_chunks(spark), "en", F.expr(failure)).collect()
    assert len(got) == 1
    assert (got[0]["ok"], got[0]["attempts"], got[0]["recovered_by"]) == (ok, attempts, recovered)


def test_render_reads_its_chunks_once(spark):
    texts = [SCRIPT, "Rest now.", "", SCRIPT + " It goes out at dawn."]
    rows = P.rendered(_chunks(spark, texts), "en", F.expr("if(sentence_no < 0, if(chunk_idx = 3, 'raise', 'truncate'), if(sentence_no = 2, 'raise', 'none'))"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and len(re.findall(r"\bScan\b", plan)) == 1 and plan.count("ArrowEvalPython") <= 2
    got = {r["chunk_idx"]: (r["ok"], r["attempts"], r["recovered_by"], r["dropped_sentence"]) for r in rows.collect()}
    assert got[0] == (True, 5, "sentence-split", "") and got[3] == (False, 3 + 1 + 1 + 3, "", texts[3]) and len(got) == 4


def test_store_is_reused_and_an_edit_costs_one_chunk(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "c"))
    store = str(tmp_path / "takes")
    texts = [SCRIPT, "Another chunk is read aloud here.", SCRIPT]
    one = {r["chunk_idx"]: r for r in P.render_with_store(_chunks(spark, texts), store).collect()}
    assert [one[k]["reused"] for k in range(3)] == [False, False, True] and one[2]["attempts"] == 0
    two = P.render_with_store(_chunks(spark, texts), store).collect()
    assert all(r["reused"] and r["ok"] for r in two)
    texts[1] = "Another chunk is read aloud there."
    three = P.render_with_store(_chunks(spark, texts), store).collect()
    assert sorted(r["chunk_idx"] for r in three if not r["reused"]) == [1]
    four = P.render_with_store(_chunks(spark, texts), store, cfg=RenderConfig(reroll=frozenset([1]))).collect()
    assert sorted(r["chunk_idx"] for r in four if not r["reused"]) == [1]


def test_quarantine(spark):
    results = P.rendered(_chunks(spark), "en", F.lit("raise"))
    with pytest.raises(R.QuarantinedError, match="1 chunks failed"):
        R.quarantine(results)
    assert R.report(results, ["script_id"]).collect()[0]["clean"] is False


def test_audio_steps(spark):
    rate = 8000
    t = np.arange(rate) / rate
    x = np.concatenate([np.zeros(2000), 0.3 * np.sin(2 * np.pi * 200 * t), np.zeros(3000)]).astype(np.float32)
    assert abs(len(A.trimmed(x, rate)) - rate) < 0.13 * rate  # guard and frame at both ends
    tone = (0.3 * np.sin(2 * np.pi * 440 * np.arange(48000) / 48000)).astype(np.float32)
    low = A.resampled(tone, 48000, 16000)
    assert len(low) == 16000 and abs(np.abs(low[2000:-2000]).max() - 0.3) < 0.01
    up = A.pitch(A.glide(rate, 200, 300, 2.0, 0.6), rate)
    assert 12 * math.log2(np.median(up[-20:]) / np.median(up[:40])) > 1.5
    y, lufs = A.mastered(np.tile(tone, 2), 48000, MasterConfig())
    assert y.shape == (96000, 2) and abs(lufs + 16) < 0.5
    short, none = A.mastered(tone[:100], 48000, MasterConfig(channels=1))
    assert math.isnan(none) and np.abs(short).max() < 1
    full = A.loudness(np.sin(2 * np.pi * 997 * np.arange(96000) / 48000)[:, None], 48000)
    assert abs(full + 3.01) < 0.1
    df = spark.createDataFrame([(x.tolist(),)], "audio array<float>")
    got = df.select(A.limited(A.gained(F.col("audio"), F.lit(12.0)), 0.9).alias("a")).collect()[0]["a"]
    assert max(map(abs, got)) < 0.9
    tones = spark.createDataFrame([("up", A.glide(rate, 200, 300, 2.0, 0.6).tolist()), ("none", [0.0] * 100)], "id string, audio array<float>")
    found = {r["id"]: r for r in A.with_contour(tones, rate).collect()}
    assert found["up"]["contour"] == "rise" and found["none"]["contour"] == "undef" and found["none"]["voiced_frames"] == 0


def test_wav_round_trip_and_scripts(spark, tmp_path):
    x = np.linspace(-0.5, 0.5, 400, dtype=np.float32)
    writers.write_wavs(spark.createDataFrame([("a", x.tolist())], "script_id string, audio array<float>"), str(tmp_path / "w"), 8000)
    (tmp_path / "w" / "bad.wav").write_bytes(b"no sound")
    got = {r["path"].rsplit("/", 1)[1]: r for r in readers.wavs(spark, str(tmp_path / "w")).collect()}
    assert got["a.wav"]["sample_rate"] == 8000 and np.abs(np.array(got["a.wav"]["audio"]) - x).max() < 1e-4
    assert got["bad.wav"]["audio"] is None
    (tmp_path / "en_s.txt").write_text("# Title\nFirst  block\nhere.\n\n\n[PAUSE 2]\n\nLast.")
    kinds = [(r["seg_no"], r["kind"]) for r in readers.scripts(spark, str(tmp_path / "en_s.txt"), 0.5).orderBy("seg_no").collect()]
    assert kinds == [(0, "text"), (1, "gap"), (2, "text"), (3, "gap"), (4, "text")]
    assert readers.spoken_lines(spark, str(tmp_path / "en_s.txt")).collect()[0]["text"] == "First  block here. Last."
    rows, long = readers.inputs(spark, str(tmp_path), "en_", 5)
    assert rows.count() == 0 and long == 1


def test_reroll_list():
    assert G.parse_reroll("1, 4") == frozenset([0, 3])
    for bad in ("", "0", "a"):
        with pytest.raises(ValueError):
            G.parse_reroll(bad)
