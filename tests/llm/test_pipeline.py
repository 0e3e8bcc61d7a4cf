"""The pipeline on a small corpus whose result is known stage by stage."""

import random

import pytest

import corpus_pipeline
from lectern.llm import decontaminate, language_id, line_dedup, ngram_join, packing

from .helpers import clashing, documents, words
from .test_other_operators import _pack_by_force, _smith_waterman, _texts
from .test_text_operators import _linked, _removed_lines


@pytest.fixture
def corpus(spark, tmp_path):
    rows, take = _texts(3, 30)
    r = random.Random(8)
    unique = lambda n: " ".join(f"{r.choice('abcdefgh')}{r.choice('aeiou')}word{r.randint(0, 10**6)}" for _ in range(n))
    item = "alpha river seldom carries seventeen yellow lanterns beyond broken harbour walls"
    rows = [(d, f"{t} {t.split()[0]}{d}\n{' '.join(w + str(d) for w in t.split()[:9])}", lang) for d, t, lang in rows]
    rows += [(900, "the fox and the dog and the forest\n" + item, "en"), (901, rows[0][1], "en"), (902, None, "en"), (903, "", "de"), (904, "!!!", "de")]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), rows


def test_stages_are_the_operators_one_after_the_other(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    ids = lambda df: {x["doc_id"] for x in df.select("doc_id").collect()}
    by_name = dict(corpus_pipeline.STAGES)

    kept = by_name["language ID"](spark, docs, folder)
    assert kept.columns == columns
    assert ids(docs) - ids(kept) == {x["doc_id"] for x in language_id.identify(docs).where("not accepted").collect()} >= {902, 903, 904}
    kept = kept.checkpoint()

    lined = by_name["line dedup"](spark, kept, folder).checkpoint()
    gone = {}
    for x in line_dedup.removed_lines(kept).collect():
        gone.setdefault(x["doc_id"], set()).add(x["line_no"])
    want = {}
    for x in kept.collect():
        lines = [s for k, s in enumerate(x["text"].split("\n")) if k not in gone.get(x["doc_id"], ())]
        if any(s.strip() for s in lines) and len("\n".join(lines)) >= corpus_pipeline.LEAST_SHARE * len(x["text"]):
            want[x["doc_id"]] = "\n".join(lines)
    assert {x["doc_id"]: x["text"] for x in lined.collect()} == want and 901 not in want
    assert all(x["n_chars"] == len(x["text"]) for x in lined.collect())

    single = by_name["n-gram Jaccard join"](spark, lined, folder).checkpoint()
    assert ids(single) == ids(lined) - {x["doc_id"] for x in ngram_join.later_copies(lined).collect()}

    clean = by_name["benchmark decontamination"](spark, single, folder).checkpoint()
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert ids(single) - ids(clean) == {x["doc_id"] for x in decontaminate.contaminated(single, bench).collect()} == {900}

    whole = sorted(map(str, packing.pack(clean).collect()))
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == whole


def _plain_pipeline(rows, items):
    """Windows as lists of (document, first, length), by loops over all lines, pairs and places."""
    docs = [(d, t) for d, t, _ in rows if words(t)]  # all of them are in known languages
    gone, kept = _removed_lines(docs, line_dedup.THRESHOLD, line_dedup.MIN_TOKENS), []
    for d, t in docs:
        left = [s for k, s in enumerate(t.split("\n")) if (d, k) not in gone]
        if d is not None and len(left) < len(t.split("\n")):
            if not any(s.strip() for s in left) or len("\n".join(left)) < corpus_pipeline.LEAST_SHARE * len(t):
                continue
            t = "\n".join(left)
        kept.append((d, t))
    root = {d: c for d, c, _, _ in _linked(kept, ngram_join.THRESHOLD, ngram_join.NGRAM)}
    kept = [(d, t) for d, t in kept if d is None or root.get(d, d) == d]
    grams = lambda t: set(zip(words(t), words(t)[1:], words(t)[2:], strict=False))
    leak = lambda t: any(grams(t) & grams(x) and _smith_waterman(words(x), words(t)) >= decontaminate.THRESHOLD * 2 * len(words(x)) for x in items)
    kept = [(d, t) for d, t in kept if d is None or not leak(t)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))
    return _pack_by_force([(d, len(t.encode())) for d, t in order], packing.CAPACITY, packing.OPEN_WINDOWS)


def test_the_whole_equals_a_plain_version(spark, tmp_path):
    rows, take = _texts(5, 25)
    r = random.Random(2)
    item = "nine grey herons waited beside seventeen frozen millponds until somebody opened every sluice"
    rows = [(d, f"{t} {' '.join(f'own{d}x{k}' for k in range(6))}\nline {d} has its {t.split()[0]}{d} words", lang) for d, t, lang in rows]
    base = take("the quick brown fox jumps over lazy dogs near rivers", 60).split()
    for k in range(12):  # near copies in one line, each with words of its own
        w = list(base)
        for at in r.sample(range(60), 3):
            w[at] = f"copy{k}of{at}"
        rows.append((500 + k, " ".join(w), "en"))
    rows += [(700 + k, f"the dog and the forest with friends {k}\n" + " ".join(item.split()[: 12 - k] + [f"the{k}"] * k), "en") for k in range(4)]
    rows += [(900, rows[0][1], "en"), (901, None, "en"), (902, "", None), (903, "?!", "de"), (None, "the fox and the dog follow them", "en"), (904, "the dog " * 9000, "en"), (905, rows[1][1] + "\n" + rows[2][1] + "\nand the dog", "en")]
    clashing(documents(spark, rows)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = sorted(([*zip(x["doc_ids"], x["firsts"], x["lengths"], strict=True)] for x in found), key=repr)
    want = sorted(_plain_pipeline(rows, [item]), key=repr)
    ids = {d for w in want for d, _, _ in w}
    assert ids >= {500, None, 904} and not ids & {501, 511, 700, 900, 901, 903}
    assert got == want


def test_an_empty_table_gives_no_windows(spark, tmp_path):
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "some words of an item")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
