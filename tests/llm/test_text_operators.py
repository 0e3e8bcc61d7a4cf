"""Substring dedup, n-gram Jaccard join and line dedup against plain Python versions."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import line_dedup, ngram_join, rarity, substring_dedup

from .helpers import clashing, documents, rows, words

AWKWARD = [(None, "No id. No id at all. None here to be found. One two three four five."), (7, None), (8, ""), (9, "\n\n  \n"), (10, "?!.")]


def _corpus(seed=5, many=40):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    sentence = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randint(4, 9))).capitalize() + "."
    shared = [[sentence() for _ in range(4)] for _ in range(3)]
    out = []
    for k in range(many):
        body = [sentence() for _ in range(r.randint(2, 8))]
        if r.random() < 0.5:
            at = r.randint(0, len(body))
            body[at:at] = r.choice(shared)
        out.append((100 + k, r.choice([" ", "\n"]).join(body)))
    out += [(200, out[0][1]), (200, out[0][1]), (201, out[3][1].replace("w1 ", "w2 "))]
    return out + AWKWARD


def _cut(text, long):
    """Sentences as (words, characters), each up to the next one's first word."""
    found = list(re.finditer(r"[A-Za-z0-9\u0080-\U0010ffff]+", text))
    gaps = [text[m.end() : n.start()] for m, n in zip(found, found[1:], strict=False)]
    whole, at = [[]], 0
    for k in range(len(found)):
        whole[-1].append(k)
        if k < len(gaps) and re.search(r"\n|[.!?][ \t]", gaps[k]):
            whole.append([])
    begins = []
    for part in whole:
        for at, k in enumerate(part):
            inner = at and len(part) > long and (re.search("[,;:]", gaps[k - 1]) or len(found[k - 1][0].lower().encode()) % 8 == 7)
            if not at or inner:
                begins.append(k)
    out = []
    for k, (a, z) in enumerate(zip(begins, [*begins[1:], len(found)], strict=False)):
        to = found[z].start() if z < len(found) else len(text)
        out.append(([m[0].lower() for m in found[a:z]], text[found[a].start() if k else 0 : to]))
    return out


def _removed_sentences(table, span, least):
    spans, cuts = [], {}
    for d, t in {(d, t) for d, t in table if d is not None and t is not None}:
        s = cuts[d] = _cut(t, substring_dedup.LONG)
        for k in range(len(s)):
            for z in range(k + span, len(s) + 1):
                if sum(len(x[0]) for x in s[k:z]) >= least:
                    spans.append((tuple(w for x in s[k:z] for w in x[0]), d, k, z))
                    break
    first = {}
    for key, d, k, _ in spans:
        first[key] = min(first.get(key, (d, k)), (d, k))
    gone = {}
    for key, d, k, z in spans:
        if (d, k) > first[key]:
            gone.setdefault(d, set()).update(range(k, z))
    return sorted((d, tuple(sorted(v)), len(cuts[d]), "".join(x[1] for k, x in enumerate(cuts[d]) if k not in v)) for d, v in gone.items())


@pytest.mark.parametrize("least", [12, 40])
def test_substring_dedup_equals_brute_force(spark, least):
    table = [(d, t) for d, t in _corpus(many=60)]
    table += [(300, "Début: très été, " + "x" * 90_000 + " " + "one two three four five six seven eight nine ten. " * 400), (301, "é. " * 120)]
    found = substring_dedup.repeated_spans(clashing(documents(spark, table)), min_words=least)
    want = _removed_sentences(table, substring_dedup.SPAN, least)
    assert len(want) > (20 if least == 12 else 2)
    assert rows(found) == want


def test_substring_dedup_of_a_passage_within_sentences(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9)))
    prose = lambda n: " ".join(word() + r.choice(["", "", "", ",", "."]) for _ in range(n))
    passage = prose(70)
    table = [(k, f"{prose(60)} {passage} {prose(40)}") for k in range(6)] + [(k, prose(200)) for k in range(10, 16)]
    found = substring_dedup.repeated_spans(documents(spark, table)).collect()
    assert {x["doc_id"] for x in found} == {1, 2, 3, 4, 5}
    for x in found:
        text = dict(table)[x["doc_id"]]
        assert len(words(text)) - len(words(x["kept_text"])) in range(40, 71)


def test_substring_dedup_keeps_the_rest_in_order(spark):
    repeated = "One two three four five six. Seven eight nine ten eleven. Twelve and some more words here. "
    table = [(1, repeated), (2, f"Mine first. {repeated}Mine last."), (3, f"{repeated}{repeated}"), (4, repeated.upper())]
    found = {r["doc_id"]: r for r in substring_dedup.repeated_spans(documents(spark, table), min_words=15).collect()}
    assert set(found) == {2, 3, 4}
    assert found[2]["kept_text"] == "Mine first. Mine last."
    assert found[3]["kept_text"] == found[4]["kept_text"] == ""


def _jaccard_pairs(table, t, n):
    sets = {}
    for d, text in table:
        w = words(text)
        if d is not None and w:
            sets.setdefault(d, set()).add(frozenset(zip(*(w[k:] for k in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)]))
    first, out = {}, {}
    for d in sorted(sets):
        for s in sets[d]:
            if first.setdefault(s, d) != d:  # the first stands for equal ones
                out[first[s], d] = 1.0
    for (a, x), (b, y) in itertools.combinations(sorted((d, s) for s, d in first.items()), 2):
        if a != b and len(x & y) / len(x | y) >= t:
            out[a, b] = max(out.get((a, b), 0), len(x & y) / len(x | y))
    return out


def test_ngram_join_equals_brute_force(spark):
    r = random.Random(2)
    base = [" ".join(f"t{r.randint(0, 400)}" for _ in range(60)) for _ in range(6)]
    table = list(AWKWARD)
    for k in range(48):
        w = base[k % 6].split()
        for _ in range(r.randint(0, 8)):
            w[r.randrange(60)] = f"u{r.randint(0, 99)}"
        table.append((k, " ".join(w)))
    want = _jaccard_pairs(table, 0.45, 3)
    got = {(a, b): j for a, b, j in rows(ngram_join.near_pairs(clashing(documents(spark, table))))}
    assert len(want) > 50
    assert set(got) == set(want)
    assert all(abs(got[p] - want[p]) < 1e-5 for p in got)
    found = rows(ngram_join.linked(clashing(documents(spark, table))))
    assert found == _linked(table, 0.45, 3)


def _linked(table, t, n):
    """(doc_id, class, copies, links) by brute force, for ids that aren't repeated."""
    sets = {}
    for d, text in table:
        w = words(text)
        if d is not None and w:
            sets[d] = frozenset(zip(*(w[k:] for k in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)])
    near = lambda x, y: len(x & y) / len(x | y) >= t
    root = {d: d for d in sets}
    for _ in sets:
        new = {d: min(root[e] for e in sets if near(sets[d], sets[e])) for d in sets}
        if new == root:
            break
        root = new
    out = []
    for d, x in sets.items():
        copies, links = sum(y == x for y in sets.values()) - 1, len({y for y in sets.values() if y != x and near(x, y)})
        if copies or links:
            out.append((d, root[d], copies, links))
    return sorted(out, key=repr)


def test_shared_postings_whatever_the_batches():
    r = np.random.default_rng(3)
    for cut in (1, 2, 3, 7, 1000):
        key = np.sort((r.integers(-40, 40, 300) << 24) + r.integers(0, 3, 300) * 2)
        ids = r.integers(0, 5, 300)
        order = np.lexsort((ids, key))
        key, ids = key[order], ids[order]
        batches = [pa.RecordBatch.from_arrays([pa.array(key[a : a + cut]), pa.array(ids[a : a + cut]), pa.array(np.zeros(len(key[a : a + cut]), np.int8))], ["key", "id", "side"]) for a in range(0, 300, cut)]
        got = [tuple(x.values()) for b in ngram_join._shared(iter(batches)) for x in b.to_pylist()]
        rows = sorted(set(zip(key.tolist(), ids.tolist(), strict=True)))
        grams = [k >> 24 for k, _ in rows]
        assert sorted({(k, i) for _, k, i, _ in got}) == [x for x, g in zip(rows, grams, strict=True) if grams.count(g) > 1]
        homes = {}
        for home, k, _, _ in got:
            homes.setdefault(k >> 24, set()).add(home)
        assert all(len(x) == 1 for x in homes.values()) and len(set.union(*homes.values())) > 1


def test_popular_ngrams_are_split_into_tiles(spark):
    r = random.Random(6)
    base = [f"t{k}" for k in range(40)]
    table = [(k, " ".join(base[: r.randint(20, 40)] + [f"own{k}x{j}" for j in range(r.randint(0, 14))])) for k in range(70)] + [(k, f"alone{k} and more{k} words{k} here") for k in range(70, 90)]
    table += [(200 + k, table[0][1]) for k in range(40)]  # copies count once
    want = _linked(table, 0.45, 3)
    assert len({x[1] for x in want}) < 5 and sum(x[3] for x in want) > 2000
    assert rows(ngram_join.linked(documents(spark, table), heavy=12)) == want


def test_a_repeated_id_is_one_document(spark):
    one, two = "alpha beta gamma delta epsilon zeta", "red green blue white black gray"
    table = [(1, one), (1, one), (1, two), (2, two), (3, one + " eta"), (4, "none of these words at all")]
    assert rows(ngram_join.linked(documents(spark, table))) == [(1, 1, 1, 1), (2, 1, 1, 0), (3, 1, 0, 1)]


def test_ngram_join_of_equal_sets_pairs_with_the_first(spark):
    same = "alpha beta gamma delta epsilon zeta"
    table = [(3, same), (1, same.upper()), (2, same + "!"), (1, same), (5, None), (6, "")]
    assert rows(ngram_join.near_pairs(documents(spark, table))) == [(1, 2, 1.0), (1, 3, 1.0)]
    assert rows(ngram_join.later_copies(documents(spark, table))) == [(2, 1), (3, 1)]


def test_long_lists_make_tiles(spark):
    r = random.Random(3)
    base = [f"t{k}" for k in range(50)]
    table = []
    for k in range(330):
        w = list(base)
        w[r.randrange(50)] = f"u{k}"
        table.append((k, " ".join(w)))
    found = ngram_join.near_pairs(documents(spark, table)).count()
    assert found == 330 * 329 // 2
    assert ngram_join.later_copies(documents(spark, table)).select("kept").distinct().collect()[0][0] == 0


def _large_groups():
    """Groups of 120 and 15 copies, each with 4 to 8 words of its own."""
    r = random.Random(11)
    table = []
    for base, many in ((0, 120), (1, 15), (2, 2)):
        text = [f"g{base}w{k}" for k in range(90)]
        for k in range(many):
            w = list(text)
            for at in r.sample(range(90), r.randint(4, 8)):
                w[at] = f"own{base}x{k}x{at}"
            table.append((1000 * base + k, " ".join(w)))
    return table


def test_ngram_join_finds_all_pairs_of_large_groups(spark):
    table = _large_groups()
    want = _jaccard_pairs(table, 0.45, 3)
    got = {(a, b): j for a, b, j in rows(ngram_join.near_pairs(documents(spark, table)))}
    assert len(want) > 5000
    assert set(got) == set(want)
    assert all(abs(got[p] - want[p]) < 1e-5 for p in got)


def test_crowds_are_compared_in_blocks(spark):
    r = random.Random(12)
    table = _large_groups()
    mixed = [f"g0w{k}" for k in range(45)] + [f"g1w{k}" for k in range(45)]
    table += [(2000 + k, " ".join(w if r.random() < 0.9 else f"own{k}x{at}" for at, w in enumerate(mixed))) for k in range(12)]  # near both groups
    table += [(3000, table[3][1]), (3001, table[130][1])]
    want = _linked(table, 0.45, 3)
    assert sum(x[3] for x in want) > 11000
    assert rows(ngram_join.linked(documents(spark, table), crowd=8, block=25)) == want
    # the pairs of a crowd aren't written: a row for each set and pair of blocks at most
    *_, near, links = ngram_join.set_pairs(documents(spark, table), 0.45, 3, "doc_id", "text", crowd=8, block=25)
    assert 2 * near.count() + links.agg({"links": "sum"}).collect()[0][0] == sum(x[3] for x in want if x[0] < 3000)
    assert near.count() < 1000 and links.count() < 150 * 8


def test_intersections_and_candidates_of_crowds():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 400 if k % 2 else 90, 70)).astype(np.uint64) for k in range(60)]
    got = ngram_join._counted(sets[:35], sets[20:])
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sets[20:]] for x in sets[:35]]
    key = np.sort((r.integers(-6, 6, 400) << 24) + r.integers(20, 30, 400) * 2)
    ids, crowd = np.arange(400), r.choice([0, 1, 1, 1, 2], 400)
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(key[a:b]), pa.array(ids[a:b]), pa.array((crowd[a:b] << 2).astype(np.int32))], ["key", "id", "side"])
    want = {(x, y) for x, y in itertools.combinations(range(400), 2) if key[x] >> 24 == key[y] >> 24 and (key[x] & 0xFFFFFF) >= 0.9 * (key[y] & 0xFFFFFF) and (not crowd[x] or crowd[x] != crowd[y])}
    for cut in (1, 7, 1000):
        found = ngram_join._candidates((batch(a, min(400, a + cut)) for a in range(0, 400, cut)), 0.9)
        assert {(p["x"], p["y"]) for b in found for p in b.to_pylist()} == want


def test_later_copies_of_large_groups_leave_one(spark):
    table = _large_groups()
    kept = dict(rows(ngram_join.later_copies(documents(spark, table)).select("doc_id", "kept")))
    want, pairs = {}, list(_jaccard_pairs(table, 0.45, 3))
    for _ in table:  # until nothing changes
        for a, b in pairs:
            want[b] = want[a] = min(want.get(a, a), want.get(b, b))
    assert kept == {d: k for d, k in want.items() if d != k}
    assert [kept.get(d) for d in range(1, 120)] == [0] * 119


def _removed_lines(table, t, least):
    lines = {}
    for d, text in table:
        if d is not None and text is not None:
            for k, line in enumerate(text.split("\n")):
                s = frozenset(words(line))
                if len(s) >= least:
                    lines.setdefault((d, k), set()).add(s)
    flat = sorted((p, s) for p, ss in lines.items() for s in ss)
    out = {}
    for p, s in flat:
        for q, o in flat:
            if q < p and len(s & o) / len(s | o) >= t - 1e-12:
                out.setdefault(p, q)
                break
    return out


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(4)
    lines = [" ".join(f"w{r.randint(0, 50)}" for _ in range(r.randint(1, 25))) for _ in range(30)]
    table = list(AWKWARD)
    for k in range(40):
        own = []
        for _ in range(r.randint(1, 6)):
            w = r.choice(lines).split()
            if r.random() < 0.4:
                w[r.randrange(len(w))] = f"v{r.randint(0, 9)}"
            own.append(" ".join(w))
        table.append((k, "\n".join(own)))
    table += [(3, table[8][1]), (41, "x" * 200_000 + " " + "y " * 100)]
    got = {(d, k): (a, b) for d, k, a, b, _ in rows(line_dedup.removed_lines(clashing(documents(spark, table))))}
    assert got == _removed_lines(table, 0.9, 3)


def test_frequent_words_are_split_into_tiles(spark):
    r = random.Random(8)
    base = [f"w{k}" for k in range(24)]
    table = []
    for k in range(150):  # templates with one rare word each: all share their other words
        w = [x for x in base if r.random() < 0.97] + ([f"own{k}"] if k % 2 else [])
        table.append((k, " ".join(w) + f"\nalone{k} is line{k} number{k}"))
    want = _removed_lines(table, 0.9, 3)
    got = {(d, k): (a, b) for d, k, a, b, _ in rows(line_dedup.removed_lines(documents(spark, table), heavy=10))}
    assert got == want and len(want) > 60


def test_documents_without_lines(spark):
    table = [(1, "a b c d\nrest of one"), (2, "a b c d\nmore of the two"), (3, "A B C D"), (4, None), (None, "a b c d"), (5, "")]
    docs = documents(spark, table)
    left = rows(line_dedup.without_lines(docs, line_dedup.removed_lines(docs)).select("doc_id", "text", "n_chars"))
    assert (2, "more of the two", 15) in left
    assert 3 not in [r[0] for r in left]
    assert {r[0] for r in left} == {1, 2, 4, 5, None}
    assert line_dedup.without_lines(docs, line_dedup.removed_lines(docs)).columns == docs.columns


@pytest.mark.parametrize("operator", [substring_dedup.repeated_spans, ngram_join.near_pairs, ngram_join.linked, ngram_join.later_copies, line_dedup.removed_lines])
def test_empty_table(spark, operator):
    assert operator(documents(spark, [])).count() == 0
    assert operator(documents(spark, AWKWARD)).count() == 0


def test_counts_are_sent_narrow_and_whole():
    r = np.random.default_rng(9)
    for most, width in ((1, 1), (255, 1), (256, 2), (65_536, 4), (1 << 40, 8)):
        counts = r.integers(0, most + 1, 1 << 12).astype(np.uint64)
        counts[7] = most
        sent = rarity.narrow(counts)
        assert rarity.wide(sent, len(counts)).tolist() == counts.tolist()
        assert len(sent) <= width * len(counts) + 64


def test_a_sketch_of_any_size_counts_all_tokens(spark):
    values = np.unique(np.random.default_rng(4).integers(0, 1 << 62, 3000))
    table = spark.createDataFrame([(int(v) << 1,) for k, v in enumerate(values) for _ in range(1 + k % 5)], "v bigint").repartition(3)

    def tokens(batch):
        yield batch.column(0).to_numpy().view(np.uint64)

    for bits in (17, 22, 24):
        total = np.bincount((values.astype(np.uint64) << np.uint64(1) >> np.uint64(64 - bits)).astype(np.int64), weights=1 + np.arange(len(values)) % 5, minlength=1 << bits)
        want = np.where(total > 0, 1 + np.floor(np.log2(np.maximum(total, 1))), 0)
        assert (rarity.sketch(table, tokens, bits) == want).all()


def test_the_sketch_of_ngrams_grows_with_the_table(spark, monkeypatch):
    for tokens, bits in ((0, 22), (1 << 20, 22), (40 << 22, 22), ((40 << 22) + 1, 23), (40 << 24, 24), (1 << 40, 26)):
        assert rarity.bits_for(tokens) == bits
    table = _corpus(6, 60)
    want = rows(ngram_join.linked(documents(spark, table)))
    seen, plain = [], rarity.sketch

    def seeing(*args):
        seen.append(plain(*args))
        return seen[-1]

    monkeypatch.setattr(ngram_join, "sketch", seeing)
    monkeypatch.setattr(rarity, "BITS", 16)
    monkeypatch.setattr(rarity, "PER_BUCKET", 1 / 256)
    octets = sum(len(t.encode()) for d, t in table + AWKWARD if d is not None and t)
    assert rows(ngram_join.linked(documents(spark, table + AWKWARD))) == want and want
    assert len(seen[0]) == 1 << rarity.bits_for(octets / ngram_join.GRAM_BYTES) > 1 << 16


def test_pairs_of_a_batch_are_verified_together():
    r = np.random.default_rng(10)
    sets = [[np.unique(r.integers((1 << 50) - 30, 1 << 50, r.integers(1, 25))) for _ in range(17_000)] for _ in range(2)]
    x, y = (pa.array([s.tobytes() for s in part], pa.binary()) for part in sets)
    want = [(len(np.intersect1d(a, b)), len(a) + len(b)) for a, b in zip(*sets, strict=True)]
    assert list(zip(*(c.tolist() for c in line_dedup._common(x, y)), strict=True)) == want
    assert list(zip(*(c.tolist() for c in line_dedup._common(x[5:90], y[5:90])), strict=True)) == want[5:90]
    assert [len(c) for c in line_dedup._common(x[:0], y[:0])] == [0, 0]
