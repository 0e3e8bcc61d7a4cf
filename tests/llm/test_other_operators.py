"""The remaining operators against plain Python versions and held-out rows."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from lectern.llm import decontaminate, html_text, language_id, packing, secrets, top_k, toxicity

from .helpers import clashing, documents, rows, words


# toxicity -----------------------------------------------------------------


def _ruzzo_tompa_by_force(scores):
    """Maximal segments by recursion: the best one, then left and right of it."""
    if not scores or max(scores) <= 0:
        return []
    total = [0, *itertools.accumulate(scores)]
    best = max(((total[b] - total[a], -(b - a), -a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), key=lambda x: x[:3])
    a, b = -best[2], best[3]
    left, right = _ruzzo_tompa_by_force(scores[:a]), _ruzzo_tompa_by_force(scores[b:])
    return [*left, (a, b, best[0]), *((x + b, y + b, s) for x, y, s in right)]


def test_segments_are_the_maximal_ones():
    r = random.Random(1)
    for _ in range(300):
        scores = [r.randint(-5, 5) + r.random() / 100 for _ in range(r.randint(0, 14))]
        got = toxicity.segments(np.array(scores))
        want = _ruzzo_tompa_by_force(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]


def test_sparse_segments_equal_the_dense():
    r = random.Random(2)
    for _ in range(100):
        n = r.randint(3, 60)
        at = np.array(sorted(r.sample(range(n), r.randint(1, 3))))
        gains = np.array([r.random() * 4 + 0.1 for _ in at])
        dense = np.full(n, -0.2)
        dense[at] = gains
        assert [x[:2] for x in toxicity.sparse_segments(at, gains, 0.2)] == [x[:2] for x in toxicity.segments(dense)]


def _labelled(spark, many=400, seed=3):
    r = random.Random(seed)
    plain, bad = [f"w{k}" for k in range(300)], ["vile", "scum", "idiot"]
    docs, labels = [], []
    for k in range(many):
        w = [r.choice(plain) for _ in range(r.randint(30, 120))]
        toxic = k % 8 == 0
        if toxic:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(bad))
        docs.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    return docs, labels


def test_toxic_documents_held_out(spark):
    docs, labels = _labelled(spark)
    known = spark.createDataFrame(labels[:200] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    awkward = [(None, "vile scum"), (900, None), (901, ""), (902, "idiot " * 3000)]
    found = toxicity.toxic_passages(clashing(documents(spark, docs + awkward)), known)
    ids = {r["doc_id"] for r in found.collect()}
    held = {d for d, t in labels[200:] if t}
    assert len(ids & held) >= 0.9 * len(held)
    assert 902 in ids and not ids & {None, 900, 901}
    clean = {d for d, t in labels if not t}
    assert len(ids & clean) <= 0.02 * len(clean)


def test_toxicity_without_labels(spark):
    docs = documents(spark, [(1, "a b c")])
    nothing = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.toxic_passages(docs, nothing).count() == 0
    assert toxicity.toxic_passages(documents(spark, []), nothing).count() == 0


# decontamination ----------------------------------------------------------


def _smith_waterman(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best


def test_leaks_equal_brute_force(spark):
    r = random.Random(7)
    vocabulary = [f"w{k}" for k in range(800)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(8, 40)))) for k in range(12)]
    docs = []
    for k in range(60):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 150))]
        if k % 3 == 0:
            own = r.choice(items)[1].split()
            for _ in range(r.randint(0, len(own) // 3)):
                own[r.randrange(len(own))] = "edited"
            at = r.randint(0, len(w))
            w[at:at] = own
        docs.append((k, " ".join(w)))
    for k in range(60, 80):  # copies with many words put between, and very long documents
        own = r.choice(items)[1].split()
        w = [r.choice(vocabulary) for _ in range(r.choice([20, 3000]))]
        at = r.randint(0, len(w))
        cut = r.randint(3, len(own) - 3)
        w[at:at] = own[:cut] + [f"between{j}" for j in range(r.randint(0, len(own)))] + own[cut:]
        docs.append((k, " ".join(w)))
    # seeds: 3-grams of an item in 10 documents at most, and its 8 rarest (the first of equal ones)
    grams = lambda t: [tuple(w[j : j + 3]) for w in [words(t)] for j in range(max(1, len(w) - 2))]
    count = collections.Counter(g for _, t in docs for g in grams(t))
    want = {}
    for i, x in items:
        by = sorted(range(len(grams(x))), key=lambda j: (count[grams(x)[j]], j))
        seeds = {grams(x)[j] for j in by if count[grams(x)[j]] <= 10} | {grams(x)[j] for j in by[:8]}
        for d, t in docs:
            if seeds & set(grams(t)):
                score = _smith_waterman(words(x), words(t)) / (2 * len(words(x)))
                if score >= decontaminate.THRESHOLD:
                    want[d, i] = round(score, 6)
    bench = spark.createDataFrame(items + [(None, "w1 w2 w3"), (50, None), (51, "")], "item_id bigint, text string")
    awkward = [(None, items[0][1]), (900, None), (901, "")]
    found = decontaminate.contaminated(clashing(documents(spark, docs + awkward)), bench)
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in found.collect()}
    assert len(want) >= 30
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-5 for k in got)


def test_more_items_than_a_block(spark):
    items = spark.createDataFrame([(k, f"alpha{k} beta{k} gamma{k} delta{k}") for k in range(30)], "item_id bigint, text string")
    docs = documents(spark, [(1, "x alpha3 beta3 gamma3 delta3 y"), (2, "alpha7 beta8 gamma9")])
    found = decontaminate.contaminated(docs, items, block_bytes=220)
    assert rows(found.select("doc_id", "item_id", "score", "first_word", "end_word")) == [(1, 3, 1.0, 1, 5)]
    assert decontaminate.contaminated(documents(spark, []), items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


# HTML ---------------------------------------------------------------------


def test_the_article_stays(spark):
    html = "<html><head><title>T</title><script>var a='</p>';</script></head><body><ul><li>Home</li><li>More</li></ul><div>Buy now</div><article><h1>Title here</h1><p>" + "First words of it. " * 10 + "<p>A&#66;&amp;lt; &#x43;</p><p>" + "Second words. " * 12 + "</p></article><footer>&copy; us</footer></body></html>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<p>short</p>"), (None, "<p>" + "long text " * 9), (5, "<!-- " + html), (5, "plain " * 30)], "page_id bigint, html string")
    found = rows(html_text.main_text(clashing(pages)))
    by = {r[0]: r for r in found if r[0] != 5}
    lines = by[1][1].split("\n")
    assert lines[0] == "Title here" and lines[2] == "AB&lt; C" and len(lines) == 4 and by[1][2] == 1
    assert by[2][1:] == (None, None) and by[3][1:] == ("", 0) and by[4][1:] == ("", 0)
    assert by[None][1] == ("long text " * 9).strip()
    assert [r[1] for r in found if r[0] == 5] == ["", ("plain " * 30).strip()]
    assert html_text.main_text(pages.limit(0)).count() == 0


# top-k --------------------------------------------------------------------


def test_html_source_layout_between_paragraphs_changes_nothing(spark):
    paragraphs = [f"<p>Paragraph {k} " + "has words of its own. " * (2 + 3 * (k % 4)) + "</p>" for k in range(8)]
    pages = [(k, "<body><ul><li>Home</li></ul><article>" + gap.join(paragraphs) + "</article></body>") for k, gap in enumerate(("", "\n", "\r\n\r\n  "))]
    found = rows(html_text.main_text(spark.createDataFrame(pages, "page_id bigint, html string")))
    assert found[0][1].count("Paragraph") == 8
    assert [r[1:] for r in found] == [found[0][1:]] * 3


@pytest.mark.parametrize(("many", "annulus", "width"), [(300, 16, 3), (40, 512, 64), (5, 4, 1)])
def test_top_k_equals_brute_force(spark, many, annulus, width):
    r = np.random.default_rng(many)
    vecs = np.round(r.normal(size=(many, 6)) + r.integers(0, 4, (many, 1)) * 5, 2)
    vecs[1] = vecs[0]
    table = [(k, v.tolist()) for k, v in enumerate(vecs)]
    awkward = [(None, vecs[0].tolist()), (900, None), (901, []), (902, [1.0]), (903, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (904, [float("nan")] * 6), (0, vecs[0].tolist())]
    df = spark.createDataFrame(table + awkward, "vec_id bigint, embedding array<double>")
    got = rows(top_k.top_k(clashing(df), k=4, annulus=annulus, group=2, width=width))
    want = []
    for a in range(many):
        near = sorted((math.dist(vecs[a], vecs[b]), b) for b in range(many) if b != a)[:4]
        want += [(a, k, b, round(round(d, 6), 5)) for k, (d, b) in enumerate(near, 1)]
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want, key=repr)]
    assert all(abs(x[3] - y[3]) < 2e-5 for x, y in zip(got, sorted(want, key=repr), strict=True))


def test_top_k_of_a_query_set(spark):
    r = np.random.default_rng(4)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(r.normal(size=(400, 5)))], "vec_id bigint, embedding array<double>")
    every = top_k.top_k(df, k=3, annulus=16, group=2, width=4)
    some = top_k.top_k(df, k=3, annulus=16, group=3, width=4, every=20)
    assert rows(some) == rows(every.where("vec_id % 20 = 0")) and some.count() == 60


def test_top_k_of_far_away_points(spark):
    r = np.random.default_rng(1)
    vecs = 1e6 + r.normal(size=(60, 4))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vecs)], "vec_id bigint, embedding array<double>")
    got = {(a, k): b for a, k, b, _ in rows(top_k.top_k(df, k=3, annulus=8, group=1, width=2))}
    for a in range(60):
        near = sorted((math.dist(vecs[a], vecs[b]), b) for b in range(60) if b != a)[:3]
        assert [got[a, k] for k in (1, 2, 3)] == [b for _, b in near]


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id bigint, embedding array<double>")
    assert top_k.top_k(df).count() == 0
    assert top_k.top_k(df.limit(0)).count() == 0


# packing ------------------------------------------------------------------


def _pack_by_force(lengths, capacity, spaces):
    still, out = [], []
    for d, n in lengths:
        for at in range(0, n, capacity):
            piece = (d, at, min(capacity, n - at))
            room = [w for w in still if sum(p[2] for p in w) + piece[2] <= capacity]
            if room:
                w = max(room, key=lambda w: sum(p[2] for p in w))
            else:
                if len(still) == spaces:
                    full = max(still, key=lambda w: sum(p[2] for p in w))
                    still.remove(full)
                    out.append(full)
                still.append(w := [])
            w.append(piece)
            if sum(p[2] for p in w) == capacity:
                still = [x for x in still if x is not w]
                out.append(w)
    return out + still


def test_one_partition_packs_like_brute_force(spark):
    r = random.Random(1)
    table = [(k, "x" * r.randint(0, 130)) for k in range(300)] + [(500, "é" * 400), (501, None), (502, "")]
    got = packing.pack(clashing(documents(spark, table)), capacity=100, open_windows=4, partition_rows=10_000)
    want = _pack_by_force([(d, len((t or "").encode())) for d, t in sorted(table)], 100, 4)
    key = lambda w: sorted(w)
    assert sorted(([*zip(x["doc_ids"], x["firsts"], x["lengths"], strict=True)] for x in got.collect()), key=key) == sorted(want, key=key)


def test_partitions_merge_and_keep_every_unit(spark):
    r = random.Random(2)
    table = [(k, "x" * r.randint(0, 80)) for k in range(500)] + [(None, "abc"), (3, "again"), (3, "again")]
    found = packing.pack(documents(spark, table), capacity=100, open_windows=3, partition_rows=40, merge=2).collect()
    units = {}
    for w in found:
        assert w["used"] == sum(w["lengths"]) <= 100
        for d, a, n in zip(w["doc_ids"], w["firsts"], w["lengths"], strict=True):
            units[d] = units.get(d, 0) + n
    want = {}
    for d, t in table:
        if t:
            want[d] = want.get(d, 0) + len(t)
    assert units == want
    assert len({w["window_id"] for w in found}) == len(found)
    assert sum(want.values()) / (100 * len(found)) > 0.85
    assert packing.pack(documents(spark, [])).count() == 0


# secrets ------------------------------------------------------------------


def _guess_by_force(value, word_bits):
    """Least cost over all segmentations, by plain recursion on spans."""
    from functools import cache

    walk = {(i, e): b for i, x in secrets.walks(value).items() for e, b, _ in x}
    date = {(i, e): b for i, x in secrets.dates(value).items() for e, b, _ in x}

    def span(a, b):
        options = [sum(secrets._CLASS.get(c, 11.0) for c in value[a:b])]
        options += [t[a, b] for t in (walk, date, word_bits) if (a, b) in t]
        for unit in range(1, (b - a) // 2 + 1):
            times, own = 1, value[a : a + unit]
            if (own + own).find(own, 1) < unit:
                continue  # a repeat itself
            while value[a + unit * times : a + unit * (times + 1)] == value[a : a + unit]:
                times += 1
            if times >= 2 and a + unit * times == b:
                inner = {(x - a, y - a): c for (x, y), c in word_bits.items() if a <= x and y <= a + unit}
                options.append(_guess_by_force(value[a : a + unit], inner) + math.log2(times))
        return min(options)

    @cache
    def best(end):
        return 0.0 if end == 0 else min(best(a) + secrets.SEGMENT_BITS + span(a, end) for a in range(end))

    return best(len(value))


def test_guess_bits_are_the_least():
    r = random.Random(5)
    pieces = ["summer", "2024", "12.05.1999", "abab", "qwerty", "zzz", "X9", "!", "pass", "1234", "dog", "é"]
    for _ in range(60):
        value = "".join(r.choice(pieces) for _ in range(r.randint(1, 4)))[:18]
        own = {}
        for a, b in secrets.letter_spans(value):
            if secrets.folded(value[a:b]) in ("summer", "pass", "dog"):
                own[a, b] = secrets.word_bits(value[a:b], 50, 10_000)
        bits, parts = secrets.guess_bits(value, own)
        assert abs(bits - _guess_by_force(value, own)) < 1e-9
        assert [p[1] for p in parts] == [0, *(p[2] for p in parts[:-1])] and parts[-1][2] == len(value)


def test_guess_bits_of_long_values():
    unit = "k7#Qz0pLw9@xVb2!mNc5%tRf8&yHg3*jDs6^eW"
    assert len(unit) > 32
    bits, parts = secrets.guess_bits(unit * 2, {})
    assert [p[0] for p in parts] == ["repeat"] and abs(bits - secrets.guess_bits(unit, {})[0] - 1 - secrets.SEGMENT_BITS) < 1e-9
    assert abs(secrets.guess_bits("x" * 5000, {})[0] - _guess_by_force("x", {}) - math.log2(5000) - secrets.SEGMENT_BITS) < 1e-9


def _secrets_by_force(table, least):
    """(document, place) with bits of every credential value, by whole-text regular expressions and counts."""
    counts, total, out = {}, 0, {}
    for d, t in table:
        if d is not None and t is not None:
            for w in words(t):
                counts[w] = counts.get(w, 0) + 1
                total += 1
    context = re.compile(r"""(pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|signing[_-]?key|credentials?|auth)[a-z0-9_-]*["']?[ \t]*(?::=|=>|==?|:)[ \t]*(?:bearer[ \t]+)?(?:"([^"\n]{6,})"|'([^'\n]{6,})'|["']?([^\s"'`,;<>]{6,}))""", re.I | re.A)
    for d, t in table:
        for m in context.finditer(t or "") if d is not None else ():
            k = next(k for k in (2, 3, 4) if m[k] is not None)
            value, own = m[k], {}
            plain = secrets.folded(value)
            for a, b in itertools.combinations(range(len(value) + 1), 2):
                piece = plain[a:b]
                if b - a >= 3 and piece.isalpha() and any(c.isalpha() for c in value[a:b]) and counts.get(piece, 0) >= least:
                    own[a, b] = secrets.word_bits(value[a:b], counts[piece], total)
            out[d, m.start(k)] = (value, own)
    return out


def test_secrets_equal_brute_force(spark):
    r = random.Random(12)
    long_word = "pneumonoultramicroscopicsilicovolcano"
    prose = [(k, f"the summer garden is warm and {long_word} was never here dragon {k}") for k in range(12)]
    pieces = ["summer", "Garden", "dragon", "1999", "2024-05-06", "qwert", "abc", "777", "X", "#k", "zQ9", "s3cret", "é"]
    table = list(prose)
    for k in range(40):
        value = "".join(r.choice(pieces) for _ in range(r.randint(2, 5)))
        key = r.choice(["password", "api_key", "auth", "DB_PASSWORD_OF_THE_VERY_LONG_SERVICE_NAME_IN_PRODUCTION", "x-token-value"])
        table.append((100 + k, f"text before, {key}{r.choice([' = ', ': ', ' := '])}{r.choice(['', chr(34), chr(39)])}{value}"))
    table += [(200, f"secret: {long_word}99"), (201, 'passphrase = "' + "summer garden and dragon " * 8 + '"'), (202, None), (203, "token=" + "aB3$" * 100), (None, "password: summer2024")]
    found = {(x["doc_id"], x["start"]): x for x in secrets.guess_costs(clashing(documents(spark, table))).collect()}
    want = _secrets_by_force(table, secrets.WORD_LEAST)
    assert set(found) == set(want) and len(want) >= 35
    for place, (value, own) in want.items():
        x = found[place]
        assert x["length"] == len(value) and x["sha256"] == hashlib.sha256(value.encode()).hexdigest()
        bits = secrets.guess_bits(value, own)[0] if len(value) > 30 else _guess_by_force(value, own)
        assert abs(x["bits"] - bits) < 1e-3, value
        assert x["secret"] == (x["bits"] >= secrets.MIN_BITS)
    assert found[200, 8]["segments"].startswith("word:37")
    assert found[201, 14]["length"] == 200


def test_secrets_of_documents(spark):
    common = [(k, "the summer is warm and the summer is long") for k in range(20)]
    table = [(100, 'token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"'), (101, "password: summersummer"), (102, "api_key=xxxxxxxxxxxxxxxx and PASSWORD: 'qwertyuiop'"), (103, "no context here"), (104, None), (105, ""), (None, "password: h8$Kq02!zvXm"), (106, "password: h8$Kq02!zvXm" + " x" * 50_000), (106, "password: h8$Kq02!zvXm" + " x" * 50_000)]
    found = {(r["doc_id"], r["context"]): r for r in secrets.guess_costs(clashing(documents(spark, common + table))).collect()}
    assert {k for k, r in found.items() if r["secret"]} == {(100, "token"), (106, "password")}
    assert found[101, "password"]["segments"] in ("repeat:12", "word:6 word:6")
    assert found[102, "api_key"]["segments"] == "repeat:16"
    assert found[102, "password"]["segments"] == "walk:10"
    assert found[100, "token"]["start"] == 9 and found[100, "token"]["length"] == 40
    assert secrets.guess_costs(documents(spark, [])).count() == 0


# language ID --------------------------------------------------------------

EN = "the quick brown fox jumps over the lazy dog and then the other animals follow them through this small forest with their friends"
DE = "der schnelle braune fuchs springt über den faulen hund und dann folgen ihm die anderen tiere durch den kleinen wald mit ihren freunden"


def _texts(seed, many):
    r = random.Random(seed)
    take = lambda s, n: " ".join(r.choice(s.split()) for _ in range(n))
    return [(2 * k, take(EN, 40), "en") for k in range(many)] + [(2 * k + 1, take(DE, 40), "de") for k in range(many)], take


def test_languages_held_out(spark):
    train, take = _texts(1, 60)
    model = language_id.train(documents(spark, train))
    both = take(EN, 40) + " " + take(DE, 20)
    test = [(1, take(EN, 30)), (2, take(DE, 30)), (3, both), (4, "9xq7 zzkq 8vqx " * 20), (5, None), (6, ""), (7, "..."), (None, take(EN, 20)), (1, take(DE, 30)), (8, take(EN, 30_000))]
    found = language_id.identify(clashing(documents(spark, test)), model).collect()
    assert len(found) == len(test)
    by = {r["doc_id"]: r for r in found if r["doc_id"] != 1}
    assert {r["main_language"] for r in found if r["doc_id"] == 1} == {"en", "de"}
    assert by[2]["languages"] == ["de"] and by[2]["accepted"]
    assert set(by[3]["languages"]) == {"en", "de"} and abs(by[3]["proportions"][0] - 2 / 3) < 0.1
    assert not by[4]["accepted"] and by[4]["languages"][0] == "und"
    assert all(not by[k]["accepted"] and by[k]["languages"] == [] and by[k]["main_language"] is None for k in (5, 6, 7))
    assert by[None]["main_language"] == "en" and by[8]["languages"] == ["en"]


def test_language_set_is_the_best_of_all():
    r = np.random.default_rng(1)
    for _ in range(20):
        n, parts = int(r.integers(3, 60)), 3
        like = np.exp(-r.exponential(3, (n, parts)))
        like /= like.max(axis=1, keepdims=True)
        chosen, _ = language_id.choose(like, np.array([0]), 1.0)
        price = math.log1p(n)
        best = None
        for size in (1, 2, 3):
            for combo in itertools.combinations(range(parts), size):
                mask = np.zeros((1, parts))
                mask[0, list(combo)] = 1
                _, score = language_id.mixture(like, np.array([0]), mask, settled=1e-9)
                value = score[0] - price * (size - 1)
                if best is None or value > best[0] + 0.05:
                    best = (value, combo)
        mask = chosen
        _, own = language_id.mixture(like, np.array([0]), mask, settled=1e-9)
        assert own[0] - price * (mask.sum() - 1) >= best[0] - 0.1


def test_languages_without_labels_or_rows(spark):
    docs = documents(spark, [(1, "some words here", None), (2, None, None)])
    found = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert found[1]["main_language"] == "und" and not found[1]["accepted"]
    assert language_id.identify(documents(spark, [])).count() == 0
