"""The registered queries over the driver's tables, and their SQL.

Where a query needs scores of recognisers or failures of an engine, these are
arithmetic on ids, so that Spark and SQL see the same ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..functions.lexica import CRITICAL, LETTERS, NUMBER_WORDS_EN, QUESTION_WORDS
from ..operators import audio as A
from ..operators import harness as H
from ..operators import ladder as L
from ..operators import report as R
from ..operators import segment as G
from ..operators import takes as K
from ..operators.config import MasterConfig, RenderConfig, SynthConfig
from . import render as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _in(words) -> str:
    return "(" + ", ".join("'" + w + "'" for w in sorted(words)) + ")"


# SQL of expressions -------------------------------------------------------

_WS = "' ' || chr(9) || chr(10) || chr(13)"
_SENT = f"list_filter(list_transform(string_split(regexp_replace({{}}, '([.!?])[\"”’'')\\]]*\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, {_WS})), lambda x: x <> '')"
_SENTENCES = _SENT.format("text")
_LOW = "translate(lower({}), '’‘ʼ＇', '''''''''')"
_NORM = "trim(regexp_replace(regexp_replace(" + _LOW + ", '[^\\pL\\pN_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_TOKENS = "list_filter(string_split(" + _NORM.format("text") + ", ' '), lambda x: x <> '')"
_NUMBERISH = f"(regexp_matches({{0}}, '^[0-9]+$') OR {{0}} IN {_in(NUMBER_WORDS_EN)})"
_COUNT = "len(list_filter(string_split(regexp_replace({}, '\\s+', ' ', 'g'), ' '), lambda x: x <> ''))"
_CHUNKS = f"""sents AS (SELECT doc_id, unnest({_SENTENCES}) AS sentence, unnest(range(len({_SENTENCES}))) AS pos FROM documents),
chunks AS (SELECT doc_id, (pos // 3)::INTEGER AS chunk_idx, string_agg(sentence, ' ' ORDER BY pos) AS text, count(*)::INTEGER AS n_sentences FROM sents GROUP BY ALL)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, chunk_idx, text, n_sentences): three sentences each."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("s")).where("size(s) > 0")
    rows = docs.select("doc_id", "s", F.explode(F.sequence(F.lit(0), F.floor((F.size("s") - 1) / 3).cast("int"))).alias("chunk_idx"))
    part = F.slice("s", F.col("chunk_idx") * 3 + 1, F.lit(3))
    return rows.select("doc_id", "chunk_idx", F.array_join(part, " ").alias("text"), F.size(part).alias("n_sentences"))


# text ----------------------------------------------------------------------


@_query(f"SELECT doc_id, len({_SENTENCES})::INTEGER AS n_sentences, round(list_avg(list_transform({_SENTENCES}, lambda x: length(x))), 4) AS avg_chars FROM documents")
def sentences_per_document(spark, sf_dir):
    s = T.sentences(F.col("text"))
    n = F.transform(s, F.length)
    total = F.aggregate(n, F.lit(0), lambda a, x: a + x)
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(s).alias("n_sentences"), F.round(F.try_divide(total, F.size(s)), 4).alias("avg_chars"))


@_query(f"SELECT doc_id, unnest(range(len({_SENTENCES})))::INTEGER AS pos, unnest({_SENTENCES}) AS sentence FROM documents")
def sentence_rows(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@_query(f"SELECT doc_id, {_NORM.format('text')} AS normalized FROM documents")
def normalized_text(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.normalized(F.col("text"), F.col("lang")).alias("normalized"))


@_query(f"SELECT doc_id, array_to_string(list_filter({_TOKENS}, lambda w: NOT {_NUMBERISH.format('w')}), ' ') AS words FROM documents")
def content_words(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(T.content_words(F.col("text"), F.col("lang")), " ").alias("words"))


@_query(f"SELECT doc_id, array_to_string(list_sort(list_filter({_TOKENS}, lambda w: w IN {_in(CRITICAL)})), ' ') AS words FROM documents")
def critical_token_counts(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(T.critical_words(T.tokens(F.col("text"), F.col("lang"))), " ").alias("words"))


@_query(
    f"""WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents), f AS (SELECT doc_id, w, list_transform(w, lambda x: {_NUMBERISH.format('x')}) AS num FROM t)
SELECT doc_id, coalesce(list_bool_or(list_transform(num, lambda x, i: x AND coalesce(num[i + 1], false))), false) AS compound,
 array_to_string(list_sort(list_filter(list_transform(w, lambda x, i: CASE WHEN num[i] AND NOT coalesce(num[i + 1], false) AND NOT (i > 1 AND num[greatest(i - 1, 1)]) THEN (CASE WHEN regexp_matches(x, '^(0|[1-9][0-9]{{0,17}})$') THEN x ELSE '?' || x END) END), lambda x: x IS NOT NULL)), ' ') AS numerals FROM f"""
)
def numeric_tokens(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", "lang", T.tokens(F.col("text"), F.col("lang")).alias("w"))
    return rows.select("doc_id", T.has_compound_numeral(F.col("w"), F.col("lang")).alias("compound"), F.array_join(T.isolated_numerals(F.col("w"), F.col("lang")), " ").alias("numerals"))


_RUNS = "regexp_extract_all(text, '[\\pL\\pN_]+|[^\\pL\\pN_]+')"
_EN_NAMES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in LETTERS["en"].items()) + "}"


@_query(f"SELECT doc_id, CASE WHEN lang <> 'en' THEN text ELSE array_to_string(list_transform({_RUNS}, lambda x: CASE WHEN regexp_matches(x, '^[A-Z]{{2,6}}$') THEN array_to_string(list_transform(string_split(x, ''), lambda c: {_EN_NAMES}[c]), ' ') ELSE x END), '') END AS spoken FROM documents")
def spelled_acronyms(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.spelled_acronyms(F.col("text"), F.col("lang")).alias("spoken"))


@_query("SELECT lang, sum(len(list_filter(" + _RUNS + ", lambda x: regexp_matches(x, '^[A-Z]{2,6}$'))))::BIGINT AS acronyms FROM documents GROUP BY lang")
def acronym_counts(spark, sf_dir):
    words = F.filter(F.split("text", r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[A-Z]{2,6}$"))
    return _t(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.size(words)).alias("acronyms"))


@_query(f"SELECT conv_id, turn, role, (regexp_matches(trim(text, {_WS}), '\\?[\"”“’‘'')\\]»]*$') AND len(list_filter({_TOKENS}, lambda w: w IN {_in(QUESTION_WORDS['en'])})) = 0) AS rising FROM conversations")
def rising_questions(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", L.wants_rise(F.col("text"), "en", SynthConfig(rising="yes_no_question")).alias("rising"))


@_query("SELECT doc_id, CASE WHEN n > 0 THEN 'missing: ' || array_to_string(w[1:6], ', ') || CASE WHEN n > 6 THEN ' +' || (n - 6) || ' more' ELSE '' END ELSE '' END AS line FROM (SELECT doc_id, " + _TOKENS + " AS w, len(" + _TOKENS + ") AS n FROM documents)")
def diagnostics_lines(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text"), F.col("lang")).alias("w"))
    return rows.select("doc_id", T.diagnostics_line(F.transform("w", lambda w: F.concat(F.lit("d:"), w))).alias("line"))


# chunks --------------------------------------------------------------------

_MERGE = f"list_reduce(list_transform(c, lambda x: [x]), lambda a, b: CASE WHEN {_COUNT.format('b[1]')} < 3 AND length(a[-1]) + 1 + length(b[1]) <= 250 THEN list_append(a[1:len(a) - 1], a[-1] || ' ' || b[1]) ELSE list_append(a, b[1]) END)"


@_query()
def greedy_chunks(spark, sf_dir):
    """Chunks by the native fold, and by the UDF where a sentence is above the limit."""
    return _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(G.chunks_of(F.col("text"))).alias("piece_no", "chunk"))


@_query()
def document_chunks(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(G.chunk_text(F.col("text"))).alias("piece_no", "chunk"))


@_query()
def chunk_budget_stats(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("lang", "source", F.explode(G.chunk_text(F.col("text"))).alias("c"))
    return rows.groupBy("lang", "source").agg(F.count("*").alias("chunks"), F.min(F.length("c")).alias("least"), F.round(F.avg(F.length("c")), 4).alias("mean"), F.max(F.length("c")).alias("most"), F.count_if(T.word_count(F.col("c")) < 3).alias("runts"))


@_query(
    f"""WITH b AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS b FROM documents),
t AS (SELECT doc_id, unnest(b) AS text, unnest(range(len(b))) AS p FROM b)
SELECT doc_id AS script_id, (2 * p)::INTEGER AS seg_no, 'text' AS kind, text, NULL::DOUBLE AS gap_s FROM t
UNION ALL SELECT doc_id, (2 * p - 1)::INTEGER, 'gap', NULL, 1.0 FROM t WHERE p > 0"""
)
def script_segments(spark, sf_dir):
    return G.parse_script(_t(spark, sf_dir, "documents"), 1.0, id_col="doc_id")


@_query(f"SELECT conv_id AS script_id, turn AS seg_no, role AS voice_id, {_COUNT.format('text')}::INTEGER AS words, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS nth FROM conversations")
def dialogue_turns(spark, sf_dir):
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("script_id"), F.col("turn").alias("seg_no"), F.col("role").alias("voice_id"), T.word_count(F.col("text")).alias("words"), nth.alias("nth"))


@_query()
def dialogue_plan(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations").where("trim(text) <> ''").select(F.col("conv_id").alias("script_id"), F.col("turn").alias("seg_no"), F.lit("text").alias("kind"), "text", F.col("role").alias("voice_id"))
    return G.plan_chunks(turns)


# engine and ladder ---------------------------------------------------------

_W = f"(SELECT conv_id, turn, {_COUNT.format('text')} AS words FROM conversations)"


@_query(f"SELECT conv_id, turn, trunc(greatest(words / 2.5 * 1.6 + 2.0, 4.0) * 25)::INTEGER AS cap, round(words / 4.5, 6) AS shortest, round((1.5 + 0.75 * words)::DOUBLE, 6) AS longest FROM {_W}")
def duration_bounds(spark, sf_dir):
    w = T.word_count(F.col("text"))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", L.frame_cap(w).alias("cap"), F.round(L.shortest(w), 6).alias("shortest"), F.round(L.longest(w), 6).alias("longest"))


_FAIL_SQL = "['none', 'none', 'drop_sentence', 'repeat', 'truncate', 'runaway', 'raise', 'none'][((doc_id * 31 + chunk_idx * 7 + n * 5) % 8 + 1)::INTEGER]"


def _failure():
    return F.get(F.array(*map(F.lit, ("none", "none", "drop_sentence", "repeat", "truncate", "runaway", "raise", "none"))), ((F.col("doc_id") * 31 + F.col("chunk_idx") * 7 + F.col("n") * 5) % 8).cast("int"))


@_query(
    f"""WITH {_CHUNKS}, a AS (SELECT *, unnest([1, 2, 3]) AS n FROM chunks), f AS (SELECT *, {_FAIL_SQL} AS failure, {_SENT.format('text')} AS s, list_filter(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM a),
p AS (SELECT *, CASE WHEN failure = 'raise' THEN NULL WHEN failure = 'drop_sentence' AND len(s) > 1 THEN array_to_string(s[1:len(s) - 1], ' ') WHEN failure = 'repeat' THEN array_to_string(list_transform(range(greatest(len(s), 3)), lambda k: s[1]), ' ')
 WHEN failure = 'truncate' THEN array_to_string(w[1:greatest(len(w) // 3, 1)], ' ') WHEN failure = 'runaway' THEN repeat('babble ', 200) ELSE text END AS spoken, trunc(greatest(len(w) / 2.5 * 1.6 + 2.0, 4.0) * 25) AS cap FROM f)
SELECT doc_id, chunk_idx, n::INTEGER AS n, failure, sha256(coalesce(spoken, '')) AS spoken_digest, round(CASE WHEN failure = 'raise' THEN NULL WHEN failure = 'runaway' THEN cap / 25 ELSE least({_COUNT.format('spoken')} / 2.5, cap / 25) END, 6) AS duration FROM p"""
)
def fake_outcomes(spark, sf_dir):
    rows = L.attempts(_chunks(spark, sf_dir), _failure())
    return rows.select("doc_id", "chunk_idx", "n", "failure", F.sha2(F.coalesce("spoken", F.lit("")), 256).alias("spoken_digest"), F.round("duration", 6).alias("duration"))


_SCORE = "((doc_id * 31 + chunk_idx * 7 + n * 5) % 11)"
_ATT = f"""{_CHUNKS}, r AS (SELECT doc_id, chunk_idx, unnest([1, 2, 3]) AS n FROM chunks),
att AS (SELECT doc_id, chunk_idx, n, {_SCORE} = 0 AS raised, {_SCORE} >= 7 AS ok, {_SCORE} >= 3 AS cheap_ok, CASE WHEN {_SCORE} >= 3 THEN {_SCORE} / 11.0::DOUBLE ELSE 0.0 END AS coverage, CASE WHEN {_SCORE} = 8 THEN NULL ELSE ({_SCORE} - 5) * 0.4 END AS delta, chunk_idx % 2 = 0 AS rise FROM r)"""
_LADDER = """one AS (SELECT doc_id, chunk_idx, min(n) FILTER (ok AND NOT raised AND (NOT rise OR delta IS NULL OR delta >= 1.5)) AS stop_n, min(n) FILTER (ok AND NOT raised) AS first_ok,
 arg_max(n, (cheap_ok::INTEGER, coverage, -n)) FILTER (NOT raised) AS best FROM att GROUP BY ALL),
lad AS (SELECT o.doc_id, o.chunk_idx, coalesce(stop_n, first_ok, best) AS chosen, first_ok IS NOT NULL AS ok, coalesce(stop_n, 3) AS calls, first_ok, coalesce(first_ok, coalesce(stop_n, first_ok, best)) AS until FROM one o)"""


def _attempts(spark, sf_dir):
    rows = _chunks(spark, sf_dir).select("doc_id", "chunk_idx", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("n"))
    s = (F.col("doc_id") * 31 + F.col("chunk_idx") * 7 + F.col("n") * 5) % 11
    return rows.select("doc_id", "chunk_idx", "n", (s == 0).alias("raised"), (s >= 7).alias("ok"), (s >= 3).alias("cheap_ok"), F.when(s >= 3, s / 11.0).otherwise(0.0).alias("coverage"), F.when(s == 8, None).otherwise((s - 5) * 0.4).alias("delta"), (F.col("chunk_idx") % 2 == 0).alias("wants_rise"))


@_query(
    f"""WITH {_ATT}, {_LADDER}
SELECT doc_id, chunk_idx, chosen::INTEGER AS chosen, l.ok AS ok, (SELECT count(*) FROM att a WHERE a.doc_id = l.doc_id AND a.chunk_idx = l.chunk_idx AND (a.raised OR NOT a.ok) AND a.n < l.until)::INTEGER AS prior_failures, calls::INTEGER AS calls,
 round(coalesce((SELECT any_value(a.coverage) FROM att a WHERE a.doc_id = l.doc_id AND a.chunk_idx = l.chunk_idx AND a.n = l.chosen), 0.0), 6) AS coverage FROM lad l"""
)
def ladder_selection(spark, sf_dir):
    return L.ladder(_attempts(spark, sf_dir), ["doc_id", "chunk_idx"]).withColumn("coverage", F.round("coverage", 6))


_PART = "((doc_id * 17 + chunk_idx * 5 + sentence_no * 3) % 7)"


@_query(
    f"""WITH {_CHUNKS}, p AS (SELECT doc_id, chunk_idx, n_sentences, unnest(range(n_sentences)) AS sentence_no FROM chunks), q AS (SELECT *, {_PART} >= 2 AS ok, {_PART} % 3 + 1 AS calls, {_PART} / 7.0::DOUBLE AS coverage, ({_PART} + 1) * 0.5 AS duration FROM p),
f AS (SELECT doc_id, chunk_idx, min(sentence_no) FILTER (NOT ok) AS failed_at, max(n_sentences) AS n FROM q GROUP BY ALL)
SELECT q.doc_id, q.chunk_idx, (any_value(failed_at) IS NULL AND any_value(n) >= 2) AS ok, round(CASE WHEN any_value(failed_at) IS NULL AND any_value(n) >= 2 THEN min(coverage) ELSE 0.0 END, 6) AS coverage, (3 + sum(calls))::BIGINT AS calls,
 round((CASE WHEN any_value(failed_at) IS NULL AND any_value(n) >= 2 THEN sum(duration) + 0.12 * (any_value(n) - 1) END)::DOUBLE, 6) AS duration
FROM q JOIN f USING (doc_id, chunk_idx) WHERE failed_at IS NULL OR sentence_no <= failed_at GROUP BY q.doc_id, q.chunk_idx"""
)
def split_recovery(spark, sf_dir):
    rows = _chunks(spark, sf_dir).select("doc_id", "chunk_idx", "n_sentences", F.explode(F.sequence(F.lit(0), F.col("n_sentences") - 1)).alias("sentence_no"))
    s = (F.col("doc_id") * 17 + F.col("chunk_idx") * 5 + F.col("sentence_no") * 3) % 7
    parts = rows.select("*", (s >= 2).alias("ok"), (s % 3 + 1).alias("calls"), (s / 7.0).alias("coverage"), ((s + 1) * 0.5).cast("double").alias("duration"), F.lit(3).alias("calls_before"))
    out = L.split_recovery(parts, ["doc_id", "chunk_idx"])
    return out.withColumn("coverage", F.round("coverage", 6)).withColumn("duration", F.round("duration", 6))


# take store ----------------------------------------------------------------

_SETTINGS = K.settings(SynthConfig()).replace("'", "''")
_KEY = "sha256(" + " || ".join(f"length({p}) || ':' || {p}" for p in ("text", "text", "'v/' || lang", f"'{P.ENGINE}'", f"'{P.VERIFIER}'", f"'{_SETTINGS}'")) + ")"


def _keys(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return docs.select("doc_id", "text", K.take_key(F.col("text"), F.col("text"), F.concat(F.lit("v/"), F.col("lang")), F.lit(P.ENGINE), F.lit(P.VERIFIER), SynthConfig()).alias("key"))


@_query(f"SELECT doc_id, {_KEY} AS key FROM documents")
def take_keys(spark, sf_dir):
    return _keys(spark, sf_dir).select("doc_id", "key")


_STORE = f"k AS (SELECT doc_id, {_KEY} AS key FROM documents), st AS (SELECT DISTINCT key FROM k WHERE doc_id % 2 = 0)"


def _lookup(spark, sf_dir):
    rows = _keys(spark, sf_dir).select("doc_id", "key")
    store = rows.where("doc_id % 2 = 0").select("key").distinct()
    for name in ("format", "text", "written_at", "attempts"):
        store = store.withColumn(name, F.lit(None).cast("string"))
    return K.lookup(rows, store, F.col("doc_id") % 10 == 0)


@_query(f"WITH {_STORE} SELECT doc_id, key, 0 AS attempts, true AS reused, true AS ok FROM k JOIN st USING (key) WHERE doc_id % 10 <> 0")
def take_hits(spark, sf_dir):
    return _lookup(spark, sf_dir)[0]


@_query(f"WITH {_STORE} SELECT doc_id, key FROM k WHERE doc_id % 10 = 0 OR key NOT IN (SELECT key FROM st)")
def take_misses(spark, sf_dir):
    return _lookup(spark, sf_dir)[1]


@_query(f"WITH k AS (SELECT doc_id, {_KEY} AS key FROM documents) SELECT doc_id, key FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id) = 1")
def first_takes(spark, sf_dir):
    rows = _keys(spark, sf_dir).select("doc_id", "key", F.col("doc_id").alias("script_id"), F.lit(0).alias("chunk_idx"))
    return K.first_of_key(rows)[0].select("doc_id", "key")


_EVENT_TAKES = """takes AS (SELECT 'k' || user_id AS key, event_id, ts, (event_id % 13 <> 0) AND (event_id % 17 <> 0) AND (event_id % 19 <> 0) AND (event_id % 23 <> 0) AND (event_id % 29 <> 0) AS good FROM events)"""


def _takes(spark, sf_dir):
    """Takes of a store, one for each event: some of another format or rate, some without a field, some with damaged audio."""
    e = F.col("event_id")
    audio = F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: ((e % 100 + k) / 256).cast("float"))
    rows = _t(spark, sf_dir, "events").select(
        "event_id",
        F.when(e % 13 == 0, K.FORMAT - 1).otherwise(K.FORMAT).alias("format"),
        F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"),
        F.when(e % 17 == 0, 8000).otherwise(P.RATE).alias("sample_rate"),
        audio.alias("audio"),
        F.when(e % 19 == 0, None).otherwise(F.col("event_type")).alias("transcript"),
        F.when(e % 23 == 0, None).otherwise(F.lit(1.0)).alias("coverage"),
        F.lit("").alias("dropped_sentence"),
        F.when(e % 3 == 0, "sentence-split").otherwise("").alias("recovered_by"),
        F.array().cast("array<string>").alias("word_diagnostics"),
        F.col("event_type").alias("text"),
        F.lit(3 / P.RATE).alias("duration_s"),
        F.lit(1).alias("attempts"),
        F.col("ts").alias("written_at"),
    )
    digest = K.audio_digest(F.col("audio"))
    return rows.withColumn("digest", F.when(e % 29 == 0, F.sha2(digest, 256)).otherwise(digest))


@_query(f"WITH {_EVENT_TAKES} SELECT key, event_id FROM takes WHERE good QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) = 1")
def reroll_latest(spark, sf_dir):
    """Of the takes under a key the latest that is in order."""
    return K.valid(_takes(spark, sf_dir), P.RATE, tie="event_id").select("key", "event_id")


@_query(f"WITH {_EVENT_TAKES}, v AS (SELECT * FROM takes WHERE good QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) = 1) SELECT key FROM v WHERE event_id % 3 <> 0")
def usable_takes(spark, sf_dir):
    """Takes put together from sentences don't count once rising ends are wanted."""
    return K.valid(_takes(spark, sf_dir), P.RATE, tie="event_id").where(K.usable_under(SynthConfig(rising="yes_no_question"))).select("key")


@_query(f"WITH {_EVENT_TAKES}, v AS (SELECT DISTINCT key FROM takes WHERE good), u AS (SELECT DISTINCT 'k' || user_id AS key FROM events WHERE event_type = 'purchase' AND event_id % 2 = 0) SELECT count(*) AS usable, count(u.key) AS used FROM v LEFT JOIN u USING (key)")
def take_usage(spark, sf_dir):
    used = _t(spark, sf_dir, "events").where("event_type = 'purchase' and event_id % 2 = 0").select(F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"))
    return K.usage(K.valid(_takes(spark, sf_dir), P.RATE, tie="event_id"), used)


# evaluation ----------------------------------------------------------------

_RUNS_SQL = "runs AS (SELECT doc_id, lang, source, (60 + (doc_id * 13 + coalesce(toxic, 0) * 7) % 41) / 100::DOUBLE AS w, (60 + (doc_id * 29 + quality * 3) % 41) / 100::DOUBLE AS p, (50 + (doc_id * 7) % 51) / 100::DOUBLE AS mutual, doc_id % 9 <> 0 AS reached FROM labels JOIN documents USING (doc_id))"
_BUCKET = "CASE WHEN NOT reached THEN 'cheap_fail' WHEN w >= 0.9 AND p >= 0.9 THEN 'both_accept' WHEN w >= 0.9 THEN 'second_only_reject' WHEN p >= 0.9 THEN 'first_only_reject' WHEN mutual >= 0.8 THEN 'both_reject_agree' ELSE 'both_reject_disagree' END"


def _runs(spark, sf_dir):
    rows = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents"), "doc_id")
    d = F.col("doc_id")
    score = lambda x, m, least: (F.lit(least) + x % m) / F.lit(100.0)
    return rows.select("doc_id", "lang", "source", score(d * 13 + F.coalesce("toxic", F.lit(0)) * 7, 41, 60).alias("w"), score(d * 29 + F.col("quality") * 3, 41, 60).alias("p"), score(d * 7, 51, 50).alias("mutual"), (d % 9 != 0).alias("reached"))


@_query(f"WITH {_RUNS_SQL} SELECT doc_id, {_BUCKET} AS bucket FROM runs")
def headtohead_buckets(spark, sf_dir):
    return _runs(spark, sf_dir).select("doc_id", H.headtohead_bucket(F.col("w"), F.col("p"), F.col("mutual"), F.col("reached")).alias("bucket"))


@_query(f"WITH {_RUNS_SQL} SELECT doc_id, bucket FROM (SELECT doc_id, {_BUCKET} AS bucket FROM runs) WHERE bucket NOT IN ('both_accept', 'both_reject_agree', 'cheap_fail')")
def disagreements(spark, sf_dir):
    return H.disagreements(headtohead_buckets(spark, sf_dir))


@_query(
    f"""WITH {_RUNS_SQL} SELECT count(*) AS rows, count_if(w < 0.9 OR p < 0.9) AS any_rejects, count_if(w < 0.9) AS w_rejects, count_if(w < 0.9 AND p >= 0.9) AS w_alone, count_if(w < 0.9 AND p >= 0.9) AS w_rescued, round(100 * count_if(w < 0.9) / count(*), 2) AS w_percent,
 count_if(p < 0.9) AS p_rejects, count_if(p < 0.9 AND w >= 0.9) AS p_alone, count_if(p < 0.9 AND w >= 0.9) AS p_rescued, round(100 * count_if(p < 0.9) / count(*), 2) AS p_percent FROM runs WHERE reached"""
)
def headtohead_totals(spark, sf_dir):
    return H.headtohead_totals(_runs(spark, sf_dir), ["w", "p"])


@_query(f"WITH {_RUNS_SQL}, b AS (SELECT CASE WHEN w >= 0.9 AND p >= 0.9 THEN 'both_fine' WHEN w < 0.9 AND p < 0.9 AND mutual >= 0.8 THEN 'audio_wrong' ELSE 'asr_unreliable' END AS bucket FROM runs) SELECT bucket, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM b GROUP BY bucket")
def crosscheck_tally(spark, sf_dir):
    rows = _runs(spark, sf_dir).withColumn("bucket", H.crosscheck_bucket(F.col("w"), F.col("p"), F.col("mutual")))
    return H.tally(rows, "bucket")


@_query(f"WITH {_RUNS_SQL} SELECT doc_id, w >= 0.9 OR p >= 0.9 AS ok, round(CASE WHEN w >= 0.9 THEN w WHEN p >= 0.9 THEN p ELSE greatest(w, p) END, 6) AS coverage, CASE WHEN w >= 0.9 OR (p < 0.9 AND w >= p) THEN 'first' ELSE 'second' END AS transcript FROM runs")
def cascade_choice(spark, sf_dir):
    def verdict(score, name):
        detail = F.struct(F.col(score).alias("score"), F.lit("").alias("worst_sentence"), F.array().cast("array<string>").alias("word_diagnostics"))
        return S.verdict(detail, F.lit(name))

    rows = _runs(spark, sf_dir).select("doc_id", S.cascade([verdict("w", "first"), verdict("p", "second")]).alias("v"))
    return rows.select("doc_id", "v.ok", F.round("v.coverage", 6).alias("coverage"), "v.transcript")


@_query(
    f"""WITH {_CHUNKS}, c AS (SELECT doc_id, chunk_idx, unnest(['none', 'drop', 'duplicate', 'truncate', 'swap']) AS corruption FROM chunks WHERE n_sentences >= 2),
k AS (SELECT corruption, (doc_id * 11 + chunk_idx * 3 + length(corruption)) % 10 < CASE WHEN corruption = 'none' THEN 9 ELSE 1 END AS ok FROM c)
SELECT corruption, count(*) AS n, count_if(ok) AS accepted, round(count_if(CASE WHEN corruption = 'none' THEN NOT ok ELSE ok END) / count(*), 4) AS wrong_rate FROM k GROUP BY corruption
UNION ALL SELECT 'all', count(*), count_if(ok), round(count_if(ok) / count(*), 4) FROM k WHERE corruption <> 'none'"""
)
def acceptance_matrix(spark, sf_dir):
    rows = _chunks(spark, sf_dir).select("doc_id", "chunk_idx", T.sentences(F.col("text")).alias("x"), F.array_repeat(F.lit(""), F.col("n_sentences")).alias("sentences"), F.lit(True).alias("trusted"))
    cases = H.acceptance_cases(rows)
    ok = (F.col("doc_id") * 11 + F.col("chunk_idx") * 3 + F.length("corruption")) % 10 < F.when(F.col("corruption") == "none", 9).otherwise(1)
    return H.acceptance(cases.withColumn("ok", ok))


_CATEGORIES = [("click", 0, "rise"), ("view", 1, "fall"), ("purchase", 2, "flat"), ("signup", 3, "rise"), ("error", 4, "fall"), ("login", 5, "flat"), ("logout", 6, "rise")]
_TAKES = "t AS (SELECT event_id, event_type AS category, CASE WHEN event_id % 11 = 0 THEN 'undef' WHEN value - 50 >= 1.5 THEN 'rise' WHEN value - 50 <= -1.5 THEN 'fall' ELSE 'flat' END AS contour, event_id % 7 <> 0 AS verified FROM events)"


@_query(
    f"""WITH {_TAKES}, c AS (SELECT * FROM (VALUES {', '.join(map(str, _CATEGORIES))}) c(category, ord, expected))
SELECT category, ord, count(*) AS total, count_if(verified) AS verified, count_if(verified AND contour = 'rise') AS rise, count_if(verified AND contour = 'flat') AS flat, count_if(verified AND contour = 'fall') AS fall, count_if(verified AND contour = 'undef') AS undef,
 round(count_if(verified AND contour = expected) / nullif(count_if(verified AND contour <> 'undef'), 0), 2) AS match_rate FROM t JOIN c USING (category) GROUP BY category, ord"""
)
def contour_aggregate(spark, sf_dir):
    delta = F.when(F.col("event_id") % 11 == 0, None).otherwise(F.col("value") - 50)
    takes = _t(spark, sf_dir, "events").select(F.col("event_type").alias("category"), A.contour(delta).alias("contour"), (F.col("event_id") % 7 != 0).alias("verified"))
    return H.contour_aggregate(takes, spark.createDataFrame(_CATEGORIES, "category string, ord int, expected string"))


@_query(
    "WITH c AS (SELECT event_id AS case_id, event_type AS category, round(value, 2) AS value FROM events), d AS (SELECT event_id AS case_id, event_type AS category, round(value, 2) + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS value, unnest([1, 3]) AS take FROM events WHERE event_id % 3 = 0) SELECT case_id, n::INTEGER AS take FROM c, (SELECT unnest([1, 2, 3]) AS n) WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.case_id = c.case_id AND d.take = n AND d.case_id % 5 <> 0)"
)
def resume_plan(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select(F.col("event_id").alias("case_id"), F.col("event_type").alias("category"), F.round("value", 2).alias("value"))
    done = events.where("case_id % 3 = 0").select("case_id", "category", (F.col("value") + F.when(F.col("case_id") % 5 == 0, 1).otherwise(0)).alias("value"), F.explode(F.array(F.lit(1), F.lit(3))).alias("take"))
    return H.resume_plan(events, done, 3, ["case_id", "category", "value"])


@_query("SELECT event_id, round(CASE WHEN value <> 0 THEN (event_id % 100) / value END, 4) AS rtf FROM events")
def real_time_factors(spark, sf_dir):
    runs = _t(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 100).alias("synth_s"), F.col("value").alias("audio_s"))
    return H.real_time_factor(runs).select("event_id", "rtf")


@_query("SELECT user_id AS input_file, round(avg(event_id % 97) FILTER (event_type = 'click'), 4) AS click, round(avg(event_id % 97) FILTER (event_type = 'view'), 4) AS view, round(avg(event_id % 97) FILTER (event_type = 'purchase'), 4) AS purchase FROM events GROUP BY user_id")
def engine_scorecard(spark, sf_dir):
    runs = _t(spark, sf_dir, "events").select(F.col("user_id").alias("input_file"), F.col("event_type").alias("engine"), (F.col("event_id") % 97).alias("value"))
    return H.scorecard(runs, ["click", "view", "purchase"], "value")


# audio ---------------------------------------------------------------------


def _rounded(audio):
    """To 4 places, without negative zeros."""
    return F.transform(audio, lambda x: F.when(F.abs(x) < 5e-5, 0.0).otherwise(F.round(x.cast("double"), 4)))


def _r4(x: str) -> str:
    return f"(CASE WHEN abs(({x})::FLOAT) < 5e-5 THEN 0.0::DOUBLE ELSE round(({x})::FLOAT::DOUBLE, 4) END)"


@_query(f"SELECT vec_id, list_transform(embedding, lambda x: {_r4('x * power(10.0, (vec_id % 7 - 3) / 20.0)')}) AS audio FROM embeddings")
def gain_scaled(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select("vec_id", _rounded(A.gained(F.col("embedding"), (F.col("vec_id") % 7 - 3).cast("double"))).alias("audio"))


@_query(f"SELECT vec_id, list_transform(embedding, lambda x: {_r4('CASE WHEN abs(x) <= 0.08 THEN x ELSE sign(x) * (0.08 + 0.02 * tanh((abs(x::DOUBLE) - 0.08) / 0.02)) END')}) AS audio FROM embeddings")
def soft_limited(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select("vec_id", _rounded(A.limited(F.col("embedding"), 0.1)).alias("audio"))


@_query(f"SELECT vec_id, list_transform(embedding, lambda x, i: {_r4('x * CASE WHEN i <= 8 THEN (i - 1) / 7.0 WHEN i > len(embedding) - 8 THEN (len(embedding) - i) / 7.0 ELSE 1.0 END')}) AS audio FROM embeddings")
def declicked(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select("vec_id", _rounded(A.declick(F.col("embedding"), 1000)).alias("audio"))


@_query("WITH f AS (SELECT vec_id, list_transform(embedding, lambda x: 100 + abs(x::DOUBLE) * 100) AS f FROM embeddings) SELECT vec_id, round(12 * log2(list_median(f[len(f) - 29:]) / list_median(f[greatest(len(f) - 79, 1):len(f) - 30])), 6) AS delta_st FROM f")
def terminal_delta(spark, sf_dir):
    f0 = F.transform("embedding", lambda x: F.lit(100.0) + F.abs(x.cast("double")) * 100)
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.round(A.delta_from_f0(f0), 6).alias("delta_st"))


_CORRUPTED = {
    "none": "embedding",
    "drop": "list_concat(embedding[1:k], embedding[k + 2:len(embedding)])",
    "duplicate": "list_concat(embedding[1:k + 1], embedding[k + 1:len(embedding)])",
    "truncate": "embedding[1:k]",
    "swap": "list_concat(embedding[1:k], embedding[k + 2:k + 2], embedding[k + 1:k + 1], embedding[k + 3:len(embedding)])",
}


@_query("WITH e AS (SELECT vec_id, embedding, (vec_id % 8)::INTEGER AS k FROM embeddings)" + " UNION ALL".join(f" SELECT vec_id, '{kind}' AS corruption, list_transform({audio}, lambda x: {_r4('x')}) AS audio FROM e" for kind, audio in _CORRUPTED.items()))
def corrupted_audio(spark, sf_dir):
    """Every corruption of every wave."""
    rows = _t(spark, sf_dir, "embeddings").withColumn("corruption", F.explode(F.array(*map(F.lit, H.CORRUPTIONS))))
    return rows.select("vec_id", "corruption", _rounded(A.corrupted(F.col("embedding"), F.col("corruption"), (F.col("vec_id") % 8).cast("int"))).alias("audio"))


@_query(
    f"""WITH x AS (SELECT vec_id, list_concat(list_transform(range(64), lambda i: 0.0::FLOAT), embedding) AS x FROM embeddings),
r AS (SELECT vec_id, x, list_transform(range((len(x) - 15) // 5 + 1), lambda k: sqrt(list_sum(list_transform(x[k * 5 + 1:k * 5 + 15], lambda y: y::DOUBLE * y::DOUBLE)) / 15)) AS rms FROM x),
l AS (SELECT vec_id, x, list_filter(range(len(rms)), lambda k: rms[k + 1] >= list_max(rms) * power(10.0, -42 / 20.0)) AS loud FROM r)
SELECT vec_id, list_transform(x[greatest(0, loud[1] * 5 - 15) + 1:least(len(x), loud[-1] * 5 + 30)], lambda y: {_r4('y')}) AS audio FROM l"""
)
def trimmed_audio(spark, sf_dir):
    silent = F.array_repeat(F.lit(0.0).cast("float"), 64)
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", A.trim(F.concat(silent, F.col("embedding")), 500).alias("audio"))
    return rows.select("vec_id", _rounded(F.col("audio")).alias("audio"))


@_query()
def mastered_audio(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("script_id"), F.flatten(F.array_repeat("embedding", 30)).alias("audio"))
    return A.master(rows, 4000, MasterConfig(channels=1)).select("script_id", "channels", "duration_s", F.round("loudness_lufs", 3).alias("loudness_lufs"), F.round("peak_dbfs", 3).alias("peak_dbfs"))


# scoring and whole renderings ----------------------------------------------


@_query()
def coverage_scores(spark, sf_dir):
    """Chunks against what the simulated engine makes of them, by turns under every failure."""
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(G.chunk_text(F.col("text"))).alias("chunk_idx", "text")).repartition("doc_id", "chunk_idx")
    rows = rows.withColumn("failure", F.get(F.array(*(F.lit(x) for x in ("none", "drop_sentence", "repeat", "truncate"))), ((F.col("doc_id") + F.col("chunk_idx")) % 4).cast("int")))
    rows = rows.withColumn("heard", L.spoken_by_fake(F.col("text"), F.col("failure"))).withColumn("d", S.scorer()(F.col("text"), F.col("heard"), F.lit("en")))
    return rows.select("doc_id", "chunk_idx", "failure", F.round("d.score", 6).alias("score"), "d.worst_sentence", "d.word_diagnostics")


def _results(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id"), F.posexplode(G.chunk_text(F.col("text"))).alias("chunk_idx", "text"))
    chunks = rows.withColumn("script_id", F.col("doc_id"))
    fails = F.get(F.array(*map(F.lit, ("none", "none", "drop_sentence", "repeat", "truncate", "runaway", "raise", "none"))), ((F.col("script_id") * 31 + F.col("chunk_idx") * 7 + F.col("n") * 5 + F.col("sentence_no") * 3 + 8) % 8).cast("int"))
    return docs, P.rendered(chunks.drop("doc_id"), "en", fails, RenderConfig())


@_query()
def chunk_results(spark, sf_dir):
    return _results(spark, sf_dir)[1]


@_query()
def render_report(spark, sf_dir):
    docs, results = _results(spark, sf_dir)
    kept = results.select("script_id", "ok", "recovered_by", "reused", "duration_s").join(docs.select(F.col("doc_id").alias("script_id"), "lang", "source"), "script_id")
    return R.report(kept, ["lang", "source"]).withColumn("duration_s", F.round("duration_s", 3))


@_query()
def top_failures(spark, sf_dir):
    return R.failures(_results(spark, sf_dir)[1])
