"""The registered queries of this subpackage, and their SQL where SQL can say it.

Each applies its operator, with the parameters that a production run would
use, to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_text, language_id, line_dedup, ngram_join, packing, secrets, substring_dedup, top_k, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(_table(spark, sf_dir, "embeddings"), every=20, group=64)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.guess_costs(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removed_lines(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_toxicity": op3_toxicity,
    "op4_decontamination": op4_decontamination,
    "op5_html_extraction": op5_html_extraction,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_packing": op7_packing,
    "op8_secret_scan": op8_secret_scan,
    "op9_line_dedup": op9_line_dedup,
    "op10_language_id": op10_language_id,
}

_WORDS = "regexp_extract_all(lower({}), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')"



def _html_sql() -> str:
    """The extraction in SQL: the same steps over lists."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    text = "regexp_replace(translate(html, chr(1), ' '), '(?s)<!--.*?(?:-->|\\z)', '', 'g')"
    for name in html_text.HIDDEN:
        gap = "chr(10)" if name in ("head", "select") else "''"
        text = f"regexp_replace({text}, '(?is)<{name}\\b[^>]*>.*?(?:</{name}\\s*>|\\z)', {gap}, 'g')"
    text = f"regexp_replace(translate({text}, chr(13), chr(10)), '(?i)</?(?:{html_text.BLOCKS})(?:[\\s/][^>]*)?>', chr(10), 'g')"
    text = f"regexp_replace({text}, '<[a-zA-Z/!?][^>]*>', '', 'g')"
    marked = f"string_split(regexp_replace({text}, '&#(x[0-9a-fA-F]{{1,6}}|[0-9]{{1,7}});', chr(1) || '\\1;', 'g'), chr(1))"
    code = "string_split(x, ';')[1]"
    value = f"(CASE WHEN starts_with({code}, 'x') THEN ('0x' || {code}[2:])::BIGINT ELSE {code}::BIGINT END)"
    real = f"(({value} >= 32 AND {value} < 55296) OR ({value} > 57343 AND {value} <= 1114111))"
    decoded = f"CASE WHEN i = 1 THEN x ELSE (CASE WHEN {real} THEN chr(({value})::INTEGER) ELSE '&#' || {code} || ';' END) || x[len({code}) + 2:] END"
    plain = f"array_to_string(list_transform({marked}, lambda x, i: {decoded}), '')"
    for name, char in html_text.ENTITIES.items():
        plain = f"replace({plain}, '&{name};', {quoted(char)})"
    sums = lambda n: f"list_transform({n}, lambda x, i: x + coalesce({n}[i + 1], 0))"
    greatest = f"list_max({sums('list_transform(string_split(r, chr(10)), lambda y: len(y))')})"
    return f"""
WITH lines AS (
  SELECT page_id, list_transform(string_split({plain}, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\x0b\\f\\xa0]+', ' ', 'g'))) AS lines FROM pages),
blocks AS (SELECT page_id, lines, {sums('list_transform(lines, lambda y: len(y))')} AS blocks FROM lines),
regions AS (
  SELECT page_id, list_max(blocks) AS most,
    string_split(array_to_string(list_transform(lines, lambda x, i: x || CASE WHEN blocks[i] <= {html_text.DIVE} THEN chr(1) ELSE chr(10) END), ''), chr(1)) AS regions FROM blocks),
kept AS (
  SELECT page_id, list_filter(regions, lambda r: {greatest} >= greatest({html_text.LEAST}, {html_text.SHARE} * most)) AS kept FROM regions)
SELECT page_id, array_to_string(list_filter(string_split(array_to_string(kept, chr(10)), chr(10)), lambda x: x <> ''), chr(10)) AS text, len(kept)::INTEGER AS n_regions FROM kept
"""


SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH t AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
tok AS (
  SELECT doc_id, text, regexp_extract(text, '^[^A-Za-z0-9\x{80}-\x{10FFFF}]*') AS lead,
    unnest(regexp_extract_all(text, '[A-Za-z0-9\x{80}-\x{10FFFF}]+[^A-Za-z0-9\x{80}-\x{10FFFF}]*')) AS x,
    unnest(range(len(regexp_extract_all(text, '[A-Za-z0-9\x{80}-\x{10FFFF}]+')))) AS i FROM t),
cut AS (SELECT doc_id, lead, x, i, lower(regexp_extract(x, '^[A-Za-z0-9\x{80}-\x{10FFFF}]+')) AS w, regexp_replace(x, '^[A-Za-z0-9\x{80}-\x{10FFFF}]+', '') AS gap FROM tok),
ends AS (SELECT *, regexp_matches(gap, '\n|[.!?][ \t]') AS stop, regexp_matches(gap, '[,;:]') OR strlen(w) % 8 = 7 AS inner_stop FROM cut),
whole AS (SELECT *, coalesce(sum(stop::INTEGER) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM ends),
sized AS (SELECT *, stop OR (inner_stop AND count(*) OVER (PARTITION BY doc_id, sent) > {LONG}) AS fin FROM whole),
parts AS (SELECT *, coalesce(sum(fin::INTEGER) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM sized),
pieces AS (
  SELECT doc_id, pos, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS words, CASE WHEN pos = 0 THEN any_value(lead) ELSE '' END || string_agg(x, '' ORDER BY i) AS piece
  FROM parts GROUP BY doc_id, pos),
sums AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS through FROM pieces),
runs AS (
  SELECT a.doc_id, a.pos, min(b.pos) AS fin FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos + {SPAN} - 1 AND a.pos + {MIN_WORDS} + {SPAN} AND b.through - a.through + a.n >= {MIN_WORDS}
  GROUP BY a.doc_id, a.pos),
spans AS (SELECT r.doc_id, r.pos, r.fin, string_agg(p.words, ' ' ORDER BY p.pos) AS k FROM runs r JOIN pieces p ON p.doc_id = r.doc_id AND p.pos BETWEEN r.pos AND r.fin GROUP BY ALL),
firsts AS (SELECT k, min((doc_id, pos)) AS first FROM spans GROUP BY k),
later AS (SELECT s.doc_id, s.pos, s.fin FROM spans s JOIN firsts f USING (k) WHERE (s.doc_id, s.pos) > f.first),
gone AS (SELECT DISTINCT p.doc_id, p.pos FROM pieces p JOIN later l ON p.doc_id = l.doc_id AND p.pos BETWEEN l.pos AND l.fin)
SELECT p.doc_id, list(p.pos::INTEGER ORDER BY p.pos) FILTER (g.pos IS NOT NULL) AS removed, count(*)::INTEGER AS n_sentences,
       coalesce(string_agg(p.piece, '' ORDER BY p.pos) FILTER (g.pos IS NULL), '') AS kept_text
FROM pieces p LEFT JOIN gone g USING (doc_id, pos) GROUP BY p.doc_id HAVING count(g.pos) > 0
""".replace("{LONG}", str(substring_dedup.LONG)).replace("{SPAN}", str(substring_dedup.SPAN)).replace("{MIN_WORDS}", str(substring_dedup.MIN_WORDS)),
    "op2_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT DISTINCT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
sets AS (
  SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) ELSE [array_to_string(w, ' ')] END)) AS g
  FROM w WHERE len(w) > 0),
firsts AS (SELECT g, min(doc_id) AS f, count(*) AS members, len(g) AS n, row_number() OVER () AS id FROM sets GROUP BY g),
grams AS (SELECT id, n, unnest(g) AS x FROM firsts),
common AS (
  SELECT a.id AS a, b.id AS b, count(*) AS c FROM grams a JOIN grams b ON a.x = b.x AND a.id < b.id AND least(a.n, b.n) >= 0.45 * greatest(a.n, b.n) - 1e-9 GROUP BY a.id, b.id),
pairs AS (
  SELECT a, b, x.f AS p, y.f AS q FROM common JOIN firsts x ON a = x.id JOIN firsts y ON b = y.id WHERE c >= ceil(0.45 * (x.n + y.n - c) - 1e-9) AND x.f <> y.f),
links AS (SELECT id, count(*) AS links FROM (SELECT a AS id FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY id),
edges AS (SELECT p AS u, q AS v FROM pairs UNION SELECT q, p FROM pairs UNION SELECT doc_id, f FROM sets JOIN firsts USING (g) UNION SELECT f, doc_id FROM sets JOIN firsts USING (g)),
reach AS (SELECT u, v FROM edges UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u),
classes AS (SELECT u AS doc_id, min(v) AS class_id FROM reach GROUP BY u)
SELECT doc_id, any_value(class_id) AS class_id, sum(members - 1)::BIGINT AS copies, sum(coalesce(links, 0))::BIGINT AS links
FROM sets JOIN firsts USING (g) LEFT JOIN links USING (id) JOIN classes USING (doc_id) WHERE links IS NOT NULL OR members > 1 GROUP BY doc_id
""",
    "op5_html_extraction": _html_sql(),
    "op6_exact_top_k": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
pairs AS (SELECT a.vec_id AS vec_id, b.vec_id AS neighbor_id, list_distance(a.e, b.e) AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) AS rank FROM pairs)
SELECT vec_id, rank::INTEGER AS rank, neighbor_id, round(distance, 6) AS distance FROM ranked WHERE rank <= 10
""",
    "op9_line_dedup": f"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
lines AS (
  SELECT doc_id, line_no, list_sort(list_distinct({_WORDS.format('line')})) AS words FROM raw),
sets AS (
  SELECT words, len(words) AS n, min((doc_id, line_no)) AS first FROM lines WHERE len(words) >= 3 GROUP BY words),
pairs AS (
  SELECT a.words AS words, b.first AS other, len(list_intersect(a.words, b.words)) AS common, a.n + b.n AS total
  FROM sets a JOIN sets b ON a.first <> b.first AND b.n BETWEEN ceil(0.9 * a.n - 1e-9) AND floor(a.n / 0.9 + 1e-9) AND a.n + b.n > 18),
near AS (
  SELECT words, min((other, -common / (total - common))) AS best FROM pairs
  WHERE common >= ceil(0.9 * (total - common) - 1e-9) GROUP BY words),
matches AS (
  SELECT l.doc_id, l.line_no, s.first AS other, -1.0::DOUBLE AS minus FROM lines l JOIN sets s USING (words) WHERE s.first < (l.doc_id, l.line_no)
  UNION ALL
  SELECT l.doc_id, l.line_no, m.other, -m.common / (m.total - m.common) FROM lines l JOIN pairs m USING (words)
  WHERE m.common >= ceil(0.9 * (m.total - m.common) - 1e-9) AND m.other < (l.doc_id, l.line_no))
SELECT doc_id, line_no::INTEGER AS line_no, min((other, minus))[1][1] AS first_doc_id,
       min((other, minus))[1][2]::INTEGER AS first_line_no, round(-min((other, minus))[2], 6) AS jaccard
FROM matches GROUP BY doc_id, line_no
""",
}
