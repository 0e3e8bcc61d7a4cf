"""Small tables with every awkward case, and plain Python versions of what the operators share."""

import re

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


def words(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def clashing(df):
    """The same table with columns whose names an operator may use itself."""
    from pyspark.sql import functions as F

    for name in ("n", "h1", "h2", "first", "key", "value", "word", "bucket", "pos", "gone", "toxic", "label", "v", "TEXT2"):
        df = df.withColumn(name, F.lit("x"))
    return df


def rows(df):
    """The rows as sorted plain tuples."""

    def plain(x):
        if isinstance(x, (list, tuple)):
            return tuple(map(plain, x))
        return round(x, 5) if isinstance(x, float) else x

    return sorted((plain(tuple(r)) for r in df.collect()), key=repr)
