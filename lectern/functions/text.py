"""Text functions as native column expressions.

Word characters are letters, numbers and the underscore of all scripts, spelled
out as ``\\p{L}\\p{N}_`` because regular-expression engines differ in ``\\w``.
A language may be a literal string or a column.
"""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .lexica import CRITICAL, LETTERS, NUMBER_WORDS_CS, NUMBER_WORDS_EN, NUMERAL_VALUES, QUESTION_WORDS

CLOSERS = "[\"”’')\\]]"
SENTENCE_END = rf"(?U)(?<=[.!?]){CLOSERS}*\s+"
_NUMERIC = "^[\\p{Nd}²³¹⁰⁴-⁹₀-₉]+$"
_AUXILIARIES = "would|were|was|used|should|ought|need|must|might|may|is|have|has|had|do|does|did|dare|could|are|am"

Lang = Column | str


def _lang(lang: Lang) -> Column:
    return F.lit(lang) if isinstance(lang, str) else lang


def is_lang(lang: Lang, prefix: str) -> Column:
    return _lang(lang).startswith(prefix)


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(split_words(text))


def sentences(text: Column) -> Column:
    """Sentences, cut after . ! ? and the closing signs that follow, which go."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), stripped), lambda s: s != "")


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no function for it."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def expand_negations(text: Column) -> Column:
    """English n't written out; only with the apostrophe between n and t."""
    out = F.regexp_replace(text, rf"(?U)\b({_AUXILIARIES})n't\b", "$1 not")
    for short, long in (("ain't", "aint"), ("can't", "cannot"), ("shan't", "shall not"), ("won't", "will not")):
        out = F.regexp_replace(out, rf"(?U)\b{short}\b", long)
    return out


def normalized(text: Column, lang: Lang = "en") -> Column:
    """Lower case, words only, one space between; for composed (NFC) text."""
    low = F.translate(F.lower(text), "’‘ʼ＇", "''''")
    low = F.when(is_lang(lang, "en"), expand_negations(low)).otherwise(low)
    return stripped(F.regexp_replace(F.regexp_replace(low, r"(?U)[^\p{L}\p{N}_\s]", " "), r"(?U)\s+", " "))


def tokens(text: Column, lang: Lang = "en") -> Column:
    return F.filter(F.split(normalized(text, lang), " "), lambda w: w != "")


def _words(known: frozenset[str]) -> Column:
    return F.array(*map(F.lit, sorted(known)))


def is_numberish(word: Column, lang: Lang = "en") -> Column:
    """Digits of any script only, or a number word of the language."""
    named = F.when(is_lang(lang, "cs"), word.isin(sorted(NUMBER_WORDS_CS))).otherwise(word.isin(sorted(NUMBER_WORDS_EN)))
    return word.rlike(_NUMERIC) | named


def content_words(text: Column, lang: Lang = "en") -> Column:
    return F.filter(tokens(text, lang), lambda w: ~is_numberish(w, lang))


def critical_words(words: Column) -> Column:
    """Words whose loss changes the meaning, sorted: equal arrays are equal counts."""
    return F.array_sort(F.filter(words, lambda w: w.isin(sorted(CRITICAL))))


def has_compound_numeral(words: Column, lang: Lang = "en") -> Column:
    """Two numerals side by side."""
    flags = F.array_join(F.transform(words, lambda w: F.when(is_numberish(w, lang), "1").otherwise("0")), "")
    return flags.contains("11")


def isolated_numerals(words: Column, lang: Lang = "en") -> Column:
    """Values of numerals without a numeral beside them, as sorted strings; '?' before those of no one value.

    Digits count if they are canonical and of 18 places at most.
    """
    # neighbours within one string: no look into arrays, whose making would be repeated for every word
    marks = F.array_join(F.transform(words, lambda w: F.when(is_numberish(w, lang), F.concat(F.lit("1"), w)).otherwise("0")), " ")
    table = F.create_map(*(F.lit(str(x)) for kv in sorted(NUMERAL_VALUES.items()) for x in kv))

    def value(w: Column) -> Column:
        return F.when(w.rlike("^(0|[1-9][0-9]{0,17})$"), w).otherwise(F.coalesce(F.try_element_at(table, w), F.concat(F.lit("?"), w)))

    alone = F.regexp_extract_all(F.concat(F.lit("0 "), marks, F.lit(" 0")), F.lit(r"(?<=(?:^| )0 )1(\S+)(?= 0)"), F.lit(1))
    return F.array_sort(F.transform(alone, value))


def pronounced(text: Column, lexicon: list[tuple[str, str]]) -> Column:
    """Whole words replaced by their respellings, the longest first."""
    ordered = sorted(lexicon, key=lambda kv: -len(kv[0]))
    literal = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    return functools.reduce(lambda c, kv: F.regexp_replace(c, rf"(?U)\b\Q{kv[0]}\E\b", literal(kv[1])), ordered, text)


def spelled_acronyms(text: Column, lang: Lang) -> Column:
    """Words of two to six capitals as the names of their letters; other languages unchanged."""
    base = F.substring_index(_lang(lang), "-", 1)
    parts = F.split(text, r"(?<![\p{L}\p{N}_])(?=[A-Z]{2,6}(?![\p{L}\p{N}_]))|(?<=(?<![\p{L}\p{N}_])[A-Z]{2,6})(?![\p{L}\p{N}_])")

    def spoken(names: dict[str, str]) -> Column:
        table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
        spell = lambda p: F.array_join(F.transform(F.filter(F.split(p, ""), lambda c: c != ""), lambda c: F.element_at(table, c)), " ")
        return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[A-Z]{2,6}$"), spell(p)).otherwise(p)), "")

    out = text
    for code, names in LETTERS.items():
        out = F.when(base == code, spoken(names)).otherwise(out)
    return out


def spoken_form(text: Column, lang: Lang, lexicon: list[tuple[str, str]] | None = None, spell: bool = False) -> Column:
    """What an engine is asked to say: the lexicon first, then acronyms."""
    out = pronounced(text, lexicon or [])
    return spelled_acronyms(out, lang) if spell else out


def yes_no_question(text: Column, lang: Lang) -> Column:
    """Ends in a question mark and holds no question word; false for languages without a list."""
    base = F.substring_index(_lang(lang), "-", 1)
    said = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    open_ = F.lit(False)
    for code, known in QUESTION_WORDS.items():
        open_ = F.when(base == code, ~F.arrays_overlap(said, _words(known))).otherwise(open_)
    return stripped(text).rlike("\\?[\"”“’‘')\\]»]*$") & (F.size(said) > 0) & open_


def diagnostics_line(codes: Column, limit: int = 6) -> Column:
    """The codes d:, i: and s: by group, so many of each and how many more."""
    if limit < 1:
        raise ValueError("limit must be 1 at least")

    def group(name: str, mark: str, arrow: bool = False) -> Column:
        own = F.transform(F.filter(codes, lambda c: c.startswith(f"{mark}:")), lambda c: c.substr(F.lit(3), F.length(c)))
        shown = F.transform(own, lambda c: F.regexp_replace(c, "^([^/]*)/", "$1→")) if arrow else own
        more = F.when(F.size(own) > limit, F.concat(F.lit(" +"), (F.size(own) - limit).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
        return F.when(F.size(own) > 0, F.concat(F.lit(f"{name}: "), F.array_join(F.slice(shown, 1, limit), ", "), more))

    return F.concat_ws(" · ", group("missing", "d"), group("inserted", "i"), group("substituted", "s", True))


def bench_normalized(text: Column) -> Column:
    """Lower case without punctuation, as probes compare transcripts."""
    return stripped(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def recovered(transcript: Column, pattern: Column) -> Column:
    """Whether the transcript shows the term that the pattern stands for."""
    return F.coalesce(F.rlike(bench_normalized(transcript), pattern), F.lit(False))


def probe_verdict(raw_ok: Column, respelled_ok: Column) -> Column:
    """What to do with a lexicon entry, by whether each spelling was recognised."""
    return F.when(raw_ok & respelled_ok, "optional").when(respelled_ok, "keep").when(raw_ok, "drop").otherwise("rework")


def language_for(stem: Column) -> Column:
    """Language by the prefix of a file name."""
    return F.when(stem.startswith("en_"), "en").otherwise("cs")

