"""Main text of web pages by the distribution of their line blocks.

Head, scripts, styles and comments go with what they hold, block tags become
line breaks and other tags nothing.  The block at a line is the sum of the
lengths of ``window`` lines from it on.  Blocks surge where they rise above
``dive`` and go on to reach the surge level before they fall back; they dive where
they fall to ``dive`` again.  The text between surge and dive points is kept.

The surge level is ``least`` characters, or ``share`` of the page's greatest block
where that is more, so that a short footer beside a long article stays out.

All of it is native expressions; the page is one row throughout, and nothing is
shuffled.  A '>' within a quoted attribute ends its tag.  Entities are decoded
once: numeric ones, and the names in ``ENTITIES``; others stay as they are.

Defined results: one row for each row of the table, rows without an id and
repeated rows included; a null page has the text null, an empty one and one
without a surge the text ''; equal blocks need no order; an unclosed script,
style or comment runs to the end of the page; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns

WINDOW = 2
DIVE = 0
LEAST = 40
SHARE = 0.5

#: Elements that go whole, before tags are looked at.
HIDDEN = ("head", "script", "style", "noscript", "template", "svg", "iframe", "select")
BLOCKS = "address|article|aside|blockquote|body|br|button|caption|dd|details|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|legend|li|main|nav|ol|option|p|pre|section|summary|table|tbody|td|tfoot|th|thead|tr|ul"
#: &amp; comes last, so that what it uncovers isn't decoded again.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "middot": "·", "bull": "•", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "euro": "€", "pound": "£", "sect": "§", "deg": "°", "amp": "&"}
_CUT = "\u0001"


def _numbers(text: Column) -> Column:
    """Numeric entities as their characters; those that name none stay."""
    marked = F.split(F.regexp_replace(text, r"&#(x[0-9a-fA-F]{1,6}|[0-9]{1,7});", f"{_CUT}$1;"), _CUT)

    def decoded(part: Column) -> Column:
        code = F.substring_index(part, ";", 1)
        value = F.when(code.startswith("x"), F.conv(F.substring(code, 2, 9), 16, 10)).otherwise(code).cast("bigint")
        real = ((value >= 32) & (value < 0xD800)) | ((value > 0xDFFF) & (value <= 0x10FFFF))
        char = F.decode(F.unhex(F.lpad(F.hex(value), 8, "0")), "UTF-32")
        rest = part.substr(F.length(code) + F.lit(2), F.length(part))
        return F.concat(F.when(real, char).otherwise(F.concat(F.lit("&#"), code, F.lit(";"))), rest)

    return F.array_join(F.transform(marked, lambda x, i: F.when(i == 0, x).otherwise(decoded(x))), "")


def page_lines(html: Column) -> Column:
    """The lines of a page without its markup."""
    text = F.regexp_replace(F.translate(html, _CUT, " "), r"(?s)<!--.*?(?:-->|\z)", "")
    for name in HIDDEN:
        text = F.regexp_replace(text, rf"(?is)<{name}\b[^>]*>.*?(?:</{name}\s*>|\z)", "\n" if name in ("head", "select") else "")
    # white space between two block tags is layout of the source, not blank lines of the page
    text = F.regexp_replace(F.translate(text, "\r", "\n"), rf"(?i)(</?(?:{BLOCKS})(?:[\s/][^>]*)?>)\s*\n\s*(?=</?(?:{BLOCKS})(?:[\s/][^>]*)?>)", "$1")
    text = F.regexp_replace(text, rf"(?i)</?(?:{BLOCKS})(?:[\s/][^>]*)?>", "\n")
    text = F.regexp_replace(text, r"<[a-zA-Z/!?][^>]*>", "")
    text = _numbers(text)
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\x0b\f\xa0]+", " ")))


def _sums(lengths: Column, window: int) -> Column:
    """Sums over the windows that begin at each element."""
    return F.transform(lengths, lambda x, i: sum((F.coalesce(F.get(lengths, i + k), F.lit(0)) for k in range(1, window)), x))


def main_text(pages: DataFrame, window: int = WINDOW, dive: int = DIVE, least: int = LEAST, share: float = SHARE, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_regions) of every page: the kept lines, and the kept stretches between surge and dive."""
    if window < 1 or dive < 0 or not 0 <= share <= 1:
        raise ValueError("window must be 1 at least, dive not negative, share in [0, 1]")
    rows = columns(pages, page_id=(id_col, "long"), html=(html_col, "string"))
    rows = rows.select("page_id", page_lines(F.col("html")).alias("lines"))
    rows = rows.select("page_id", "lines", F.transform("lines", F.length).alias("n"))
    rows = rows.select("page_id", "lines", _sums(F.col("n"), window).alias("blocks"))
    # a break follows each line whose block has dived; stretches between breaks are regions
    marked = F.transform("lines", lambda x, i: F.concat(x, F.when(F.get(F.col("blocks"), i) <= dive, F.lit(_CUT)).otherwise(F.lit("\n"))))
    rows = rows.select("page_id", F.array_max("blocks").alias("most"), F.split(F.array_join(marked, ""), _CUT).alias("regions"))

    def greatest(region: Column) -> Column:
        lengths = F.array(F.transform(F.split(region, "\n"), F.length))  # bound by a lambda, so made once
        return F.array_max(F.get(F.transform(lengths, lambda n: _sums(n, window)), F.lit(0)))

    level = F.greatest(F.lit(float(max(least, dive + 1))), F.lit(float(share)) * F.col("most"))
    rows = rows.select("page_id", F.filter("regions", lambda r: greatest(r) >= level).alias("kept"))
    text = F.array_join(F.filter(F.split(F.array_join("kept", "\n"), "\n"), lambda x: x != ""), "\n")
    return rows.select("page_id", text.alias("text"), F.size("kept").alias("n_regions"))
