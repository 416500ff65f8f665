"""Text functions as native columns (no Python in the plan)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..wikitext import cleanup, expr, values

TOKEN = r"[\p{L}\p{M}\p{N}]{2,99}"


def tokens(text: Column) -> Column:
    """Words of two to 99 letters, digits and combining marks, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def normalize_title(title: Column) -> Column:
    """Underscores and runs of blanks to one blank, outer blanks off, first letter upper case."""
    t = F.trim(F.regexp_replace(F.regexp_replace(title, "_", " "), r"\s+", " "))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 2_147_483_647))


def url_encode(text: Column) -> Column:
    """Percent-encoding with ``A-Za-z0-9-_.~`` left as they are."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def anchor_encode(text: Column) -> Column:
    return F.translate(text, " ", "_")


def article_link(code: Column, page_id: Column) -> Column:
    return F.format_string("https://%s.wikipedia.org/wiki?curid=%d", code, page_id)


def format_time(seconds: Column) -> Column:
    """``59s``, ``1m01s``, ``1h00m``."""
    s = F.floor(seconds).cast("long")
    return (
        F.when(seconds < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(seconds < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m"), F.lpad((s % 60).cast("string"), 2, "0"), F.lit("s")))
        .otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h"), F.lpad(F.floor((s % 3600) / 60).cast("string"), 2, "0"), F.lit("m")))
    )


def format_rate(per_second: Column) -> Column:
    """Per second from one upwards, else per minute."""
    return F.when(per_second >= 1, F.concat(F.format_string("%.1f", per_second), F.lit("/s"))).otherwise(F.concat(F.format_string("%.1f", per_second * 60), F.lit("/min")))


def redirect_target(text: Column) -> Column:
    return F.regexp_extract(text, r"(?i)^#REDIRECT(?:ION)?\s*\[\[([^\]]+)\]\]", 1)


def html_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def html_unescape(text: Column) -> Column:
    """The entities of XML, decimal numbers of characters up to 126 and the no-break blank, ``&amp;`` last."""
    out = F.replace(text, F.lit("&nbsp;"), F.lit("\u00a0"))
    for code in (*range(33, 38), *range(39, 48), *range(58, 65), *range(91, 97), *range(123, 127)):
        out = F.replace(out, F.lit(f"&#{code};"), F.lit(chr(code)))
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def highlight(text: Column, terms: Column) -> Column:
    """Escaped text with every whole word of ``terms`` (an array of words) in bold."""
    quoted = F.transform(terms, lambda t: F.regexp_replace(t, r"([^\p{L}\p{M}\p{N}])", r"\\$1"))
    pattern = F.concat(F.lit(r"(?i)(?<![\p{L}\p{M}\p{N}])("), F.array_join(quoted, "|"), F.lit(r")(?![\p{L}\p{M}\p{N}])"))
    return F.when(F.size(terms) > 0, F.regexp_replace(html_escape(text), pattern, F.lit("<b>$1</b>"))).otherwise(html_escape(text))


# markup ------------------------------------------------------------------

BLOCK_TAGS, EXTENSION_TAGS = cleanup.BLOCKS, cleanup.EXTENSIONS


def strip_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<!--.*?-->", "")


def strip_refs(c: Column) -> Column:
    return F.regexp_replace(c, r"(?is)<ref\b[^>]*?/>|<ref\b[^>]*>.*?</ref>", "")


def strip_extensions(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?is)<({'|'.join(EXTENSION_TAGS)})\b(?:[^>/]|/(?!>))*>.*?</\1>", "")


def breaks(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)<br[^>]*>", "\n")


def strip_tags(c: Column) -> Column:
    """Tags go; a block tag between two word characters leaves a blank."""
    block = F.regexp_replace(c, rf"(?i)([A-Za-z0-9])</?(?:{'|'.join(BLOCK_TAGS)})(?:\s[^>]*)?/?>(?=[A-Za-z0-9])", "$1 ")
    return F.regexp_replace(block, r"</?[A-Za-z][^>]*>", "")


def wiki_links(c: Column) -> Column:
    """File, category and language links removed, other links to their label, innermost first."""
    for _ in range(3):
        c = F.regexp_replace(c, r"(?i)\[\[(?:file|image|category|media):[^\[\]]*\]\]", "")
        c = F.regexp_replace(c, r"\[\[[a-z]{2,3}:[^\[\]]*\]\]", "")
        c = F.regexp_replace(c, r"\[\[(?:[^\[\]]*\|)?([^\[\]|]*)\]\]", "$1")
    return c


def external_links(c: Column) -> Column:
    c = F.regexp_replace(c, r"\[(?:https?:)?//[^\s\]]* ([^\]]*)\]", "$1")
    return F.regexp_replace(c, r"\[(?:https?:)?//[^\s\]]*\]", "")


def emphasis(c: Column) -> Column:
    return F.regexp_replace(c, "''+", "")


def headers(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)^=+[ \t]*(.*?)[ \t]*=+[ \t]*$", "\n$1\n")


def list_markers(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)^[*#:;]+ *", "")


def switches(c: Column) -> Column:
    return F.regexp_replace(c, r"__[A-Z]{3,}__", "")


def rules(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)^-{4,}", "\n")


def unicode_spaces(c: Column) -> Column:
    """Wide and no-break blanks to blanks, line separators to breaks, byte order marks removed; joiners stay."""
    blanks = " " + "".join(map(chr, range(0x2000, 0x200C))) + "  　"
    return F.translate(c, blanks + "  ﻿", " " * len(blanks) + "\n\n")


def collapse_blanks(c: Column) -> Column:
    """One blank, trimmed lines, at most two breaks in a row."""
    c = F.regexp_replace(c, r"[ \t\r\f]+", " ")
    c = F.regexp_replace(c, r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def plain_markup(c: Column) -> Column:
    """The passes that need no template and no nesting, in order."""
    for step in (strip_comments, strip_refs, strip_extensions, wiki_links, breaks, strip_tags, external_links, emphasis, headers, list_markers, switches, rules, unicode_spaces, collapse_blanks):
        c = step(c)
    return c


# lines and values -----------------------------------------------------------


def word_count(c: Column) -> Column:
    return F.when(F.length(F.trim(c)) > 0, F.size(F.split(F.trim(c), r"\s+"))).otherwise(0)


def digit_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[0-9٠-٩۰-۹०-९]"))


def char_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"\s+", ""))


def is_prose(c: Column, least_words: int) -> Column:
    return (word_count(c) >= least_words) & (digit_count(c) * 2 < char_count(c))


def drop_value(c: Column) -> Column:
    """Whether a parameter value of a missing template is debris rather than text."""
    n, low = F.octet_length(c), F.lower(c)
    control, words = sorted(values.SWITCHES | values.LAYOUT), sorted(values.PARAMETER_WORDS)
    return (
        (n < 2)
        | c.rlike(r"^[\{\[]..")
        | low.isin(control)
        | c.rlike(r"^[0-9.%pxem]+$")
        | ((n <= 8) & c.startswith("#"))
        | (c.rlike(r"^[A-Za-z_-]+$") & ((n <= 3) | low.isin(words)))
        | c.rlike(r"(?i).\.(?:jpg|png|svg|gif|jpeg|webp)$")
        | ((n < 40) & (c.rlike(r"[a-z-]{3,}[:;]") | (c.rlike(r"[a-z-]{3,}=") & c.rlike(r"[a-z]-[a-z-]*=|-[a-z-]+="))))
        | ((n >= 5) & (n < 40) & c.rlike(r"^[a-z0-9.%-]+$") & c.contains("-") & c.rlike("[0-9]"))
        | ((n >= 4) & (n < 40) & c.rlike(r"^[A-Za-z-]{2,}=[\"']"))
        | c.rlike(r"^[a-z]{2,3}-[A-Z][a-z]{3}$")
    )


def line_is_debris(c: Column) -> Column:
    """Line rules that hold whatever the line's origin."""
    n, low = F.octet_length(c), F.lower(c)
    leaked = cleanup.LEAKED
    return (
        F.substring_index(low, " ", 1).isin(leaked)
        | ((n < 40) & c.endswith("="))
        | c.startswith('">')
        | c.endswith('">')
        | c.startswith("!")
        | c.startswith("|-")
        | ((n > 10) & (c.endswith("nowrap") | c.endswith("noprint")))
        | F.substring(c, 1, 20).rlike("colspan|rowspan")
        | ((n > 2) & (n < 40) & c.rlike(r"^[a-z-]{2,} ?[=:]"))
    )


# parser functions ---------------------------------------------------------


def pf_if(t: Column, a: Column, b: Column) -> Column:
    return F.when(F.length(F.trim(t)) > 0, a).otherwise(b)


def pf_ifeq(left: Column, right: Column, a: Column, b: Column) -> Column:
    """Equal as text, or as numbers where both are numbers."""
    num = F.coalesce(left.try_cast("double") == right.try_cast("double"), F.lit(False))
    return F.when((left == right) | num, a).otherwise(b)


def pf_switch(x: Column, cases: list[tuple[list[str], Column]], default: Column) -> Column:
    """First case one of whose keys matches; keys without a value fall through to the next."""
    out = None
    for keys, value in cases:
        out = F.when(x.isin(keys), value) if out is None else out.when(x.isin(keys), value)
    return default if out is None else out.otherwise(default)


def formatnum(n: Column) -> Column:
    """Thousands separated where the integer part is all digits."""
    whole = F.regexp_extract(n, r"^[+-]?(\d+)(?:\.\d*)?$", 1)
    grouped = F.regexp_replace(whole, r"(?<=\d)(?=(?:\d{3})+$)", ",")
    return F.when(F.length(whole) > 0, F.concat(F.regexp_extract(n, r"^([+-]?)", 1), grouped, F.regexp_extract(n, r"(\.\d*)$", 1))).otherwise(n)


def pad_left(v: Column, width: int, fill: str = "0") -> Column:
    return F.when(F.octet_length(v) < width, F.concat(F.repeat(F.lit(fill), F.lit(width) - F.octet_length(v)), v)).otherwise(v)


def pad_right(v: Column, width: int, fill: str = "0") -> Column:
    return F.when(F.octet_length(v) < width, F.concat(v, F.repeat(F.lit(fill), F.lit(width) - F.octet_length(v)))).otherwise(v)


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UP, _LOW)


def upper_ascii(c: Column) -> Column:
    return F.translate(c, _LOW, _UP)


def upper_first(c: Column) -> Column:
    return F.concat(upper_ascii(F.substring(c, 1, 1)), F.substring(c, 2, 2_147_483_647))


def safe_divide(a: Column, b: Column) -> Column:
    """Division with 0 for a zero divisor."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def safe_mod(a: Column, b: Column) -> Column:
    return F.when(b != 0, a % b).otherwise(F.lit(0.0))


def expression(c: Column) -> Column:
    """Values of expressions in a text column, as ``#expr`` shows them."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else expr.expression(x))

    return run(c)


def magic_dates(ts: Column) -> dict[str, Column]:
    """The CURRENT* words at a time given as a column."""
    return {
        "CURRENTYEAR": F.date_format(ts, "yyyy"),
        "CURRENTMONTH": F.date_format(ts, "MM"),
        "CURRENTMONTH1": F.date_format(ts, "M"),
        "CURRENTMONTHNAME": F.date_format(ts, "MMMM"),
        "CURRENTMONTHABBREV": F.date_format(ts, "MMM"),
        "CURRENTDAY": F.date_format(ts, "d"),
        "CURRENTDAY2": F.date_format(ts, "dd"),
        "CURRENTDOW": (F.dayofweek(ts) - 1).cast("string"),
        "CURRENTDAYNAME": F.date_format(ts, "EEEE"),
        "CURRENTTIME": F.date_format(ts, "HH:mm"),
        "CURRENTHOUR": F.date_format(ts, "HH"),
        "CURRENTWEEK": F.weekofyear(ts).cast("string"),
        "CURRENTTIMESTAMP": F.date_format(ts, "yyyyMMddHHmmss"),
    }
