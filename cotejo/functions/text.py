"""Text normalisation and first-match extraction, all as native column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from cotejo.functions.binding import let

# Every character that counts as white space.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def _accent_table() -> tuple[str, str]:
    """Precomposed letters whose canonical base is one character, then bare combining marks to drop."""
    src, dst = [], []
    for first, last in ((0x00C0, 0x024F), (0x1E00, 0x1EFF)):
        for code in range(first, last + 1):
            base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
            if len(base) == 1 and base != chr(code):
                src.append(chr(code))
                dst.append(base)
    marks = [chr(code) for code in range(0x0300, 0x0370) if unicodedata.category(chr(code)) == "Mn"]
    return "".join(src + marks), "".join(dst)


_ACCENTED, _PLAIN = _accent_table()

# Letters that text recognition confuses with digits, one table per input kind.
OCR_DIGIT_TABLES = {
    "pdf": ("OoDIl|!ZSB", "0001111258"),
    "capture": ("OoSsIl|B\u2014\u2013\u2018\u2019\u201c\u201d\"\u00ab\u00bb\u00b7", "00551118--"),
}


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITESPACE))


def strip_accents(c: Column) -> Column:
    return F.translate(c, _ACCENTED, _PLAIN)


def collapse_spaces(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def norm_desc(c: Column) -> Column:
    """Item key: no accents, only letters, digits, dot and dash, single spaces, upper case."""
    kept = F.regexp_replace(strip_accents(F.coalesce(c, F.lit(""))), r"[^A-Za-z0-9\s.-]", " ")
    return F.upper(collapse_spaces(kept))


def norm_name(c: Column) -> Column:
    """Company key: trimmed, no accents, single spaces, upper case."""
    return F.upper(F.regexp_replace(strip_accents(strip(F.coalesce(c, F.lit("")))), r"\s+", " "))


def clean_xml(c: Column) -> Column:
    """Drop a CDATA wrapper, unescape the named and numeric ASCII entities, drop a byte-order mark."""
    s = strip(F.coalesce(c, F.lit("")))
    s = F.when(
        s.startswith("<![CDATA[") & s.endswith("]]>"), strip(F.regexp_extract(s, r"(?s)^<!\[CDATA\[(.*)\]\]>$", 1))
    ).otherwise(s)
    plain = s
    for entity, char in (
        ("&lt;", "<"), ("&#60;", "<"), ("&#x3C;", "<"), ("&#x3c;", "<"),
        ("&gt;", ">"), ("&#62;", ">"), ("&#x3E;", ">"), ("&#x3e;", ">"),
        ("&quot;", '"'), ("&#34;", '"'), ("&#x22;", '"'),
        ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"),
        ("&amp;", "&"),
    ):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    escaped = s.contains("&lt;") | s.contains("&gt;") | s.contains("&amp;")
    return F.ltrim(F.when(escaped, plain).otherwise(s), F.lit("\ufeff"))


def ocr_digits(c: Column, table: str = "pdf") -> Column:
    return F.translate(c, *OCR_DIGIT_TABLES[table])


def strip_zero_width(c: Column) -> Column:
    return F.translate(c, "\u200b\ufeff", "")


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """First match or null (an unmatched or empty group is null)."""
    return let(F.regexp_extract(c, pattern, group), lambda v: F.when(v != "", v))


def extract_first(c: Column, patterns: Sequence[str], group: int = 1) -> Column:
    """First pattern of the list that matches anywhere wins."""
    return F.coalesce(*[extract(c, p, group) for p in patterns])


def extract_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def contains_any(c: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | c.contains(w)
    return found


def lines_of(c: Column, keep_empty: bool = False) -> Column:
    """Trimmed lines of a text; empty ones are dropped unless asked for."""
    trimmed = F.transform(F.split(F.replace(c, F.lit("\r"), F.lit("")), "\n"), strip)
    return trimmed if keep_empty else F.filter(trimmed, lambda x: x != "")
