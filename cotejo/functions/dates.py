"""Dates as printed on invoices, in PDF metadata and in image metadata."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cotejo.functions.binding import let
from cotejo.functions.text import strip


def pdf_date(c: Column) -> Column:
    """`D:YYYYMMDDHHmmSS` with missing parts defaulted; an impossible day is clamped to 12/28. Offset ignored."""

    def stamp(d: Column) -> Column:
        # the digits given, completed from January 1st, midnight
        full = F.concat(d, F.substr(F.lit("00000101000000"), F.length(d) + 1))
        part = lambda a, n: F.substring(full, a, n)
        clock = F.concat(part(9, 2), F.lit(":"), part(11, 2), F.lit(":"), part(13, 2))
        day = lambda m, x: F.concat_ws("-", part(1, 4), m, x)
        at = lambda date: F.concat_ws(" ", date, clock).try_cast("timestamp_ntz")
        clamped = day(F.least(part(5, 2), F.lit("12")), F.least(part(7, 2), F.lit("28")))
        return F.when((d != "") & ~d.startswith("0000"), F.coalesce(at(day(part(5, 2), part(7, 2))), at(clamped)))

    return let(F.regexp_extract(strip(c), r"^(?:D:)?(\d{4}(?:\d{2}){0,5})", 1), stamp)


def issue_date(c: Column) -> Column:
    """d/m/y or d-m-y; a two-digit year belongs to this century."""
    shape = r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$"

    def read(s: Column) -> Column:
        century = F.when(s.rlike(r"/\d{2}$"), F.regexp_replace(s, r"/(\d{2})$", "/20$1")).otherwise(s)
        return F.when(s.rlike(shape), F.regexp_replace(century, shape, "$3-$2-$1").try_cast("date"))

    return let(F.replace(strip(c), F.lit("-"), F.lit("/")), read)


# Accepted shapes and the plain form each is rewritten to; the clock reading is kept
# and any offset dropped.
META_SHAPES = [
    (r"^(\d{4}):(\d{1,2}):(\d{1,2}) (\d{1,2}:\d{1,2}:\d{1,2})$", "$1-$2-$3 $4"),
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})[ T](\d{1,2}:\d{1,2}:\d{1,2})$", "$1-$2-$3 $4"),
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})T(\d{1,2}:\d{1,2}:\d{1,2})(?:\.\d{1,6})?(?:Z|[+-]\d{2}:?\d{2})$", "$1-$2-$3 $4"),
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", "$1-$2-$3"),
]


def meta_date(c: Column) -> Column:
    """EXIF, XMP and ISO spellings to a timestamp without zone."""

    def read(s: Column) -> Column:
        tries = [F.when(s.rlike(p), F.regexp_replace(s, p, plain).try_cast("timestamp_ntz")) for p, plain in META_SHAPES]
        return F.when(s != "", F.coalesce(*tries))

    return let(strip(c), read)


def whole_days(later: Column, earlier: Column) -> Column:
    """Elapsed days rounded down, also when negative."""
    seconds = F.timestamp_diff("SECOND", earlier, later)
    return F.floor(seconds / 86400)
