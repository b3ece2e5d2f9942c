"""Column expressions.  All are built-in Spark functions, so they stay inside
whole-stage code generation; none of them is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the lenient UUID shape (five hex groups, an optional '+' sign per
# group, at most 36 characters in total; no group that overflows a signed 64-bit
# number: 17+ significant hex digits, or 16 starting with 8-f).
UUID_SHAPE = (r"^(?=.{0,36}\z)(?!(?:.*-)?\+?0*(?:[1-9a-fA-F][0-9a-fA-F]{16}|[89a-fA-F][0-9a-fA-F]{15}(?:-|\z)))"
              r"\+?[0-9A-Fa-f]+(?:-\+?[0-9A-Fa-f]+){4}\z")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


HEX32_GROUPS = r"^(.{8})(.{4})(.{4})(.{4})(.{12})$"


def is_valid_uuid(c) -> Column:
    """B1: true iff the text is accepted by the JVM's lenient UUID parser.

    Five '-'-separated hex groups, each may be short and may carry a leading
    '+'; the whole text is at most 36 characters; no group may overflow a signed
    64-bit number.  No trimming: spaces or a line end make the id invalid.  Null is
    invalid.  One regular expression, so the id is computed once; no UDF and no
    per-group lambda.
    """
    return F.coalesce(_c(c).rlike(UUID_SHAPE), F.lit(False))


def uuid_from_hex(hex32) -> Column:
    """Cut a 32-character hex text into the 8-4-4-4-12 form (one pass)."""
    return F.regexp_replace(_c(hex32), HEX32_GROUPS, "$1-$2-$3-$4-$5")


def in_range(x, lo: float, hi: float) -> Column:
    """Inclusive bounds; null, NaN and +-Infinity are out of range."""
    x = _c(x)
    return F.coalesce(~F.isnan(x) & (x >= F.lit(lo)) & (x <= F.lit(hi)), F.lit(False))


def epoch_ms_ntz(ts) -> Column:
    """Epoch milliseconds of a TIMESTAMP_NTZ (wall clock read as UTC), truncating.

    Independent of the session time zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.floor(F.timestamp_diff("MICROSECOND", epoch, _c(ts)) / F.lit(1000)).cast("long")


def epoch_ms(ts) -> Column:
    """Epoch milliseconds of a TIMESTAMP (instant), truncating like the JVM clock."""
    return F.unix_millis(_c(ts))


def ms_to_ts(ms) -> Column:
    return F.timestamp_millis(_c(ms))


def rfc3339_text(ms) -> Column:
    """RFC 3339 text with second precision in UTC, e.g. 2024-10-27T12:00:00Z."""
    return F.date_format(F.timestamp_millis(_c(ms)), "yyyy-MM-dd'T'HH:mm:ssXXX")


def ms_text(ms_value) -> Column:
    """Milliseconds as text with two decimals (metric CSV column)."""
    return F.format_string("%.2f", _c(ms_value).cast("double"))


def fixed6_text(x) -> Column:
    """Coordinate text with exactly six decimals (viewer table)."""
    return F.format_string("%.6f", _c(x).cast("double"))


def clock12_text(ms) -> Column:
    """12-hour clock text with two-digit fields, e.g. 03:04:05 PM (viewer table)."""
    return F.date_format(F.timestamp_millis(_c(ms)), "hh:mm:ss a")


def split_ids(text, sep: str = ",") -> Column:
    """Split a delimited id list, trim each id and drop blanks.  Null -> empty list."""
    parts = F.split(F.coalesce(_c(text), F.lit("")), "\\" + sep if sep in "|.^$*+?()[]{}\\" else sep)
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def join_ids(arr, sep: str = "|") -> Column:
    return F.coalesce(F.array_join(_c(arr), sep), F.lit(""))


def floor_div(a, b) -> Column:
    """Exact integer floor division (b > 0)."""
    a, b = _c(a), (F.lit(b) if isinstance(b, int) else _c(b))
    return F.call_function("div", a - F.pmod(a, b), b)


def ceil_div(a, b) -> Column:
    return -floor_div(-_c(a), b)


def grid_floor(ts_ms, origin_ms: int, every_ms: int) -> Column:
    """Last grid point at or before ts (grid = origin + k * every)."""
    return F.lit(origin_ms) + floor_div(_c(ts_ms) - F.lit(origin_ms), every_ms) * F.lit(every_ms)


def grid_ceil(ts_ms, origin_ms: int, every_ms: int) -> Column:
    """First grid point at or after ts."""
    return F.lit(origin_ms) + ceil_div(_c(ts_ms) - F.lit(origin_ms), every_ms) * F.lit(every_ms)
