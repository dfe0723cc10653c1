"""Date parsing, truncation, shifting and bucket labels as Column expressions.

All results are zoneless (``timestamp_ntz`` / ``date``) and computed without
the session time zone, so plans give the same answer on any cluster setting.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, StringType, TimestampNTZType, TimestampType

# The date formats the original tool accepts.
# Import coercion and schema inference (4 formats, in this order):
#   %Y-%m-%d %H:%M:%S, %Y-%m-%d, %Y/%m/%d %H:%M:%S, %Y/%m/%d
# Cleaning step date normalisation adds a fifth: %Y-%m-%d %H:%M
# Spark patterns below use single letters so 1- and 2-digit fields both parse,
# like Python's strptime does.
COERCE_FORMATS = ("yyyy-M-d H:m:s", "yyyy-M-d", "yyyy/M/d H:m:s", "yyyy/M/d")
CLEAN_FORMATS = COERCE_FORMATS + ("yyyy-M-d H:m",)
# Formats that carry a time of day (used by inference: Date vs DateTime).
TIMED_FORMATS = ("yyyy-M-d H:m:s", "yyyy/M/d H:m:s", "yyyy-M-d H:m")

TRUNC_UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute")


# Shape of each accepted format, as strptime reads it (4-digit year, 1-2
# digit fields). A cell is only handed to the parser when its shape fits:
# a regex test is cheap, a failed parse attempt is not.
_D = r"[0-9]{1,2}"
SHAPES = {
    "yyyy-M-d H:m:s": rf"^[0-9]{{4}}-{_D}-{_D} {_D}:{_D}:{_D}$",
    "yyyy-M-d": rf"^[0-9]{{4}}-{_D}-{_D}$",
    "yyyy/M/d H:m:s": rf"^[0-9]{{4}}/{_D}/{_D} {_D}:{_D}:{_D}$",
    "yyyy/M/d": rf"^[0-9]{{4}}/{_D}/{_D}$",
    "yyyy-M-d H:m": rf"^[0-9]{{4}}-{_D}-{_D} {_D}:{_D}$",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?$",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]": r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?$",
    "yyyy-MM-dd'T'HH:mm": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}$",
    "yyyy-MM-dd HH:mm": r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}$",
    "yyyy-MM-dd": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
}


_EPOCH = "1970-01-01 00:00:00"


def parse_with(c: Column, fmt: str) -> Column:
    """Strict parse of a string with one pattern, NULL on failure.

    Only cells whose shape fits the pattern reach the parser (a failed parse
    is far dearer than a regex test). The text is read with an explicit
    ``+0000`` offset, so the instant equals the wall-clock time read as UTC,
    and its epoch microseconds are added to the zoneless epoch: the session
    time zone never enters (a wall-clock time inside a daylight-saving gap
    stays as written). Impossible dates (month 13, 30 February, second 60)
    give NULL, as ``strptime`` rejects them."""
    instant = F.try_to_timestamp(F.concat(c, F.lit("+0000")), F.lit(fmt + "Z"))
    wall = F.timestamp_add("MICROSECOND", F.unix_micros(instant),
                           F.lit(_EPOCH).cast("timestamp_ntz"))
    shape = SHAPES.get(fmt)
    if shape is None:
        return wall
    fits = (F.octet_length(c) <= 32) & c.rlike(shape) & (F.substring(c, 1, 4) != "0000")
    return F.when(fits, wall)


def parse_multi(c: Column, formats=COERCE_FORMATS) -> Column:
    """First format that parses wins (coalesce); NULL if none does."""
    return F.coalesce(*[parse_with(c, f) for f in formats])


def parse_iso(c: Column) -> Column:
    """ISO date or datetime text (``YYYY-MM-DD``, ``YYYY-MM-DD[T ]HH:MM[:SS[.f]]``)."""
    s = F.trim(c)
    return F.coalesce(
        parse_with(s, "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"),
        parse_with(s, "yyyy-MM-dd HH:mm:ss[.SSSSSS]"),
        parse_with(s, "yyyy-MM-dd'T'HH:mm"),
        parse_with(s, "yyyy-MM-dd HH:mm"),
        parse_with(s, "yyyy-MM-dd"),
    )


def as_timestamp(c: Column, dtype: DataType) -> Column:
    """Any date-like column as ``timestamp_ntz``; text is parsed as ISO."""
    if isinstance(dtype, TimestampNTZType):
        return c
    if isinstance(dtype, (DateType, TimestampType)):
        return c.cast("timestamp_ntz")
    if isinstance(dtype, StringType):
        return parse_iso(c)
    return F.lit(None).cast("timestamp_ntz")


def trunc(c: Column, unit: str) -> Column:
    """``date_trunc`` with a zoneless ``timestamp_ntz`` result; week = Monday."""
    unit = unit.lower()
    if unit not in TRUNC_UNITS:
        raise ValueError(f"unsupported truncation unit '{unit}'")
    if unit in ("year", "quarter", "month", "week"):
        return F.trunc(F.to_date(c), unit).cast("timestamp_ntz")
    if unit == "day":
        return F.to_date(c).cast("timestamp_ntz")
    minute = F.minute(c) if unit == "minute" else F.lit(0)
    return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c),
                                minute, F.lit(0))


def shift(c: Column, dtype: DataType, value, unit: str) -> Column:
    """Add a (possibly fractional, possibly negative) number of days, months or
    years. Fractions spill like a SQL interval literal: fractional years round
    to whole months, a month fraction becomes 30-day days, a day fraction
    becomes time of day. Dates are promoted to timestamps first."""
    v = float(value)
    unit = unit.lower()
    months, days, micros = 0, 0, 0
    if unit in ("years", "year"):
        months = int(round(v * 12))
    elif unit in ("months", "month"):
        months = int(v)
        frac_days = (v - months) * 30
        days = int(frac_days)
        micros = int(round((frac_days - days) * 86_400_000_000))
    elif unit in ("days", "day"):
        days = int(v)
        micros = int(round((v - days) * 86_400_000_000))
    else:
        raise ValueError(f"unsupported shift unit '{unit}'")
    base = as_timestamp(c, dtype)
    secs = F.lit(micros / 1_000_000).cast("decimal(18,6)")
    interval = F.make_interval(F.lit(0), F.lit(months), F.lit(0), F.lit(days),
                               F.lit(0), F.lit(0), secs)
    return base + interval


def bucket_label(c: Column, granularity: str) -> Column:
    """Chart bucket label text: ``YYYY-MM-DD`` (day, and Monday for week),
    ``YYYY-MM``, ``YYYY-Qn``, ``YYYY``."""
    g = granularity.lower()
    d = F.to_date(c)
    if g == "day":
        return F.date_format(d, "yyyy-MM-dd")
    if g == "week":
        return F.date_format(F.trunc(d, "week"), "yyyy-MM-dd")
    if g == "month":
        return F.date_format(d, "yyyy-MM")
    if g == "quarter":
        return F.concat(F.date_format(d, "yyyy"), F.lit("-Q"), F.quarter(d).cast("string"))
    if g == "year":
        return F.date_format(d, "yyyy")
    raise ValueError(f"unsupported granularity '{granularity}'")


def is_datelike(dtype: DataType) -> bool:
    return isinstance(dtype, (DateType, TimestampType, TimestampNTZType))


def iso_text(c: Column) -> Column:
    """Timestamp as ISO-8601 text the way Python's ``isoformat`` writes it:
    ``YYYY-MM-DDTHH:MM:SS``, plus ``.ffffff`` only when there are microseconds."""
    base = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    return F.when(micros == "000000", base).otherwise(F.concat(base, F.lit("."), micros))
