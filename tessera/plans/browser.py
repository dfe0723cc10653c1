"""Table browser (B1-B4): date window, column filters, sort, page + total."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType

from ..functions import dates
from ..functions.paging import page_of
from ..model import HIDDEN_COLUMNS

PAGE_MAX = 200
ISO_DATETIME = "yyyy-MM-dd'T'HH:mm:ss"


class BrowseError(ValueError):
    pass


def _day(s: str, what: str) -> dt.date:
    try:
        return dt.date.fromisoformat(s)
    except ValueError as e:
        raise BrowseError(f"invalid {what} date '{s}', use YYYY-MM-DD") from e


def browse_frame(df: DataFrame, *, datetime_col: str | None = None, start: str | None = None,
                 end: str | None = None, filters=(), ) -> DataFrame:
    """B1 + B2: the filtered table with hidden columns removed (unsorted)."""
    visible = [c for c in df.columns if c not in HIDDEN_COLUMNS]
    types = {f.name: f.dataType for f in df.schema.fields}
    if datetime_col and (start or end) and isinstance(types.get(datetime_col),
                                                       (TimestampType, TimestampNTZType)):
        c = F.col(f"`{datetime_col}`")
        kind = "timestamp_ntz" if isinstance(types[datetime_col], TimestampNTZType) else "timestamp"
        # date(c) >= start  <=>  c >= start 00:00 ; date(c) <= end <=> c < end+1 00:00
        if start:
            df = df.filter(c >= F.lit(_day(start, "start").isoformat()).cast(kind))
        if end:
            nxt = _day(end, "end") + dt.timedelta(days=1)
            df = df.filter(c < F.lit(nxt.isoformat()).cast(kind))
    for f in filters:
        name, value = f[0], f[1]
        mode = f[2] if len(f) > 2 else "contains"
        if name not in visible or value is None or not str(value).strip():
            continue
        value = str(value).strip()
        c = F.col(f"`{name}`")
        if mode == "exact":
            lit = F.lit(value)
            if not isinstance(types[name], StringType):
                lit = lit.cast(types[name])
            df = df.filter(c == lit)
        else:
            text = c if isinstance(types[name], StringType) else c.cast("string")
            df = df.filter(text.like(f"%{value}%"))
    return df.select(*[F.col(f"`{c}`") for c in visible])


def browse(df: DataFrame, *, page: int = 1, size: int = 20, sort_col: str | None = None,
           sort_dir: str | None = None, iso_dates: bool = True, **kw) -> DataFrame:
    """One page. Sort on one visible column (``desc`` or else asc,
    NULLs last ascending / first descending), then every visible column as
    a tie-break so pages are stable. Dates become ISO text."""
    if page < 1 or not 1 <= size <= PAGE_MAX:
        raise BrowseError(f"page must be >= 1 and size within 1..{PAGE_MAX}")
    df = browse_frame(df, **kw)
    keys = []
    if sort_col and sort_col in df.columns:
        c = F.col(f"`{sort_col}`")
        keys.append(c.desc_nulls_first() if sort_dir == "desc" else c.asc_nulls_last())
    keys += [F.col(f"`{c}`").asc_nulls_last() for c in df.columns]
    out = page_of(df, keys, (page - 1) * size, size)
    if iso_dates:
        out = out.select(*[_iso(f) for f in out.schema.fields])
    return out


def browse_total(df: DataFrame, **kw) -> DataFrame:
    """Total rows after B1/B2, as a one-row frame."""
    return browse_frame(df, **kw).agg(F.count(F.lit(1)).alias("total"))


def _iso(field):
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (TimestampType, TimestampNTZType)):
        return dates.iso_text(c).alias(field.name)
    if isinstance(field.dataType, DateType):
        return F.date_format(c, "yyyy-MM-dd").alias(field.name)
    return c
