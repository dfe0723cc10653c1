"""Row content hash (U5) as a Column expression.

The hash must equal the one the original stored, so already-loaded tables
dedup against new files: SHA-256 of ``json.dumps(row, sort_keys=True,
ensure_ascii=False)`` over the business columns. The JSON text is assembled
with Column functions in exactly that layout (``{"a": 1, "b": null}``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DataType, DateType, DecimalType, DoubleType,
                               FloatType, IntegralType, StringType, TimestampNTZType,
                               TimestampType)

from .dates import iso_text


# control characters without a short escape whose \u escape has a hex letter;
# Python writes them in lower case, the JSON writer in upper case
_HEX_LETTER_ESCAPES = [f"\\u{i:04X}" for i in range(0x20)
                       if any(ch in "ABCDEF" for ch in f"{i:04X}") and i not in (0x0A, 0x0C, 0x0D)]


def json_string(c: Column) -> Column:
    """A JSON string literal (quotes and escapes) for text, via ``to_json``,
    written exactly as Python's ``json.dumps(..., ensure_ascii=False)``."""
    out = F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    for esc in _HEX_LETTER_ESCAPES:
        out = F.replace(out, F.lit(esc), F.lit(esc.lower()))
    return out


def py_float_text(c: Column) -> Column:
    """Python ``repr`` of a float for ordinary magnitudes: shortest digits,
    at least one decimal (``100.0``, ``6.55``)."""
    t = F.regexp_replace(c.cast("decimal(38,12)").cast("string"), r"0+$", "")
    return F.regexp_replace(t, r"\.$", ".0")


def json_value(c: Column, dtype: DataType) -> Column:
    if isinstance(dtype, (TimestampNTZType, TimestampType)):
        v = F.concat(F.lit('"'), iso_text(c.cast("timestamp_ntz")), F.lit('"'))
    elif isinstance(dtype, DateType):
        # coercion stores dates as midnight datetimes, as the original did
        v = F.concat(F.lit('"'), iso_text(c.cast("timestamp_ntz")), F.lit('"'))
    elif isinstance(dtype, IntegralType):
        v = c.cast("string")
    elif isinstance(dtype, (DoubleType, FloatType, DecimalType)):
        v = py_float_text(c.cast("double"))
    elif isinstance(dtype, BooleanType):
        v = F.when(c, F.lit("true")).otherwise(F.lit("false"))
    elif isinstance(dtype, StringType):
        v = json_string(c)
    else:
        v = json_string(c.cast("string"))
    return F.when(c.isNull(), F.lit("null")).otherwise(v)


def content_hash(fields: list[tuple[str, DataType]], present: set[str] | None = None) -> Column:
    """SHA-256 hex of the sorted business columns; a column absent from the
    file (not in ``present``) is written as ``null``."""
    parts = []
    for name, dtype in sorted(fields, key=lambda f: f[0]):
        key = '"' + name.replace("\\", "\\\\").replace('"', '\\"') + '": '
        if present is not None and name not in present:
            val = F.lit("null")
        else:
            val = json_value(F.col(f"`{name}`"), dtype)
        parts.append(F.concat(F.lit(key), val))
    body = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    return F.sha2(body, 256)
