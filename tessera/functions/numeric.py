"""Numeric coercion as Column expressions (never a Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DataType, DecimalType, DoubleType, FloatType,
                               IntegralType, NumericType, StringType)


# Text that is a number: no type suffix as in ``3F`` or ``12d``, which a cast would take.
NUMBER = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"


def text_to_double(t: Column) -> Column:
    """Trimmed text as double; NULL where it is not a number."""
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def to_double(c: Column, dtype: DataType) -> Column:
    """Value as double when it is a number (numbers, booleans, numeric text);
    NULL otherwise. Dates and timestamps are not numbers here."""
    if isinstance(dtype, (NumericType, BooleanType)):
        return c.cast("double")
    if isinstance(dtype, StringType):
        return text_to_double(F.trim(c))
    return F.lit(None).cast("double")


def is_numeric_type(dtype: DataType) -> bool:
    return isinstance(dtype, (NumericType,))


def is_integral(dtype: DataType) -> bool:
    return isinstance(dtype, IntegralType)


def is_fractional(dtype: DataType) -> bool:
    return isinstance(dtype, (DoubleType, FloatType, DecimalType))
