"""Pages of a sorted frame.

The first rows of an order are a top-k, which tasks cut down before anything moves.
A page far behind the start is not: ``offset + limit`` rows would meet in one task to
throw all but the last few away. Such a page is found by position: rows are dealt to
sorted slices by their keys, the rows of each slice are counted, and only rows whose
exact position lies in the page leave their slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import POS, SIZE, positions

NEAR = 10_000       # rows up to the end of the page that one task may hold


def page_of(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows ``offset .. offset + limit - 1`` of ``df`` in ``order``, in that order."""
    if offset + limit <= NEAR:
        return df.orderBy(*order).offset(offset).limit(limit)
    placed = positions(df, [], order)
    page = placed.filter((F.col(POS) >= offset) & (F.col(POS) < offset + limit))
    return page.orderBy(POS).drop(POS, SIZE)
