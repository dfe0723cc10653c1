"""Structural rules of tables whose exports break.

These exports write a remark as it was typed: its commas make cells beyond the header,
its line breaks make rows that begin in the middle of a record. Such rows go and count
as rejected, since nothing tells which record they belong to; cells beyond the header
go back into the last column. Another table gets its rules by ``for_export``, or by
``cleaning.register`` if it needs others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .cleaning import CleaningReport, drop_malformed, merge_overflow, register

# The cells of a whole record, and how a record's number may begin
# (nothing: rows are not judged by it).
EXPORTS = {
    "refund_orders": (18, ("RB", "RE", "RF")),
    "service_refund_work_orders": (28, ("GD", "GDC", "TS")),
    "wallet_withdrawals": (8, ()),
}


def for_export(table: str, cells: int, prefixes: tuple[str, ...] = ()) -> None:
    """Register the rules of an export: broken rows go first, so that only whole
    records are joined up."""
    if prefixes:
        number = "^(" + "|".join(prefixes) + r")\d+$"

        @register(table)
        def whole_records(df: DataFrame, report: CleaningReport) -> DataFrame:
            return drop_malformed(df, report, number)

    @register(table)
    def remark_in_one_cell(df: DataFrame, report: CleaningReport) -> DataFrame:
        return merge_overflow(df, report, cells)


for _table, (_cells, _prefixes) in EXPORTS.items():
    for_export(_table, _cells, _prefixes)
