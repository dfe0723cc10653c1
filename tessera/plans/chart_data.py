"""Chart data from a stored visualization: view -> time profile -> chart transform."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..catalog import Catalog
from ..operators import charts, timeprofile
from .view import compile_view

# Chart types with the config keys that each needs.
REQUIRED = {
    "table": ("visible_columns",),
    "kpi_card": ("value_column", "label"),
    "bar": ("x_column", "y_columns"),
    "line": ("x_column", "y_columns"),
    "pie": ("label_column", "value_column"),
    "scatter": ("x_column", "y_columns"),
    "histogram": ("columns", "bins"),
    "boxplot": ("category_column", "value_column"),
}


class ChartError(ValueError):
    pass


def chart_rows(catalog: Catalog, view: dict, config: dict, start: str | None = None, end: str | None = None,
               granularity: str | None = None, agg: str | None = None) -> DataFrame:
    """The view's rows under the time profile, which applies only where the
    config names a ``date_column``."""
    rows, when = compile_view(catalog, view), config.get("date_column")
    if not when:
        return rows
    rows = timeprofile.time_filter(rows, when, start, end)
    return timeprofile.rebucket(rows, when, granularity, agg or "SUM") if granularity else rows


def chart_data(catalog: Catalog, view: dict, chart_type: str, config: dict, **profile) -> DataFrame:
    """What a chart of ``chart_type`` shows of a view; ``profile`` as in ``chart_rows``."""
    if chart_type not in REQUIRED:
        raise ChartError(f"unknown chart type '{chart_type}'")
    missing = [k for k in REQUIRED[chart_type] if k not in config]
    if missing:
        raise ChartError(f"a {chart_type} chart needs {', '.join(missing)}")
    df, get = chart_rows(catalog, view, config, **profile), config.get
    method = (get("aggregation") or "SUM").upper()
    series = {"cat": get("group_by_column"), "start": get("date_range_start"), "end": get("date_range_end")}
    match chart_type:
        case "table":
            return charts.table_chart(df, get("visible_columns"), get("sort_column"), get("sort_direction") or "asc",
                                      get("page") or 1)
        case "kpi_card":
            return charts.kpi(df, get("value_column"), method)
        case "bar":
            return charts.bar(df, get("x_column"), get("y_columns"), method=method,
                              granularity=get("time_granularity") or get("granularity"), **series)
        case "line":
            return charts.line(df, get("x_column"), get("y_columns"), method=(get("time_aggregation") or method).upper(),
                               granularity=get("time_granularity") or get("granularity") or "none", **series)
        case "pie":
            return charts.pie(df, get("label_column"), get("value_column"), method)
        case "scatter":
            return charts.scatter_sampled(df, get("x_column"), get("y_columns"), get("group_by_column"))
        case "histogram":
            return charts.histogram(df, get("columns"), int(get("bins") or charts.HIST_DEFAULT_BINS))
        case _:
            return charts.boxplot(df, get("value_column"), get("category_column") or None)
