"""Chart-data transforms (G1-G22) on a view's DataFrame.

The original ran these in the browser over every fetched row. Here each one
is a DataFrame plan: grouping with partial aggregation, top-k selection via
``TakeOrderedAndProject``, distributed positions for quantiles and sampling.
Only chart-sized output (<= bins, <= 11 categories, <= 2000 points a series)
is meant to leave the cluster. The few driver reads are bounded metadata: at
most 11 category names, two numbers for histogram bounds, 8 pie labels.

Numeric conventions of the original are kept and named:
* ``number_or_zero``: NULL counts as 0, non-numbers are skipped (bar, series,
  KPI card);
* ``number_or_skip``: NULL and non-numbers are skipped (histogram, box-plot,
  KPI tile).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DataType, NumericType, StringType)

from ..functions import dates
from ..functions.numeric import text_to_double
from ..functions.paging import page_of
from ..functions.ranking import POS, SIZE, positions

# Labels and limits of the original chart code.
UNKNOWN = "未知"        # empty / NULL category
OTHER = "其他"          # merged tail of categories / slices
ALL = "全部"            # box-plot group when no category column is set
MAX_CATEGORIES = 10
PIE_MAX_SLICES = 8
MAX_SCATTER_POINTS = 2000
TABLE_PAGE_SIZE = 20
HIST_DEFAULT_BINS, HIST_MAX_BINS = 20, 200
AGGS = ("SUM", "COUNT", "AVG", "MIN", "MAX")


def q(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


def _type(df: DataFrame, c: str) -> DataType:
    return df.schema[c].dataType


# ---------------------------------------------------------------------------
# numeric and category helpers
# ---------------------------------------------------------------------------

def number_or_skip(c: Column, dtype: DataType) -> Column:
    """Value as double; NULL for NULL and for anything that is not a number.
    Blank text counts as 0 (browser ``Number('')``)."""
    if isinstance(dtype, NumericType):
        return c.cast("double")
    if isinstance(dtype, BooleanType):
        return c.cast("double")
    if isinstance(dtype, StringType):
        t = F.trim(c)
        return F.when(t == "", F.lit(0.0)).otherwise(text_to_double(t))
    return F.lit(None).cast("double")


def number_or_zero(c: Column, dtype: DataType) -> Column:
    """Like ``number_or_skip`` but NULL counts as 0 (browser ``Number(null)``)."""
    return F.when(c.isNull(), F.lit(0.0)).otherwise(number_or_skip(c, dtype))


def category(c: Column) -> Column:
    """G1: NULL or empty category -> 未知."""
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(UNKNOWN))


def x_text(c: Column, dtype: DataType) -> Column:
    """X value as text: ISO for timestamps (as the view serialises them)."""
    if dates.is_datelike(dtype):
        return dates.iso_text(c.cast("timestamp_ntz"))
    return F.coalesce(c.cast("string"), F.lit(""))


def _agg(values: Column, method: str, empty_zero: bool = True) -> Column:
    """Aggregate a numeric column; an empty set gives 0 like the browser code."""
    m = method.upper()
    if m not in AGGS:
        raise ValueError(f"unsupported aggregation '{method}'")
    f = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "COUNT": F.count}[m]
    out = f(values)
    if m == "COUNT":
        return out
    return F.coalesce(out, F.lit(0.0)) if empty_zero else out


# ---------------------------------------------------------------------------
# G2 top categories
# ---------------------------------------------------------------------------

def top_categories(df: DataFrame, cat_col: str, n: int = MAX_CATEGORIES,
                   weight: Column | None = None) -> tuple[list[str], bool]:
    """The ``n`` most frequent normalised categories (ties by name) and whether
    a tail exists. A distributed top-k: only n + 1 names reach the driver."""
    counts = df.groupBy(category(q(cat_col)).alias("__cat")).agg(
        (F.sum(weight) if weight is not None else F.count(F.lit(1))).alias("__cnt"))
    top = counts.orderBy(F.desc("__cnt"), F.asc("__cat")).limit(n + 1).collect()
    names = [r["__cat"] for r in top[:n]]
    return sorted(names), len(top) > n


def limit_categories(df: DataFrame, cat_col: str, n: int = MAX_CATEGORIES,
                     weight: Column | None = None) -> tuple[DataFrame, list[str]]:
    """Keep the top-``n`` categories, rename the rest to 其他. Returns the
    frame (category column normalised) and the category list, kept names
    sorted, 其他 last."""
    names, tail = top_categories(df, cat_col, n, weight)
    cat = category(q(cat_col))
    if tail:
        cat = F.when(cat.isin(names), cat).otherwise(F.lit(OTHER))
        names = names + [OTHER]
    return df.withColumn(cat_col, cat), names


# ---------------------------------------------------------------------------
# G3 categorical aggregate, G4-G8 series
# ---------------------------------------------------------------------------

def aggregate_categories(df: DataFrame, x: str, ys: list[str], cat: str | None = None,
                         method: str = "SUM") -> DataFrame:
    """One row per (x, category): COUNT = rows, else the function over the
    y values with NULL as 0 (non-numbers skipped, empty -> 0)."""
    keys = [x_text(q(x), _type(df, x)).alias(x)]
    if cat:
        keys.append(category(q(cat)).alias(cat))
    aggs = []
    for y in ys:
        if method.upper() == "COUNT":
            aggs.append(F.count(F.lit(1)).alias(y))
        else:
            aggs.append(_agg(number_or_zero(q(y), _type(df, y)), method).alias(y))
    return df.groupBy(*keys).agg(*aggs)


def series_rows(df: DataFrame, x: str, start: str | None = None, end: str | None = None,
                is_time: bool | None = None) -> DataFrame:
    """Drop rows without x; for a date x keep [start, end] (inclusive)."""
    t = _type(df, x)
    df = df.filter(q(x).isNotNull() & (q(x).cast("string") != ""))
    if is_time is None:
        is_time = dates.is_datelike(t)
    if not is_time:
        return df
    import datetime as dt
    c = dates.as_timestamp(q(x), t)
    if start:
        df = df.filter(c >= F.lit(dt.date.fromisoformat(start).isoformat()).cast("timestamp_ntz"))
    if end:
        nxt = dt.date.fromisoformat(end) + dt.timedelta(days=1)
        df = df.filter(c < F.lit(nxt.isoformat()).cast("timestamp_ntz"))
    return df


def bucket_series(df: DataFrame, x: str, ys: list[str], granularity: str,
                  method: str = "SUM", cat: str | None = None) -> DataFrame:
    """G5 + G6: one row per (bucket label, category); the function over the y
    values with NULL as 0; COUNT counts numeric-or-NULL cells. Text x that is
    not a date keeps its own text as label. Empty category stays NULL."""
    t = _type(df, x)
    ts = dates.as_timestamp(q(x), t)
    label = F.coalesce(dates.bucket_label(ts, granularity), q(x).cast("string"))
    keys = [label.alias(x)]
    if cat:
        keys.append(F.nullif(q(cat).cast("string"), F.lit("")).alias(cat))
    aggs = []
    for y in ys:
        v = number_or_zero(q(y), _type(df, y))
        aggs.append(_agg(v, method).alias(y))
    return df.groupBy(*keys).agg(*aggs)


def raw_series(df: DataFrame, x: str) -> DataFrame:
    """Rows sorted by x, no aggregation."""
    return df.orderBy(q(x).asc_nulls_last())


def pivot_series(df: DataFrame, x: str, ys: list[str], cat: str, cats: list[str],
                 method: str = "FIRST") -> DataFrame:
    """One row per x, one column ``y||category`` per pair. The frame is
    expected to hold one row per (x, category) (after G3/G5), so FIRST is
    exact; a raw series with repeated cells combines them with ``method``
    (deviation: arrival order is not defined on a cluster). Categories are
    passed explicitly, so no extra pass discovers them."""
    c = category(q(cat))
    key = x_text(q(x), _type(df, x)) if not isinstance(_type(df, x), StringType) else q(x)
    f = {"FIRST": lambda e: F.first(e, ignorenulls=True), "SUM": F.sum, "MAX": F.max,
         "MIN": F.min, "AVG": F.avg, "COUNT": F.count}[method.upper()]
    cells = [f(F.when(c == F.lit(k), q(y))).alias(f"{y}||{k}") for y in ys for k in cats]
    return df.groupBy(key.alias(x)).agg(*cells).orderBy(q(x))


def bar(df: DataFrame, x: str, ys: list[str], cat: str | None = None, method: str = "SUM",
        granularity: str | None = None, start: str | None = None,
        end: str | None = None) -> DataFrame:
    """G4 -> (G5) -> G2 -> G3 -> G8."""
    is_time = dates.is_datelike(_type(df, x))
    rows = series_rows(df, x, start, end, is_time)
    if is_time:
        return _time_series(rows, x, ys, cat, method, granularity or "day")
    if not cat:
        return aggregate_categories(rows, x, ys, None, method).orderBy(q(x))
    limited, cats = limit_categories(rows, cat)
    agg = aggregate_categories(limited, x, ys, cat, method)
    return pivot_series(agg, x, ys, cat, cats)


def line(df: DataFrame, x: str, ys: list[str], cat: str | None = None, method: str = "SUM",
         granularity: str = "none", start: str | None = None,
         end: str | None = None) -> DataFrame:
    """G4 -> (G5 or G7) -> G2 -> G8."""
    is_time = dates.is_datelike(_type(df, x))
    rows = series_rows(df, x, start, end, is_time)
    if is_time and granularity != "none":
        return _time_series(rows, x, ys, cat, method, granularity)
    if not cat:
        return raw_series(rows, x)
    limited, cats = limit_categories(rows, cat)
    return pivot_series(limited, x, ys, cat, cats, method=method)


def _time_series(rows, x, ys, cat, method, granularity):
    """Bucketed series with categories: rank categories by their number of
    bucket rows (as the original does after bucketing), then re-aggregate the
    merged 其他 tail from the raw rows (deviation: the original lets merged
    cells overwrite each other)."""
    bucketed = bucket_series(rows, x, ys, granularity, method, cat)
    if not cat:
        return bucketed
    names, tail = top_categories(bucketed, cat)
    cats = names + ([OTHER] if tail else [])
    if tail:
        keep = category(q(cat))
        rows = rows.withColumn(cat, F.when(keep.isin(names), keep).otherwise(F.lit(OTHER)))
        bucketed = bucket_series(rows, x, ys, granularity, method, cat)
    return pivot_series(bucketed, x, ys, cat, cats)


# ---------------------------------------------------------------------------
# G9 histogram
# ---------------------------------------------------------------------------

def histogram(df: DataFrame, cols: list[str], bins: int = HIST_DEFAULT_BINS) -> DataFrame:
    """Shared equal-width bins over one or more columns, max value in the
    last bin, all-equal data widened by ±0.5, empty bins kept. Columns:
    ``bin``, ``bin_start``, ``bin_end`` and one count per input column."""
    bins = max(1, min(int(bins), HIST_MAX_BINS))
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("col"),
                 F.when(q(c).isNotNull(), number_or_skip(q(c), _type(df, c))).alias("v"))
        for c in cols])).alias("p")).select("p.col", "p.v").filter(F.col("v").isNotNull()
                                                                    & ~F.isnan("v"))
    bounds = long.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    spark = df.sparkSession
    if bounds["lo"] is None:
        schema = "bin long, bin_start double, bin_end double, " + \
            ", ".join(f"`{c}` long" for c in cols)
        return spark.createDataFrame([], schema)
    lo, hi = float(bounds["lo"]), float(bounds["hi"])
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    idx = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
    counts = long.groupBy(idx.alias("bin")).agg(*[
        F.count(F.when(F.col("col") == c, 1)).alias(c) for c in cols])
    frame = spark.range(bins).withColumnRenamed("id", "bin")
    out = frame.join(counts, "bin", "left")
    return out.select(
        F.col("bin"),
        (F.lit(lo) + F.col("bin").cast("double") * F.lit(width)).alias("bin_start"),
        (F.lit(lo) + (F.col("bin") + 1).cast("double") * F.lit(width)).alias("bin_end"),
        *[F.coalesce(q(c), F.lit(0)).cast("long").alias(c) for c in cols]).orderBy("bin")


# ---------------------------------------------------------------------------
# G10/G11 box-plot
# ---------------------------------------------------------------------------

def _box_values(df: DataFrame, value: str, cat: str | None) -> tuple[DataFrame, list | None]:
    """The narrow (category, value) frame. It is re-read by the top-k, the
    counts and the fences; column pruning keeps each re-read to two columns,
    which measured cheaper than materialising it."""
    v = F.when(q(value).isNotNull(), number_or_skip(q(value), _type(df, value)))
    # the single group's label depends on the value column, so the joins
    # with the statistics keep a real equi-join key instead of a constant
    # (a constant key would plan as a nested-loop join)
    label = category(q(cat)) if cat else F.when(v.isNotNull(), F.lit(ALL))
    base = df.select(label.alias("category"),
                     v.alias("value")).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    if not cat:
        return base, None
    names, tail = top_categories(base, "category")
    if tail:                                   # tail categories are dropped
        base = base.filter(F.col("category").isin(names))
    return base, names


QUARTILES = (("q1", 0.25), ("median", 0.5), ("q3", 0.75))
SKETCH = 100_000                                    # accuracy of the sketch that brackets a quartile
SPREADS = (4 / SKETCH, 4e-4, 4e-3, 4e-2, 0.25)      # shares of the rows on either side of it


def _brackets(vals: DataFrame) -> DataFrame:
    """Per category its size and, per quartile, two values with the quartile between
    them and as few others as the sketch allows: one pass, nothing sorted."""
    grid = [round(p + sign * s, 9) for _, p in QUARTILES for s in SPREADS for sign in (-1, 1)]
    found = vals.groupBy("category").agg(F.count(F.lit(1)).alias("count"),
                                         F.percentile_approx("value", grid, SKETCH).alias("__grid"))

    def end(quartile: int, upper: int) -> Column:
        out = F.get("__grid", F.lit(2 * len(SPREADS) * (quartile + 1) - 2 + upper))
        for k in reversed(range(len(SPREADS) - 1)):     # the smallest spread that holds some rows
            out = F.when(F.col("count") * SPREADS[k] >= 4, F.get("__grid", F.lit(2 * (len(SPREADS) * quartile + k) + upper))).otherwise(out)
        return out

    return found.select("category", "count", *[end(k, 0).alias(f"__{n}_low") for k, (n, _) in enumerate(QUARTILES)],
                        *[end(k, 1).alias(f"__{n}_high") for k, (n, _) in enumerate(QUARTILES)])


def _quartiles(vals: DataFrame) -> DataFrame:
    """Exact linear-interpolation quartiles per category by narrowing. A sketch
    brackets each quartile; a second pass counts the rows below each bracket and the
    copies of each value inside, the only values that move. Where the counts show
    that a rank lies outside its bracket, the category's values are ranked in full."""
    from ..session import cut_lineage
    bounds = cut_lineage(_brackets(vals))           # one row per kept category (<= 10)
    near = reduce(lambda a, b: a | b, [F.col("value").between(F.col(f"__{n}_low"), F.col(f"__{n}_high")) for n, _ in QUARTILES])
    below = [F.count_if(F.col("value") < F.col(f"__{n}_low")).alias(f"__{n}_below") for n, _ in QUARTILES]
    counted = cut_lineage(vals.join(F.broadcast(bounds), "category")
                          .groupBy("category", F.when(near, F.col("value")).alias("value"))
                          .agg(F.count(F.lit(1)).alias("copies"), *below))
    sizes = counted.groupBy("category").agg(*[F.sum(f"__{n}_below").alias(f"__{n}_below") for n, _ in QUARTILES])
    ends = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("p"), F.col(f"__{n}_low").alias("low"),
                                        F.col(f"__{n}_high").alias("high"), F.col(f"__{n}_below").alias("below"))
                               for n, p in QUARTILES])).alias("b")
    brackets = bounds.join(sizes, "category").select("category", "count", ends).select("category", "count", "b.*")
    inside = (counted.filter("value IS NOT NULL").select("category", "value", "copies")
              .join(F.broadcast(brackets), "category").filter(F.col("value").between(F.col("low"), F.col("high"))))
    first = F.col("below") + F.sum("copies").over(Window.partitionBy("category", "name").orderBy("value")) - F.col("copies")
    at = (F.col("count") - 1).cast("double") * F.col("p")
    ranked = inside.withColumn("first", first)

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("first") <= rank) & (rank < F.col("first") + F.col("copies")), F.col("value")))

    found = (ranked.groupBy("category", "name").agg(F.first("count").alias("count"), value_at(F.floor(at)).alias("low"),
                                                    value_at(F.ceil(at)).alias("high"), F.first(at - F.floor(at)).alias("part"))
             .groupBy("category").agg(F.first("count").alias("count"), *[
                 F.max(F.when(F.col("name") == n, F.col("low") + (F.col("high") - F.col("low")) * F.col("part"))).alias(n)
                 for n, _ in QUARTILES]))
    found = cut_lineage(bounds.select("category").join(found, "category", "left"))
    missed = reduce(lambda a, b: a | b, [F.col(n).isNull() for n, _ in QUARTILES])
    rest = [r["category"] for r in found.filter(missed).select("category").collect()]
    if not rest:
        return found
    return found.filter(~missed).unionByName(_ranked_quartiles(vals.filter(F.col("category").isin(rest))))


def _ranked_quartiles(vals: DataFrame) -> DataFrame:
    """The same from the positions of all distinct values. Equal values are
    counted first, so ties fold before the shuffle; the distinct ones get the
    positions their copies take, and the few around each quartile are kept."""
    distinct = vals.groupBy("category", "value").agg(F.count(F.lit(1)).alias("copies"))
    ranked = positions(distinct, ["category"], [F.col("value")], weight="copies")

    def holds(at: Column) -> Column:
        return (F.col(POS) <= at) & (at < F.col(POS) + F.col("copies"))

    at = {name: (F.col(SIZE) - 1).cast("double") * F.lit(p) for name, p in QUARTILES}
    near = ranked.filter(reduce(lambda a, b: a | b, [holds(f(x)) for x in at.values() for f in (F.floor, F.ceil)]))
    aggs = [F.first(SIZE).alias("count")]
    for name, x in at.items():
        low = F.max(F.when(holds(F.floor(x)), F.col("value")))
        high = F.max(F.when(holds(F.ceil(x)), F.col("value")))
        aggs.append((low + (high - low) * F.first(x - F.floor(x))).alias(name))
    return near.groupBy("category").agg(*aggs)


def boxplot(df: DataFrame, value: str, cat: str | None = None) -> DataFrame:
    """Per category count, q1, median, q3 and whiskers (extreme values
    inside q1 - 1.5 IQR .. q3 + 1.5 IQR; q1/q3 when none). Top 10 categories
    by count, or one group 全部."""
    from ..session import cut_lineage
    vals, _ = _box_values(df, value, cat)
    # <= 10 rows read twice: materialised so the quartile job runs once
    stats = cut_lineage(_quartiles(vals))
    fenced = _with_fences(vals, stats)
    inl = fenced.filter(~F.col("__out")).groupBy("category").agg(
        F.min("value").alias("__lo"), F.max("value").alias("__hi"))
    return (stats.join(inl, "category", "left")
            .select("category", "count", "q1", "median", "q3",
                    F.coalesce("__lo", "q1").alias("whisker_low"),
                    F.coalesce("__hi", "q3").alias("whisker_high")))


def _with_fences(vals: DataFrame, stats: DataFrame) -> DataFrame:
    # stats has one row per kept category (<= 10): a bounded broadcast
    s = F.broadcast(stats.select("category", "q1", "q3"))
    iqr = F.col("q3") - F.col("q1")
    low, high = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    return vals.join(s, "category").withColumn(
        "__out", (F.col("value") < low) | (F.col("value") > high))


def boxplot_outliers(df: DataFrame, value: str, cat: str | None = None) -> DataFrame:
    """The values outside the fences, as a long (category, value) frame."""
    from ..session import cut_lineage
    vals, _ = _box_values(df, value, cat)
    stats = cut_lineage(_quartiles(vals))
    return _with_fences(vals, stats).filter("__out").select("category", "value")


# ---------------------------------------------------------------------------
# G12/G22 pie
# ---------------------------------------------------------------------------

def pie(df: DataFrame, label: str, value: str, method: str = "SUM") -> DataFrame:
    """Aggregate per label (NULL -> 未知; non-numbers and NULL count as
    0; COUNT = rows), largest 8 slices kept, the rest summed into 其他
    (summed even for AVG/MIN/MAX, like the original). Ties by label."""
    lab = F.coalesce(q(label).cast("string"), F.lit(UNKNOWN))
    v = F.coalesce(number_or_skip(q(value), _type(df, value)), F.lit(0.0))
    m = method.upper()
    agg = F.count(F.lit(1)).cast("double") if m == "COUNT" else _agg(v, m)
    slices = df.groupBy(lab.alias("name")).agg(agg.alias("value"))
    top = slices.orderBy(F.desc("value"), F.asc("name")).limit(PIE_MAX_SLICES + 1).collect()
    if len(top) <= PIE_MAX_SLICES:
        return slices
    names = [r["name"] for r in top[:PIE_MAX_SLICES]]
    head = slices.filter(F.col("name").isin(names))
    rest = slices.filter(~F.col("name").isin(names)).agg(F.sum("value").alias("value")) \
        .select(F.lit(OTHER).alias("name"), "value")
    return head.unionByName(rest)


def pie_share(slices: DataFrame, hidden: tuple[str, ...] = ()) -> DataFrame:
    """Each visible slice as percent of the visible total (1 decimal).
    The slice frame has at most 9 rows, so the empty-window total is safe."""
    vis = slices.filter(~F.col("name").isin(list(hidden))) if hidden else slices
    total = F.sum("value").over(Window.partitionBy())
    share = (F.col("value") / total * 100).cast("decimal(38,6)")
    return vis.withColumn("share", F.round(share, 1).cast("double"))


# ---------------------------------------------------------------------------
# G13-G15 KPI
# ---------------------------------------------------------------------------

def kpi_tile(df: DataFrame, column: str, method: str = "SUM") -> DataFrame:
    """One row ``value``: the function over finite numeric non-null
    values; COUNT = all rows; NULL when nothing is numeric."""
    m = method.upper()
    if m == "COUNT":
        return df.agg(F.count(F.lit(1)).cast("double").alias("value"))
    v = number_or_skip(q(column), _type(df, column))
    v = F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)
    return df.agg(_agg(v, m, empty_zero=False).alias("value"))


def kpi(df: DataFrame, column: str, method: str = "SUM") -> DataFrame:
    """KPI card without a date: NULL as 0, non-numbers skipped, 0 when
    empty; COUNT = numeric-or-NULL rows."""
    v = number_or_zero(q(column), _type(df, column))
    m = method.upper()
    agg = F.count(v).cast("double") if m == "COUNT" else _agg(v, m)
    return df.agg(agg.alias("value"))


def _period_key(ts: Column, granularity: str) -> Column:
    fmt = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}.get(granularity)
    if fmt is None:
        raise ValueError(f"unsupported KPI granularity '{granularity}'")
    return F.date_format(ts, fmt)


def kpi_change(df: DataFrame, column: str, method: str, date_column: str,
               granularity: str = "day") -> DataFrame:
    """Value of the latest period with data, % change against the
    previous calendar period and against the same period a year earlier;
    NULL when that period has no rows or a value of 0. One row:
    ``period, value, prev_change, year_ago_change``."""
    t = _type(df, date_column)
    ts = dates.as_timestamp(q(date_column), t)
    v = number_or_zero(q(column), _type(df, column))
    m = method.upper()
    per = (df.select(_period_key(ts, granularity).alias("period"), v.alias("__v"))
             .filter(F.col("period").isNotNull())
             .groupBy("period").agg(
                 (F.count(F.col("__v")).cast("double") if m == "COUNT"
                  else _agg(F.col("__v"), m)).alias("value")))
    cur = per.agg(F.max("period").alias("period"))        # one row
    if granularity == "day":
        d = F.to_date("period")
        prev = F.date_format(F.date_sub(d, 1), "yyyy-MM-dd")
        # a year back; 29 Feb rolls over to 1 Mar like a calendar widget
        ya = F.when((F.month(d) == 2) & (F.dayofmonth(d) == 29),
                    F.make_date(F.year(d) - 1, F.lit(3), F.lit(1))) \
              .otherwise(F.make_date(F.year(d) - 1, F.month(d), F.dayofmonth(d)))
        ya = F.date_format(ya, "yyyy-MM-dd")
    elif granularity == "month":
        d = F.to_date(F.concat("period", F.lit("-01")))
        prev = F.date_format(F.add_months(d, -1), "yyyy-MM")
        ya = F.date_format(F.add_months(d, -12), "yyyy-MM")
    else:
        prev = ya = (F.col("period").cast("int") - 1).cast("string")
    cur = cur.select("period", prev.alias("__prev"), ya.alias("__ya"))
    p_cur = per.select(F.col("period"), F.col("value"))
    p_prev = per.select(F.col("period").alias("__prev"), F.col("value").alias("__pv"))
    p_ya = per.select(F.col("period").alias("__ya"), F.col("value").alias("__yv"))
    out = cur.join(p_cur, "period").join(p_prev, "__prev", "left").join(p_ya, "__ya", "left")

    def pct(base):
        return F.when(F.col(base).isNotNull() & (F.col(base) != 0),
                      (F.col("value") - F.col(base)) / F.col(base) * 100)
    return out.select("period", "value", pct("__pv").alias("prev_change"),
                      pct("__yv").alias("year_ago_change"))


# ---------------------------------------------------------------------------
# G16/G17 scatter with stride sampling
# ---------------------------------------------------------------------------

def column_is_numeric(df: DataFrame, column: str) -> bool:
    t = _type(df, column)
    if isinstance(t, (NumericType, BooleanType)):
        return True
    if not isinstance(t, StringType):
        return False
    v = number_or_skip(q(column), t)
    row = df.filter(q(column).isNotNull()).agg(
        F.bool_and(v.isNotNull()).alias("ok"), F.count(F.lit(1)).alias("n")).first()
    return bool(row["n"]) and bool(row["ok"])


def scatter(df: DataFrame, x: str, ys: list[str], cat: str | None = None) -> DataFrame:
    """One point set per (y column, category) as a long frame
    ``series, category, x, y``; rows with a non-numeric y are dropped, and rows
    with a non-numeric x when x is numeric. Categories: top 10 + 其他."""
    x_num = column_is_numeric(df, x)
    if cat:
        df, _ = limit_categories(df, cat)
    xt = _type(df, x)
    xv = number_or_zero(q(x), xt) if x_num else x_text(q(x), xt)
    parts = []
    for y in ys:
        yv = F.when(q(y).isNotNull(), number_or_skip(q(y), _type(df, y)))
        parts.append(df.select(F.lit(y).alias("series"),
                               (category(q(cat)) if cat else F.lit("")).alias("category"),
                               xv.alias("x"), yv.alias("y")))
    pts = reduce(DataFrame.unionByName, parts).filter(F.col("y").isNotNull() & ~F.isnan("y"))
    if x_num:
        pts = pts.filter(F.col("x").isNotNull() & ~F.isnan("x"))
    return pts


def stride_sample(points: DataFrame, series_cols: list[str], order: list[Column],
                  limit: int = MAX_SCATTER_POINTS) -> DataFrame:
    """Per series keep rows ``floor(i * n / limit)`` for i < limit (all
    rows when n <= limit). Positions come from ``positions`` (no global
    window); the stride test uses the same double arithmetic as the original."""
    ranked = positions(points, series_cols, order)
    n = F.col(SIZE).cast("double")
    stride = n / F.lit(float(limit))
    p = F.col(POS)
    i1 = F.floor(p.cast("double") / stride)
    hit = reduce(lambda a, b: a | b, [
        (i < limit) & (F.floor(i.cast("double") * stride) == p) for i in (i1 - 1, i1, i1 + 1)])
    keep = (F.col(SIZE) <= limit) | hit
    return ranked.filter(keep).drop(POS, SIZE)


def scatter_sampled(df: DataFrame, x: str, ys: list[str], cat: str | None = None,
                    limit: int = MAX_SCATTER_POINTS) -> DataFrame:
    """G16 + G17: points ordered by (x, y) inside each series, then sampled."""
    pts = scatter(df, x, ys, cat)
    return stride_sample(pts, ["series", "category"], [F.col("x"), F.col("y")], limit)


# ---------------------------------------------------------------------------
# G18 table chart, G19 column kinds
# ---------------------------------------------------------------------------

def table_chart(df: DataFrame, cols: list[str] | None = None, sort: str | None = None,
                direction: str = "asc", page: int = 1) -> DataFrame:
    """Chosen columns, one sort column with NULLs last both ways, pages
    of 20 (every column as a tie-break so pages are stable)."""
    cols = cols or df.columns
    out = df.select(*[q(c) for c in cols])
    keys = []
    if sort:
        keys.append(q(sort).desc_nulls_last() if direction == "desc" else q(sort).asc_nulls_last())
    keys += [q(c).asc_nulls_last() for c in cols]
    return page_of(out, keys, (max(1, page) - 1) * TABLE_PAGE_SIZE, TABLE_PAGE_SIZE)


ISO_PREFIX = r"^\d{4}-\d{2}-\d{2}"


def column_kinds(df: DataFrame) -> DataFrame:
    """``column, kind`` with kind number / date / text. Typed columns
    answer from the schema; text columns are numbers (or dates) when every
    non-null value parses, checked in one aggregation pass over all columns."""
    checks, typed = [], {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (NumericType,)):
            typed[f.name] = "number"
        elif dates.is_datelike(f.dataType):
            typed[f.name] = "date"
        elif isinstance(f.dataType, StringType):
            c = q(f.name)
            nn = c.isNotNull()
            checks += [
                F.coalesce(F.bool_and(F.when(nn, number_or_skip(c, f.dataType).isNotNull())),
                           F.lit(False)).alias(f"n::{f.name}"),
                F.coalesce(F.bool_and(F.when(nn, c.rlike(ISO_PREFIX))), F.lit(False))
                .alias(f"d::{f.name}"),
            ]
        else:
            typed[f.name] = "text"
    spark = df.sparkSession
    typed_df = spark.createDataFrame([(k, v) for k, v in typed.items()],
                                     "column string, kind string")
    if not checks:
        return typed_df
    flags = df.agg(*checks)
    text_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    rows = [F.struct(F.lit(n).alias("column"),
                     F.when(F.col(f"`n::{n}`"), "number").when(F.col(f"`d::{n}`"), "date")
                     .otherwise("text").alias("kind")) for n in text_cols]
    return flags.select(F.explode(F.array(*rows)).alias("r")).select("r.*").unionByName(typed_df)
