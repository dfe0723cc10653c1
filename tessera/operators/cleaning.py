"""Cleaning steps (C1-C15) and their report.

Every step is ``(df, report) -> df``. Row counts for the report are
attached with ``DataFrame.observe``: they are gathered while the final plan
runs, so reporting adds no extra pass over the data. Only steps that must
decide something from the data before they can build the plan run a job of
their own: dropping empty columns (C3) and choosing a date format (C4), each
one aggregation over all columns at once.

Steps work on business columns only; bookkeeping columns (``_ordinal``,
``_source_file``, ``_reject``) pass through untouched.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import dates

ORDINAL = "_ordinal"
RAW_CELLS = "_cells"            # cells that a row's record had in its file
MORE = "_more"                  # those beyond the header's columns
# bookkeeping columns that ride along with the data but are never cleaned
BOOKKEEPING = ("_ordinal", "_source_file", "_cells", "_more", "_reject", "_action")

# Python's str.strip() whitespace set (Java's \s alone misses
# U+3000 ideographic space and friends), as a character list for trim and
# as a regex class, and the exact null tokens of the strip step.
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")
WS = (r"[\t\n\x0B\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
NULL_TOKENS = ("nan", "null", "None", "")
# Import coercion null tokens (compared case-insensitively after trimming)
COERCE_NULL_TOKENS = ("nan", "null", "none", "")
_ids = itertools.count()


def is_bookkeeping(c: str) -> bool:
    return c in BOOKKEEPING or c.startswith("__")


def business_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not is_bookkeeping(c)]


def q(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


def py_strip(c: Column) -> Column:
    """Python's ``str.strip()``: only the ends are looked at (no regex scan
    over long texts)."""
    return F.trim(c, F.lit(WS_CHARS))


# ---------------------------------------------------------------------------
# C8 report
# ---------------------------------------------------------------------------

@dataclass
class _Step:
    name: str
    before: Observation | int | None
    after: Observation
    modified: str | None = None            # metric name inside ``after``
    dropped_counts_as: str = "rejected"    # rejected | skipped | none
    warnings: list[str] = field(default_factory=list)
    column_metrics: dict[str, str] = field(default_factory=dict)
    fixed_modified: int | None = None


class CleaningReport:
    """Per step: rows before / after / dropped / modified and warnings.

    Read it after one action that runs the cleaned frame once (a write, a
    count, a checkpoint). A global sort on top of the frame runs its input
    twice in one query (sampling + sorting) and would double the counts."""

    def __init__(self):
        self.steps: list[_Step] = []
        self.column_warnings: dict[str, list[str]] = {}
        self._last: Observation | None = None
        self._input: Observation | None = None

    def start(self, df: DataFrame) -> DataFrame:
        obs = Observation(f"clean_in_{next(_ids)}")
        self._input = self._last = obs
        return df.observe(obs, F.count(F.lit(1)).alias("rows"))

    def step(self, df: DataFrame, name: str, modified: Column | None = None,
             dropped_counts_as: str = "rejected", warnings=None,
             column_modified: dict[str, Column] | None = None,
             fixed_modified: int | None = None) -> DataFrame:
        obs = Observation(f"clean_{name}_{next(_ids)}")
        metrics = [F.count(F.lit(1)).alias("rows")]
        if modified is not None:
            metrics.append(F.coalesce(F.sum(modified), F.lit(0)).alias("modified"))
        colm = {}
        for i, (col, expr) in enumerate((column_modified or {}).items()):
            colm[col] = f"c{i}"
            metrics.append(F.coalesce(F.sum(expr), F.lit(0)).alias(f"c{i}"))
        out = df.observe(obs, *metrics)
        self.steps.append(_Step(name, self._last, obs, "modified" if modified is not None else None,
                                dropped_counts_as, list(warnings or []), colm, fixed_modified))
        self._last = obs
        return out

    def rows(self) -> list[dict]:
        """Resolve the observations (after an action on the final frame)."""
        out = []
        for s in self.steps:
            after = s.after.get
            before = s.before.get["rows"] if isinstance(s.before, Observation) else s.before
            mod = after.get(s.modified, 0) if s.modified else (s.fixed_modified or 0)
            dropped = (before or 0) - after["rows"]
            warnings = list(s.warnings)
            for col, metric in s.column_metrics.items():
                n = after.get(metric, 0)
                if n:
                    self.column_warnings.setdefault(col, []).append(f"{n} values trimmed")
            if s.name in ("deduplicate_rows",) and dropped:
                warnings.append(f"{dropped} duplicate rows removed")
            if s.name == "deduplicate_by_key":
                mod, dropped = dropped, 0
                if mod:
                    warnings.append(f"{mod} duplicate key rows collapsed (kept latest)")
            if s.name == "drop_malformed_rows" and dropped:
                warnings.append(f"Dropped {dropped} malformed/split rows")
            out.append({"step": s.name, "rows_before": int(before or 0),
                        "rows_after": int(after["rows"]), "rows_dropped": int(dropped),
                        "rows_modified": int(mod), "warnings": warnings,
                        "dropped_counts_as": s.dropped_counts_as})
        return out

    def to_frame(self, spark) -> DataFrame:
        rows = [(r["step"], r["rows_before"], r["rows_after"], r["rows_dropped"],
                 r["rows_modified"], r["warnings"]) for r in self.rows()]
        return spark.createDataFrame(
            rows, "step string, rows_before long, rows_after long, rows_dropped long, "
                  "rows_modified long, warnings array<string>")

    def totals(self) -> dict:
        """Rows dropped by cleaning: rejected vs skipped (duplicates)."""
        rej = skip = 0
        for r in self.rows():
            if r["step"] == "deduplicate_by_key":
                skip += r["rows_modified"]
            elif r["dropped_counts_as"] == "skipped":
                skip += r["rows_dropped"]
            elif r["dropped_counts_as"] == "rejected":
                rej += r["rows_dropped"]
        return {"rejected": rej, "skipped": skip}


# ---------------------------------------------------------------------------
# C1-C6 common steps
# ---------------------------------------------------------------------------

def strip_whitespace(df: DataFrame, report: CleaningReport) -> DataFrame:
    """Trim every text cell (Unicode whitespace); ``nan``, ``null``,
    ``None`` and empty become NULL. Counts changed cells per column."""
    cols = [f.name for f in df.schema.fields
            if isinstance(f.dataType, StringType) and not is_bookkeeping(f.name)]
    changed = {}
    exprs = {}
    for c in cols:
        s = py_strip(q(c))
        cleaned = F.when(s.isin(*NULL_TOKENS), F.lit(None).cast("string")).otherwise(s)
        exprs[c] = cleaned
        changed[c] = (q(c).isNotNull() & (cleaned.isNull() | (cleaned != q(c)))).cast("int")
    total = sum(changed.values(), F.lit(0)) if changed else F.lit(0)
    # metrics are computed on the input, so observe before replacing values
    marked = df.withColumn("__changed", total)
    for c, e in changed.items():
        marked = marked.withColumn(f"__chg_{c}", e)
    obs_df = report.step(marked, "strip_whitespace", F.col("__changed"), "none",
                         column_modified={c: F.col(f"`__chg_{c}`") for c in changed})
    return obs_df.select(*[exprs[c].alias(c) if c in exprs else q(c) for c in df.columns])


def drop_null_rows(df: DataFrame, report: CleaningReport) -> DataFrame:
    """Drop rows whose business cells are all NULL (counted rejected)."""
    cols = business_columns(df)
    out = df.na.drop(how="all", subset=cols) if cols else df
    return out


def column_stats(df: DataFrame, formats=dates.CLEAN_FORMATS) -> dict:
    """One aggregation pass for C3 and C4: non-null cells per business
    column, and for text columns the cells each date format parses.
    ``{col: {"n": int, fmt: int, ...}}``. Columns are stacked into
    (column, value) rows, so the aggregate has the same handful of
    expressions however wide the file is (partial aggregation leaves one
    row per column and task before the shuffle)."""
    cols = business_columns(df)
    if not cols:
        return {}
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("k"), F.lit(c in text).alias("t"),
                 q(c).cast("string").alias("v")) for c in cols]))
    stacked = df.select(pairs.alias("p")).select("p.k", "p.t", "p.v")
    v, is_text = F.col("v"), F.col("t")
    agg = stacked.groupBy("k").agg(
        F.count(v).alias("n"),
        *[F.count(F.when(is_text, dates.parse_with(v, fmt))).alias(f"p{j}")
          for j, fmt in enumerate(formats)])
    got = {r["k"]: r for r in agg.collect()}
    out = {}
    for c in cols:
        r = got.get(c)
        out[c] = {"n": r["n"] if r else 0}
        if c in text:
            for j, fmt in enumerate(formats):
                out[c][fmt] = r[f"p{j}"] if r else 0
    return out


def drop_null_columns(df: DataFrame, report: CleaningReport | None = None,
                      stats: dict | None = None) -> tuple[DataFrame, int]:
    """Drop columns without any value (one aggregation pass)."""
    cols = business_columns(df)
    if not cols:
        return df, 0
    if stats is None:
        counts = df.agg(*[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
        empty = [c for i, c in enumerate(cols) if counts[f"n{i}"] == 0]
    else:
        empty = [c for c in cols if stats[c]["n"] == 0]
    return (df.drop(*empty) if empty else df), len(empty)


def handle_missing_values(df: DataFrame, report: CleaningReport,
                          stats: dict | None = None) -> DataFrame:
    """C2 + C3 as one report step (like the original)."""
    df = drop_null_rows(df, report)
    df, n_cols = drop_null_columns(df, stats=stats)
    warn = [f"{n_cols} empty columns dropped"] if n_cols else []
    if n_cols:
        report.column_warnings.setdefault("_system", []).append(warn[0])
    return report.step(df, "handle_missing_values", None, "rejected", warn)


def normalize_dates(df: DataFrame, report: CleaningReport, compat: bool = False,
                    min_share: float = 0.5, formats=dates.CLEAN_FORMATS,
                    stats: dict | None = None) -> DataFrame:
    """C4: per text column try the formats in order; the first whose parsed
    count passes the threshold converts the column (cells that do not parse
    become NULL). Threshold: more than ``min_share`` of the non-null cells;
    with ``compat=True`` the original's absolute rule, more than half of
    min(20, non-null cells)."""
    cols = [f.name for f in df.schema.fields
            if isinstance(f.dataType, StringType) and not is_bookkeeping(f.name)]
    chosen: dict[str, str] = {}
    if cols:
        if stats is None or any(fmt not in stats.get(c, {}) for c in cols for fmt in formats):
            stats = column_stats(df.select(*[q(c) for c in cols]), formats)
        for c in cols:
            n = stats[c]["n"]
            if not n:
                continue
            limit = 0.5 * min(20, n) if compat else min_share * n
            for fmt in formats:
                if stats[c][fmt] > limit:
                    chosen[c] = fmt
                    break
    out = df.select(*[dates.parse_with(q(c), chosen[c]).alias(c) if c in chosen else q(c)
                      for c in df.columns])
    return report.step(out, "normalize_formats", None, "none", fixed_modified=len(chosen))


def dedup_rows(df: DataFrame, report: CleaningReport) -> DataFrame:
    """Drop exact duplicates of the business columns (counted skipped).
    A hash aggregate with map-side combine: hot duplicates collapse before
    the shuffle. The earliest ordinal of each group is kept."""
    cols = business_columns(df)
    if ORDINAL in df.columns:
        out = df.groupBy(*[q(c) for c in cols]).agg(F.min(ORDINAL).alias(ORDINAL))
        out = out.select(*[q(c) for c in df.columns if c in cols or c == ORDINAL])
    else:
        out = df.dropDuplicates(cols)
    return report.step(out, "deduplicate_rows", None, "skipped")


def dedup_by_key(df: DataFrame, key: list[str], report: CleaningReport | None = None
                 ) -> DataFrame:
    """One row per key, the last in file order wins; NULL keys are equal
    to each other. ``max_by`` is a partial aggregate, so a hot key collapses
    map-side instead of shipping all its rows to one task."""
    others = [c for c in df.columns if c not in key]
    if ORDINAL not in df.columns:
        raise ValueError("dedup_by_key needs the ingest ordinal column")
    packed = F.struct(*[q(c) for c in others])
    out = (df.groupBy(*[q(k) for k in key])
             .agg(F.max_by(packed, F.col(ORDINAL)).alias("__row"))
             .select(*[q(k) for k in key], "__row.*")
             .select(*[q(c) for c in df.columns]))
    if report is not None:
        out = report.step(out, "deduplicate_by_key", None, "skipped")
    return out


def validate_values(df: DataFrame, report: CleaningReport) -> DataFrame:
    """The original's value-validation step changes nothing; kept as a line."""
    return report.step(df, "validate_values", None, "none")


def clean(df: DataFrame, key: list[str] | None = None, dedup: bool = True,
          compat_dates: bool = False, report: CleaningReport | None = None
          ) -> tuple[DataFrame, CleaningReport]:
    """The common steps in order: C1, C2+C3, C4, then C5 (keyless, dedup on)
    or C6 (keyed), then the validation line."""
    from ..session import balance
    report = report or CleaningReport()
    df = balance(df)
    if report._last is None:
        df = report.start(df)
    df = strip_whitespace(df, report)
    # rows dropped by C2 hold no values, so the statistics of C3 and C4 can
    # be taken in one pass before it
    stats = column_stats(df)
    df = handle_missing_values(df, report, stats)
    df = normalize_dates(df, report, compat=compat_dates, stats=stats)
    if key:
        df = dedup_by_key(df, key, report)
    elif dedup:
        df = dedup_rows(df, report)
    df = validate_values(df, report)
    return df, report


# ---------------------------------------------------------------------------
# C9-C11 structural rules and the rule registry
# ---------------------------------------------------------------------------

_RULES: dict[str, list[Callable]] = {}


def register(table: str):
    """C11: register a structural rule ``(df, report) -> df`` for a table;
    rules run in registration order before header mapping."""
    def deco(fn):
        _RULES.setdefault(table, []).append(fn)
        return fn
    return deco


def rules_for(table: str) -> list[Callable]:
    return list(_RULES.get(table, []))


def apply_rules(df: DataFrame, table: str, report: CleaningReport) -> DataFrame:
    for rule in rules_for(table):
        df = rule(df, report)
    return df


def drop_malformed(df: DataFrame, report: CleaningReport, key_pattern: str,
                   ratio: float = 0.6, columns: list[str] | None = None) -> DataFrame:
    """Drop rows with few cells (at most max(2, floor(ratio x ncols))) or
    whose first cell is not a valid key. A cell that is there but blank counts;
    only cells that the record lacks do not, so the count is that of the scan
    (``_cells``). Frames without it count their non-NULL cells. A frame of one
    row or less is left alone, which is part of the plan and not a job."""
    cols = columns or business_columns(df)
    threshold = max(2, int(len(cols) * ratio))
    if RAW_CELLS in df.columns:
        present = F.least(F.col(RAW_CELLS), F.lit(len(cols)))
    else:
        present = sum([q(c).isNotNull().cast("int") for c in cols], F.lit(0))
    first = py_strip(q(cols[0]))
    bad_key = (first.isNull() | (first == "") | F.lower(first).isin("nan", "null", "none")
               | ~first.rlike(key_pattern))
    many = df.select(F.lit(1).alias("__one")).limit(2).agg(F.count("*") > 1).scalar()
    out = df.filter(~many | ~((present <= threshold) | bad_key))
    return report.step(out, "drop_malformed_rows", None, "rejected")


def merge_overflow(df: DataFrame, report: CleaningReport, expected: int,
                   columns: list[str] | None = None) -> DataFrame:
    """While there are more than ``expected`` columns, append the last
    to the one before it (comma-joined when non-empty), then drop it. A NULL
    left side contributes an empty string (the original wrote ``nan``). Cells
    beyond the header's columns (``_more``) count as columns behind the last."""
    cols = list(columns or business_columns(df))
    rest = [c for c in df.columns if c not in cols and c != MORE]
    beyond = MORE in df.columns and len(cols) >= expected
    if len(cols) <= expected and not beyond:
        return df
    touched = F.lit(False)
    exprs = {c: q(c) for c in cols}
    if beyond:      # up to the last cell that is not blank
        last = F.array_max(F.transform(MORE, lambda c, i: F.when(py_strip(c) != "", i + 1)))
        touched = last.isNotNull()
        kept = F.transform(F.slice(MORE, F.lit(1), F.coalesce(last, F.lit(0))), lambda c: F.coalesce(c, F.lit("")))
        exprs[cols[-1]] = F.when(touched, F.concat_ws(",", F.coalesce(exprs[cols[-1]], F.lit("")), F.array_join(kept, ","))) \
            .otherwise(exprs[cols[-1]])
    elif MORE in df.columns:
        rest.append(MORE)
    while len(cols) > expected:
        last, prev = cols.pop(), cols[-1]
        has = exprs[last].isNotNull() & (py_strip(exprs[last]) != "")
        touched = touched | has
        exprs[prev] = F.when(has, F.concat(F.coalesce(exprs[prev], F.lit("")), F.lit(","),
                                           exprs[last])).otherwise(exprs[prev])
    out = df.select(*[exprs[c].alias(c) for c in cols], *[q(c) for c in rest],
                    touched.cast("int").alias("__merged"))
    out = report.step(out, "fix_extra_trailing_column", F.col("__merged"), "none")
    return out.drop("__merged")
