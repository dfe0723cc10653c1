"""Coercion, rejection, change detection and merge.

Rows that cannot be written carry a reason in ``_reject`` instead of being
dropped on the spot, so one plan yields both the good rows and the reject
log. Matching a file against its target is one join on the key (the original
looked keys up per 500-row batch); adaptive execution picks its form from the
bytes of both sides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import dates
from ..functions.hashing import content_hash
from ..functions.numeric import text_to_double
from ..model import ColumnSpec, TableSpec
from .cleaning import COERCE_NULL_TOKENS, ORDINAL, is_bookkeeping, py_strip, q

REJECT = "_reject"
ACTION = "_action"
IMPORTED_AT = "imported_at"


def _reason(cond: Column, reason: Column | str) -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.when(cond, reason)


def _add_reason(df: DataFrame, cond: Column, reason: Column | str) -> DataFrame:
    """Keep the first reason a row got. ``coalesce`` mentions the previous
    reason once, so chained checks stay linear in size after Catalyst
    inlines them (a when/otherwise would double it at every step)."""
    cur = F.col(REJECT) if REJECT in df.columns else F.lit(None).cast("string")
    return df.withColumn(REJECT, F.coalesce(cur, _reason(cond, reason)))


# ---------------------------------------------------------------------------
# C12-C15
# ---------------------------------------------------------------------------

def coerce_column(t: Column, raw: Column, raw_type, col: ColumnSpec) -> tuple[Column, Column]:
    """(typed value, failure flag) from ``t``, the cell as trimmed text. Null
    tokens (any case) become NULL; integers go through a double and truncate
    toward zero; dates try the four import formats; a value that parses but
    does not fit the column (too big, not a boolean, invalid JSON) is
    flagged, as the database refused it."""
    is_null = t.isNull() | F.lower(t).isin(*COERCE_NULL_TOKENS)
    nothing = F.lit(False)
    kind = col.type
    if kind in ("Integer", "BigInteger"):
        d = text_to_double(t)
        finite = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))
        v = F.when(finite, d.try_cast("bigint" if kind == "BigInteger" else "int"))
        fail = finite & v.isNull()
    elif kind == "Numeric":
        d = text_to_double(t)
        v = d.try_cast(col.spark_type())
        fail = d.isNotNull() & v.isNull()
    elif kind in ("DateTime", "Date"):
        ts = raw if raw_type.typeName() in ("timestamp", "timestamp_ntz") else \
            dates.parse_multi(t, dates.COERCE_FORMATS)
        ts = ts.cast("timestamp_ntz")
        v = ts if kind == "DateTime" else ts.cast("date")
        fail = nothing
    elif kind == "Boolean":
        v = t.try_cast("boolean")
        fail = t.isNotNull() & v.isNull()
    elif kind == "JSON":
        v = t
        fail = t.isNotNull() & F.try_parse_json(t).isNull()
    else:
        v = t
        fail = nothing
    v = F.when(is_null, F.lit(None)).otherwise(v).cast(col.spark_type())
    return v, (~is_null) & fail


def coerce(df: DataFrame, spec: TableSpec) -> DataFrame:
    """C12 + C13 + C14: typed columns (only those present in the frame),
    strings cut to their declared length, and reject reasons for values
    that do not fit and for NULLs in required columns. The trimmed text of
    each cell is computed once in its own projection and then reused, which
    keeps the generated code of the typing step small."""
    present = [c for c in spec.columns if c.name in df.columns]
    types = {f.name: f.dataType for f in df.schema.fields}
    staged = df.select("*", *[
        py_strip(q(c.name) if isinstance(types[c.name], StringType)
                 else q(c.name).cast("string")).alias(f"__t_{c.name}") for c in present])
    typed, fails = {}, {}
    for c in present:
        v, fail = coerce_column(F.col(f"`__t_{c.name}`"), q(c.name), types[c.name], c)
        if c.type == "String" and c.length:                       # C13
            v = F.substring(v, 1, c.length)
        typed[c.name], fails[c.name] = v, fail
    out = staged.select(*[typed[n].alias(n) if n in typed else q(n) for n in df.columns],
                        *[f.alias(f"__fail_{n}") for n, f in fails.items()])
    reasons = [_reason(F.col(f"`__fail_{n}`"), f"value does not fit column {n}")
               for n in fails]
    reasons += [_reason(q(c.name).isNull(), f"required value missing: {c.name}")  # C14
                for c in present if not c.nullable]
    cur = [F.col(REJECT)] if REJECT in out.columns else []
    out = out.withColumn(REJECT, F.coalesce(*cur, *reasons, F.lit(None).cast("string")))
    return out.drop(*[f"__fail_{n}" for n in fails])


def reject_null_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """A NULL in any key column rejects the row."""
    cond = reduce(lambda a, b: a | b, [q(k).isNull() for k in key])
    return _add_reason(df, cond, "key value missing")


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(REJECT).isNull()), df.filter(F.col(REJECT).isNotNull())


# ---------------------------------------------------------------------------
# U2-U4 classify and merge
# ---------------------------------------------------------------------------

def same_value(a: Column, b: Column, dtype) -> Column:
    """U2 equality: NULL-safe, empty text equals NULL. Both sides already
    carry the target type, so numbers compare by value and dates by date."""
    if isinstance(dtype, StringType):
        a, b = F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))
    return a.eqNullSafe(b)


def has_changes(update_cols: list[str], types: dict, src="s", tgt="t") -> Column:
    """Any file column (other than the key) differs from the stored row."""
    if not update_cols:
        return F.lit(False)
    diffs = [~same_value(F.col(f"{src}.`{c}`"), F.col(f"{tgt}.`{c}`"), types[c])
             for c in update_cols]
    return reduce(lambda a, b: a | b, diffs)


def classify(src: DataFrame, tgt: DataFrame, key: list[str], carry: str | None = None) -> DataFrame:
    """``_action`` = insert (no stored row), update (stored row differs
    in a file column) or skip (identical). One join on the key with the target
    cut to the key and the compared columns; how to join is left to adaptive
    execution, which knows the bytes of both sides. ``carry`` names one more
    column of the target to return, such as the file that holds the row."""
    update_cols = [c for c in src.columns
                   if c not in key and not is_bookkeeping(c) and c in tgt.columns
                   and c != IMPORTED_AT]
    types = {f.name: f.dataType for f in tgt.schema.fields}
    t = tgt.select(*[q(k) for k in key], *[q(c) for c in update_cols], F.lit(True).alias("__hit"),
                   *([q(carry)] if carry else [])).alias("t")
    s = src.alias("s")
    cond = reduce(lambda a, b: a & b, [F.col(f"s.`{k}`") == F.col(f"t.`{k}`") for k in key])
    action = (F.when(F.col("t.__hit").isNull(), F.lit("insert"))
               .when(has_changes(update_cols, types), F.lit("update"))
               .otherwise(F.lit("skip")))
    return s.join(t, cond, "left").select(*[F.col(f"s.`{c}`") for c in src.columns], action.alias(ACTION),
                                        *([F.col(f"t.`{carry}`")] if carry else []))


def merge(classified: DataFrame, tgt: DataFrame, key: list[str], spec: TableSpec | None = None,
          now: Column | None = None) -> DataFrame:
    """U4 (+U11): the new table. Updated rows take the file's columns and
    keep the others; inserted rows take defaults for columns the file lacks;
    ``imported_at`` is refreshed on both. The target is read once: one left
    join with the updates, to which the inserts are appended."""
    now = now if now is not None else F.localtimestamp().cast("timestamp_ntz")
    file_cols = [c for c in classified.columns if not is_bookkeeping(c)]
    upd = classified.filter(F.col(ACTION) == "update").withColumn("__hit", F.lit(True)).alias("u")
    ins = fill_defaults(classified.filter(F.col(ACTION) == "insert"), tgt, spec, now)
    cond = reduce(lambda a, b: a & b, [F.col(f"t.`{k}`") == F.col(f"u.`{k}`") for k in key])

    def new_value(f) -> Column:
        old = F.col(f"t.`{f.name}`")
        if f.name in file_cols:
            return F.when(F.col("u.__hit"), F.col(f"u.`{f.name}`").cast(f.dataType)).otherwise(old)
        if f.name == IMPORTED_AT:
            return F.when(F.col("u.__hit"), now.cast(f.dataType)).otherwise(old)
        return old

    kept = tgt.alias("t").join(upd, cond, "left").select(*[new_value(f).alias(f.name) for f in tgt.schema.fields])
    return kept.unionByName(ins)


def fill_defaults(rows: DataFrame, tgt: DataFrame, spec: TableSpec | None,
                  now: Column | None = None) -> DataFrame:
    """Columns the file lacks take their declared default (or NULL);
    the frame is brought to the target's columns and types."""
    now = now if now is not None else F.localtimestamp().cast("timestamp_ntz")
    out = []
    for f in tgt.schema.fields:
        if f.name in rows.columns and not is_bookkeeping(f.name):
            out.append(q(f.name).cast(f.dataType).alias(f.name))
        elif f.name == IMPORTED_AT:
            out.append(now.cast(f.dataType).alias(f.name))
        else:
            default = None
            if spec is not None:
                try:
                    default = spec.column(f.name).default
                except KeyError:
                    default = None
            out.append(F.lit(default).cast(f.dataType).alias(f.name))
    return rows.select(*out)


# ---------------------------------------------------------------------------
# U5-U7 keyless tables
# ---------------------------------------------------------------------------

def with_content_hash(df: DataFrame, spec: TableSpec) -> DataFrame:
    """``content_hash`` over all business columns of the spec (columns
    missing from the file count as NULL)."""
    business = [c for c in spec.columns if c.name not in ("id", "imported_at", "created_at",
                                                          "content_hash")]
    from pyspark.sql.types import _parse_datatype_string as parse
    fields = [(c.name, parse(c.spark_type())) for c in business]
    return df.withColumn("content_hash", content_hash(fields, set(df.columns)))


def insert_new(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Rows whose hash is neither in the target nor earlier in the file."""
    firsts = src.groupBy("content_hash").agg(F.min(ORDINAL).alias(ORDINAL))
    uniq = src.join(firsts, ["content_hash", ORDINAL], "left_semi")
    return uniq.join(tgt.select("content_hash"), "content_hash", "left_anti")


def append(src: DataFrame, tgt: DataFrame, spec: TableSpec | None = None) -> DataFrame:
    """Keyless table without dedup: every row goes in."""
    return tgt.unionByName(fill_defaults(src, tgt, spec))


# ---------------------------------------------------------------------------
# U8-U10 integrity
# ---------------------------------------------------------------------------

def reject_fk(df: DataFrame, col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """U8: a value missing in the parent rejects the row; NULL passes. The
    parent keys are de-duplicated first so the join cannot multiply rows."""
    pk = parent.select(q(parent_col).alias("__fk")).distinct().withColumn("__fk_ok", F.lit(True))
    j = df.join(pk, q(col) == F.col("__fk"), "left")
    j = _add_reason(j, q(col).isNotNull() & F.col("__fk_ok").isNull(),
                    F.concat(F.lit(f"foreign key {col}="), q(col).cast("string"),
                             F.lit(" not present in parent")))
    return j.drop("__fk", "__fk_ok")


def reject_unique(df: DataFrame, tgt: DataFrame, col: str, key: list[str]) -> DataFrame:
    """A non-key unique column. In the file, the first row (by ordinal)
    of a value wins and later ones are rejected; a value already stored
    under another key is rejected too. First rows come from a partial
    aggregate (skew-safe), not from a window over the value."""
    live = df.filter(F.col(REJECT).isNull() & q(col).isNotNull())
    first = live.groupBy(q(col).alias("__v")).agg(F.min(ORDINAL).alias("__first"))
    out = df.join(first, q(col) == F.col("__v"), "left")
    out = _add_reason(out, F.col("__first").isNotNull() & (F.col(ORDINAL) != F.col("__first")),
                      f"duplicate value in unique column {col}")
    # One row per stored value: it is under another key if its smallest or largest key is another.
    own = F.struct(*[q(k) for k in key])
    stored = (tgt.filter(q(col).isNotNull()).groupBy(q(col).alias("__sv"))
              .agg(F.min(own).alias("__low"), F.max(own).alias("__high")))
    out = out.join(stored, q(col) == F.col("__sv"), "left")
    other_key = ~own.eqNullSafe(F.col("__low")) | ~own.eqNullSafe(F.col("__high"))
    out = _add_reason(out, F.col("__sv").isNotNull() & other_key,
                      f"value already stored in unique column {col}")
    return out.drop("__v", "__first", "__sv", "__low", "__high")


def find_duplicate_key(df: DataFrame, key: list[str]) -> DataFrame:
    """The smallest key value occurring more than once (empty frame when
    the key is unique), found with a partial aggregate."""
    dup = df.groupBy(*[q(k) for k in key]).agg(F.count(F.lit(1)).alias("__n")) \
            .filter(F.col("__n") > 1).drop("__n")
    return dup.orderBy(*[q(k).asc_nulls_first() for k in key]).limit(1)


# ---------------------------------------------------------------------------
# U12/U13 counters and reject log
# ---------------------------------------------------------------------------

def import_result(spark, total: int, inserted: int, updated: int, skipped: int,
                  rejected: int) -> DataFrame:
    """U12 as a one-row frame."""
    return spark.createDataFrame(
        [(total, inserted, updated, skipped, rejected)],
        "total_rows long, rows_inserted long, rows_updated long, rows_skipped long, "
        "rows_rejected long")


def rejects(df: DataFrame) -> DataFrame:
    """The full reject log (ordinal, reason cut to 300 characters); the
    caller shows at most 200 entries."""
    return df.filter(F.col(REJECT).isNotNull()).select(
        F.col(ORDINAL).alias("row"), F.substring(F.col(REJECT), 1, 300).alias("error"))
