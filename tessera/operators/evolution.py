"""Table evolution and lineage (M1-M8).

Parquet tables are immutable, so every change is a rewrite: the operators
return the new DataFrame (and the new spec); the caller writes it to a fresh
version folder and switches the catalog entry. The data checks that guard a
change (lossy casts, NULLs, duplicate keys) are single aggregations.
"""

from __future__ import annotations

import copy
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType, StringType

from ..model import BOOKKEEPING_COLUMNS, ColumnSpec, TableSpec, spark_type_name
from ..operators.upsert import find_duplicate_key, with_content_hash

# Casts the original schema manager treats as lossless
# (anything else is flagged as possibly lossy).
SAFE_CASTS = {
    "String": {"String", "Text"},
    "Text": {"Text"},
    "Integer": {"Integer", "BigInteger", "Numeric", "String", "Text"},
    "BigInteger": {"BigInteger", "Numeric", "String", "Text"},
    "Numeric": {"Numeric", "String", "Text"},
    "Boolean": {"Boolean", "String", "Text"},
    "DateTime": {"DateTime", "String", "Text"},
    "Date": {"Date", "DateTime", "String", "Text"},
    "JSON": {"JSON", "Text"},
}


class EvolutionError(ValueError):
    pass


def q(c):
    return F.col("`" + c.replace("`", "``") + "`")


def _spec_copy(spec: TableSpec) -> TableSpec:
    return copy.deepcopy(spec)


def add_column(df: DataFrame, spec: TableSpec, col: ColumnSpec) -> tuple[DataFrame, TableSpec]:
    """M1: new column, existing rows take the default; no primary key."""
    if col.primary_key:
        raise EvolutionError("a new column cannot be the primary key")
    if col.name in df.columns or col.name in BOOKKEEPING_COLUMNS:
        raise EvolutionError(f"column '{col.name}' exists or is reserved")
    if not col.nullable and col.default is None:
        raise EvolutionError("a required new column needs a default")
    new = _spec_copy(spec)
    new.columns.append(col)
    return df.withColumn(col.name, F.lit(col.default).cast(col.spark_type())), new


def drop_column(df: DataFrame, spec: TableSpec, name: str,
                children: list[TableSpec] = ()) -> tuple[DataFrame, TableSpec]:
    """M2: refused for the primary key, bookkeeping and FK-referenced columns."""
    if name in BOOKKEEPING_COLUMNS:
        raise EvolutionError(f"'{name}' is a bookkeeping column")
    c = spec.column(name)
    if c.primary_key:
        raise EvolutionError(f"'{name}' is the primary key")
    for child in children:
        for cc in child.columns:
            if cc.fk == (spec.name, name):
                raise EvolutionError(f"'{name}' is referenced by {child.name}.{cc.name}")
    new = _spec_copy(spec)
    new.columns = [x for x in new.columns if x.name != name]
    if new.upsert_key:
        new.upsert_key = [k for k in new.upsert_key if k != name] or None
    return df.drop(name), new


def rename_column(df: DataFrame, spec: TableSpec, old: str, new_name: str
                  ) -> tuple[DataFrame, TableSpec]:
    """M3: rename a column (and its key / spec entries)."""
    if new_name in df.columns:
        raise EvolutionError(f"column '{new_name}' exists")
    new = _spec_copy(spec)
    new.column(old).name = new_name
    if new.upsert_key:
        new.upsert_key = [new_name if k == old else k for k in new.upsert_key]
    return df.withColumnRenamed(old, new_name), new


def rename_table(catalog, old: str, new: str, views: DataFrame | None = None) -> None:
    """M3: refused while saved views use the table."""
    if views is not None and dependencies(views, old).limit(1).count():
        raise EvolutionError(f"views use table '{old}'")
    catalog.rename(old, new)
    if new in catalog.specs:
        catalog.specs[new].name = new


FRACTIONS = (DecimalType, DoubleType, FloatType)


def change_type(df: DataFrame, spec: TableSpec, name: str, new_type: str
                ) -> tuple[DataFrame, TableSpec, bool, DataFrame]:
    """M4: (new frame, new spec, lossy flag from the safe-cast matrix, a
    one-row frame ``lossy_rows`` = values that do not survive: they cannot be
    cast, or are another value when cast back (a fraction, a time of day).
    Fractions are rounded half away from zero, as the database does. The cast
    itself is strict: a value that cannot be cast fails the job, as the database
    refused the ALTER."""
    old = spec.column(name).type
    lossy = new_type not in SAFE_CASTS.get(old, set())
    target, kind = spark_type_name(new_type), df.schema[name].dataType
    value = F.round(q(name), 0) if new_type in ("Integer", "BigInteger") and isinstance(kind, FRACTIONS) else q(name)
    back = value.try_cast(target)
    changed = back.isNull()
    if not isinstance(kind, StringType):
        changed = changed | (back.try_cast(kind) != q(name))
    losses = df.agg(F.count(F.when(q(name).isNotNull() & changed, 1)).alias("lossy_rows"))
    new = _spec_copy(spec)
    new.column(name).type = new_type
    return df.withColumn(name, value.cast(target)), new, lossy, losses


def null_violations(df: DataFrame, name: str) -> DataFrame:
    """M5: rows that would break NOT NULL (a count; 0 allows the change)."""
    return df.agg(F.count(F.when(q(name).isNull(), 1)).alias("violations"))


def assert_not_null(df: DataFrame, name: str) -> None:
    if df.filter(q(name).isNull()).limit(1).count():
        raise EvolutionError(f"column '{name}' holds NULL values")


def assert_unique(df: DataFrame, name: str) -> None:
    """M5: adding UNIQUE needs the duplicate probe (U10) to come back empty."""
    if find_duplicate_key(df.filter(q(name).isNotNull()), [name]).count():
        raise EvolutionError(f"column '{name}' holds duplicate values")


def set_key(df: DataFrame, spec: TableSpec, key: list[str] | None, dedup: bool = True
            ) -> tuple[DataFrame, TableSpec]:
    """M6: change the upsert key (or go keyless). A new key is probed for
    duplicates first; a keyless table with dedup gets ``content_hash``, a
    keyed one loses it."""
    new = _spec_copy(spec)
    new.upsert_key, new.dedup = (list(key) if key else None), dedup
    if key:
        dup = find_duplicate_key(df, key).first()
        if dup is not None:
            raise EvolutionError(f"duplicate key value {tuple(dup)}")
        return (df.drop("content_hash") if "content_hash" in df.columns else df), new
    if dedup and not new.key():          # a primary key stays the natural key
        business = [c for c in df.columns if c not in BOOKKEEPING_COLUMNS]
        return with_content_hash(df.select(*[q(c) for c in business]), new) \
            .select(*df.columns if "content_hash" in df.columns else
                    [*df.columns, "content_hash"]), new
    return (df.drop("content_hash") if "content_hash" in df.columns else df), new


def drop_table(catalog, name: str, views: DataFrame | None = None, confirm: bool = False
               ) -> None:
    """M7: refused when a foreign key points at the table; needs ``confirm``
    when saved views use it."""
    for other, spec in catalog.specs.items():
        if other != name and any(c.fk and c.fk[0] == name for c in spec.columns):
            raise EvolutionError(f"table '{other}' references '{name}'")
    if views is not None and not confirm and dependencies(views, name).limit(1).count():
        raise EvolutionError(f"views use table '{name}'; pass confirm=True")
    catalog.drop(name)


def _word(name: str) -> str:
    return r"(?U)\b" + re.escape(name) + r"\b"


def dependencies(views: DataFrame, table: str, column: str | None = None) -> DataFrame:
    """M8: saved views whose SQL text or config JSON names the table (and the
    column) as whole words. ``views`` has ``name``, ``config_json`` and
    optionally ``sql`` columns."""
    hay = [F.coalesce(q("sql"), F.lit(""))] if "sql" in views.columns else []
    hay.append(F.coalesce(q("config_json"), F.lit("")))
    conds = []
    for h in hay:
        c = h.rlike(_word(table))
        if column:
            c = c & h.rlike(_word(column))
        conds.append(c)
    hit = conds[0]
    for c in conds[1:]:
        hit = hit | c
    return views.filter(hit).select("name")


def dependent_visualizations(views: DataFrame, visualizations: DataFrame, table: str,
                             column: str | None = None) -> DataFrame:
    """M8: charts built on the dependent views (a join on the view name)."""
    deps = dependencies(views, table, column).withColumnRenamed("name", "view_name")
    return visualizations.join(deps, "view_name", "left_semi")


def fk_children(specs: dict[str, TableSpec], table: str, column: str | None = None) -> list[dict]:
    """M8: tables whose foreign keys reference ``table`` (spec metadata)."""
    out = []
    for other, spec in specs.items():
        if other == table:
            continue
        for c in spec.columns:
            if c.fk and c.fk[0] == table and (column is None or c.fk[1] == column):
                out.append({"table": other, "column": c.name,
                            "references": f"{table}.{c.fk[1]}"})
    return out


def config_text(cfg) -> str:
    """JSON text of a view config, as stored for the dependency scan."""
    d = cfg.to_dict() if hasattr(cfg, "to_dict") else cfg
    return json.dumps(d, ensure_ascii=False, sort_keys=True)
