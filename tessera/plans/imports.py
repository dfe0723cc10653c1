"""File import as one Spark plan: read -> structural rules -> header gate ->
cleaning -> coercion/rejects -> classify -> merge -> counters.

The classified frame is read twice (counters and the write), so it is cut
from its lineage once with a reliable checkpoint in the cluster's shared
checkpoint folder; a lost executor then re-reads files instead of re-running
the whole import. A stored table (``versions.py``) gets a version that rewrites
only the files holding an updated row; of any other table a whole new version is
written to a fresh folder and the catalog switched to it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..model import TableSpec
from ..operators import cleaning as C
from ..operators import table_rules  # noqa: F401  (registers its rules)
from ..operators import upsert as U
from ..session import cut_lineage, scratch_path
from ..sources.delimited import RawFrame, read_delimited
from ..sources.schema import map_headers
from ..versions import FILE, JobLog, VersionedTable


@dataclass
class ImportOutcome:
    total_rows: int
    rows_inserted: int
    rows_updated: int
    rows_skipped: int
    rows_rejected: int
    report: C.CleaningReport
    rejects: DataFrame
    table: DataFrame
    path: str | None

    def counters(self) -> dict:
        return {"total_rows": self.total_rows, "rows_inserted": self.rows_inserted,
                "rows_updated": self.rows_updated, "rows_skipped": self.rows_skipped,
                "rows_rejected": self.rows_rejected}


def import_files(catalog: Catalog, table: str, paths, spec: TableSpec | None = None,
                 **kw) -> ImportOutcome:
    raw = read_delimited(catalog.spark, paths)
    return import_raw(catalog, table, raw, spec, **kw)


def import_raw(catalog: Catalog, table: str, raw: RawFrame, spec: TableSpec | None = None,
               **kw) -> ImportOutcome:
    """Structural rules run on positional columns before the header gate."""
    spec = spec or catalog.specs[table]
    report = C.CleaningReport()
    df = report.start(raw.df)
    total = None
    df = C.apply_rules(df, table, report)
    mapped = map_headers(RawFrame(df, raw.headers), spec)
    return import_frame(catalog, table, mapped, spec, report=report, total=total, **kw)


def import_frame(catalog: Catalog, table: str, df: DataFrame, spec: TableSpec,
                 report: C.CleaningReport | None = None, total: int | None = None,
                 write: bool = True, compat_dates: bool = False, batch: tuple[str, int] | None = None,
                 log: JobLog | None = None, run: str | None = None, source_id: str | None = None
                 ) -> ImportOutcome | None:
    """Import an all-text frame whose columns are already table column names
    (plus ``_ordinal``). ``batch`` (stream, number) is stored with the version; one
    that is stored already is not imported again (None). With ``log`` the job is
    recorded under ``run``."""
    spark = df.sparkSession
    key = spec.key()
    stored = catalog.versioned(table)
    if stored is not None and stored.refresh().holds(batch):
        return None
    if C.ORDINAL not in df.columns:
        df = df.withColumn(C.ORDINAL, F.monotonically_increasing_id())
    report = report or C.CleaningReport()
    if report._last is None:
        df = report.start(df)
    cleaned, report = C.clean(df, key=key, dedup=spec.dedup, compat_dates=compat_dates,
                              report=report)
    typed = U.coerce(cleaned, spec)
    keyless_hash = not key and spec.dedup
    if keyless_hash:
        typed = U.with_content_hash(typed, spec)
    if key:
        typed = U.reject_null_keys(typed, key)
    for c in spec.columns:
        if c.fk and c.name in typed.columns:
            parent, pcol = c.fk
            typed = U.reject_fk(typed, c.name, catalog.table(parent), pcol)
    tgt = catalog.table(table)
    if key:
        for c in spec.columns:
            if c.unique and c.name not in key and c.name in typed.columns:
                typed = U.reject_unique(typed, tgt, c.name, key)
    # the cleaned, typed file: read for counts, rejects and the merge
    typed = cut_lineage(typed)
    split = {r["ok"]: r["n"] for r in typed.groupBy(F.col(U.REJECT).isNull().alias("ok"))
             .agg(F.count(F.lit(1)).alias("n")).collect()}
    good_rows_pre, n_bad = split.get(True, 0), split.get(False, 0)
    good, bad = U.split_rejects(typed)
    if key:
        # keys can collide only after coercion ('1' and '1.0'): last wins again
        good = C.dedup_by_key(good.drop(U.REJECT), key)
        if stored is not None:
            good = cut_lineage(good)
            low, high = good.agg(F.min(key[0]), F.max(key[0])).first()
            tgt = stored.frame(stored.files(low, high), with_file=True)     # no other file can hold a key
        classified = U.classify(good, tgt, key, FILE if stored is not None else None)
    elif keyless_hash:
        new = U.insert_new(good.drop(U.REJECT), tgt)
        classified = good.drop(U.REJECT).join(
            new.select(C.ORDINAL).withColumn(U.ACTION, F.lit("insert")), C.ORDINAL, "left") \
            .withColumn(U.ACTION, F.coalesce(F.col(U.ACTION), F.lit("skip")))
    else:
        classified = good.drop(U.REJECT).withColumn(U.ACTION, F.lit("insert"))
    classified = cut_lineage(classified)
    counts = {r[U.ACTION]: r["n"] for r in
              classified.groupBy(U.ACTION).agg(F.count(F.lit(1)).alias("n")).collect()}
    if total is None:
        total = report._input.get["rows"] if report._input is not None else None
    totals = report.totals()
    good_rows = sum(counts.values())
    collapsed_after_coerce = good_rows_pre - good_rows if key else 0
    inserted, updated = counts.get("insert", 0), counts.get("update", 0)
    skipped = counts.get("skip", 0) + totals["skipped"] + collapsed_after_coerce
    rejected = totals["rejected"] + n_bad
    run = run or uuid.uuid4().hex
    if stored is not None:
        path = stored.path
        if write:
            stored = write_version(stored, classified, key, spec, inserted, updated, batch)
        return _logged(log, run, table, source_id, stored.version, ImportOutcome(
            total or 0, inserted, updated, skipped, rejected, report, U.rejects(bad), stored.frame(), path))
    if key:
        new_table = U.merge(classified, tgt, key, spec)
    elif keyless_hash:
        new_table = tgt.unionByName(U.fill_defaults(
            classified.filter(F.col(U.ACTION) == "insert"), tgt, spec))
    else:
        new_table = U.append(classified, tgt, spec)
    path = None
    if write:
        path = scratch_path(spark, f"{table}-v")
        new_table.write.parquet(path)
        catalog.register_path(table, path)
        new_table = spark.read.parquet(path)
    return _logged(log, run, table, source_id, None, ImportOutcome(
        total or 0, inserted, updated, skipped, rejected, report, U.rejects(bad), new_table, path))


def write_version(stored: VersionedTable, classified: DataFrame, key: list[str] | None, spec: TableSpec,
                  inserted: int, updated: int, batch: tuple[str, int] | None = None) -> VersionedTable:
    """U4, U6, U7 on a stored table: files that hold an updated row are written anew
    with the new rows, all others stay as they are."""
    if not inserted and not updated:
        return stored.commit(batch=batch) if batch else stored
    if not updated:
        new = classified.filter(F.col(U.ACTION) == "insert")
        return stored.commit(U.fill_defaults(new, stored.frame(stored.files().limit(0)), spec), batch=batch)
    touched = cut_lineage(classified.filter(F.col(U.ACTION) == "update").select(F.col(FILE).alias("file")).distinct())
    old = stored.frame(stored.files().join(touched, "file", "left_semi"))
    return stored.commit(U.merge(classified.drop(FILE), old, key, spec), touched, batch)


def _logged(log: JobLog | None, run: str, table: str, source_id: str | None, version: int | None,
            out: ImportOutcome) -> ImportOutcome:
    if log is not None:
        log.record(run, table, out.counters(), out.rejects, version, source_id)
    return out
