"""Upsert counter sequences (inserted, updated, skipped, rejected)."""

import os

from pyspark.sql import functions as F

from tessera_testing import write_csv
from tessera.catalog import Catalog
from tessera.model import ColumnSpec, TableSpec
from tessera.plans.imports import import_files
from tessera.sources.schema import create_table


def counters(o):
    return (o.rows_inserted, o.rows_updated, o.rows_skipped, o.rows_rejected)


def _setup(spark, tmp, spec):
    cat = Catalog(spark)
    create_table(spark, spec, os.path.join(tmp, spec.name + "-v0"), cat)
    return cat


def test_pk_sequence(spark, tmp_path):
    tmp = str(tmp_path)
    spec = TableSpec("dept", [
        ColumnSpec("dept_id", "Integer", primary_key=True, nullable=False, label="部门编号"),
        ColumnSpec("dept_name", "String", 50, label="部门名称"),
        ColumnSpec("manager", "String", 50, label="负责人", default="待定")])
    cat = _setup(spark, tmp, spec)
    f1 = write_csv(f"{tmp}/a.csv", "部门编号,部门名称,负责人\n1,A,杨\n2,B,李\n")
    assert counters(import_files(cat, "dept", f1)) == (2, 0, 0, 0)
    assert counters(import_files(cat, "dept", f1)) == (0, 0, 2, 0)
    f3 = write_csv(f"{tmp}/c.csv", "部门编号,部门名称,负责人\n1,A2,杨\n3,C,王\n")
    assert counters(import_files(cat, "dept", f3)) == (1, 1, 0, 0)
    f4 = write_csv(f"{tmp}/d.csv", "dept_id,负责人\n2,李四\n")
    assert counters(import_files(cat, "dept", f4)) == (0, 1, 0, 0)
    row = cat.table("dept").filter("dept_id = 2").first()
    assert row["dept_name"] == "B" and row["manager"] == "李四"
    f5 = write_csv(f"{tmp}/e.csv", "部门编号,部门名称,负责人\nabc,X,Y\n")
    assert counters(import_files(cat, "dept", f5)) == (0, 0, 0, 1)
    assert cat.table("dept").count() == 3


def test_key_collapse_last_wins(spark, tmp_path):
    tmp = str(tmp_path)
    spec = TableSpec("d2", [ColumnSpec("dept_id", "Integer", primary_key=True, nullable=False),
                            ColumnSpec("name", "String", 50)])
    cat = _setup(spark, tmp, spec)
    f = write_csv(f"{tmp}/a.csv", "dept_id,name\n1,旧名称\n1,新名称\n")
    o = import_files(cat, "d2", f)
    assert (o.rows_inserted, o.rows_skipped) == (1, 1)
    assert cat.table("d2").first()["name"] == "新名称"


def test_numeric_and_dates_reimport(spark, tmp_path):
    tmp = str(tmp_path)
    spec = TableSpec("emp", [ColumnSpec("emp_id", "Integer", primary_key=True, nullable=False),
                             ColumnSpec("salary", "Numeric"), ColumnSpec("hire_date", "Date")])
    cat = _setup(spark, tmp, spec)
    f = write_csv(f"{tmp}/a.csv", "emp_id,salary,hire_date\n101,15800.50,2023-03-15\n"
                                  "102,13200.00,2021-11-20\n")
    assert counters(import_files(cat, "emp", f)) == (2, 0, 0, 0)
    assert counters(import_files(cat, "emp", f)) == (0, 0, 2, 0)


def test_composite_key(spark, tmp_path):
    tmp = str(tmp_path)
    spec = TableSpec("sales", [ColumnSpec("code", "String", 20), ColumnSpec("region", "String", 20),
                               ColumnSpec("amount", "Integer")], upsert_key=["code", "region"])
    cat = _setup(spark, tmp, spec)
    f = write_csv(f"{tmp}/a.csv", "code,region,amount\nc1,华东,10\nc1,华东,20\nc2,华北,5\n")
    assert counters(import_files(cat, "sales", f)) == (2, 0, 1, 0)
    f2 = write_csv(f"{tmp}/b.csv", "code,region,amount\nc1,华东,20\nc2,华北,5\n")
    assert counters(import_files(cat, "sales", f2)) == (0, 0, 2, 0)
    f3 = write_csv(f"{tmp}/c.csv", "code,region,amount\nc1,华东,99\n")
    assert counters(import_files(cat, "sales", f3)) == (0, 1, 0, 0)


def test_keyless_dedup_and_append(spark, tmp_path):
    tmp = str(tmp_path)
    spec = TableSpec("notes", [ColumnSpec("title", "String", 20), ColumnSpec("amount", "Integer")])
    cat = _setup(spark, tmp, spec)
    f = write_csv(f"{tmp}/a.csv", "title,amount\n甲,1\n乙,2\n")
    assert counters(import_files(cat, "notes", f))[:3] == (2, 0, 0)
    assert counters(import_files(cat, "notes", f))[:3] == (0, 0, 2)
    f2 = write_csv(f"{tmp}/b.csv", "title,amount\n丙,3\n丙,3\n")
    assert counters(import_files(cat, "notes", f2))[:3] == (1, 0, 1)
    spec2 = TableSpec("log", [ColumnSpec("title", "String", 20), ColumnSpec("amount", "Integer")],
                      dedup=False)
    cat2 = _setup(spark, tmp, spec2)
    g = write_csv(f"{tmp}/g.csv", "title,amount\n甲,1\n甲,1\n")
    assert counters(import_files(cat2, "log", g))[:3] == (2, 0, 0)
    assert counters(import_files(cat2, "log", g))[:3] == (2, 0, 0)


def test_foreign_key(spark, tmp_path):
    tmp = str(tmp_path)
    dept = TableSpec("dept", [ColumnSpec("dept_id", "Integer", primary_key=True, nullable=False)])
    emp = TableSpec("emp", [ColumnSpec("emp_id", "Integer", primary_key=True, nullable=False),
                            ColumnSpec("dept_id", "Integer", fk=("dept", "dept_id"))])
    cat = _setup(spark, tmp, dept)
    create_table(spark, emp, f"{tmp}/emp-v0", cat)
    import_files(cat, "dept", write_csv(f"{tmp}/d.csv", "dept_id\n1\n2\n"))
    f1 = write_csv(f"{tmp}/e1.csv", "emp_id,dept_id\n101,1\n102,2\n")
    assert counters(import_files(cat, "emp", f1)) == (2, 0, 0, 0)
    f2 = write_csv(f"{tmp}/e2.csv", "emp_id,dept_id\n101,1\n102,2\n103,999\n")
    assert counters(import_files(cat, "emp", f2)) == (0, 0, 2, 1)
