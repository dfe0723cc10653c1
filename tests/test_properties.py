"""Property checks against plain-Python definitions of the same rules."""

import datetime as dt
import hashlib
import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, LongType, StringType, StructField, StructType,
                               TimestampNTZType)

from tessera.functions.hashing import content_hash
from tessera.operators.cleaning import NULL_TOKENS, py_strip

SETTINGS = dict(max_examples=10, deadline=None,
                suppress_health_check=[HealthCheck.function_scoped_fixture])

WS = "".join(chr(i) for i in range(0x3100) if chr(i).isspace())
text = st.text(alphabet=st.sampled_from(list("ab中文 \"\\/,") + list(WS) + ["\n", "é"]),
               max_size=12)


def py_hash(row: dict) -> str:
    out = {}
    for k, v in row.items():
        out[k] = v.isoformat() if isinstance(v, dt.datetime) else v
    return hashlib.sha256(json.dumps(out, sort_keys=True, ensure_ascii=False)
                          .encode("utf-8")).hexdigest()


rows = st.lists(st.fixed_dictionaries({
    "name": st.one_of(st.none(), text),
    "qty": st.one_of(st.none(), st.integers(-10**12, 10**12)),
    "price": st.one_of(st.none(), st.decimals(min_value=-10**6, max_value=10**6, places=2,
                                              allow_nan=False).map(float)),
    "at": st.one_of(st.none(), st.datetimes(min_value=dt.datetime(1990, 1, 1),
                                            max_value=dt.datetime(2030, 1, 1))),
}), min_size=1, max_size=8)


@settings(**SETTINGS)
@given(rows)
def test_content_hash_matches_python_json(spark, data):
    schema = StructType([StructField("name", StringType()), StructField("qty", LongType()),
                         StructField("price", DoubleType()), StructField("at", TimestampNTZType())])
    df = spark.createDataFrame([(r["name"], r["qty"], r["price"], r["at"]) for r in data], schema)
    h = content_hash([(f.name, f.dataType) for f in schema.fields])
    got = [r[0] for r in df.select(h).collect()]
    assert got == [py_hash(r) for r in data]


@settings(**SETTINGS)
@given(st.lists(st.one_of(st.none(), text), min_size=1, max_size=20))
def test_strip_matches_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = [r[0] for r in df.select(py_strip(F.col("s"))).collect()]
    assert got == [None if v is None else v.strip() for v in values]
    assert "None" in NULL_TOKENS
