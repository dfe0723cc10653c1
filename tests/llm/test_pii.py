import datetime
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import pii
from tessera.llm.common import table

KEY = b"test key"
P, BACK = pii.Pseudonyms(KEY), pii.Pseudonyms(KEY, back=True)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 26, 97, 1000])
def test_feistel_permutes_every_set(n):
    f = pii.Feistel(KEY)
    got = [f.permute(x, n, b"t") for x in range(n)]
    assert sorted(got) == list(range(n))
    assert [f.permute(y, n, b"t", back=True) for y in got] == list(range(n))


VALUES = ["4539578763621486", "4539 5787 6362 1486", "4539-5787-6362-1486", "3782 822463 10005", "DE89370400440532013000",
          "GB29 NWBK 6016 1331 9268 19", "078-05-1120", "+1 (487) 555-7209", "+49 30 1234567", "(212) 555-0187",
          "233.254.104.120", "1999-12-31", "31/12/1999", "04/05/2001", "28.02.2004", "jane.doe-7@mail4.example.com"]


@pytest.mark.parametrize("value", VALUES)
def test_format_validity_and_return(value):
    text = f"Before {value}, after."
    new, found = P.rewritten(text)
    assert sum(found.values()) == 1 and new != text
    inner = new[len("Before "):-len(", after.")]
    if "." not in value or "@" in value or value[2] == ".":
        assert [c if not c.isalnum() else c.isdigit() for c in inner] == [c if not c.isalnum() else c.isdigit() for c in value]
    assert P.rewritten(new)[1] == found             # still valid, of the same kind
    assert BACK.rewritten(new)[0] == text


def test_check_digits_and_links():
    a, b = (P.value("card", v) for v in VALUES[:2])
    assert a == b.replace(" ", "") and a[0] == "4" and pii.luhn(a[:-1]) == int(a[-1])
    new = P.value("iban", VALUES[4])
    assert pii._mod97(new[4:] + new[:4]) == 1 and new[:2] == "DE"
    iso, american = P.value("date", "1999-12-31"), P.value("date", "12/31/1999")
    assert datetime.datetime.strptime(american, "%m/%d/%Y").strftime("%Y-%m-%d") == iso


@pytest.mark.parametrize("text", [
    "4539578763621487", "1111111111111111", "x4539578763621486", "453957876362148", "DE88370400440532013000", "000-12-3456",
    "666-12-3456", "256.1.1.1", "1.2.3", "1.2.3.4.5", "01.2.3.4", "1999-02-30", "13/13/2000", "30.02.2000", "1899-01-01", "v1.2",
    "@home", "a@b", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "n° 7831 79"])
def test_what_does_not_validate_stays(text):
    assert P.rewritten(f"- {text} -")[0] == f"- {text} -"


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10 ** 15 - 1))
def test_different_cards_stay_different(x):
    body = "4" + str(x).zfill(15)[:14]
    value = body + str(pii.luhn(body))
    new = P.value("card", value)
    assert new is None or BACK.value("card", new) == value


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    hidden = pii.pseudonymised(docs, KEY)
    assert hidden.columns == docs.columns
    changed = hidden.join(docs.select("doc_id", F.col("text").alias("was")), "doc_id").filter("text <> was")
    assert changed.count() > 20
    again = pii.pseudonymised(hidden, KEY, back=True)
    assert again.join(docs.select("doc_id", F.col("text").alias("was")), "doc_id").filter("text <> was").count() == 0


def test_cases(docs):
    rnd = random.Random(2)
    words = " ".join(rnd.choices(["word", "no", "12"], k=20_000))
    df = docs([(1, None), (2, ""), (3, VALUES[0]), (None, VALUES[1]), (3, VALUES[0]), (4, words + " " + VALUES[0])])
    got = pii.pseudonyms(df.withColumn("n_card", F.lit("mine")), KEY).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and by[1].text is None and by[2].text == "" and by[1].n_replaced == 0
    assert by[3].text == by[None].text.replace(" ", "") and by[4].text == words + " " + by[3].text and by[4].n_card == 1
    assert pii.pseudonyms(docs([]), KEY).count() == 0
