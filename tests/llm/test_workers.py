"""Workers without the package, and tables whose columns are named like helper columns."""

import os
import subprocess
import sys

import pytest

import corpus_pipeline
from tessera.llm import lang_id, pii

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
NAMES = ["op1_language_id", "op3_decontamination", "op4_toxicity", "op8_html_text"]
JOB = """
import sys
sys.path.insert(0, sys.argv[1])        # of the driver alone
from tessera.session import get_session
from tessera.llm.queries import items
spark = get_session("local[4]", shuffle_partitions=4)

def there(_):
    import importlib.util
    yield importlib.util.find_spec("tessera") is not None

assert spark.sparkContext.parallelize([0], 1).mapPartitions(there).collect() == [False]
for name in sys.argv[2:]:
    assert items[name][0](spark, "/root/testdata/sf0.001").count() > 0, name
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("SPARK_HOME", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    env["PYTHONPATH"] = os.pathsep.join(p for p in env.get("PYTHONPATH", "").split(os.pathsep)
                                        if p and os.path.realpath(p) != ROOT)
    (tmp_path / "job.py").write_text(JOB)
    done = subprocess.run([sys.executable, "job.py", ROOT, *NAMES], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]


HELPERS = ["_id", "_key", "_own", "_kept", "_rows", "_sha", "_clean", "_HITS", "_got", "_summary", "_before", "_verdict", "__own"]


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_keep_columns_named_like_helpers(spark, stage):
    text = "the cat sat on the mat and looked at all the other cats of the house"
    rows = [(i, text if i < 3 else f"{text} {i} more", "en", "s", 9, *[f"{n}{i}" for n in HELPERS]) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                 + ", ".join(f"{n} string" for n in HELPERS))
    got = corpus_pipeline.staged(stage[1](spark, docs, "/root/testdata/sf0.001"), "test-names")
    assert got.columns == docs.columns
    kept = got.collect()
    assert kept and all(r[n] == f"{n}{r.doc_id}" for r in kept for n in HELPERS)


def test_pseudonyms_keep_columns_named_like_helpers(spark):
    docs = spark.createDataFrame([(1, "call 415-555-0100", "mine", "too")], "doc_id long, text string, _got string, _g string")
    got = pii.pseudonymised(docs, b"k" * 32).first()
    assert (got["_got"], got["_g"]) == ("mine", "too")


@pytest.mark.parametrize("text, letter", [("²", False), ("½ Ⅷ ① 12", False), ("٣", False), ("ß", True), ("12 語", True), ("ª", True), ("_", False)])
def test_letters_are_those_of_isalpha(text, letter):
    assert lang_id.has_letter(text) is letter
