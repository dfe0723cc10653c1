import hashlib
import os
import re
import sys

import public_tokenizers
import pytest
import tiktoken

sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline  # noqa: E402
import test_decontam  # noqa: E402
import test_minhash  # noqa: E402
from tessera.llm import bpe, decontam  # noqa: E402
from tessera.llm.common import table  # noqa: E402
from tessera.llm.queries import RANKS, items  # noqa: E402

SF = "/root/testdata/sf0.001"
UP = {c: c + 32 for c in range(65, 91)}


def brute(docs, bench):
    """The pipeline in plain Python: (doc_id, text) of what is left, stage by stage."""
    rows = [(i, t) for i, t in docs if t and any(map(str.isalpha, t))]
    yield rows
    last = {}
    for i, t in rows:
        last[t.translate(UP)] = max(i, last.get(t.translate(UP), i))
    rows = [(i, t) for i, t in rows if last[t.translate(UP)] == i]
    yield rows
    kept = {g[0] for g in test_minhash.brute(rows, 5) if g[3]}
    rows = [(i, t) for i, t in rows if i in kept]
    yield rows
    out, windows = [], set()
    bench = [(k, w) for k, w in ((k, decontam.words_of(t)) for k, t in bench) if w]
    windows = {tuple(w[j:j + 10]) for _, w in bench for j in range(max(1, len(w) - 9))}
    for i, t in rows:
        words = decontam.words_of(t)
        if any(tuple(words[j:j + 10]) in windows for j in range(len(words))):
            hit, _ = test_decontam.brute(words, bench, 10)
            if len(hit) > decontam.MAX_COVERAGE * len(words):
                continue
            spans = [m.span() for m in decontam.WORD.finditer(t.encode().lower())]
            raw, keep, at = t.encode(), [], 0
            for j in sorted(hit):
                if j - 1 not in hit:
                    keep.append(raw[at:spans[j][0]])
                at = spans[j][1]
            t = b"".join([*keep, raw[at:]]).decode()
        out.append((i, t))
    yield out


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    bench = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    want = brute([(r.doc_id, r.text) for r in docs.collect()], bench)
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.staged(stage(spark, now, SF), "test-" + name.replace(" ", "-"))
        assert now.columns == docs.columns
        assert sorted((r.doc_id, r.text) for r in now.collect()) == sorted(next(want)), name
        assert all(r.n_chars == len(r.text) for r in now.collect())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()}
    for r in now.collect():
        got = last.pop(r.doc_id)
        assert list(got.ids) == enc.encode_ordinary(r.text) and got.n_tokens == len(got.ids)
        assert got.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert not last


@pytest.mark.parametrize("pairs", [[], [(None, None), (1, ""), (2, "12 -"), (3, "the words here"), (3, "the words here"),
                                        (4, "THE words here"), (None, "some other words"), (5, "x " * 40_000)]])
def test_stages_take_odd_tables(spark, docs, pairs):
    now = docs(pairs)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.staged(stage(spark, now, SF), "test-odd")
    assert sorted((r.doc_id for r in now.collect()), key=str) == ([4, 5, None] if pairs else [])
    assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() == len([4, 5, None] if pairs else [])


def test_one_query_for_each_operator():
    import __spark_entry__ as entry
    assert {re.match(r"op(\d+)_", k)[1] for k in items} == {str(n) for n in range(1, 14)}
    assert set(items) | {"pipeline"} <= set(entry.queries())
