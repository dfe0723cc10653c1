import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tessera.llm import bpe
from tessera.llm.queries import RANKS

ranks = bpe.load_ranks(RANKS)
ENC = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sample_texts():
    rnd = random.Random(5)
    words = ["the", "naïve", "  ", "\n\n", "don't", "12345", "été", "###", "中文字", "🙂", " ", "x" * 90]
    out = ["", " ", "a", "\n" * 200, "z" * 900, "ab" * 700, "日本" * 300, "1" * 333]
    out += ["".join(rnd.choice(words) + rnd.choice(["", " ", "  "]) for _ in range(n)) for n in (3, 40, 400, 900)]
    return out


def test_merge_equals_library():
    for t in sample_texts():
        codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
        ids = codec.encode(codec.pieces(t))
        assert ids == ENC.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_merge_together_equals_merge():
    rnd = random.Random(8)
    pieces = [bytes(rnd.choices(b"aehinorst d\xc3\xa9", k=rnd.randrange(2, 40))) for _ in range(3000)] + [b"aa", b"\xff\xfe", b"z" * 63]
    pairs = bpe.load_pairs(ranks)
    assert bpe.merge_together([p for p in pieces if p not in ranks], ranks, pairs) == [bpe.merge(p, ranks) for p in pieces if p not in ranks]
    assert bpe.merge_together([], ranks, pairs) == []


def test_new_pieces_of_texts_are_merged_together():
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN, bpe.load_pairs(ranks))
    split = [codec.pieces(t) for t in sample_texts()]
    codec.learn(split)
    assert [codec.encode(p) for p in split] == [ENC.encode_ordinary(t) for t in sample_texts()]
    assert all(len(p.encode()) >= bpe.LONG_PIECE for x in split for p in x if p not in codec.memo)


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (50, 3), (200, 100)])
def test_chunks_stitch_to_whole(spark, docs, chunk, overlap):
    texts = sample_texts() + [None, "the same", "the same"]
    df = docs([(None if i == 3 else i, t) for i, t in enumerate(texts)]).withColumnRenamed("source", "ids")
    got = bpe.encode(df, RANKS, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap)
    rows = sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in got.collect())
    want = sorted((-1 if i == 3 else i, ENC.encode_ordinary(t or "")) for i, t in enumerate(texts))
    assert rows == want
    raw = {r.doc_id: bytes(r.raw) for r in bpe.decode(got, RANKS).collect()}
    assert all(raw[None if i == 3 else i] == (t or "").encode() for i, t in enumerate(texts))


def test_repeated_long_rows_and_empty_table(docs):
    t = "word and " * 50
    got = bpe.encode(docs([(7, t), (7, t), (8, t)]), RANKS, public_tokenizers.PATTERN, chunk=100, overlap=20,
                     finish=bpe.digest_rows, schema="n long, i string, d string").collect()
    assert sorted(r.doc_id for r in got) == [7, 7, 8]
    assert {r.d for r in got} == {hashlib.sha256(t.encode()).hexdigest()}
    assert bpe.encode(docs([]), RANKS, public_tokenizers.PATTERN).count() == 0
