import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from tessera.llm import piece_bpe
from tessera.llm.common import table
from tessera.llm.queries import items

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = piece_bpe.load(PATH)


def sample_texts():
    rnd = random.Random(8)
    words = ["the", "naïve", "  ", "\n\n", "don't", "12345", "été", "###", "中文字", "🙂", " ", "x" * 90, "▁", "<s>",
             "<0x41>", "ﬁ", "\x00", "�", "е́", "نص", "▁a"]
    out = ["", " ", "  ", "a", "\n" * 200, "z" * 900, " " * 333, "ab" * 700, "日本" * 300, "▁", "a ", " a", "</s>"]
    return out + ["".join(rnd.choice(words) + rnd.choice(["", " ", "  "]) for _ in range(n)) for n in (3, 40, 400, 900) * 5]


def test_agenda_equals_library():
    coder = piece_bpe.Coder(MODEL)
    for t in sample_texts():
        ids = coder.encode(t)
        assert ids == LIB.encode(t), t[:80]
        assert coder.decode([ids]) == [LIB.decode(LIB.encode(t))]
    coder.compare()


@pytest.mark.parametrize("short", [0, 24])
def test_agenda_is_score_ordered(monkeypatch, short):
    """By definition: of all pairs that form a piece, the best score merges, leftmost first."""
    monkeypatch.setattr(piece_bpe, "SHORT", short)
    rnd = random.Random(3)
    for _ in range(300):
        s = "".join(rnd.choice("abcdehint▁") for _ in range(rnd.randrange(1, 14)))
        parts = list(s)
        while True:
            found = [(MODEL.order[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in MODEL.order]
            if not found:
                break
            k = min(found)[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        assert piece_bpe.symbols(s, MODEL.order) == parts


def test_check_stops_on_a_difference():
    wrong = piece_bpe.Coder(MODEL._replace(order={p: -o for p, o in MODEL.order.items()}))
    wrong.encode("international understanding of the thing")
    with pytest.raises(ValueError, match="sentencepiece library"):
        wrong.compare()


def test_memo_stays_bounded_and_right(monkeypatch):
    monkeypatch.setattr(piece_bpe, "MEMO", 5)
    coder = piece_bpe.Coder(MODEL)
    text = " ".join(f"word{i} of" for i in range(200))
    assert coder.encode(text) == LIB.encode(text) and len(coder.memo) <= 5 and len(coder.older) <= 5
    coder.compare()


def test_unused_pieces_and_unknown_symbols():
    model = MODEL._replace(unused=frozenset({"th", "▁the"}), byte_ids=None)
    coder = piece_bpe.Coder(model, check=False)
    whole = [LIB.id_to_piece(i) for i in coder.encode("the")]
    assert "▁the" not in whole and "th" not in whole and "".join(whole) == "▁the"
    ids = coder.encode("a \U0001f9ff\U0001f9ff b")
    assert ids.count(model.unknown) == 1


def test_operator_cases(spark, frame):
    rows = [(1, "hello  world"), (2, None), (2, None), (None, "x"), (4, "word " * 30_000), (5, ""), (1, "hello  world")]
    docs = frame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, ids int, id string")
    out = piece_bpe.encode(docs, PATH)
    got = sorted((str(r.doc_id), list(r.ids)) for r in out.collect())
    assert got == sorted((str(i), LIB.encode(t or "")) for i, t in rows)
    back = sorted((str(r.doc_id), r.text) for r in piece_bpe.decode(out, PATH).collect())
    assert back == sorted((str(i), t or "") for i, t in rows)
    assert piece_bpe.encode(frame([], "doc_id long, text string"), PATH).count() == 0


def test_query_equals_library(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in items["op12_sentencepiece"][0](spark, sf).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in table(spark, sf, "documents").collect():
        ids = LIB.encode(r.text or "")
        assert got.pop(r.doc_id) == (len(ids), sha(",".join(map(str, ids))), sha(LIB.decode(ids)))
    assert not got
