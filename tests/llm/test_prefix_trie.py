import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, pos int, name string"


def name(role, text):
    """The digest by which turns of equal number are ordered."""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn), name(role, text), role, text))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = tuple(own.get(base, [])[:h]) + tuple(ts[h:])
    return out


def brute(seqs):
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[:len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(1 for q in below if not any(r[:-1] == q for r in members if r))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in cs if len(seqs[c]) == len(p))))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built(frame, rows):
    df = frame([(*r, 7, "x") for r in rows], SCHEMA)
    out = pt.trie(*pt.with_borrowed_starts(pt.turns_in_order(df)))
    assert out.schema.simpleString() == "struct<" + ",".join(f"{c.split()[0]}:bigint" if "long" in c else "ends_sha256:string"
                                                             for c in pt.NODES.split(", ")) + ">"
    return sorted((tuple(r) for r in out.collect()), key=str)


def talk(n_convs, most, seed, words="abc"):
    rnd = random.Random(seed)
    return [(c, t, rnd.choice(["user", "assistant"]) if t else "user", rnd.choice(words) * rnd.randrange(1, 3))
            for c in range(n_convs) for t in range(rnd.randrange(most + 1))]


def test_equals_brute_force(frame):
    rows = talk(230, 9, 1)
    assert built(frame, rows) == brute(rebuilt(rows))


def test_long_sequences_over_many_runs(frame, monkeypatch):
    monkeypatch.setattr(pt, "RUN", 4)
    rnd = random.Random(2)
    rows = [(c, t, "user", "x" if t < 30 else rnd.choice("ab")) for c, m in ((100, 41), (101, 64), (102, 65), (103, 1), (104, 33))
            for t in range(m)]
    assert built(frame, rows) == brute(rebuilt(rows))


def test_hot_conversations_and_many_ends(frame, monkeypatch):
    monkeypatch.setattr(pt, "ENDS", 4)
    rows = [(c, t, "user", "same") for c in range(0, 90, 3) for t in range(7)] + talk(60, 4, 5, "s")
    assert built(frame, rows) == brute(rebuilt(rows))


def test_nulls_ties_and_ids(frame):
    rows = [(None, 0, "user", "lost"), (7, None, None, None), (7, None, "user", "b"), (7, 1, "user", "b"), (7, 1, "user", "b"),
            (7, 1, "user", "a"), (-5, 0, "user", ""), (-105, 2, "user", "é🙂"), (0, 5, "a", "bc"), (1, 5, "ab", "c"),
            (200, 0, "user", "k"), (250, 0, "user", "k"), (3, 0, "", "long " * 20_000)]
    assert built(frame, rows) == brute(rebuilt(rows))


def test_empty_and_turnless(frame):
    assert built(frame, []) == []
    assert built(frame, [(None, 0, "user", "x")]) == []
    short = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(short, 0, "user", "x")]
    assert built(frame, rows) == brute(rebuilt(rows)) and len(built(frame, rows)) == 1
    assert rebuilt(rows) == {short: ()}


def test_names_are_equal_only_for_equal_prefixes(spark):
    turns = spark.range(3).select(F.col("id").alias("conv")).crossJoin(spark.range(9).select(F.col("id").alias("pos"))) \
        .withColumn("m", F.lit(9)).withColumn("size", F.lit(1)) \
        .withColumn("name", pt.digest(F.concat_ws(":", F.when((F.col("conv") == 2) & (F.col("pos") == 4), -1).otherwise(0)).cast("binary")))
    got = {(r.conv, r.pos): bytes(r["name"]) for r in pt.named(turns, 9).collect()}
    assert len(got) == 27 and all(got[0, p] == got[1, p] for p in range(9))
    assert all((got[0, p] == got[2, p]) == (p < 4) for p in range(9))
    assert len({got[0, p] for p in range(9)}) == 9
