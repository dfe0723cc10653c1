import base64
import gzip
import hashlib
import random
from pathlib import Path

import pytest

from tessera.llm import warc


def record(i, body=b"x", kind="response", digest=None):
    sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
    return (f"WARC/1.1\r\nWARC-Type: {kind}\r\nX-Row-ID: {i}\r\nWARC-Payload-Digest: sha1:{digest or sha}\r\n"
            f"Content-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"


def ids(records):
    return [int(h["x-row-id"]) for _, h, _ in records]


def test_whole_archives():
    parts = [record(i, b"body %d\r\n\r\nWARC/1.1\r\nnot a record" % i) for i in range(5)]
    for data in (b"".join(parts), b"".join(map(gzip.compress, parts))):
        records, gaps = warc.salvage(data, "a")
        assert ids(records) == list(range(5)) and gaps == []


def test_plain_damage_is_skipped_and_logged():
    bad = bytearray(record(1, b"0123456789"))
    bad[-8] ^= 1                                    # payload no longer matches its digest
    cut = record(2, b"y" * 50)[:-30]                # block shorter than Content-Length
    data = b"junk" + record(0) + bytes(bad) + cut + record(3) + b"WARC/1.1\r\nbroken"
    records, gaps = warc.salvage(data, "a")
    assert ids(records) == [0, 3]
    assert sum(n for _, _, n, _ in gaps) + sum(len(record(i)) for i in (0, 3)) == len(data)
    assert gaps[0][:3] == ("a", 0, 4)
    assert gaps[1][3] == "payload digest disagrees"


def test_gzip_damage_loses_only_its_member():
    members = [gzip.compress(record(i, bytes([65 + i]) * 400)) for i in range(4)]
    broken = bytearray(members[1])
    broken[len(broken) // 2] ^= 0xFF
    data = members[0] + bytes(broken) + b"\0\0" + members[2] + members[3][:-9]
    records, gaps = warc.salvage(data, "a")
    assert ids(records) == [0, 2, 3]     # of the last only the trailer is lost: its record is whole and checked
    assert records[1][0] == len(members[0]) + len(broken) + 2
    assert [g[1] for g in gaps][0] == len(members[0])
    assert sum(g[2] for g in gaps) == len(data) - len(members[0]) - len(members[2])


def test_damaged_member_keeps_what_precedes():
    import random
    rnd = random.Random(1)
    data = gzip.compress(b"".join(record(i, rnd.randbytes(3000)) for i in range(200)))
    cut = data[:len(data) // 2]
    records, gaps = warc.salvage(cut + gzip.compress(record(999)), "a")
    assert 60 < len(records) < 110 and ids(records)[:-1] == list(range(len(records) - 1)) and ids(records)[-1] == 999
    assert gaps == [("a", 0, len(cut), gaps[0][3])]


def test_empty_archive():
    assert warc.salvage(b"", "a") == ([], [])


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip_cases(spark, frame, compression):
    rows = [(1, "u1", "<p>a</p>"), (2, None, "<p>a</p>"), (3, "u\r\n3", None), (4, "u4", ""), (None, "u5", "é\r\nx"),
            (6, "u6", "WARC/1.1\r\n\r\n"), (6, "u6", "WARC/1.1\r\n\r\n"), (7, "u7", "z" * 100_000)]
    df = frame([(*r, 0) for r in rows], "page_id long, url string, html string, payload int")
    got = warc.round_trip(df, records_per_archive=3, compression=compression)
    out = sorted(map(tuple, got.collect()), key=str)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        first = max(same) if same else None
        kind = "response" if i == first else "revisit"
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), kind,
                     first if kind == "revisit" else None))
    assert out == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0
    small = warc.round_trip(df, min_bytes=5).filter("payload_bytes < 5")
    assert {r.record_type for r in small.collect()} == {"response"}


def test_payloads_come_back(spark, frame, tmp_path):
    df = frame([(1, "u", "héllo\r\n"), (2, "v", "")], "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "w"))
    got = {r.row_id: (r.uri, bytes(r.payload)) for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert got == {"1": ("u", "héllo\r\n".encode()), "2": ("v", b"")}


def test_damage_in_a_written_archive_loses_one_record(spark, frame, tmp_path):
    rnd = random.Random(2)
    df = frame([(i, f"u{i}", rnd.randbytes(1000).hex()) for i in range(60)], "page_id long, url string, html string")
    warc.write(df.coalesce(1), str(tmp_path / "w"))
    data = [f.read_bytes() for f in Path(tmp_path / "w").glob("part-*")]
    assert len(b"".join(map(gzip.decompress, data)).split(b"WARC/1.1")) == 61
    for whole in data:
        every = ids(warc.salvage(whole, "a")[0])
        for at in [len(whole) * k // 7 for k in range(1, 7)]:
            broken = bytearray(whole)
            broken[at] ^= 0xFF
            records, gaps = warc.salvage(bytes(broken), "a")
            assert set(ids(records)) <= set(every) and len(records) >= len(every) - 1 and gaps
            assert ids(records)[-1] == every[-1]


def test_members_end_in_the_writers_byte():
    for n in (0, 10, 17 << 20):
        assert gzip.decompress(warc.packed(b"x" * n) + b"\0") == b"x" * n
