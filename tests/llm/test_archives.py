"""Archives: a record for every row, gzip members, damage."""

import gzip
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bracken.llm import warc

SCHEMA = "page_id long, url string, html string"


def files(folder):
    return sorted(p for p in folder.iterdir() if p.name.startswith("part-"))


def test_repeated_rows_are_a_record_each(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "REPEATS", 3)
    rows = [(1, "u", "same")] * 12 + [(2, "u", "same")] * 2 + [(1, "v", "other")] * 2 + [(None, "w", "same"), (None, "w", "same"), (3, None, None), (3, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for least in (0, 5):
        warc.write(df, str(tmp_path / f"w{least}"), least)
        got = warc.read(spark, str(tmp_path / f"w{least}"), payloads=True).collect()
        assert len(got) == len(rows) and all(r.error is None for r in got) and len({r.record_id for r in got}) == len(rows)
        assert Counter((int(r.page_id) if r.page_id else None, r.payload_bytes) for r in got) == Counter((p, len(h or "")) for p, _, h in rows)
        responses = Counter(r.payload_digest for r in got if r.record_type == "response")
        if least:
            assert responses[warc.digest(b"same")] == 16 and responses[warc.digest(b"")] == 2 and responses[warc.digest(b"other")] == 1
        else:
            assert set(responses.values()) == {1}
            assert {r.refers_to for r in got if r.payload_digest == warc.digest(b"same") and r.record_type == "revisit"} == {"1"}
        assert all(bytes(r.payload).decode() in ("same", "other", "") for r in got if r.record_type == "response")


def test_every_record_is_a_member(spark, tmp_path):
    rows = [(i, f"u{i}", f"page {i} " * (i * 3000)) for i in range(6)]
    warc.write(spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit(1)), str(tmp_path / "w"), date="2020-02-02T00:00:00Z")
    n = 0
    for f in files(tmp_path / "w"):
        raw, first = f.read_bytes(), True
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        while raw:
            z = zlib.decompressobj(31)
            record = z.decompress(raw)
            assert z.eof and record.startswith(b"WARC/1.1") and record.endswith(b"\r\n\r\n") and record.count(b"WARC/1.1") == 1 and b"2020-02-02T00:00:00Z" in record
            assert (b"warcinfo" in record) == first
            raw, first, n = z.unused_data, False, n + 1
    assert n > 2 * len(rows)
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read(spark, str(tmp_path / "w"), payloads=True).collect()}
    assert got == {str(i): html for i, _, html in rows}


def damaged(raws):
    """Damage to the second of three records, and what is left of the others."""
    a, b, c = raws
    yield "wrong length", a + b.replace(b"Content-Length: ", b"Content-Length: 9", 1) + c, 3
    yield "no length", a + b.replace(b"Content-Length: ", b"Content-Length: x", 1) + c, 3
    yield "bad header", a + b"X" + b + c, 3
    yield "cut short", a + b + c[: len(c) // 2], 3
    yield "nothing", a + b"\r\n\r\n" + c, 3
    yield "no type", a + b.replace(b"WARC-Type", b"WARC-Tipe", 1) + c, 2
    yield "no digest", a + b.replace(b"WARC-Payload-Digest: sha1:", b"X: ", 1) + c, 3


@pytest.mark.parametrize("packed", [False, True])
def test_damage_gives_rows_with_errors(spark, tmp_path, packed):
    pages = [(1, b"one " * 50, None), (2, b"two " * 50, "<urn:uuid:1>"), (3, b"three " * 50, None)]
    raws = [warc.records(i, "u", text, f"<urn:uuid:{i}>", to, 1 if to else None)[0] + b"\r\n\r\n" for i, text, to in pages]
    for name, content, n in damaged(raws):
        at = tmp_path / f"{name}{packed}"
        at.mkdir()
        (at / "part-0").write_bytes(gzip.compress(content) if packed else content)
        got = warc.read(spark, str(at)).collect()
        good = {r.page_id for r in got if r.error is None}
        assert len(got) == n and good == ({"1", "2"} if name == "cut short" else {"1", "3"}), (name, got)
        assert all(r.payload_digest is None for r in got if r.error)


def test_damaged_members_leave_the_others(spark, tmp_path):
    members = [gzip.compress(warc.records(i, "u", b"text %d " % i * 99, f"<urn:uuid:{i}>", None, None)[0] + b"\r\n\r\n") for i in range(4)]
    bad = bytearray(members[1])
    bad[len(bad) // 2] ^= 0xFF
    (tmp_path / "part-0").write_bytes(members[0] + bytes(bad) + members[2] + members[3][:-20])
    got = warc.read(spark, str(tmp_path)).collect()
    assert {"0", "2"} <= {r.page_id for r in got if r.error is None} <= {"0", "2", "3"} and any(r.error for r in got)


def test_lost_first_segment(spark, tmp_path):
    made = warc.records(7, "u", b"payload " * 5000, "<urn:uuid:x>", None, None, segment=10_000)
    (tmp_path / "part-0").write_bytes(b"".join(r + b"\r\n\r\n" for r in made[1:]))
    (row,) = warc.read(spark, str(tmp_path)).collect()
    assert row.page_id == "7" and row.error == "segment 1 is missing" and row.payload_digest is None
