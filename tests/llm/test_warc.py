import hashlib

import pytest

from tessera.llm import warc as W


def want(rows):
    data = [(p, u, (h or "").encode()) for p, u, h in rows]
    first = {}
    for p, _, b in data:
        if len(b) >= 100 and p is not None:
            first[b] = min(p, first.get(b, p))
    out = []
    for p, u, b in data:
        f = first.get(b)
        f = None if f == p else f
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if f is not None else "response", f, u))
    return sorted(out, key=str)


def test_round_trip_with_segments(spark, tmp_path):
    big = "é" * 3000 + "\r\n\r\nWARC/1.1\r\n" + "x" * 5000
    rows = [(3, "http://a", "y" * 100), (1, "http://b", "y" * 100), (1, "http://b2", "y" * 100), (None, "http://n", "y" * 100), (2, None, "z" * 99), (4, "http://c", "z" * 99), (5, "u\r\nv", None), (6, "http://e", ""), (7, "http://big", big), (8, "http://big", big)]
    df = spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, row int, digest string")
    path = W.write_archives(df, str(tmp_path / "w"), archive_bytes=4096, segment_bytes=700)
    got = W.read_archives(spark, path).collect()
    assert sorted(((r.page_id, r.length, r.digest, r.record_type, r.refers_to, r.url) for r in got), key=str) == [(a, b, c, d, e, "u%0D%0Av" if u == "u\r\nv" else u) for a, b, c, d, e, u in want(rows)]
    assert {bytes(r.payload) for r in got if r.record_type == "response" and r.page_id == 7} == {big.encode()}
    back = W.page_records(df, str(tmp_path / "q")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(str, map(tuple, back))) == sorted(str(x[:5]) for x in want(rows))
    assert W.page_records(df.limit(0), str(tmp_path / "e")).count() == 0


def test_framing():
    for payload in (b"", b"a", b"x" * 70_000):
        assert W.dechunked(W.chunked(payload, 1000)) == payload
    with pytest.raises(ValueError):
        W.dechunked(b"5\r\nabc\r\n0\r\n\r\n")
    with pytest.raises(ValueError):
        list(W.parse(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcd\r\n\r\n"))


def test_missing_segment_is_an_error(spark, tmp_path):
    record = next(W.records(0, 1, "u", b"x" * 400, "d", None, 150))
    (tmp_path / "a.warc").write_bytes(record + W.TRAILER)
    with pytest.raises(Exception, match="segments are missing"):
        W.read_archives(spark, str(tmp_path)).collect()


def test_repeated_missing_and_odd_segments(spark, tmp_path):
    good = list(W.records(0, 1, "u", b"x" * 400, "d", None, 150))
    assert len(good) == 4
    cases = {"twice": [good[0], good[1], good[1], good[3]], "early": good[1:], "gap": [good[0], good[1], good[3]], "last": good[:3], "again": [*good, good[2]]}
    for name, records in cases.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(b"".join(r + W.TRAILER for r in records))
        with pytest.raises(Exception, match="segments are missing, repeated"):
            W.read_archives(spark, str(tmp_path / name)).collect()
    (tmp_path / "mixed").mkdir()
    for k, r in enumerate(reversed(good)):  # out of order, in different files
        (tmp_path / "mixed" / f"{k}.warc").write_bytes(r + W.TRAILER)
    assert [bytes(r.payload) for r in W.read_archives(spark, str(tmp_path / "mixed")).collect()] == [b"x" * 400]


def test_many_repeated_payloads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "REPEATED", 0)
    monkeypatch.setattr(W, "SALT_ROWS", 4)
    rows = [(i, f"u{i}", ("a" if i % 3 else f"b{i % 2}") * 120) for i in range(60)] + [(70, None, "s" * 99), (71, None, "s" * 99), (None, None, "a" * 120)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    back = W.page_records(df, str(tmp_path / "q")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(str, map(tuple, back))) == sorted(str(x[:5]) for x in want(rows))
