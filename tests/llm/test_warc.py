import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from granary.llm import warc
from granary.llm.warc import arc_record, arc_version_block, parse_arc, members, parse_warc, payload_of, records_of, round_trip, warc_date, write_warc

SCHEMA = "page_id long, url string, html string, first long, key string"


def test_round_trip_and_revisits(spark):
    same = "<p>WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n</p>\n"
    pages = [(5, "http://a/ b?c\n", same), (3, "http://ä.de/ü", same), (9, None, same), (1, "-", None), (2, "x%20", ""), (7, "http://long", "é" * 200_000), (8, "http://u", "unique")]
    df = spark.createDataFrame([(*p, 1, "k") for p in pages], SCHEMA)
    got = {r.page_id: r for r in round_trip(df).collect()}
    first = {}
    for i, url, html in sorted(pages):
        raw = (html or "").encode()
        lead = first.setdefault(raw, i)
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if lead == i else ("revisit", lead))
        assert r.target_uri == ("about:blank" if url is None else url.replace("\n", "%0A"))
    assert len({r.record_id for r in got.values()}) == len(pages)
    short = {r.page_id: r.record_type for r in round_trip(df, 10).collect()}
    assert short[1] == short[2] == "response" and short[9] == short[5] == "revisit"


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "u", "a", 0, ""), (1, "u", "a", 0, ""), (1, "u", "b", 0, ""), (None, "u", "a", 0, ""), (4, "v", "a", 0, "")], SCHEMA)
    got = round_trip(df).collect()
    assert len(got) == 5 and len({r.record_id for r in got}) == 5
    assert sorted(r.record_type for r in got if r.payload_bytes == 1 and r.refers_to == 1) == ["revisit"] * 3
    assert round_trip(df.limit(0)).count() == 0


def test_arc_versions():
    body = b"HTTP/1.0 200 OK\n\nbody\n\n"
    for version in (1, 2):
        data = arc_version_block(version) + arc_record("http://x/a b", body, version, "20010203040506", "1.2.3.4") + arc_record(None, b"", version)
        (f, p), (g, q) = parse_arc(data)
        assert (f["url"], f["date"], f["ip"], f["version"], p) == ("http://x/a b", "20010203040506", "1.2.3.4", version, body) and (g["url"], q) == (None, b"")
    for bad in (b"a b c\n", b"http://x 1.1.1.1 2000 text/html 99\nshort", b"http://x 1.1.1.1 2000 text/html many\n", b"no end"):
        with pytest.raises(ValueError):
            list(parse_arc(bad))
    assert warc_date("2001") == "2001-01-01T00:00:00Z" and warc_date("20019999") == "1970-01-01T00:00:00Z"


def test_archives_convert(spark):
    data = arc_version_block(1) + arc_record("http://x/", b"one") + arc_record("http://y/", b"two")
    df = spark.createDataFrame([(bytearray(data), "f1"), (None, "f2")], "content binary, name string")
    out = {r.key: bytes(r.warc) for r in records_of(df, F.col("content"), F.col("name")).collect()}
    heads = list(parse_warc(out["f1"]))
    assert [payload_of(*x) for x in heads] == [b"one", b"two"] and all(x[1].startswith(b"HTTP/1.1 200") for x in heads) and out["f2"] == b"" and heads[0][0]["warc-type"] == "response"


def test_records_are_gzip_members_in_bounded_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 3000)
    pages = [(i, f"http://h/{i}", "é" * (i * 100)) for i in range(20)] + [(99, "http://long", "x" * (17 << 20))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    write_warc(df, str(tmp_path / "w"))
    files = [f.read_bytes() for f in (tmp_path / "w").rglob("part-*")]
    assert len(files) > 5
    records = [r for f in files for r in members(f)]
    assert len(records) == 21 and all(len(list(parse_warc(r))) == 1 for r in records)
    assert all(len(f) < 3000 + 400 for f in files if len(list(members(f))) > 1)
    assert {payload_of(*next(parse_warc(r))).decode() for r in records} == {p[2] for p in pages}
    with pytest.raises(ValueError):
        list(members(files[0][:-9]))


def test_string_ids(spark):
    df = spark.createDataFrame([("b", "u", "x"), ("a", "u", "x"), (None, "u", "y")], "page_id string, url string, html string")
    assert {(r.page_id, r.record_type, r.refers_to) for r in round_trip(df).collect()} == {("a", "response", None), ("b", "revisit", "a"), (None, "response", None)}
