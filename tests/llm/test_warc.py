import gzip
import hashlib

import pytest

from tidemark.llm.warc import assemble, parse_archive, read_warc, warc_records, warc_round_trip, write_warc

SCHEMA = "page_id long, url string, html string, type string, _key int"


def rows(*pages):
    return [(i, f"http://h{i}.example.org/p?q=1", html, "t", 1) for i, html in pages]


def test_round_trip(spark, tmp_path):
    long = "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 9_000
    same = "é" * 60
    pages = [(3, same), (1, same), (2, same), (4, "short"), (5, "short"), (6, None), (7, ""), (8, long), (9, long), (10, "a" * 99), (11, "a" * 99), (12, "b" * 100), (13, "b" * 100)]
    df = spark.createDataFrame(rows(*pages), SCHEMA)
    got = {r.page_id: tuple(r)[1:] for r in warc_round_trip(df, "page_id", "url", "html", str(tmp_path / "w")).collect()}
    first = {}
    for i, html in sorted(pages):
        raw = (html or "").encode()
        lead = first.setdefault(raw, i) if len(raw) >= 100 else i
        to = None if lead == i else lead
        assert got[i] == (len(raw), hashlib.sha256(raw).hexdigest(), "response" if to is None else "revisit", to)
    assert len(got) == len(pages)


def test_awkward(spark, tmp_path):
    pages = [(1, "http://a\r\nb", "x" * 200, "t", 1)] * 2 + [(None, None, "x" * 200, "t", 1), (None, None, None, "t", 1), (2, None, "y", "t", 1)]
    df = spark.createDataFrame(pages, SCHEMA)
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc_round_trip(df, "page_id", "url", "html", str(tmp_path / "w")).collect()), key=str)
    assert got == [(1, "response", None), (1, "revisit", 1), (2, "response", None), (None, "response", None), (None, "revisit", 1)]
    repeated = [(7, "u", "same", "t", 1)] * 2 + [(None, "u", "z" * 300, "t", 1)] * 2
    out = warc_round_trip(spark.createDataFrame(repeated, SCHEMA), "page_id", "url", "html", str(tmp_path / "r")).collect()
    assert sorted((str(r.page_id), r.record_type) for r in out) == [("7", "response")] * 2 + [("None", "response"), ("None", "revisit")]
    assert warc_round_trip(df.where("false"), "page_id", "url", "html", str(tmp_path / "e")).count() == 0


def test_nested_captures(spark, tmp_path):
    df = spark.createDataFrame(rows((1, "<p>one</p>")), SCHEMA)
    path = str(tmp_path / "w")
    write_warc(warc_records(df, "page_id", "url", "html"), path)
    records = read_warc(spark, path)
    (capture,) = assemble(records).collect()
    assert capture.response.payload == b"<p>one</p>" and capture.target_uri == "http://h1.example.org/p?q=1"
    assert capture.request.type == "request" and capture.metadata.fields == "page-id: 1\r\n"
    orphans = assemble(records.where("type <> 'response'").unionByName(records.where("type = 'request'"))).collect()
    assert [(o.response, o.request.type, o.metadata.type) for o in orphans] == [(None, "request", "metadata")]


def test_parser():
    record = b"WARC/1.0\r\nWARC-Type: metadata\r\nwarc-record-id: <a>\r\nContent-Length: 4\r\n\r\nab\r\n\r\n\r\n"
    plain = record * 2
    members = gzip.compress(record) + gzip.compress(record)
    for raw in (plain, gzip.compress(plain), members):
        assert [(r[0], r[-2]) for r in parse_archive(raw, True)] == [("<a>", "ab\r\n")] * 2
    assert list(parse_archive(b"", True)) == []
    with pytest.raises(ValueError):
        list(parse_archive(record[:-8], True))
    with pytest.raises(ValueError):
        list(parse_archive(b"HTTP/1.1 200 OK\r\n\r\n", True))


def test_plain_and_gzipped_archives_of_any_name(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <%d>\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    for i, (name, pack) in enumerate([("a.warc", bytes), ("b.warc.gz", gzip.compress), ("deep/c", gzip.compress)]):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(pack(record % i))
    assert sorted(r.record_id for r in read_warc(spark, str(tmp_path)).collect()) == ["<0>", "<1>", "<2>"]
