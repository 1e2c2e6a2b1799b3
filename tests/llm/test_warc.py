"""WARC: SQL of the query, and transactions read from files written and from hand-made records."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from quoinlake.llm.catalog import QUERIES, SQL
from quoinlake.llm.warc import captures, read_records, records_of, transactions, with_revisits, write_warc
from quoinlake.workspace import new_folder
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"


def test_query_matches_its_sql(spark):
    assert compare(spark, duck(SF), QUERIES["op4_warc"], SQL["op4_warc"], SF) == ""


def test_revisits_round_trip(spark):
    html = "<p>\r\n\r\nWARC/1.1\r\né</p>\r\n\r\n"
    rows = [(5, "http://a b/x\n%", html, 1), (3, "u", html, 1), (9, None, None, 1), (4, "u", "", 1), (7, "u", "other", 1), (3, "u", html, 2), (None, "u", "z", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n int")
    folder = new_folder(spark, "w")
    write_warc(with_revisits(captures(df, "page_id", "url", "html")), folder)
    got = transactions(read_records(spark, folder)).collect()
    seen = []
    for r in got:
        page = int(bytes(r["metadata"]["payload"]).decode().split(": ")[1])
        resp = r["response"]
        payload = next((h or "") for p, _, h, _ in rows if p == page).encode()
        assert resp["payload_bytes"] == len(payload)
        assert resp["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode() == resp["declared"][5:]
        assert resp["target"] == next((u or "") for p, u, *_ in rows if p == page)
        if resp["record_type"] == "response":
            assert bytes(resp["payload"]) == payload and resp["refers_to"] is None
        seen.append((page, resp["record_type"]))
        assert r["request"]["target"] == resp["target"]
    assert sorted(seen) == [(3, "response"), (3, "revisit"), (4, "response"), (5, "revisit"), (7, "response"), (9, "revisit")]


def test_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = with_revisits(captures(df, "page_id", "url", "html"), least_bytes=5).where("first is not null").collect()
    assert [r["id"] for r in got] == [4]


def test_transaction_without_its_other_records(spark):
    one = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Length: 6\r\n\r\nH\r\n\r\nab"[:-1] + b"b\r\n\r\n"
    assert len(list(records_of(one))) == 1
    records = spark.createDataFrame(
        [("<x>", "response", None, None, "u", None, None, bytearray(b"ab"), 2, "D")],
        "record_id string, record_type string, concurrent_to string, refers_to string, target string, captured string, declared string, payload binary, payload_bytes long, payload_digest string",
    )
    r = transactions(records).first()
    assert r["request"] is None and r["metadata"] is None and r["response"]["payload_bytes"] == 2


def test_no_rows(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    folder = new_folder(spark, "w")
    write_warc(with_revisits(captures(df, "page_id", "url", "html")), folder)
    assert transactions(read_records(spark, folder)).count() == 0
    assert captures(df.withColumn("id", F.lit(1)), "page_id", "url", "html").columns[0] == "id"


def record(kind, n, block, names=str):
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<{kind}{n}>"), ("WARC-Concurrent-To", f"<response{n}>"),
               ("WARC-Target-URI", f"http://h/\r\n {n}"), ("Content-Length", len(block))]
    return b"WARC/1.0\r\n" + b"".join(f"{names(k)}:  {v}\r\n".encode() for k, v in headers) + b"\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("names", [str, str.lower, str.upper])
@pytest.mark.parametrize("form", ["plain", "one member", "a member a record", "members and zeros"])
def test_archives_of_other_writers(spark, tmp_path, form, names):
    page = "x" * 200_000 + "\r\n\r\nWARC/1.0\r\n"
    parts = [record("warcinfo", 0, b"software: other\r\n", names)]
    for n in range(20):
        parts += [record("request", n, b"GET / HTTP/1.1\r\n\r\n", names),
                  record("response", n, f"HTTP/1.1 200 OK\r\n\r\n{page}{n}".encode(), names),
                  record("metadata", n, f"n: {n}".encode(), names)]
    parts.append(record("response", 20, b"no headers of HTTP", names))
    whole = {"plain": b"".join(parts), "one member": gzip.compress(b"".join(parts))}
    members = b"".join(map(gzip.compress, parts))
    (tmp_path / "other.warc").write_bytes(whole.get(form) or members + (b"\0" * 512 if form.endswith("zeros") else b""))
    records = read_records(spark, str(tmp_path))
    assert records.count() == 62
    got = {r["record_id"]: r for r in transactions(records).collect()}
    assert len(got) == 21 and bytes(got["<response20>"]["response"]["payload"]) == b"no headers of HTTP"
    for n in range(20):
        r = got[f"<response{n}>"]
        assert bytes(r["response"]["payload"]) == f"{page}{n}".encode()
        assert r["request"]["target"] == r["response"]["target"] == f"http://h/ {n}"
        assert bytes(r["metadata"]["payload"]) == f"n: {n}".encode()


@pytest.mark.parametrize("packed", [False, True])
def test_truncated_archive_is_an_error(packed):
    data = record("response", 1, b"H\r\n\r\nabc")
    data = gzip.compress(data)[:-9] if packed else data[:-6]
    with pytest.raises(EOFError):
        list(records_of(data))
