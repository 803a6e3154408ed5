import base64
import glob
import hashlib
from collections import Counter

import pytest

from palimpsest.llm import warc_chain as W

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:666>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
PAGES = [
    (1, "http://a/1", "<p>x</p>"),
    (2, "http://a/2", "<p>x</p>"),
    (3, "http://a/3", None),
    (4, None, ""),
    (4, None, ""),
    (5, "http://a/\r\nX: y", "é日本\r\n\r\nWARC/1.0\r\nnot a header"),
    (6, "http://a/WARC/1.0", "before " + FAKE + FAKE + " after"),
    (7, "http://a/7", FAKE * 40),
    (8, "http://a/8", "z" * 20000),
    (9, "http://a/9", "WARC/1." * 300),
    (None, "http://a/none", "nobody"),
    (11, "http://a/11", "HTTP/1.1 200 OK\r\n\r\n" + "WARC/1.0\r\nWARC-Type: x\r\nContent-Length: 999999\r\n\r\n"),
]


def brute(rows):
    first = {}
    for i, _, h in rows:
        first.setdefault(h or "", []).append(i)
    out = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        ids = [x for x in first[h or ""] if x is not None]
        head = min(ids) if ids else None
        again = head is not None and i != head
        out[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", head if again else None] += 1
    return out


def results(df):
    return Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect())


@pytest.mark.parametrize("split", ["128m", "4k", "333"])
def test_round_trip_at_any_split(spark, tmp_path, split):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'clash' payload", "'clash' payload_bytes").coalesce(1 if split != "4k" else 3)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert results(W.round_trip(pages, f"{tmp_path}/w")) == brute(PAGES)
        rows = W.read_warc(spark, f"{tmp_path}/w", payload=True).where("type = 'response'").collect()
        assert Counter(bytes(r["payload"]) for r in rows if r["payload"]) == Counter({h.encode() for i, _, h in PAGES if h})
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_archives_by_a_plain_reader(spark, tmp_path):
    W.write_warc(spark.createDataFrame(PAGES, "page_id long, url string, html string"), f"{tmp_path}/w")
    n = 0
    for file in glob.glob(f"{tmp_path}/w/part-*"):
        data, at = open(file, "rb").read(), 0
        while at < len(data):
            head, _, _ = data[at:].partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.0\r\n")
            fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
            end = at + len(head) + 4 + int(fields[b"Content-Length"])
            assert data[end : end + 4] == b"\r\n\r\n"
            at, n = end + 4, n + 1
    assert n == len(PAGES)


def test_supplied_pages_and_empty_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert results(W.round_trip(pages)) == brute([tuple(r) for r in pages.select("page_id", "url", "html").collect()])
    assert W.round_trip(pages.where("false")).count() == 0


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    assert {r["page_id"]: r["record_type"] for r in W.round_trip(pages, min_bytes=3).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


@pytest.mark.parametrize("split", ["128m", "4k"])
def test_a_long_url_and_what_follows(spark, tmp_path, split):
    pages = [(1, "http://a/1", "one"), (2, "http://a/" + "x" * 100_000, "two"), (3, "http://a/" + "WARC/1.0\r\n" * 20_000, "three"), (4, "http://a/4", "four")]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = W.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), f"{tmp_path}/w")
        assert results(got) == brute(pages)
        assert {r["page_id"]: r["url"] for r in got.collect()}[2] == pages[1][1]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_broken_chain_is_an_error(spark, tmp_path):
    W.write_warc(spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1), f"{tmp_path}/w")
    (file,) = glob.glob(f"{tmp_path}/w/part-*")
    data = open(file, "rb").read()
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken/a.warc").write_bytes(data.replace(b"<urn:x-page:8>\r\nWARC-Date", b"<urn:x-page:8> longer\r\nWARC-Date").replace(b"Content-Length: 20", b"Content-Length: 10"))
    with pytest.raises(ValueError, match="no record at offset"):
        W.read_warc(spark, f"{tmp_path}/broken")


def test_ids_that_are_strings(spark, tmp_path):
    pages = [("a:b c%", "u", "one"), ("", "u", "two"), (None, "u", "three"), ("é\r\n>", "u", "one"), ("z", "u", "five")]
    got = W.round_trip(spark.createDataFrame(pages, "page_id string, url string, html string"), f"{tmp_path}/w")
    assert results(got) == brute(pages)


@pytest.mark.parametrize("split", ["128m", "4k"])
def test_payloads_full_of_open_headers(spark, tmp_path, split):
    header = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 99999999\r\n\r\n"
    pages = [(k, "u", header * 400 + str(k)) for k in range(3)] + [(9, "u", "plain")]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert results(W.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), f"{tmp_path}/w")) == brute(pages)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
