import hashlib

import pytest
from compare import duck_rows, spark_rows

from palimpsest.llm import warc as W

BIG = "<html>" + "a page of some length " * 80 + "é</html>"
ROWS = [
    (1, "http://a/1", BIG), (2, "http://a/2", BIG), (9, None, BIG), (3, "http://a/3", "small"), (4, "http://a/4", "small"), (5, "http://a/ 5\r\nx: y", None),
    (6, "", ""), (None, "http://a/n", BIG), (None, "u", "tiny"), (9, None, BIG), (7, "http://a/7", BIG + "!" * 300000),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, offset int")


def want(rows):
    owner = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 1000 and i is not None:
            owner[raw] = max(owner.get(raw, i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        own = owner.get(raw)
        revisit = own is not None and own != i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", own if revisit else None))
    return sorted(out, key=repr)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_round_trip(spark):
    index = W.write_archives(spark, pages(spark))
    found = W.read_records(spark, index).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in found), key=repr) == want(ROWS)
    texts = {i: h for i, _, h in ROWS if i is not None}
    for r in found:
        if r["record_type"] == "response" and r["page_id"] is not None:
            assert bytes(r["payload"]).decode() == (texts[r["page_id"]] or "")


def test_selected_records_only(spark):
    index = W.write_archives(spark, pages(spark))
    some = W.read_records(spark, index.where("page_id IN (3, 7)")).collect()
    assert sorted(r["page_id"] for r in some) == [3, 7]
    assert W.read_records(spark, W.write_archives(spark, pages(spark, []))).collect() == []


def test_records_are_gzip_members_of_their_own(tmp_path):
    import gzip

    a = W.page_record(1, "http://x", b"one", hashlib.sha1(b"one").hexdigest(), None, False)
    b = W.page_record(2, "http://x", b"one", hashlib.sha1(b"one").hexdigest(), 1, True)
    text = gzip.decompress(a + b)
    assert text.count(b"WARC/1.1\r\n") == 2 and b"WARC-Refers-To: " + W.record_id(1).encode() in text
    assert W.parse_record(b)[0]["warc-type"] == "revisit"
    for bad in (a[:-9], b"no gzip", a[:20] + bytes([a[20] ^ 255]) + a[21:]):
        with pytest.raises((ValueError, KeyError)):
            W.parse_record(bad)


def test_query(spark, sf):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted((tuple(r[c] for c in COLUMNS) for r in W.op6_warc(spark, sf).collect()), key=repr) == want(rows)


def test_sql(spark, sf):
    assert spark_rows(W.op6_warc(spark, sf)) == duck_rows(W.OP6_SQL, sf)
