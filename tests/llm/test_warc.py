import base64
import hashlib

from ledgerloom.llm import registry, warc
from ledgerloom.llm.scratch import new_folder

PAGES = "page_id long, url string, html string, key string, file string"
ROWS = [
    (5, "http://B.example.com/x?y=1#f", "<p>same</p>"),
    (3, "http://a.example.com:8080/", "<p>same</p>"),
    (9, "http://a.example.com:8080/", "<p>same</p>"),
    (1, None, None),
    (2, "", ""),
    (4, "not a url é", "é" * 70_000),
    (6, "http://[bad", "x\r\n\r\ny"),
    (6, "http://[bad", "x\r\n\r\ny"),
    (None, "http://z.example/", "only"),
    (None, "http://z.example/", "<p>same</p>"),
]


def told(pages):
    smallest = {}
    for page_id, _, html in pages:
        smallest.setdefault(html or "", []).append(page_id)
    out = []
    for page_id, _, html in pages:
        data = (html or "").encode()
        known = [p for p in smallest[html or ""] if p is not None]
        first = min(known) if known else None
        response = page_id == first
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else first))
    return sorted(map(str, out))


def test_round_trip_of_odd_pages(spark):
    pages = spark.createDataFrame([(*r, "extra", "extra") for r in ROWS], PAGES)
    rows = warc.round_trip(pages, payloads=True).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in rows) == told(ROWS)
    texts = {(r.page_id, bytes(r.payload)) for r in rows if r.record_type == "response"}
    assert (4, ("é" * 70_000).encode()) in texts and (6, b"x\r\n\r\ny") in texts
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_index_of_small_blocks_finds_each_key(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.example.org/{i % 13}", f"page {i % 50}") for i in range(300)], "page_id long, url string, html string")
    folder = new_folder(spark, "warc-test")
    captures = warc.write_archives(pages, folder, archive_bytes=2000)
    files = warc.write_index(captures, folder, block_lines=3)
    reader, held = warc.IndexReader(folder, files), {}
    for c in captures.collect():
        held.setdefault(c.key, []).append((c.file, c.offset, c.length))
    assert len(held) == 300
    for key, entries in held.items():
        assert sorted(reader.find(key)) == sorted(entries)
    assert reader.find("org,example)/none") == [] and reader.find("") == [] and reader.find("~") == []


def test_url_keys():
    assert warc.url_key("HTTP://User@WWW.Example.com:80/A/b?q=1#x") == "com,example,www:80)/A/b?q=1"
    assert warc.url_key("http://example.com") == "com,example)/"
    assert warc.url_key(None) == ")"


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    pages = [(p.page_id, p.url, p.html) for p in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rows = registry.op9_warc(spark, sf).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in rows) == told(pages)
