"""WARC archives written and read back, against a plain rule."""
import gzip
import hashlib
import glob

import duckdb
from pyspark.sql import functions as F

from schemaloom.llm import warc
from schemaloom.llm.oracle import ORACLE
from schemaloom.llm.queries import QUERIES

BIG, OTHER = "<p>" + "x" * 200, "<p>é" + "y" * 90_000
PAGES = [(5, "http://a/5", BIG), (3, "http://a/3", BIG), (9, "http://a/9\r\nX: y", BIG),
         (4, "u4", "short"), (2, "u2", "short"), (1, "u1", None), (6, None, ""), (7, "u7", OTHER),
         (8, "u8", OTHER), (3, "http://a/3", BIG), (10, "u", "a\r\n\r\nb" * 40), (11, "u", "x" * 99),
         (12, "u", "x" * 99), (13, "u", "x" * 100), (14, "u", "x" * 100), (None, "n", BIG)]


def plain():
    first = {}
    for i, _, h in PAGES:
        h = h or ""
        if len(h.encode()) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h in PAGES:
        h = h or ""
        again = h in first and i != first[h]
        out.append((i, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(),
                    "revisit" if again else "response", first[h] if again else None))
    return out


def frame(spark, rows):
    return (spark.createDataFrame(rows, "page_id long, url string, html string")
            .withColumn("payload_digest", F.lit("clash")).withColumn("record_type", F.lit(0)))


def test_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}/w"
    manifest = warc.write_archives(frame(spark, PAGES), root, file_bytes=300)
    assert manifest.count() > 2 and manifest.agg(F.sum("records")).first()[0] == len(PAGES)
    rows = warc.read_archives(spark, root, manifest).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, plain()))
    html = {i: h or "" for i, _, h in PAGES}
    assert all(r.html == html[r.page_id] for r in rows if r.record_type == "response"
               and r.page_id is not None)
    raw = b"".join(gzip.open(p).read() for p in glob.glob(f"{tmp_path}/w/*.gz"))
    assert raw.count(b"WARC/1.1\r\n") == len(PAGES) and raw.count(OTHER.encode()) == 1


def test_empty(spark):
    assert warc.archive(frame(spark, [])).collect() == []


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.sql(ORACLE["op8_warc_revisits"])
    got = QUERIES["op8_warc_revisits"](spark, sf).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
