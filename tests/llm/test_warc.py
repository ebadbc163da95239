import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from shopfloor.llm.warc import dedup_archive, leave_out_revisits, read_archives, write_archives
from shopfloor.session import materialize

SCHEMA = "page_id long, url string, html string, value string, anchor int"


def pages(spark):
    big, tricky = "<p>" + "x" * 2000 + "</p>", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n\r\r\n" + "é" * 600 + "\r"
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (9, "http://a/9", big), (3, "http://a/3", "small"),
            (4, "http://a/4", "small"), (5, None, None), (6, "http://a/6\r\nX: y", ""), (7, "u", tricky), (8, "u", tricky),
            (10, "u", "y" * 1000), (11, "u", "y" * 1000), (12, "u", "z" * 999), (13, "u", "z" * 999),
            (14, "u", "\r\n" * 700), (15, "u", "q" * 1500), (15, "u", "q" * 1500), (None, "u", "q" * 1500), (None, "u", "n" * 1200),
            (16, "u", "日本" * 400), (17, "u", "\n\r" * 600 + "\r\n")]
    return spark.createDataFrame([(*r, "v", 1) for r in rows], SCHEMA)


def brute(rows, least=1000):
    groups = {}
    for i, h in rows:
        groups.setdefault(h or "", []).append(i)
    out = []
    for i, h in rows:
        data, ids = (h or "").encode(), [x for x in groups[h or ""] if x is not None]
        keep = max(ids) if ids and len(data) >= least else None
        again = keep is not None and i != keep
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", keep if again else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("parts", [1, 5])
def test_read_back_equals_brute_force(spark, parts):
    df = pages(spark).repartition(parts)
    got = dedup_archive(df).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == \
        brute([(r.page_id, r.html) for r in df.collect()])


def test_archive_contents(spark, tmp_path):
    path = str(tmp_path / "w")
    write_archives(pages(spark), path)
    got = read_archives(spark, path, with_payload=True).collect()
    html = {r.page_id: r.html for r in pages(spark).collect()}
    for r in got:
        assert r.stated and (r.type == "revisit") == (r.html is None) == (r.refers is not None)
        if r.html is not None:
            assert r.sha1 == r.stated and (r.page is None or r.html == (html[r.page] or ""))
    assert next(r.uri for r in got if r.page == 6) == "http://a/6%0D%0AX: y"
    written = sum(p.stat().st_size for p in (tmp_path / "w").glob("*.gz"))
    assert written > 0


def test_filter_cascade_is_exact(spark):
    """Small filters let many pages through by accident; what is left out is exact all the same, and the pages
    themselves never move while accidents die out."""
    n = 30_000
    heads = spark.range(n).selectExpr("id", "sha1(string(id % 21001)) as sha1", "CASE WHEN id % 3 = 0 THEN id + 1 END as original",
                                      "string(id) as url")
    heads = materialize(heads.unionByName(heads.where("id < 5").withColumn("id", F.lit(None).cast("long"))), "test-heads")
    src = heads.drop("original").withColumn("html", F.lit("body"))
    want = sorted(str(r.id) + r.url for r in heads.where("original IS NULL").collect())
    for bits, filters in ((28, 8), (15, 12), (15, 1), (15, 2), (15, 3)):
        out = leave_out_revisits(src, heads, bits, filters)
        assert out.columns == src.columns
        assert sorted(str(r.id) + r.url for r in out.collect()) == want
        if filters >= 8:
            assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert leave_out_revisits(src, heads.withColumn("original", F.lit(None).cast("long"))).count() == n + 5


def test_revisits_name_their_original(spark, tmp_path):
    path = str(tmp_path / "w")
    write_archives(pages(spark), path)
    text = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz"))
    heads = [h for h in text.split(b"WARC/1.1\r\nWARC-Type: ") if h.startswith(b"revisit")]
    one = next(h for h in heads if b"X-Page-ID: 1\r\n" in h)
    assert b"WARC-Refers-To-Target-URI: http://a/9\r\n" in one and b"WARC-Refers-To-Date: " in one


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert dedup_archive(none).collect() == []
