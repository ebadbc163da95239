"""WARC archives with revisit resolution.

Headers only (digest, length, id, url) are shuffled by payload digest to find, for every payload of
at least ``min_bytes``, the original: the page with the largest id. Every other page
of that digest becomes a revisit record whose fresh headers point to the original (id, URL and date);
its payload is not written. Originals and pages below the size are response records.

Payloads are never shuffled: revisit records are made from headers alone, and the scan that writes the
responses must only know which pages to leave out. It learns that from a cascade of bitmap filters over
hashes of (id, digest): the first holds all revisits, the second the responses that the first lets through by
accident, the third the revisits that the second does, and so on until no accident is left. Since all pages are known,
the cascade is exact. A filter has at most 2 ** MOST_BITS bits (32 MB), the bound of what is broadcast. Where
accidents do not die out within ``MOST_FILTERS`` filters (more revisits than the bits can tell apart), the pages the
last filter leaves open are joined with the headers instead.

Archives are WARC/1.1 files, one record after another, written through Spark's text writer (one
gzip file per task; the record separator is the line separator), so any store works and
a lost task is only repeated. Reading them back is a stream per file: header
lines, then exactly Content-Length bytes, whatever the payload contains. Revisits then join
the responses by record id for their payload's length and digest.

Defined results: null html is the empty payload. A null page id ranks below every id. Rows
that repeat the original's id and payload are all responses (one record each). An empty
table writes an empty archive. Line breaks in an URL are percent-encoded. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopfloor.session import checkpoint_dir, materialize

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
MOST_BITS = 28
MOST_FILTERS = 8


def digested(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, url, html, bytes, sha1)."""
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                       F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return src.select("*", F.octet_length("html").cast("long").alias("bytes"), F.sha1("html").alias("sha1"))


def resolve_headers(heads: DataFrame, min_bytes: int) -> DataFrame:
    """heads (id, url, bytes, sha1) of all pages -> the same plus original and original_url: the page that a
    revisit points to, null for responses."""
    first = heads.where(F.col("bytes") >= min_bytes).groupBy("sha1", "bytes").agg(
        F.max(F.when(F.col("id").isNotNull(), F.struct("id", "url"))).alias("keep"), F.min("id").alias("least"),
        F.count("id").alias("ids"), F.count(F.lit(1)).alias("n"))
    shared = materialize(first.where((F.col("keep.id") != F.col("least")) | ((F.col("n") > F.col("ids")) & (F.col("ids") > 0)))
                         .select(F.col("sha1").alias("_sha1"), F.col("bytes").alias("_bytes"), "keep"), "warc-originals")
    joined = heads.join(shared, (F.col("sha1") == F.col("_sha1")) & (F.col("bytes") == F.col("_bytes")), "left")
    revisit = F.col("keep").isNotNull() & ~F.col("id").eqNullSafe(F.col("keep.id"))
    return joined.select("id", "url", "bytes", "sha1", F.when(revisit, F.col("keep.id")).alias("original"),
                         F.when(revisit, F.col("keep.url")).alias("original_url"))


def _spot(seed: int, bits: int) -> Column:
    """The bit of a page (id, sha1) in the filter with this seed."""
    return F.xxhash64(F.lit(seed), "id", "sha1").bitwiseAND(F.lit((1 << bits) - 1))


def bitmap_filter(keys: DataFrame, seed: int, most_bits: int = MOST_BITS) -> tuple[DataFrame, int]:
    """((bucket, bitmap), bits) of the pages ``keys`` (id, sha1): 16 bits a page up to ``most_bits``."""
    bits = min(most_bits, max(15, (16 * keys.count()).bit_length()))
    spot = _spot(seed, bits)
    made = keys.select(F.shiftright(spot, 15).alias(f"bucket{seed}"), spot.bitwiseAND(F.lit(32767)).alias("at")) \
        .groupBy(f"bucket{seed}").agg(F.bitmap_construct_agg("at").alias(f"bitmap{seed}"))
    return materialize(made, "warc-filter"), bits  # at most 2 ** (bits - 15) rows of 4 KB


def passed(rows: DataFrame, filter_: DataFrame, seed: int, bits: int) -> DataFrame:
    """``rows`` plus in<seed>: whether the filter has the page's bit."""
    spot = _spot(seed, bits)
    at = spot.bitwiseAND(F.lit(32767))
    byte = F.conv(F.hex(F.substring(F.col(f"bitmap{seed}"), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.pmod(F.floor(byte / F.pow(F.lit(2), at.bitwiseAND(F.lit(7)))), F.lit(2)) == 1
    return rows.withColumn("_b", F.shiftright(spot, 15)).join(F.broadcast(filter_), F.col("_b") == F.col(f"bucket{seed}"), "left") \
        .withColumn(f"in{seed}", F.coalesce(bit, F.lit(False))).drop("_b", f"bucket{seed}", f"bitmap{seed}")


def leave_out_revisits(src: DataFrame, heads: DataFrame, most_bits: int = MOST_BITS, most_filters: int = MOST_FILTERS) -> DataFrame:
    """The rows of ``src`` (id, sha1, ...) that are responses by ``heads`` (id, sha1, original), without moving ``src``."""
    pages = heads.select("id", "sha1", F.col("original").isNotNull().alias("is_revisit")).distinct()
    inside, others = pages.where("is_revisit"), pages.where(~F.col("is_revisit"))
    filters = []
    while len(filters) < most_filters and inside.limit(1).count():
        seed = len(filters)
        made, bits = bitmap_filter(inside, seed, most_bits)
        filters.append((made, seed, bits))
        through = materialize(passed(others, made, seed, bits).where(f"in{seed}").drop(f"in{seed}"), "warc-accidents")
        inside, others = through, inside
    open_ = bool(filters) and bool(inside.limit(1).count())
    rows, response = src, F.lit(True)
    for made, seed, bits in filters:
        rows = passed(rows, made, seed, bits)
    for _, seed, _ in reversed(filters):  # not in filter k: what filter k - 1 holds; in all: what the last one holds
        last = seed + 1 == len(filters)
        response = F.when(~F.col(f"in{seed}"), F.lit(seed % 2 == 0)).otherwise(
            F.lit(seed % 2 == 1) if last else response)
    if open_:
        sure = rows.where(~F.expr(" AND ".join(f"in{s}" for _, s, _ in filters)))
        unsure = rows.where(" AND ".join(f"in{s}" for _, s, _ in filters))
        gone = pages.where("is_revisit").select(F.col("id").alias("_id"), F.col("sha1").alias("_sha1"))
        exact = unsure.join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha1") == F.col("_sha1")), "left_anti")
        return sure.where(response).select(*src.columns).unionByName(exact.select(*src.columns))
    return rows.where(response).select(*src.columns)


def record_id(page: Column, sha1: Column) -> Column:
    """A stable urn:uuid from page id and payload digest."""
    h = F.md5(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("")), sha1))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in (
        (1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def records(resolved: DataFrame, date: str = DATE) -> DataFrame:
    """(value): the text of one WARC record, without its final separator."""
    revisit = F.col("original").isNotNull()

    def line(name: str, value: Column, when: Column | None = None) -> Column:
        text = F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
        return F.coalesce(text if when is None else F.when(when, text), F.lit(""))

    def escaped(c: str) -> Column:
        return F.regexp_replace(F.regexp_replace(c, "\r", "%0D"), "\n", "%0A")

    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    return resolved.select(F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("id"), F.col("sha1"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", escaped("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        line("WARC-Profile", F.lit(PROFILE), revisit),
        line("WARC-Refers-To", record_id(F.col("original"), F.col("sha1")), revisit),
        line("WARC-Refers-To-Target-URI", escaped("original_url"), revisit),
        line("WARC-Refers-To-Date", F.lit(date), revisit),
        line("X-Page-ID", F.col("id").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF), block).alias("value"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", min_bytes: int = 1000, date: str = DATE) -> None:
    src = digested(pages, id_col, url_col, html_col)
    heads = materialize(resolve_headers(materialize(src.drop("html"), "warc-headers"), min_bytes), "warc-resolved")
    responses = leave_out_revisits(src, heads).select("*", F.lit(None).cast("long").alias("original"),
                                                      F.lit(None).cast("string").alias("original_url"))
    revisits = heads.where(F.col("original").isNotNull()).withColumn("html", F.lit(""))
    records(responses.unionByName(revisits), date).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


RECORD = pa.schema([("type", pa.string()), ("record_id", pa.string()), ("refers", pa.string()),
                    ("page", pa.int64()), ("uri", pa.string()), ("bytes", pa.int64()), ("sha1", pa.string()),
                    ("stated", pa.string()), ("html", pa.string())])


def _parse(with_payload: bool):
    """mapInArrow over the CRLF-separated lines of whole archive files, in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (x.as_py() for b in batches for x in b.column(0))
        rows, size = [], 0
        for line in lines:
            if not line:
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"a record must start with its version, not {line[:40]!r}")
            head = {}
            for line in lines:
                if not line:
                    break
                name, _, value = line.partition(b": ")
                head[name.lower()] = value.decode()
            length, parts, have = int(head[b"content-length"]), [], -2
            while have < length:
                part = next(lines)
                parts.append(part)
                have += len(part) + 2
            block = b"\r\n".join(parts)[:length]
            payload = block.partition(b"\r\n\r\n")[2]
            full = head[b"warc-type"] == "response"
            page = head.get(b"x-page-id")
            rows.append((head[b"warc-type"], head[b"warc-record-id"], head.get(b"warc-refers-to"),
                         int(page) if page else None, head.get(b"warc-target-uri"),
                         len(payload) if full else None, hashlib.sha1(payload).hexdigest() if full else None,
                         head.get(b"warc-payload-digest", "").removeprefix("sha1:"),
                         payload.decode() if full and with_payload else None))
            size += len(block)
            if size > 1 << 24 or len(rows) >= 5000:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)
    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), RECORD.types)], schema=RECORD)


def read_archives(spark, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives under ``path``. A gzip file is never split, so its
    lines arrive in order. bytes and sha1 are measured on the payload; revisits have none."""
    lines = spark.read.option("lineSep", CRLF).text(path).select(F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(_parse(with_payload), "type string, record_id string, refers string, page bigint, uri string, "
                            "bytes bigint, sha1 string, stated string, html string")


def resolve_revisits(parsed: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to. A revisit
    takes length and digest from the response it refers to."""
    base = parsed.select("type", "record_id", "refers", "page", "bytes", "sha1")
    targets = base.where(F.col("refers").isNotNull()).select(F.col("refers").alias("rid")).distinct()
    originals = base.where(F.col("type") == "response").join(targets, F.col("record_id") == F.col("rid"), "left_semi") \
        .groupBy("record_id").agg(F.max("page").alias("o_page"), F.max("bytes").alias("o_bytes"),
                                  F.max("sha1").alias("o_sha1")).withColumnRenamed("record_id", "o_id")
    return base.join(originals, F.col("refers") == F.col("o_id"), "left").select(
        F.col("page").alias("page_id"), F.coalesce("bytes", "o_bytes").alias("payload_bytes"),
        F.coalesce("sha1", "o_sha1").alias("payload_digest"), F.col("type").alias("record_type"),
        F.col("o_page").alias("refers_to"))


def dedup_archive(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html", min_bytes: int = 1000) -> DataFrame:
    """Write deduplicated archives of ``pages`` and report every record as read back."""
    path = path or checkpoint_dir(pages.sparkSession, "warc")
    write_archives(pages, path, id_col, url_col, html_col, min_bytes)
    parsed = materialize(read_archives(pages.sparkSession, path).select(
        "type", "record_id", "refers", "page", "bytes", "sha1"), "warc-records")
    return resolve_revisits(parsed)
