"""Benchmark decontamination: a broadcast set of benchmark n-grams against every training window.

Benchmark texts become windows of ``n`` consecutive words (a shorter text is one window).
The distinct windows, keyed by a hash of their whole wording, are the hash set. Documents are scanned
position by position in one map-only pass: a position whose first words begin no window (a second, smaller
set, one entry per beginning) is done; for the others the whole window is hashed once per window length,
looked up, and verified by its wording. However many windows begin alike, a position costs one lookup per
length. Only verified hits leave the pass; they are then aggregated per document.

The set is broadcast in blocks of at most ``block_bytes`` (measured before the scan). A
larger benchmark is scanned in several blocks whose hits are united, so no size drops a
window and no broadcast exceeds the bound.

Defined results: null text has no words, so neither hits nor makes windows. Benchmark texts
without words make no window; equal windows of several items count for each of them. Rows
that repeat a document id are judged one by one. Empty tables give an empty result, or no
hits. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopfloor.llm.text import ALNUM_WORD, ascii_lower
from shopfloor.session import materialize

PREFIX_WORDS = 3
BLOCK_BYTES = 64 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(ALNUM_WORD), 0)


def _prefix_key(ws: Column, at: Column, p: int) -> Column:
    return F.xxhash64(F.lit(p), *[F.get(ws, at + k) for k in range(p)])


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(item, len, gram, p, key): every window of every item; ``p`` words make the key."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("ws")) \
        .where(F.size("ws") > 0)
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("ws") - n, F.lit(0))))
    grams = items.select("item", at.alias("at"), "ws") \
        .select("item", F.slice("ws", F.col("at") + 1, n).alias("ws"))
    key = reduce(lambda rest, p: F.when(F.size("ws") == p, _prefix_key(F.col("ws"), F.lit(0), p)).otherwise(rest),
                 range(1, PREFIX_WORDS), _prefix_key(F.col("ws"), F.lit(0), PREFIX_WORDS))
    return grams.select("item", F.size("ws").alias("len"), F.array_join("ws", " ").alias("gram"),
                        F.least(F.size("ws"), F.lit(PREFIX_WORDS)).alias("p"), key.alias("key")).distinct()


def window_hits(docs: DataFrame, id_col: str, text_col: str, windows: DataFrame,
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, id, h, n_words, pos, len, wid): one row per document with pos = -1 that carries
    n_words, and one per verified occurrence of a window."""
    grams = windows.select("key", "len", "gram", "p").distinct() \
        .withColumn("wid", F.xxhash64("gram", F.lit("w")))
    stats = grams.agg(F.sum(F.octet_length("gram") + 64).alias("bytes"),
                      F.collect_set("p").alias("ps")).first()  # at most PREFIX_WORDS values
    blocks = max(1, -(-(stats["bytes"] or 0) // block_bytes))
    sentinel = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("long").alias("key")))

    def keys(p: int) -> Column:
        last = F.size("ws") - p
        return F.when(last >= 0, F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.struct(i.alias("pos"), _prefix_key(F.col("ws"), i, p).alias("key")))
        ).otherwise(F.slice(sentinel, 1, 0))

    scan = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    if blocks > 1:  # every block must see the same row numbers
        scan = materialize(scan, "numbered-texts")
    scan = scan.select("id", "row", F.xxhash64("t").alias("h"), words(F.col("t")).alias("ws"))
    scan = scan.select("id", "row", "h", "ws", F.inline(F.concat(sentinel, *[keys(p) for p in sorted(stats["ps"])])))
    out = []
    for b in range(blocks):
        block = grams.where(F.pmod("wid", F.lit(blocks)) == b) if blocks > 1 else grams
        starts = block.groupBy(F.col("key").alias("start")).agg(F.sort_array(F.collect_set("len")).alias("lens"))
        begun = scan.join(F.broadcast(starts), F.col("key") == F.col("start"), "left") \
            .where(F.col("lens").isNotNull() | ((F.col("pos") == -1) & F.lit(b == 0))) \
            .select("id", "row", "h", "ws", "pos", F.explode_outer("lens").alias("len"))
        wording = F.array_join(F.slice("ws", F.col("pos") + 1, F.col("len")), " ")
        begun = begun.withColumn("whole", F.when(F.col("pos") >= 0, F.xxhash64(wording)))
        w = F.broadcast(block.select(F.xxhash64("gram").alias("wkey"), F.col("len").alias("wlen"), "gram", "wid"))
        same = (F.col("whole") == F.col("wkey")) & (F.col("len") == F.col("wlen")) & (wording == F.col("gram"))
        hit = begun.join(w, same, "left").where(F.col("gram").isNotNull() | (F.col("pos") == -1))
        out.append(hit.select("id", "row", "h", F.size("ws").alias("n_words"), "pos", "len", "wid"))
    return reduce(DataFrame.unionByName, out)


def covered_words(spans: Column) -> Column:
    """Number of words in the union of sorted (pos, len) spans."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, s: Column) -> Column:
        end = s["pos"] + s["len"]
        return F.struct(F.greatest(acc["upto"], end).alias("upto"),
                        (acc["n"] + F.greatest(end - F.greatest(acc["upto"], s["pos"]), F.lit(0))).alias("n"))

    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", n: int = 13, hit_words_per: int = 20,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: ``id_col``, n_words, n_hit (words inside an occurrence),
    n_items, items_sha256 (hex of the sorted, comma-joined item ids), contaminated
    (at least one hit word per ``hit_words_per`` words), hit_spans (word positions)."""
    windows = materialize(benchmark_windows(benchmark, item_col, text_col, n), "benchmark-windows")
    hits = materialize(window_hits(docs, id_col, text_col, windows, block_bytes), "window-hits")
    found = hits.where(F.col("pos") >= 0)
    per_doc = found.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("pos", "len"))).alias("hit_spans")) \
        .withColumn("n_hit", covered_words(F.col("hit_spans")))
    item_of = windows.select("item", F.xxhash64("gram", F.lit("w")).alias("wid")).distinct()
    items = found.select("row", "wid").distinct().join(item_of, "wid").groupBy("row") \
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = hits.where(F.col("pos") == -1).select("id", "row", "h", F.col("n_words").cast("long").alias("n_words")) \
        .join(per_doc.join(items, "row"), "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items_list = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"),
        F.size(items_list).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_list, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * hit_words_per >= F.col("n_words"))).alias("contaminated"), "hit_spans", "row", "h")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", **options) -> DataFrame:
    """The rows that are not contaminated, all columns kept. Rows are known by (id, hash of
    the text): equal rows are judged alike."""
    judged = contamination(docs, benchmark, id_col, text_col, item_col, **options)
    gone = judged.where("contaminated").select(F.col(id_col).alias("__dc_id"), F.col("h").alias("__dc_h")).distinct()
    same = F.col(id_col).eqNullSafe(F.col("__dc_id")) & (
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__dc_h"))
    return docs.join(materialize(gone, "contaminated"), same, "left_anti")
