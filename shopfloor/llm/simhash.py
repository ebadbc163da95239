"""SimHash near-duplicates by anchor-point covering.

Fingerprint: 64 bits over the XXH64 hashes (seed 42) of the word shingles of a text; a bit is
set when more than half of the hashes have it. Two fingerprints link when at most
``max_bits`` bits differ; a document's component is everything reachable over links.

Anchors are the words of a product code: two blocks of 23 bits, each covered by the binary
Golay code, whose balls of radius 3 tile the block (covering radius 3, 4,096 words). The
remaining bits are only compared. A fingerprint *lives* at the anchor nearest to it, block by
block, and *visits* every anchor within covering radius plus threshold: if x lives at (a, b) and
y differs from x in at most ``max_bits`` bits, y is at most 3 + d1 from a and 3 + d2 from b with
d1 + d2 <= max_bits. So each linking pair meets where one of them lives, and only residents are
compared with visitors (XOR and popcount). This holds for every input; no candidate is dropped.

All of this works on *distinct* fingerprints with their smallest id, so a group of copies is one
row. A fingerprint has at most 1 + 64 + 2,016 others within two bits, so links grow in
proportion to the distinct fingerprints, whatever the size of a group; a crowded anchor is
a skewed join key, which adaptive execution splits. Components: alternating large-star /
small-star rounds over the links with minima only, each round in a reliable checkpoint.

Defined results: null text and text without words have fingerprint zero, which links like any
other. Fewer words than a shingle: the whole sequence is the one shingle. Null ids rank
behind all ids. Rows that repeat an id are fingerprinted one by one. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.session import materialize, shared_dir, small_batches

SEED = 42
GOLAY_BITS, GOLAY_RADIUS = 23, 3
GOLAY_POLYNOMIAL = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1: generates the binary Golay code
SLICE = 1 << 19


def fingerprint(text: bytes, shingle_words: int = 3) -> int:
    """SimHash of one UTF-8 text. ``bytes.lower`` and ``bytes.split`` treat exactly A-Z
    and the six ASCII spaces. Hash bits are counted in slices, so a very long text
    costs bounded extra memory."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle_words, len(words))
    starts = np.concatenate(([0], ends[:len(words) - k] + 1)).tolist()
    stops = ends[k - 1:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for a in range(0, len(starts), SLICE):
        cuts = map(slice, starts[a:a + SLICE], stops[a:a + SLICE])
        h = np.fromiter(map(digest, map(joined.__getitem__, cuts), repeat(SEED)), np.uint64)
        for b in range(0, len(h), 4096):
            bits = np.unpackbits(h[b:b + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(counts * 2 > len(starts), bitorder="little")
    return int(set_bits.view("<u8")[0])


def _fingerprints(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py() or b"", shingle_words) for t in b.column(1)),
                              np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps.view(np.int64))],
                                             names=["id", "h", "fp"])
    return run


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(id, h, fp): one row per input row; h a hash of the text, fp as a signed 64-bit number."""
    kind = df.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = df.select(F.col(id_col).alias("id"), text.cast("binary").alias("t"), F.xxhash64(text).alias("h"))
    return src.mapInArrow(_fingerprints(shingle_words), f"id {kind}, h bigint, fp bigint")


def golay_words() -> np.ndarray:
    """The 4,096 words of the binary Golay code: all multiples of its polynomial."""
    words = np.zeros(1 << 12, np.uint32)
    for bit in range(12):
        words ^= np.where(np.arange(1 << 12) >> bit & 1, np.uint32(GOLAY_POLYNOMIAL << bit), 0).astype(np.uint32)
    return words


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _anchors(max_bits: int):
    """mapInArrow: fp -> (anchor, fp, home): where it lives (home) and all anchors it visits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = golay_words()
        mask = np.uint64((1 << GOLAY_BITS) - 1)
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for a in range(0, len(fp), 512):
                part = fp[a:a + 512]
                lists, homes = [], []
                for block in range(2):
                    v = (part >> np.uint64(GOLAY_BITS * block) & mask).astype(np.uint32)
                    over = np.maximum(_popcount(v[:, None] ^ words[None, :]).astype(np.int16) - GOLAY_RADIUS, 0)
                    who, word = np.nonzero(over <= max_bits)
                    lists.append((who, word, over[who, word]))
                    homes.append(np.argmin(over, axis=1))  # the code is perfect: exactly one word has excess 0
                (w0, c0, o0), (w1, c1, o1) = lists
                n0, n1 = np.bincount(w0, minlength=len(part)), np.bincount(w1, minlength=len(part))
                first1 = np.concatenate(([0], np.cumsum(n1)[:-1]))
                reps = n1[w0]  # every word of block 0 meets every word of block 1 of the same fingerprint
                i0 = np.repeat(np.arange(len(w0)), reps)
                i1 = np.arange(len(i0)) - np.repeat(np.cumsum(reps) - reps, reps) + first1[w0[i0]]
                near = o0[i0] + o1[i1] <= max_bits
                i0, i1 = i0[near], i1[near]
                who = w0[i0]
                anchor = c0[i0].astype(np.int32) << 12 | c1[i1].astype(np.int32)
                home = anchor == (homes[0][who].astype(np.int32) << 12 | homes[1][who].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor, pa.int32()), pa.array(part[who].view(np.int64)), pa.array(home)],
                    names=["anchor", "fp", "home"])
    return run


def links(distinct_fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b): all pairs of distinct fingerprints at most ``max_bits`` bits apart, a < b. Each is
    found once, at the home of the smaller one."""
    placed = materialize(distinct_fps.select("fp").mapInArrow(
        _anchors(max_bits), "anchor int, fp bigint, home boolean"), "simhash-anchors")
    resident = placed.where("home").select(F.col("anchor").alias("at"), F.col("fp").alias("a"))
    visitor = placed.select("anchor", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return resident.join(visitor, (F.col("at") == F.col("anchor")) & (F.col("a") < F.col("b")) & near) \
        .select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of an edge (a, b).

    Alternating stars: a large-star links every larger neighbour of a node to the least
    of its neighbourhood, a small-star does so for the smaller ones. Only minima are
    grouped, so a node with many edges is aggregated before the shuffle; minima are stored before they
    are joined back, so that both sides of the join are plain exchanges and adaptive execution can split the
    rows of a hub. Ends when a round changes nothing."""
    shared_dir(edges.sparkSession)
    cur = edges.select("a", "b").checkpoint()
    before = None
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")).checkpoint()
        large = both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("u")) \
            .select(F.col("m").alias("a"), "b").where("a <> b").distinct().checkpoint()
        low = large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "u").checkpoint()
        small = large.join(low, F.col("b") == F.col("u")) \
            .select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")) \
            .where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        cur = small.checkpoint()
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return cur.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root") \
        .unionByName(cur.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def classify(df: DataFrame, id_col: str, text_col: str, shingle_words: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(documents (id, h, fp), classes (fp, root, component_id)), both materialized."""
    with small_batches(df.sparkSession):
        docs = materialize(fingerprints(df, id_col, text_col, shingle_words), "simhash-fingerprints")
    distinct = materialize(docs.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-distinct")
    comp = components(links(distinct, max_bits))
    rooted = materialize(distinct.join(comp, F.col("fp") == F.col("node"), "left")
                         .select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    smallest = materialize(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-smallest")
    return docs, materialize(rooted.join(smallest, "root").select("fp", "root", "component_id"), "simhash-classes")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
               max_bits: int = 2) -> DataFrame:
    """One row per input row: ``id_col``, fingerprint (16 hex digits), component_id
    (smallest id reachable)."""
    docs, classes = classify(df, id_col, text_col, shingle_words, max_bits)
    classes = classes.withColumnRenamed("fp", "_fp")
    return docs.join(classes, F.col("fp") == F.col("_fp")).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
                         max_bits: int = 2) -> DataFrame:
    """One row of every component, all columns kept: the smallest id (nulls last), of several
    texts under that id the one with the smallest hash, of equal rows any one.

    Rows are known by (id, hash of the text). Only what goes, and the rare keepers that occur
    more than once, are joined back."""
    docs, classes = classify(df, id_col, text_col, shingle_words, max_bits)
    rows = docs.join(classes.select(F.col("fp").alias("_fp"), "root"), F.col("fp") == F.col("_fp")) \
        .groupBy("root", "id", "h").agg(F.count(F.lit(1)).alias("n"))
    rows = materialize(rows, "simhash-rows")
    best = materialize(rows.groupBy(F.col("root").alias("_root")).agg(
        F.min(F.struct(F.col("id").isNull().alias("last"), "id", "h")).alias("best")), "simhash-best")
    judged = rows.join(best, F.col("root") == F.col("_root")) \
        .withColumn("stays", F.col("best.id").eqNullSafe(F.col("id")) & (F.col("best.h") == F.col("h")))
    special = materialize(judged.where(~F.col("stays") | (F.col("n") > 1)).select(
        F.col("id").alias("__nd_id"), F.col("h").alias("__nd_h"), F.col("stays").alias("__nd_stays")), "simhash-drop")
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    tagged = df.join(special, F.col(id_col).eqNullSafe(F.col("__nd_id")) & (text_hash == F.col("__nd_h")), "left")
    alone = tagged.where(F.col("__nd_stays").isNull()).select(*[df[c] for c in df.columns])
    if not special.where("__nd_stays").limit(1).count():
        return alone
    repeated = tagged.where(F.col("__nd_stays")).dropDuplicates(["__nd_id", "__nd_h"])
    return alone.unionByName(repeated.select(*df.columns))
