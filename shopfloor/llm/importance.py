"""Importance resampling towards a target distribution.

Weights are scored from arrays: hashed n-gram counts of the whole corpus and of the target texts
(``buckets`` numbers each, summed per task and then over tasks) give one array of gains, an
integer log ratio per bucket. A document's weight is the floored mean gain of its features. Adding
Gumbel noise, a hash of (seed, id) so that reruns agree, turns "draw without replacement
by weight" into "take the highest scores".

The order comes from a distributed LSD radix sort of (score falling, id rising). The composite
key is cut into digits of ``DIGIT_BITS`` bits, lowest first; leading bits that all keys share are left
out. Every pass is a stable counting sort: rows stand in blocks of consecutive positions; the counts
of (block, digit) give, as prefix sums over digits and over the blocks before, the offset at which
the block's rows with that digit begin; a row's destination is that offset plus its place among
them. After the last digit the position is the final rank.

Cost: a pass shuffles narrow rows (16 to 30 bytes, no text) once, by (block, digit). A group holds at
most one block's rows, whatever the keys are, so equal scores or ids that fill a third of
the table stay spread. Offsets need one row per (block, digit): n / BLOCK_ROWS times at most
2 ** DIGIT_BITS, prefixed per digit; only 2 ** DIGIT_BITS totals meet in one task. Each pass is a
written table in the shared folder, so a lost executor repeats tasks of one pass only.
The gains (``buckets`` numbers) are the only data that passes through the driver.

Defined results: a null text has no features, weight 0. A null id hashes as the empty text and ranks
after every id of the same score. Rows that repeat an id are rows of their own; where score and id agree
their order is that of the input files. An empty corpus gives an empty result, an empty target
gives gains from the smoothing alone. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopfloor.session import materialize

DIGIT_BITS = 11
BLOCK_ROWS = 1 << 20
LEAST_BLOCKS = 256
MEMO_WORDS = 500_000
MEMO_BYTES = 64
#: Lower-cases A-Z and turns every other ASCII byte that is no letter or digit into a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased, as UTF-8."""
    return text.encode().translate(WORD_BYTES).split() if text else []


class Buckets(dict):
    """word -> crc32 modulo n; short words are remembered up to a bound."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, word: bytes) -> int:
        value = zlib.crc32(word) % self.n
        if len(word) <= MEMO_BYTES and len(self) < MEMO_WORDS:
            self[word] = value
        return value


def feature_buckets(words: list[bytes], memo: Buckets, max_run: int) -> np.ndarray:
    """Bucket of every run of 1 to ``max_run`` words, repeats included."""
    runs = [np.fromiter(map(memo.__getitem__, words), np.int64, len(words))]
    for k in range(2, min(max_run, len(words)) + 1):
        runs.append(np.fromiter((zlib.crc32(b" ".join(words[i:i + k])) % memo.n for i in range(len(words) - k + 1)),
                                np.int64, len(words) - k + 1))
    return np.concatenate(runs)


def bucket_counts(df: DataFrame, text_col: str, buckets: int, max_run: int) -> np.ndarray:
    """Features per bucket over all rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, memo = np.zeros(buckets, np.int64), Buckets(buckets)
        for b in batches:
            for t in b.column(0):
                total += np.bincount(feature_buckets(words_of(t.as_py()), memo, max_run), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    per_task = df.select(F.col(text_col).cast("string").alias("t")).mapInArrow(count, "bucket int, n bigint")
    out = np.zeros(buckets, np.int64)
    for r in per_task.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + B) / ((s + 1) (T + B)))) for each of the B buckets."""
    b, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b))))
                     for t, s in zip(target.tolist(), corpus.tolist())], np.int64)


def gumbel(seed: int, ident) -> int:
    """floor(-1000 ln(-ln(u))) with u from the first 32 bits of sha256("seed:id")."""
    h = int(hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_documents(df: DataFrame, target: DataFrame, id_col: str, text_col: str, target_text: str, max_run: int,
                    buckets: int, seed: int) -> DataFrame:
    """(id, row, n_words, n_features, weight, score), one row per input row, written to the shared folder."""
    gains = bucket_gains(bucket_counts(target, target_text, buckets, max_run), bucket_counts(df, text_col, buckets, max_run))
    shared = df.sparkSession.sparkContext.broadcast(gains)  # one number per bucket

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, memo = shared.value, Buckets(buckets)
        for b in batches:
            rows = []
            for ident, t in zip(b.column(0), b.column(2)):
                words = words_of(t.as_py())
                found = feature_buckets(words, memo, max_run)
                weight = int(gain[found].sum()) // len(found) if len(found) else 0
                rows.append((len(words), len(found), weight, weight + gumbel(seed, ident.as_py())))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns],
                                             names=["id", "row", "n_words", "n_features", "weight", "score"])

    narrow = df.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"),
                       F.col(text_col).cast("string").alias("t"))
    return materialize(narrow.mapInArrow(
        score, "id bigint, row bigint, n_words bigint, n_features bigint, weight bigint, score bigint"), "dsir-scores")


def _bits(low: int, high: int) -> int:
    """Bits below the highest one in which keys between low and high can differ."""
    return ((low ^ high) & (1 << 64) - 1).bit_length()


def counting_pass(rows: DataFrame, digit: Column, block: Column) -> DataFrame:
    """One stable counting sort: ``pos`` becomes the destination in the order (digit, pos)."""
    cut = rows.withColumn("_digit", digit).withColumn("_block", block)
    counts = materialize(cut.groupBy("_block", "_digit").agg(F.count(F.lit(1)).alias("_n")), "dsir-counts")
    before = Window.orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 ** DIGIT_BITS rows
    base = counts.groupBy("_digit").agg(F.sum("_n").alias("_all")) \
        .select("_digit", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_base"))
    blocks_before = Window.partitionBy("_digit").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_earlier", F.coalesce(F.sum("_n").over(blocks_before), F.lit(0))).join(base, "_digit") \
        .select("_block", "_digit", (F.col("_base") + F.col("_earlier")).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_block", "_digit").orderBy("pos")) - 1
    return cut.withColumn("_place", place.cast("long")).join(offsets, ["_block", "_digit"]) \
        .withColumn("pos", F.col("_offset") + F.col("_place")).drop("_block", "_digit", "_offset", "_place")


def radix_rank(rows: DataFrame, score: str = "score", ident: str = "id", row: str = "row", digit_bits: int = DIGIT_BITS,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` plus ``pos``: the 0-based place in the order (score falling, id rising, null ids last, ``row``).
    ``row`` holds stored numbers of ``monotonically_increasing_id``: its partitions are the first blocks."""
    span = rows.agg(F.count(F.lit(1)).alias("n"), F.min(score).alias("s0"), F.max(score).alias("s1"), F.min(ident).alias("i0"),
                    F.max(ident).alias("i1"), F.count(F.when(F.col(ident).isNull(), 1)).alias("nulls")).first()
    if not span["n"]:
        return rows.withColumn("pos", F.lit(None).cast("long"))
    mask = (1 << digit_bits) - 1
    by_id = F.coalesce(F.col(ident), F.lit(0).cast("long")).bitwiseXOR(F.lit(-1 << 63).cast("long"))
    fall = F.lit(span["s1"]) - F.col(score)
    digits = []
    for key, bits in ((by_id, _bits(span["i0"], span["i1"]) if span["i0"] is not None else 0),
                      (F.col(ident).isNull().cast("long"), 1 if span["nulls"] else 0),
                      (fall, (span["s1"] - span["s0"]).bit_length())):
        digits += [F.shiftrightunsigned(key, at).bitwiseAND(F.lit(mask)).cast("int") for at in range(0, bits, digit_bits)]
    per_block = min(block_rows, -(-span["n"] // LEAST_BLOCKS))
    out, block = rows.withColumn("pos", F.col(row)), F.shiftright("pos", 33).cast("long")
    for digit in digits or [F.lit(0)]:
        out = materialize(counting_pass(out, digit, block), "dsir-pass")
        block = F.floor(F.col("pos") / F.lit(per_block)).cast("long")
    return out


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
             max_run: int = 1, buckets: int = 10_000, seed: int = 2024, min_words: int = 20, percent: int = 10) -> DataFrame:
    """One row per input row: ``id_col``, n_features, weight, score, rank. Of the N documents with at
    least ``min_words`` words the floor(percent * N / 100) best scores are drawn and ranked from 1;
    other documents have a null rank."""
    scored = score_documents(df, target, id_col, text_col, target_text, max_run, buckets, seed)
    entrants = scored.where(F.col("n_words") >= min_words)
    draw = entrants.count() * percent // 100
    drawn = radix_rank(entrants.select("row", "id", "score")).where(F.col("pos") < draw) \
        .select("row", (F.col("pos") + 1).alias("rank"))
    return scored.join(drawn, "row", "left").select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def draw_documents(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The drawn rows of ``df`` with all their columns. Rows are known by id; of rows that repeat
    an id, all stay if one is drawn."""
    chosen = resample(df, target, id_col, text_col, **options).where(F.col("rank").isNotNull()) \
        .select(F.col(id_col).alias("__dr_id")).distinct()
    return df.join(chosen, F.col(id_col).eqNullSafe(F.col("__dr_id")), "left_semi")
