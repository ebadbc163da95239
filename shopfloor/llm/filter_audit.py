"""Filter interaction audit: what every filter removes in every order.

Each filter's failures are one stored relation of row ids. What an order of filters does up to a step
depends only on the *set* applied before it, so the audit works on the 2 ** k sets of k filters, not on
the k! orders:

survivors    starting from the rows that fail anything, filter by filter: every set built so far also
             appears extended by the filter, its rows left-anti joined with the failing ids.
             k joins make the survivors of all 2 ** k sets. Rows that fail nothing survive every set
             and are only counted (left-anti of all failing ids).
removals     for every filter, the survivors of the sets without it, left-semi joined with its
             failing ids, summed by (set, part) before anything moves.
redundancies what fails a filter less what it removes after the set; unique failures are its
             removals after all others; label losses are sums over the removed rows.
orders       all permutations, each step looking its set up by (part, set, filter).

The relations hold row numbers, not ids, so repeated ids stay separate rows. Joins are on the row number,
which is unique on the side of the rows, hence never skewed. Survivor tables are written
to the shared folder, filter after filter: at most 2 ** k narrow rows (20 bytes) per failing
row. Duplicates are found by text digest: (digest, bytes) groups are reduced to their
smallest id before the exchange and only groups with several rows are joined back, where
adaptive execution splits a hot digest.

Defined results: a null text is the empty text. A null id is neither larger nor smaller than another
(such a row is no duplicate, and makes none). Rows that repeat id and text are no duplicates of each other.
Labels that repeat an id count once, if any of them says so; labels without a document and null ids are
left out. Null parts are the empty string. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopfloor.session import materialize

UPPER = bytes(range(65, 91))
SYMBOLS = b"#$%&*|"
MEASURES = "id bigint, row bigint, part string, words int, distinct_words int, upper int, points int, symbols int, " \
           "bytes bigint, digest binary"


def measure_texts(df: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """One narrow row per document: counts of words, distinct words, capitals, code points and
    symbols, and the text's digest. Words are runs without ASCII white space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(3):
                text = t.as_py() or ""
                raw = text.encode()
                words = raw.split()  # bytes split at 0x20 and 0x09 to 0x0D only
                rows.append((len(words), len(set(words)), len(raw) - len(raw.translate(None, UPPER)), len(text),
                             len(raw) - len(raw.translate(None, SYMBOLS)), len(raw), hashlib.sha256(raw).digest()))
            kinds = [pa.int32()] * 5 + [pa.int64(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *columns], names=[
                "id", "row", "part", "words", "distinct_words", "upper", "points", "symbols", "bytes", "digest"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"),
                     F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                     F.col(text_col).cast("string").alias("t")).mapInArrow(run, MEASURES)


def mark_duplicates(measured: DataFrame) -> DataFrame:
    """``measured`` plus ``duplicate``: a smaller id has the same text."""
    shared = materialize(measured.groupBy("digest", "bytes").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
                         .where(F.col("n") > 1).drop("n"), "audit-duplicates")
    return measured.join(shared, ["digest", "bytes"], "left") \
        .withColumn("duplicate", F.coalesce(F.col("id") > F.col("first"), F.lit(False))).drop("first")


#: Name -> failure condition over the measures.
FILTERS = {
    "A": "words < 200",
    "B": "100 * distinct_words < 50 * words",
    "C": "100 * upper > 2 * points",
    "D": "symbols > 0",
    "E": "duplicate",
}


def failing_ids(measured: DataFrame, filters: Mapping[str, str]) -> dict[str, DataFrame]:
    """One stored relation of failing row numbers per filter."""
    return {name: materialize(measured.where(F.expr(rule)).select("row"), f"audit-fails-{name}")
            for name, rule in filters.items()}


def survivors(suspects: DataFrame, fails: Mapping[str, DataFrame]) -> DataFrame:
    """(applied, row, ...): the rows left by every set of filters; ``applied`` has bit i for filter i."""
    level = suspects.withColumn("applied", F.lit(0))
    for i, (name, failing) in enumerate(fails.items()):
        after = level.join(failing, "row", "left_anti").withColumn("applied", F.col("applied") + (1 << i))
        level = materialize(level.unionByName(after), f"audit-survivors-{name}")
    return level


def removals(level: DataFrame, fails: Mapping[str, DataFrame]) -> DataFrame:
    """(part, applied, filter, rows, good, toxic): what a filter removes from what the set left."""
    out = None
    for i, (name, failing) in enumerate(fails.items()):
        hit = level.where(F.col("applied").bitwiseAND(1 << i) == 0).join(failing, "row", "left_semi") \
            .groupBy("part", "applied").agg(F.count(F.lit(1)).alias("rows"), F.sum("good").alias("good"),
                                            F.sum("toxic").alias("toxic")).withColumn("filter", F.lit(name))
        out = hit if out is None else out.unionByName(hit)
    return out


def order_steps(names: list[str]) -> Column:
    """Array of (filter_order, step, filter, before): every step of every order; ``before`` is the
    set applied already."""
    steps = []
    for order in permutations(range(len(names))):
        before, text = 0, "".join(names[i] for i in order)
        for at, i in enumerate(order, 1):
            steps.append({"filter_order": text, "step": at, "filter": names[i], "before": before})
            before |= 1 << i
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,filter:string,before:int>>")


def audit(df: DataFrame, labels: DataFrame, filters: Mapping[str, str] = FILTERS, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "source", label_id: str = "doc_id") -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley."""
    names = list(filters)
    known = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).cast("long").alias("id")).agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"),
        F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    measured = materialize(mark_duplicates(materialize(measure_texts(df, id_col, text_col, part_col), "audit-measures"))
                           .join(known, "id", "left").fillna(0, ["good", "toxic"]), "audit-rows")
    fails = failing_ids(measured, filters)
    any_fail = None
    for failing in fails.values():
        any_fail = failing if any_fail is None else any_fail.unionByName(failing)
    narrow = measured.select("row", "part", "good", "toxic")
    suspects = narrow.join(any_fail, "row", "left_semi")
    clean = narrow.join(any_fail, "row", "left_anti").groupBy("part").agg(F.count(F.lit(1)).alias("clean"))

    level = survivors(suspects, fails)
    kept = materialize(level.groupBy("part", "applied").agg(F.count(F.lit(1)).alias("rows")), "audit-kept")
    removed = materialize(removals(level, fails), "audit-removed")
    parts = measured.select("part").distinct().join(clean, "part", "left").fillna(0, ["clean"])

    bit = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(1 << i))])
    steps = parts.select("part", "clean", F.inline(order_steps(names))) \
        .withColumn("after", F.col("before").bitwiseOR(F.element_at(bit, F.col("filter"))))
    at = steps.join(removed.withColumnRenamed("applied", "before").withColumnRenamed("rows", "removed"),
                    ["part", "before", "filter"], "left") \
        .join(kept.withColumnRenamed("applied", "after"), ["part", "after"], "left") \
        .fillna(0, ["removed", "good", "toxic", "rows"])
    alone, last = F.col("before") == 0, F.bit_count("after") == len(names)
    same = Window.partitionBy("part", "filter")  # one row per order
    return at.select(
        "part", "filter_order", "step", (F.col("clean") + F.col("rows")).alias("kept"), "removed",
        (F.max(F.when(alone, F.col("removed"))).over(same) - F.col("removed")).alias("redundant"),
        F.max(F.when(last, F.col("removed"))).over(same).alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("removed").over(same).alias("shapley"))
