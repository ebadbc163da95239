"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Documents with equal texts are one group and stay together. Groups enter bins by falling size, each
into the bin with the least remaining capacity that still takes it, found in a balanced search tree
keyed by (remaining capacity, bin). Groups of one size are interchangeable, so the packing runs
over the histogram of group sizes: the tightest bin takes as many groups of the size as
fit (it stays the tightest until none does), then the next one. The result is that of packing the
groups one by one.

fixed capacity  a group that fits nowhere opens a new bin, which keeps the number of shards low.
fixed number    the capacity is searched: from the mean load upwards, slack 0, 1, 3, 7, ... bytes, then
                bisected, until the packing needs no more bins than wanted. Groups larger than the mean load of
                the bins still free get a bin of their own first, since nothing can level them.

What one task holds: the histogram, one row per distinct group size. Distinct sizes are different positive
numbers with a sum of at most the corpus bytes, so there are at most sqrt(2 * bytes) of them (1.4e7 at
100 TB), and usually far fewer. Everything else is spread: groups get their place within their
size from a range partitioning, so a size that a third of all groups share is no hot key, and documents
join their group by digest (adaptive execution splits a hot one).

Defined results: a null text is the empty text in grouping, its size is the overhead alone. Rows that
repeat an id are rows of their own; a null id comes first within its shard. An empty table gives an empty
result. Other columns are not read (``write_shards`` carries them).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.operators.positions import row_positions
from shopfloor.session import materialize

OVERHEAD = 8


class CapacityTree:
    """Ordered set of (remaining capacity, bin): a treap whose hashed priorities keep it balanced.
    A node is [key, left, right, priority]."""

    def __init__(self):
        self.root = None

    def _descend(self, key, stop):
        """The parent link (node, side) under which ``stop`` holds on the way to ``key``."""
        parent, side, node = None, 0, self.root
        while node is not None and not stop(node):
            parent, side = node, 2 if node[0] < key else 1
            node = node[side]
        return parent, side, node

    def _hang(self, parent, side, node) -> None:
        if parent is None:
            self.root = node
        else:
            parent[side] = node

    def _split(self, node, key):
        """Nodes below ``key`` and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[2], high = self._split(node[2], key)
            return node, high
        low, node[1] = self._split(node[1], key)
        return low, node

    def _merge(self, low, high):
        if low is None or high is None:
            return low or high
        if low[3] >= high[3]:
            low[2] = self._merge(low[2], high)
            return low
        high[1] = self._merge(low, high[1])
        return high

    def add(self, key) -> None:
        priority = hash(key)
        parent, side, node = self._descend(key, lambda n: n[3] < priority)
        self._hang(parent, side, [key, *self._split(node, key), priority])

    def remove(self, key) -> None:
        parent, side, node = self._descend(key, lambda n: n[0] == key)
        self._hang(parent, side, self._merge(node[1], node[2]))

    def tightest(self, size: int):
        """The smallest key with at least ``size`` remaining, or None."""
        best, node = None, self.root
        while node is not None:
            if node[0][0] >= size:
                best, node = node[0], node[1]
            else:
                node = node[2]
        return best


def best_fit(classes: Iterable[tuple[int, int]], capacity: int, bins: int | None = None):
    """Pack ``n`` groups of each size, sizes falling, into bins of ``capacity``. Returns
    [(size, bin, how many)], the bins' loads; or None if more than ``bins`` are needed. A group
    larger than the capacity gets a bin of its own."""
    tree, loads, runs = CapacityTree(), [], []
    for size, n in classes:
        while n:
            spot = tree.tightest(size)
            if spot is None:
                if len(loads) == bins:
                    return None
                spot = (capacity, len(loads))
                loads.append(0)
                take = max(1, min(n, capacity // size)) if size else n
            else:
                take = min(n, spot[0] // size) if size else n
                tree.remove(spot)
            rest = spot[0] - take * size
            loads[spot[1]] += take * size
            n -= take
            runs.append((size, spot[1], take))
            if rest > 0:
                tree.add((rest, spot[1]))
    return runs, loads


def level_bins(classes: list[tuple[int, int]], bins: int):
    """``best_fit`` into at most ``bins`` bins with the smallest capacity the search finds."""
    left, runs, loads, todo = sum(s * n for s, n in classes), [], [], list(classes)
    while todo and bins - len(loads) > 1 and todo[0][0] * (bins - len(loads)) >= left:  # larger than the mean: a bin alone
        size, n = todo[0]
        runs.append((size, len(loads), 1))
        loads.append(size)
        left -= size
        todo = ([(size, n - 1)] if n > 1 else []) + todo[1:]
    if not todo:
        return runs, loads
    free, own = bins - len(loads), len(loads)
    mean = max(-(-left // free), todo[0][0])
    low, slack, done = -1, 0, None
    while done is None:
        done = best_fit(todo, mean + slack, free)
        if done is None:
            low, slack = slack, 2 * slack + 1
    high = slack
    while high - low > max(1, mean >> 14):  # to within 1/16384 of the mean load
        middle = (low + high) // 2
        tried = best_fit(todo, mean + middle, free)
        if tried is None:
            low = middle
        else:
            done, high = tried, middle
    return runs + [(s, own + b, n) for s, b, n in done[0]], loads + done[1]


PLACED = "size bigint, first bigint, bin int"


def place_classes(histogram: DataFrame, shards: int | None, capacity: int | None) -> DataFrame:
    """histogram (size, n) -> (size, first, bin): from its ``first``-th group on, a size goes to ``bin``."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = [(s, n) for b in batches for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        classes.sort(reverse=True)
        runs, _ = level_bins(classes, shards) if shards else best_fit(classes, capacity)
        first, out = {}, []
        for size, bin_, n in runs:
            out.append((size, first.get(size, 0), bin_))
            first[size] = first.get(size, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
            zip(*out) if out else [()] * 3, (pa.int64(), pa.int64(), pa.int32()))], names=["size", "first", "bin"])

    return histogram.repartition(1).mapInArrow(pack, PLACED)


def assign_shards(df: DataFrame, shards: int | None = 24, capacity: int | None = None, id_col: str = "doc_id",
                  text_col: str = "text", overhead: int = OVERHEAD, row_col: str | None = None) -> DataFrame:
    """(id, row, size, text_crc32, shard, slot), one row per input row. Give ``shards`` for a fixed number of level
    shards, or ``shards=None`` and a ``capacity`` in bytes for as few shards as best fit finds. ``row_col``: a stored
    unique row number to carry along as ``row``."""
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = materialize(df.select(
        F.col(id_col).alias("id"), (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"), F.unhex(F.sha2(text, 256)).alias("digest"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")),
        "shard-documents")
    groups = materialize(docs.groupBy("digest", "size").agg(F.count(F.lit(1)).alias("copies"))
                         .select("digest", F.col("size").alias("one"), (F.col("size") * F.col("copies")).alias("size")),
                         "shard-groups")
    placed = materialize(place_classes(groups.groupBy("size").agg(F.count(F.lit(1)).alias("n")), shards, capacity), "shard-bins")
    runs = placed.groupBy("size").agg(F.sort_array(F.collect_list(F.struct("first", "bin"))).alias("runs"))  # at most a run per bin
    single = runs.where(F.size("runs") == 1).select("size", F.col("runs")[0]["bin"].alias("shard"))
    several = runs.where(F.size("runs") > 1)
    whole = groups.join(single, "size")
    ranked = row_positions(groups.join(several, "size", "left_semi"), ["digest", "one"], ["size"], "place").join(several, "size")
    cut = ranked.withColumn("shard", F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("place")), -1)["bin"])
    home = whole.select("digest", "one", "shard").unionByName(cut.select("digest", "one", "shard"))
    homed = docs.join(home.withColumnRenamed("one", "size"), ["digest", "size"]).drop("digest")
    return row_positions(homed, ["id", "row"], ["shard"], "slot")


def write_shards(df: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
                 rows_per_file: int = 1 << 20) -> DataFrame:
    """Write ``df`` as one folder per shard under ``path``, rows in slot order, and return it as
    read back (all columns, plus shard and slot). A shard is cut into files of ``rows_per_file`` slots, so
    no task holds a whole shard."""
    source = materialize(df.withColumn("__sh_row", F.monotonically_increasing_id()), "shard-source")
    plan = assign_shards(source, shards, None, id_col, text_col, row_col="__sh_row").select(
        F.col("row").alias("__sh_row"), "shard", "slot")
    piece = F.floor(F.col("slot") / rows_per_file)
    source.join(plan, "__sh_row").drop("__sh_row").repartition("shard", piece).sortWithinPartitions("shard", "slot") \
        .write.partitionBy("shard").parquet(path)
    return df.sparkSession.read.parquet(path)
