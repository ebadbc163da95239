"""True time-range frames per key ("last 6 h / 24 h" by clock, not by row count), in linear time.

A sliding range frame is aggregated anew for every row in Spark, which costs rows times rows in the
range. Here time is cut into cells of width range / m, so that t - range always lies m cells
before t, and a frame falls into three parts, each cheap:

    head    the own cell up to t: a growing frame in time order
    middle  the m - 1 whole cells between: one summary row per cell
    tail    the cell m before, from t - range on: a growing frame in reverse time order

Growing frames take one pass. Every row is copied once, into the cell m later, where it only serves the
tails. avg, sum, count, min and max are put together from the parts; nothing is subtracted, so no digits
cancel.

Normal keys use m = 1 (no middle). Hot keys are first reduced to one row per timestamp (rows that share a
timestamp share their frame), and m doubles until no cell holds more than
``SkewParams.chunk_rows`` timestamps. A task then holds a bounded number of *rows*, whatever the rate of readings or
the length of the range; the results are joined back by (key, timestamp).

Defined results: null values are skipped by every aggregate (a frame without values gives NULL, count 0). Rows
without a time form a frame of their own per key. A NULL key is a key like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopfloor.functions.constants import SkewParams
from shopfloor.operators.rolling import join_null_safe, split_hot_keys
from shopfloor.session import materialize

#: The parts an aggregate is put together from.
_PARTS = {"avg": ("sum", "count"), "sum": ("sum",), "count": ("count",), "max": ("max",), "min": ("min",)}
_MERGE = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
MOST_CELLS = 4096


def _parts(specs: dict[str, tuple[str, str]]) -> list[tuple[str, str]]:
    return sorted({(part, c) for fn, c in specs.values() for part in _PARTS[fn]})


def _put_together(parts: dict[tuple[str, str], list[Column]], specs) -> list[Column]:
    """One column per spec from head, middle and tail of its parts."""
    def total(part, c):
        some = parts[part, c]
        if part in ("max", "min"):
            return (F.greatest if part == "max" else F.least)(*some)
        filled = sum((F.coalesce(x, F.lit(0)) for x in some[1:]), F.coalesce(some[0], F.lit(0)))
        return filled if part == "count" else F.when(F.coalesce(*some).isNotNull(), filled)

    out = []
    for alias, (fn, c) in specs.items():
        if fn == "avg":
            out.append((total("sum", c) / F.nullif(total("count", c), F.lit(0))).alias(alias))
        else:
            out.append(total(fn, c).alias(alias))
    return out


def _framed(rows: DataFrame, key: str, range_us: int, m: int, parts: list[tuple[str, str]]) -> DataFrame:
    """rows (key, _us, one column ``_<part>_<c>`` per part, ...) plus head, middle and tail of every part."""
    cut = rows.withColumn("_cell", F.expr(f"(_us * {m}L - pmod(_us * {m}L, {range_us}L)) div {range_us}L"))
    copies = F.when(F.col("_us").isNull(), F.array(F.struct(F.col("_cell").alias("cell"), F.lit(False).alias("old")))).otherwise(F.array(
        F.struct(F.col("_cell").alias("cell"), F.lit(False).alias("old")),
        F.struct((F.col("_cell") + m).alias("cell"), F.lit(True).alias("old"))))
    both = cut.select("*", F.explode(copies).alias("_copy")).withColumn("_cell", F.col("_copy.cell")) \
        .withColumn("_old", F.col("_copy.old")).drop("_copy")
    head = Window.partitionBy(key, "_cell").orderBy("_us").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    tail = Window.partitionBy(key, "_cell").orderBy(F.col("_us").desc()).rangeBetween(Window.unboundedPreceding, range_us)
    out = both.select(
        "*", *[_MERGE[p](F.when(~F.col("_old"), F.col(f"_{p}_{c}"))).over(head).alias(f"_head_{p}_{c}") for p, c in parts],
        *[_MERGE[p](F.when(F.col("_old"), F.col(f"_{p}_{c}"))).over(tail).alias(f"_tail_{p}_{c}") for p, c in parts]) \
        .where(~F.col("_old")).drop("_old")
    if m == 1:
        return out
    cells = cut.groupBy(key, "_cell").agg(*[_MERGE[p](f"_{p}_{c}").alias(f"_{p}_{c}") for p, c in parts])
    between = Window.partitionBy(key).orderBy("_cell").rangeBetween(1 - m, -1)
    middle = cells.where(F.col("_cell").isNotNull()).select(F.col(key), "_cell", *[_MERGE[p](f"_{p}_{c}").over(between).alias(f"_mid_{p}_{c}") for p, c in parts])
    return join_null_safe(out, middle, [key, "_cell"], "left")


def _cells_needed(stamps: DataFrame, key: str, range_us: int, most_rows: int) -> int:
    """The smallest power of two of cells per range with at most ``most_rows`` timestamps in a cell."""
    m = 1
    while m < MOST_CELLS:
        cell = F.floor(F.col("_us") / F.lit(range_us / m))
        fullest = stamps.groupBy(key, cell.alias("_cell")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if fullest <= most_rows:
            break
        m *= 2
    return m


def time_range_features(df: DataFrame, key: str, ts: str, range_seconds: int,
                        specs: dict[str, tuple[str, str]], skew: SkewParams = SkewParams()) -> DataFrame:
    """``specs``: alias -> (avg, sum, count, min or max; column). Frames cover [ts - range, ts], rows that share
    the timestamp included."""
    range_us, parts = range_seconds * 1_000_000, _parts(specs)
    values = {"sum": lambda c: F.col(c).cast("double"), "count": lambda c: F.col(c).isNotNull().cast("long"),
              "max": F.col, "min": F.col}
    kept = df.columns
    timed = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    cold, hot = split_hot_keys(timed, [key], skew.hot_rows)

    def finished(rows: DataFrame, sections: list[str], columns: list[str]) -> DataFrame:
        found = {(p, c): [F.col(f"_{s}_{p}_{c}") for s in sections] for p, c in parts}
        return rows.select(*columns, *_put_together(found, specs))

    parted = cold.withColumns({f"_{p}_{c}": values[p](c) for p, c in parts})
    out = finished(_framed(parted, key, range_us, 1, parts), ["head", "tail"], kept)
    if hot is None:
        return out
    stamps = materialize(hot.withColumns({f"_{p}_{c}": values[p](c) for p, c in parts}).groupBy(key, "_us").agg(
        *[_MERGE[p](f"_{p}_{c}").alias(f"_{p}_{c}") for p, c in parts]), "range-stamps")
    m = _cells_needed(stamps, key, range_us, skew.chunk_rows)
    framed = finished(_framed(stamps, key, range_us, m, parts), ["head", "mid", "tail"] if m > 1 else ["head", "tail"], [key, "_us"])
    back = join_null_safe(hot, framed, [key, "_us"], "left").select(*kept, *specs)
    return out.unionByName(back)
