"""Per-key row windows that stay bounded when one key holds a large share of rows.

Normal keys run as ordinary windows partitioned by the key (one shuffle, one
sort, all frames in one Window operator). Keys with more than
``SkewParams.hot_rows`` rows are *hot*: their rows get an exact position
(``positions.row_positions``), are cut into chunks of ``chunk_rows`` positions,
and the last ``lookback`` rows of every chunk are copied into the next chunk as
read-only context. Bounded frames are then exact inside each chunk; unbounded
fills carry the last/first non-null value across chunks through a small
per-chunk summary. NULL keys are one key, like any other.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from shopfloor.functions.constants import SkewParams
from shopfloor.operators.positions import row_positions

Builder = Callable[[WindowSpec], list[Column]]


def split_hot_keys(df: DataFrame, key: Sequence[str], hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """(normal rows, hot rows or None); together they are exactly ``df``.

    A NULL key is a key like any other: rows are tagged by a null-safe join with the hot keys (at
    most ``total_rows / hot_rows`` of them), whose strategy Spark picks from their size."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_key_rows"))
    hot = counts.where(F.col("_key_rows") > hot_rows).select(
        *[F.col(k).alias(f"_hot_{i}") for i, k in enumerate(key)], F.lit(True).alias("_hot")).checkpoint()
    if not hot.limit(1).count():
        return df, None
    same = functools.reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_hot_{i}")) for i, k in enumerate(key)])
    tagged = df.join(hot, same, "left")
    return (tagged.where(F.col("_hot").isNull()).select(*df.columns),
            tagged.where(F.col("_hot")).select(*df.columns))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left.join(right, keys)`` where NULL keys match each other."""
    names = {k: f"_r_{k}" for k in keys}
    same = functools.reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return left.join(right.withColumnsRenamed(names), same, how).drop(*names.values())


def keyed_windows(df: DataFrame, key: Sequence[str], order: Sequence[str], build: Builder,
                  lookback: int, fills: Sequence[tuple[str, str]] = (),
                  skew: SkewParams = SkewParams()) -> DataFrame:
    """Add the columns ``build(w)`` returns, ``w`` = window of ``key`` ordered by ``order``.

    ``build`` may only use row frames reaching at most ``lookback`` rows back and
    none ahead. ``fills`` = (alias, column): forward fill, then back fill, per key.
    """
    key, order = list(key), list(order)
    cold, hot = split_hot_keys(df, key, skew.hot_rows)

    w_cold = Window.partitionBy(*key).orderBy(*order)
    w_cold_rev = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    cold_out = cold.select("*", *build(w_cold), *_fill_cols(w_cold, w_cold_rev, fills))
    if hot is None:
        return cold_out

    c = skew.chunk_rows
    if lookback >= c:
        raise ValueError("chunk_rows must exceed the window lookback")
    hp = row_positions(hot, order, key, "_pos").withColumn("_chunk", F.floor(F.col("_pos") / c))
    is_ctx_src = (F.col("_pos") % c) >= (c - lookback) if lookback > 0 else F.lit(False)
    copies = F.when(is_ctx_src, F.array(
        F.struct(F.col("_chunk").alias("chunk"), F.lit(False).alias("ctx")),
        F.struct((F.col("_chunk") + 1).alias("chunk"), F.lit(True).alias("ctx")),
    )).otherwise(F.array(F.struct(F.col("_chunk").alias("chunk"), F.lit(False).alias("ctx"))))
    rep = hp.select("*", F.explode(copies).alias("_copy")) \
        .withColumn("_chunk", F.col("_copy.chunk")).withColumn("_ctx", F.col("_copy.ctx")).drop("_copy")
    w_hot = Window.partitionBy(*key, "_chunk").orderBy("_pos")
    w_hot_rev = Window.partitionBy(*key, "_chunk").orderBy(F.col("_pos").desc())
    hot_out = rep.select("*", *build(w_hot), *_fill_cols(w_hot, w_hot_rev, fills, local=True)) \
        .where(~F.col("_ctx"))
    if fills:
        hot_out = _carry_fills(hot_out, hp, key, fills)
    hot_out = hot_out.drop("_pos", "_chunk", "_ctx")
    return cold_out.unionByName(hot_out)


def _fill_cols(w: WindowSpec, w_rev: WindowSpec, fills, local: bool = False) -> list[Column]:
    """Forward fill = running last non-null; back fill = running last non-null over the
    reversed order. Both are growing frames (linear), never a frame to unbounded
    following, which Spark re-aggregates per row."""
    out = []
    for alias, col in fills:
        ff = F.last(F.col(col), ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        bf = F.last(F.col(col), ignorenulls=True).over(
            w_rev.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        if local:
            out += [ff.alias(f"_ff_{alias}"), bf.alias(f"_bf_{alias}")]
        else:
            out.append(F.coalesce(ff, bf).alias(alias))
    return out


def _carry_fills(rows: DataFrame, positioned: DataFrame, key, fills) -> DataFrame:
    """Complete chunk-local fills with the last/first non-null of earlier/later chunks."""
    aggs = []
    for alias, col in fills:
        val = F.col(col)
        aggs.append(F.max_by(val, F.when(val.isNotNull(), F.col("_pos"))).alias(f"_last_{alias}"))
        aggs.append(F.min_by(val, F.when(val.isNotNull(), F.col("_pos"))).alias(f"_first_{alias}"))
    summary = positioned.groupBy(*key, "_chunk").agg(*aggs)
    w = Window.partitionBy(*key).orderBy("_chunk")
    w_rev = Window.partitionBy(*key).orderBy(F.col("_chunk").desc())
    carry = summary.select(*key, "_chunk", *[
        c for alias, _ in fills for c in (
            F.last(f"_last_{alias}", ignorenulls=True).over(
                w.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_cf_{alias}"),
            F.last(f"_first_{alias}", ignorenulls=True).over(
                w_rev.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_cb_{alias}"))])
    out = join_null_safe(rows, carry, [*key, "_chunk"], "left")
    return out.withColumns({
        alias: F.coalesce(F.col(f"_ff_{alias}"), F.col(f"_cf_{alias}"), F.col(f"_bf_{alias}"),
                          F.col(f"_cb_{alias}"))
        for alias, _ in fills
    }).drop(*[f"_{p}_{a}" for a, _ in fills for p in ("ff", "bf", "cf", "cb")])

