"""Exact order statistics of whole columns without sorting or moving them.

One scan makes a quantile sketch of every column (``percentile_approx``: a few thousand numbers per task, merged),
which says between which two values each wanted rank lies, a few thousandths of the rows apart. A second
scan counts the rows in and between these brackets exactly and lists the distinct values inside; the
wanted values are then read off the counts. Brackets with too many values to list (very large tables) are
sketched again on their own rows first. A rank is accepted only by exact counts, so the sketch's error costs at
most another round, never a wrong value. Both scans aggregate before they move anything, and at most
``MOST_VALUES`` rows or so come to the driver.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID = 1000
ACCURACY = 10 * GRID
MOST_VALUES = 200_000
_STEPS = [i / GRID for i in range(GRID + 1)]


@dataclass(frozen=True)
class ColumnSketch:
    n: int
    nulls: int
    grid: list[float]


@dataclass(frozen=True)
class RankedValue:
    value: float
    before: int
    count: int


def sketch_columns(df: DataFrame, cols: Sequence[str]) -> dict[str, ColumnSketch]:
    """Counts and about ``GRID`` evenly spaced quantiles of every column, from one scan."""
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.count(F.when(v.isNull(), 1)).alias(f"z{i}"),
                 F.percentile_approx(v, _STEPS, ACCURACY).alias(f"g{i}")]
    row = df.agg(*aggs).first()
    return {c: ColumnSketch(row[f"n{i}"], row[f"z{i}"], list(row[f"g{i}"] or [])) for i, c in enumerate(cols)}


def _bracket(grid: list[float], share: float, margin: int) -> tuple[float, float]:
    """Two grid values around the quantile ``share``; infinite beyond the ends."""
    at = share * GRID
    low, high = math.floor(at) - margin, math.ceil(at) + margin
    return (grid[low] if low >= 0 else -math.inf), (grid[high] if high <= GRID else math.inf)


def _joined(brackets: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Sorted, overlapping ones united."""
    out: list[tuple[float, float]] = []
    for a, b in sorted(brackets):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _slot(v: Column, brackets: list[tuple[float, float]]) -> Column:
    """0 below the first bracket, 1 in it, 2 between it and the second, ..."""
    slot = None
    for k, (a, b) in enumerate(brackets):
        low, high = v < F.lit(float(a)), v <= F.lit(float(b))
        slot = F.when(low, 2 * k) if slot is None else slot.when(low, 2 * k)
        slot = slot.when(high, 2 * k + 1)
    return slot.otherwise(2 * len(brackets))


def _counted(df: DataFrame, brackets: Mapping[str, list], listed: bool) -> dict[str, list]:
    """{column: [(slot, value, rows, distinct values)]} in order, from one scan: a row for every value in a bracket,
    or, where not ``listed``, one per bracket (value None, distinct values estimated)."""
    parts = []
    for c, some in brackets.items():
        v = F.col(c).cast("double")
        slot = F.when(v.isNotNull(), _slot(v, some))
        parts.append(F.struct(F.lit(c).alias("c"), slot.alias("slot"), F.when(slot % 2 == 1, v).alias("v")))
    melted = df.select(F.explode(F.array(*parts)).alias("p")).select("p.*").where(F.col("slot").isNotNull())
    n = F.count(F.lit(1)).alias("n")
    if listed:
        rows = melted.groupBy("c", "slot", "v").agg(n).withColumn("d", F.lit(1)).collect()  # see MOST_VALUES
    else:
        rows = melted.groupBy("c", "slot").agg(n, F.approx_count_distinct("v").alias("d")) \
            .withColumn("v", F.lit(None).cast("double")).collect()  # one row per bracket and gap
    out = {c: [] for c in brackets}
    for r in sorted(rows, key=lambda r: (r["slot"], r["v"] is not None, r["v"] or 0.0)):
        out[r["c"]].append((r["slot"], r["v"], r["n"], r["d"]))
    return out


def _span(brackets: list[tuple[float, float]], slot: int) -> tuple[float, float]:
    """The range of a slot; gaps with their ends."""
    if slot % 2:
        return brackets[slot // 2]
    k = slot // 2
    return (brackets[k - 1][1] if k else -math.inf), (brackets[k][0] if k < len(brackets) else math.inf)


def _sketch_again(df: DataFrame, spans: list[tuple[str, tuple[float, float]]]) -> list[list[float]]:
    """The grids of the rows in each (column, range)."""
    def inside(c, a, b):
        v = F.col(c).cast("double")
        return F.percentile_approx(F.when(v.between(F.lit(a), F.lit(b)), v), _STEPS, ACCURACY)

    row = df.agg(*[inside(c, float(a), float(b)).alias(f"g{i}") for i, (c, (a, b)) in enumerate(spans)]).first()
    return [list(row[f"g{i}"]) for i in range(len(spans))]


def values_at(df: DataFrame, sketches: Mapping[str, ColumnSketch], ranks: Mapping[str, set[int]]) -> dict[tuple[str, int], RankedValue]:
    """{(column, rank): value} for 0-based ranks among the column's non-null values."""
    found: dict[tuple[str, int], RankedValue] = {}
    left = {c: set(rs) for c, rs in ranks.items() if rs}
    tries = [(c, _bracket(sketches[c].grid, r / max(1, sketches[c].n - 1), 1), 3 * sketches[c].n / GRID)
             for c, rs in left.items() for r in rs]
    for margin in itertools.count(2):
        if not tries:
            return found
        brackets = {c: _joined([b for k, b, _ in tries if k == c]) for c in {k for k, *_ in tries}}
        listed = sum(values for *_, values in tries) <= MOST_VALUES
        tries, again = [], []
        for c, counted in _counted(df, brackets, listed).items():
            upto = 0
            for slot, value, n, distinct in counted:
                here = {r for r in left[c] if upto <= r < upto + n}
                a, b = _span(brackets[c], slot)
                if slot % 2 and (listed or a == b):
                    found |= {(c, r): RankedValue(value if listed else a, upto, n) for r in here}
                    left[c] -= here
                elif here and slot % 2 and distinct <= MOST_VALUES // 4:
                    tries.append((c, (a, b), distinct))
                elif here:
                    again.append((c, (a, b), here, upto, n))
                upto += n
        for (c, _, here, upto, n), grid in zip(again, _sketch_again(df, [x[:2] for x in again]) if again else []):
            tries += [(c, _bracket(grid, (r - upto) / max(1, n - 1), margin), (2 * margin + 1) * n / GRID) for r in here]
