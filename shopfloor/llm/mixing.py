"""Mixing sources to target token weights by entropy balancing.

Targets: sources sorted by code point (null last) weigh 1, 2, 3, 1, 2, 3, ... and share all
tokens by weight; a target stops at ``cap`` times its source's size and the excess is shared
again. Document rates then solve, per source s with target t_s,

    minimise  sum_i r_i log r_i - r_i    so that  sum_i size_i r_i = t_s,  r_i <= cap,

whose convex dual gives exponentially tilted rates r_i = min(cap, exp(lambda_s x_i)),
x_i = size_i / mean size of s. One Newton iteration for the multipliers of all sources at once
is one distributed aggregate over the (source, size) histogram, kept inside a bracket
(bisection when a step leaves it). The histogram is built once with map-side counts, so a
source that holds a third of all rows costs no more than its distinct sizes.

Rounding into copies: along decreasing size, the copies of a size class are the difference
of rounded running sums of expected copies; what a source is still off its target is then
settled largest size first, which leaves less than its smallest document that still has
room. Inside a class every document gets the whole part and the rest goes to the first
documents in hash order, whose positions come from a range partitioning (a class may hold a
third of all rows). One task handles one source's *distinct sizes* in two steps (running
sums, settling): word counts of single texts, not rows.

Defined results: null text has size 0; a document of size 0 takes 0 words. Null sources are
one source. Rows that repeat an id are rows of their own. A source whose documents have no
words has target 0. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopfloor.llm.text import SPACE_WORD
from shopfloor.operators.positions import row_positions
from shopfloor.session import materialize

WEIGHTS = (1, 2, 3)


def source_targets(sources: DataFrame, weights=WEIGHTS, cap: float = 3.0) -> DataFrame:
    """``sources`` (source, total, ...) plus sid, weight and target."""
    ranked = row_positions(sources.withColumn("_last", F.col("source").isNull()), ["_last", "source"],
                           pos_col="sid").drop("_last")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = materialize(ranked.withColumn("weight", F.get(cycle, (F.col("sid") % len(weights)).cast("int"))),
                         "mix-sources")
    ceiling = F.lit(float(cap)) * F.col("total")
    share, n_capped = None, -1
    while True:  # each pass adds sources that reach their ceiling; a scalar per pass to the driver
        capped = F.lit(False) if share is None else ceiling < F.lit(share) * F.col("weight")
        row = ranked.agg(F.sum("total").alias("all"), F.sum(F.when(capped, ceiling)).alias("fixed"),
                         F.sum(F.when(~capped, F.col("weight"))).alias("w"),
                         F.count(F.when(capped, 1)).alias("n")).first()
        if row["n"] == n_capped:
            break
        n_capped = row["n"]
        share = max(0.0, float(row["all"] or 0) - float(row["fixed"] or 0)) / row["w"] if row["w"] else 0.0
    return ranked.withColumn("target", F.least(ceiling, F.lit(share) * F.col("weight")))


def tilt(hist: DataFrame, sources: DataFrame, cap: float = 3.0, tolerance: float = 1e-7,
         max_iterations: int = 60) -> DataFrame:
    """(sid, lam, mean): the dual multipliers. hist: (sid, size, n). Sources without words, or
    whose target is at its ceiling, need no iteration. The start is the multiplier that would be
    right if every document had the token-weighted mean size."""
    log_cap = math.log(cap)
    state = sources.where((F.col("total") > 0) & (F.col("target") < cap * F.col("total"))).select(
        "sid", "target", (F.col("total") / F.col("docs")).alias("mean"),
        (F.log(F.col("target") / F.col("total")) * F.col("total") / F.col("docs") * F.col("total") / F.col("square")).alias("lam"),
        (-F.col("total") / (F.lit(math.e) * F.col("target"))).alias("lo"),
        (F.lit(log_cap) * F.col("total") / F.col("docs") / F.col("smallest")).alias("hi"),
        F.lit(False).alias("done"))
    state = state.checkpoint()
    for _ in range(max_iterations):
        x = F.col("size") / F.col("mean")
        e = F.least(F.col("lam") * x, F.lit(log_cap))
        mass = F.col("n") * F.col("size") * F.exp(e)
        sums = hist.join(state.where(~F.col("done")), "sid").groupBy("sid", *state.columns[1:]).agg(
            F.sum(mass).alias("g"), F.sum(F.when(e < log_cap, mass * x).otherwise(0.0)).alias("h"))
        over = F.col("g") > F.col("target")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - (F.col("g") - F.col("target")) / F.nullif(F.col("h"), F.lit(0.0))
        lam = F.when((step > lo) & (step < hi), step).otherwise((lo + hi) / 2)
        done = (F.abs(F.col("g") - F.col("target")) <= tolerance * F.col("target")) | (hi - lo <= 1e-15 * F.abs(hi))
        moved = sums.select("sid", "target", "mean", F.when(done, F.col("lam")).otherwise(lam).alias("lam"),
                            lo.alias("lo"), hi.alias("hi"), done.alias("done"))
        state = state.where("done").unionByName(moved).checkpoint()
        if not state.where(~F.col("done")).limit(1).count():
            break
    return state.select("sid", "lam", "mean")


def settle(classes: Column, gap: Column, cap: float) -> Column:
    """Array of (size, change): whole copies to add or take, largest size first, until what is
    missing (``gap`` words) is smaller than every class that still has room."""
    start = F.struct(gap.alias("gap"), F.array().cast("array<struct<size:bigint,change:bigint>>").alias("picks"))

    def step(acc: Column, c: Column) -> Column:
        want = F.floor(F.abs(acc["gap"]) / c["size"])
        room = F.when(acc["gap"] > 0, (c["n"] * cap).cast("long") - c["copies"]).otherwise(c["copies"])
        m = F.least(want, room) * F.signum(acc["gap"]).cast("long")
        return F.when(m != 0, F.struct(
            (acc["gap"] - m * c["size"]).alias("gap"),
            F.concat(acc["picks"], F.array(F.struct(c["size"].alias("size"), m.alias("change")))).alias("picks"))
        ).otherwise(acc)

    return F.aggregate(classes, start, step, lambda acc: acc["picks"])


def class_copies(hist: DataFrame, sources: DataFrame, lam: DataFrame, cap: float = 3.0) -> DataFrame:
    """(sid, size, n, copies): whole copies of every size class."""
    rate = F.coalesce(F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(math.log(cap)))),
                      F.when((F.col("total") > 0) & (F.col("size") > 0), F.lit(float(cap))).otherwise(1.0))
    rated = hist.join(sources.select("sid", "total", "target"), "sid").join(lam, "sid", "left") \
        .select("sid", "size", "n", "target", (F.col("n") * rate).alias("expected"))
    w = Window.partitionBy("sid").orderBy(F.col("size").desc())
    upto = F.sum("expected").over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum("expected").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    copies = F.floor(upto + 0.5) - F.floor(before + 0.5)
    rounded = materialize(rated.withColumn("copies", F.greatest(F.lit(0), F.least(
        copies, (F.col("n") * cap).cast("long")))), "mix-classes")
    some = rounded.where(F.col("size") > 0)
    per_source = some.groupBy("sid").agg(
        (F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"),
        F.sort_array(F.collect_list(F.struct("size", "n", "copies")), asc=False).alias("classes"))
    picks = per_source.select("sid", F.inline(settle(F.col("classes"), F.col("gap"), cap)))
    return rounded.join(picks, ["sid", "size"], "left").select(
        "sid", "size", "n", (F.col("copies") + F.coalesce("change", F.lit(0))).alias("copies"))


def document_copies(df: DataFrame, id_col: str, text_col: str, source_col: str, weights, cap: int) -> DataFrame:
    """(id, source, h, size, total, target, own): one row per input row with its copies
    ``own``; h is a hash of the text."""
    docs = materialize(df.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.monotonically_increasing_id().alias("row"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"),
        F.coalesce(F.size(F.regexp_extract_all(F.col(text_col), F.lit(SPACE_WORD), 0)), F.lit(0)).cast("long")
        .alias("size")), "mix-sizes")
    by_size = materialize(docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-histogram")
    per_source = by_size.groupBy("source").agg(
        F.sum(F.col("n") * F.col("size")).alias("total"), F.sum("n").alias("docs"),
        F.sum(F.col("n") * F.col("size").cast("double") * F.col("size")).alias("square"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("smallest"))
    sources = materialize(source_targets(per_source, weights, cap), "mix-targets")
    hist = materialize(by_size.join(sources.select("source", "sid").withColumnRenamed("source", "_s"),
                                    F.col("source").eqNullSafe(F.col("_s"))).select("sid", "size", "n"), "mix-sid")
    copies = class_copies(hist, sources, tilt(hist, sources, cap), cap)
    classes = materialize(copies.join(sources.select("sid", "source", "total", "target"), "sid"), "mix-copies")
    cls = classes.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "sid", "n", "copies", "total", "target")
    tagged = docs.join(cls, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    tagged = tagged.select("id", "source", "h", "row", "sid", "size", "n", "copies", "total", "target")
    whole, rest = F.floor(F.col("copies") / F.col("n")), F.col("copies") % F.col("n")
    even = tagged.where(rest == 0).withColumn("own", whole)
    placed = row_positions(tagged.where(rest != 0).withColumn("order", F.xxhash64("id")), ["order", "id", "h", "row"],
                           ["sid", "size"], "place").drop("order")
    odd = placed.withColumn("own", whole + (F.col("place") < rest).cast("long")).drop("place")
    return even.unionByName(odd).select("id", "source", "h", "size", "total", "target", "own")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, cap: int = 3) -> DataFrame:
    """One row per input row: ``id_col``, size, source_size, target (of its source), taken
    (words), copies."""
    return document_copies(df, id_col, text_col, source_col, weights, cap).select(
        F.col("id").alias(id_col), "size", F.col("total").alias("source_size"), "target",
        (F.col("own") * F.col("size")).alias("taken"), F.col("own").alias("copies"))


def repeat_to_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  weights=WEIGHTS, cap: int = 3) -> DataFrame:
    """The mixed table: every row as often as the mix takes it, all columns kept. Rows are known by
    (id, source, hash of the text); copies of rows that agree in these are shared among
    them, by their place."""
    taken = materialize(document_copies(df, id_col, text_col, source_col, weights, cap)
                        .groupBy(F.col("id").alias("__mx_id"), F.col("source").alias("__mx_source"), F.col("h").alias("__mx_h"))
                        .agg(F.sum("own").alias("__mx_copies"), F.count(F.lit(1)).alias("__mx_rows")), "mix-taken")
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    key = ["__mx_id", "__mx_source", "__mx_h"]

    def joined(some: DataFrame) -> DataFrame:
        return df.join(some, F.col(id_col).eqNullSafe(F.col("__mx_id")) & (text_hash == F.col("__mx_h"))
                       & F.col(source_col).eqNullSafe(F.col("__mx_source")))

    def repeated(rows: DataFrame, copies: Column) -> DataFrame:
        return rows.select(*df.columns, F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias("__mx_copy")) \
            .drop("__mx_copy")

    out = repeated(joined(taken.where((F.col("__mx_rows") == 1) & (F.col("__mx_copies") > 0))), F.col("__mx_copies"))
    several = taken.where((F.col("__mx_rows") > 1) & (F.col("__mx_copies") > 0))
    if not several.limit(1).count():
        return out
    placed = row_positions(joined(several).withColumn("__mx_at", F.monotonically_increasing_id()), ["__mx_at"], key,
                           "__mx_place")
    share = F.floor(F.col("__mx_copies") / F.col("__mx_rows")) + (
        F.col("__mx_place") < F.col("__mx_copies") % F.col("__mx_rows")).cast("long")
    return out.unionByName(repeated(placed, share))
