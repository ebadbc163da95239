"""Edge maps with hysteresis, and connected defect regions, from pixel tables ``(image_id, x, y, r, g, b)``.

The detector is Canny's on the 8-bit grey image: Sobel gradients (smoothed across the gradient, borders
repeated), L1 magnitude, non-maximum suppression in four directions, then two thresholds: pixels above the
high one are edges, and so is every pixel above the low one that a chain of such pixels connects to them.

Chains are followed as connected components (8 neighbours). Every pixel starts with its own label; one round takes
the smallest label of each unbroken run along rows, columns and both diagonals, so a label travels a whole run in
one step and the number of rounds grows with the bends of a region, not with its length. Everything in a
round is clustered by ``image_id``: one exchange, then sorts. Images that did not change in a round are finished
and leave the loop, so one winding region does not repeat the table. Rounds are written to the shared folder.

No task holds more than whole images, and an image is bounded. Defined results: pixels with a null channel are
no part of the image (their neighbours then repeat themselves, as at a border); an image without edges has no
region, its centre is the darkest pixel and its box the default one around it.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopfloor.functions import constants as K
from shopfloor.functions import rules as R
from shopfloor.operators.imaging import grey
from shopfloor.session import materialize

LABEL_ROW = 1 << 20


def _lines() -> dict:
    """Windows along the four directions through a pixel."""
    return {"row": Window.partitionBy("image_id", "y").orderBy("x"),
            "column": Window.partitionBy("image_id", "x").orderBy("y"),
            "down": Window.partitionBy("image_id", F.col("x") - F.col("y")).orderBy("y"),
            "up": Window.partitionBy("image_id", F.col("x") + F.col("y")).orderBy("y")}


def sobel(pixels: DataFrame) -> DataFrame:
    """+ level (8-bit grey), dx, dy and their L1 magnitude ``strength``."""
    def around(c: str, w) -> tuple[Column, Column, Column]:
        return F.coalesce(F.lag(c).over(w), F.col(c)), F.col(c), F.coalesce(F.lead(c).over(w), F.col(c))

    row, column, *_ = _lines().values()
    p = pixels.where(F.col("r").isNotNull() & F.col("g").isNotNull() & F.col("b").isNotNull()).repartition("image_id") \
        .withColumn("level", F.floor(grey() + 0.5).cast("int"))
    left, here, right = around("level", row)
    p = p.withColumn("_slope", right - left).withColumn("_smooth", left + 2 * here + right)
    above, here, below = around("_slope", column)
    p = p.withColumn("dx", above + 2 * here + below)
    above, _, below = around("_smooth", column)
    p = p.withColumn("dy", below - above).drop("_slope", "_smooth")
    return p.withColumn("strength", F.abs("dx") + F.abs("dy"))


def ridge_pixels(pixels: DataFrame, low: int = K.CANNY_LOW, high: int = K.CANNY_HIGH) -> DataFrame:
    """``sobel`` plus is_ridge (above ``low`` and largest across its direction) and is_strong (also above ``high``)."""
    m = F.col("strength")

    def beside(w) -> tuple[Column, Column]:
        return F.coalesce(F.lag(m).over(w), F.lit(0)), F.coalesce(F.lead(m).over(w), F.lit(0))

    p = sobel(pixels)
    sides = {name: beside(w) for name, w in _lines().items()}
    p = p.withColumns({f"_{name}_{k}": c for name, pair in sides.items() for k, c in zip("ab", pair)})
    steep, flat = F.abs("dy") * 32768, F.abs("dx") * K.CANNY_TAN_22
    peak = F.when(steep < flat, (m > F.col("_row_a")) & (m >= F.col("_row_b"))) \
        .when(steep > flat + F.abs("dx") * 65536, (m > F.col("_column_a")) & (m >= F.col("_column_b"))) \
        .when(F.signum("dx") * F.signum("dy") < 0, (m > F.col("_up_a")) & (m > F.col("_up_b"))) \
        .otherwise((m > F.col("_down_a")) & (m > F.col("_down_b")))
    ridge = (m > low) & peak
    return p.withColumn("is_ridge", ridge).withColumn("is_strong", ridge & (m > high)) \
        .drop(*[f"_{name}_{k}" for name in sides for k in "ab"])


def connected_pixels(points: DataFrame) -> DataFrame:
    """``points`` (image_id, x, y, ...) plus ``label``: the smallest y * LABEL_ROW + x among the points that a chain
    of neighbouring points (8 directions) connects."""
    lines = (("y", "x"), ("x", "y"), (F.col("x") - F.col("y"), "y"), (F.col("x") + F.col("y"), "y"))
    active = points.withColumn("label", F.col("y").cast("long") * LABEL_ROW + F.col("x"))
    finished = []
    while True:
        step = active.repartition("image_id").withColumn("_old", F.col("label"))
        for line, along in lines:
            step = step.withColumn("_line", F.col(line) if isinstance(line, str) else line)
            run = F.col(along) - F.row_number().over(Window.partitionBy("image_id", "_line").orderBy(along))
            step = step.withColumn("_run", run).withColumn(
                "label", F.min("label").over(Window.partitionBy("image_id", "_line", "_run")))
        moved = F.max(F.col("label") != F.col("_old")).over(Window.partitionBy("image_id"))
        stored = materialize(step.withColumn("_moved", moved).drop("_line", "_run", "_old"), "components")
        finished.append(stored.where(~F.col("_moved")).drop("_moved"))
        active = stored.where("_moved").drop("_moved")
        if not active.limit(1).count():
            return functools.reduce(DataFrame.unionByName, finished)


def edge_regions(ridges: DataFrame) -> DataFrame:
    """(image_id, x, y, region): the edge pixels; a region is a component with a strong pixel, known by its
    smallest pixel."""
    points = connected_pixels(ridges.where("is_ridge").select("image_id", "x", "y", "is_strong"))
    held = F.max("is_strong").over(Window.partitionBy("image_id", "label"))
    return points.withColumn("_held", held).where("_held").select("image_id", "x", "y", F.col("label").alias("region"))


def region_table(edges: DataFrame) -> DataFrame:
    """(image_id, region, n_pixels, x0, y0, x1, y1) per connected region."""
    return edges.groupBy("image_id", "region").agg(
        F.count(F.lit(1)).alias("n_pixels"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"),
        F.max("y").alias("y1"))


def defect_stats(pixels: DataFrame, low: int = K.CANNY_LOW, high: int = K.CANNY_HIGH) -> DataFrame:
    """Per image: pixel statistics, edge density and centre from the edge map, and the largest region (by pixels,
    ties to the topmost, then leftmost start) with its box."""
    ridges = materialize(ridge_pixels(pixels, low, high).select("image_id", "x", "y", "r", "b", "level", "is_ridge", "is_strong"),
                         "ridges")
    edges = materialize(edge_regions(ridges), "edges")
    whole = ridges.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n_pixels"), F.avg(F.col("r") / (F.col("b") + 1.0)).alias("heat_ratio"),
        F.min("level").alias("grey_min"), F.max("level").alias("grey_max"),
        F.min_by(F.struct("y", "x"), F.struct("level", "y", "x")).alias("_dark"))
    regions = region_table(edges)
    largest = regions.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n_regions"), F.sum("n_pixels").alias("n_edges"),
        F.max_by(F.struct("n_pixels", "x0", "y0", "x1", "y1"), F.struct("n_pixels", -F.col("region"))).alias("_big"))
    middle = edges.groupBy("image_id").agg(F.floor(F.avg("y")).alias("_my"), F.floor(F.avg("x")).alias("_mx"))
    all_ = whole.join(largest, "image_id", "left").join(middle, "image_id", "left")
    cy, cx = F.coalesce("_my", "_dark.y").cast("int"), F.coalesce("_mx", "_dark.x").cast("int")
    least_at, least_side, around, side = K.REGION_BOX

    def box(first: str, last: str, centre: Column) -> tuple[Column, Column]:
        big = F.col("_big").isNotNull()
        return (F.when(big, F.greatest(F.lit(least_at), F.col(f"_big.{first}"))).otherwise(F.greatest(F.lit(2 * least_at), centre - around)),
                F.when(big, F.greatest(F.lit(least_side), F.col(f"_big.{last}") - F.col(f"_big.{first}") + 1)).otherwise(F.lit(side)))

    (box_x, box_w), (box_y, box_h) = box("x0", "x1", cx), box("y0", "y1", cy)
    n_edges = F.coalesce("n_edges", F.lit(0))
    return all_.select(
        "image_id", "n_pixels", "heat_ratio", "grey_min", "grey_max", (F.col("grey_max") - F.col("grey_min")).alias("grey_range"),
        n_edges.alias("n_edges"), (n_edges / (F.col("n_pixels") + 1e-5)).alias("edge_density"),
        F.coalesce("n_regions", F.lit(0)).alias("n_regions"), F.coalesce("_big.n_pixels", F.lit(0)).alias("region_pixels"),
        cy.alias("center_y"), cx.alias("center_x"), box_x.cast("int").alias("box_x"), box_y.cast("int").alias("box_y"),
        box_w.cast("int").alias("box_w"), box_h.cast("int").alias("box_h"))


def defect_verdicts(stats: DataFrame) -> DataFrame:
    return stats.select("*", *R.surface_verdict("heat_ratio", "edge_density", "grey_range"))
