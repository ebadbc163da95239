"""Surface inspection from pixel tables ``(image_id, x, y, r, g, b)``.

Pixels are hash-partitioned by ``image_id`` once; the row-wise and column-wise
neighbour windows ``(image_id, y)`` / ``(image_id, x)`` and the per-image
aggregates are all clustered on a superset of ``image_id``, so they reuse that
single exchange (only sorts follow). An image is bounded (H x W pixels), so no
group grows with the table.

Edges are central-difference gradient magnitudes of the grey image above a
threshold (a documented replacement for a Canny detector).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopfloor.functions import constants as K
from shopfloor.functions import rules as R

EDGE_THRESHOLD = 80.0


def grey(r: str = "r", g: str = "g", b: str = "b") -> Column:
    wr, wg, wb = K.GREY_WEIGHTS
    return F.col(r) * wr + F.col(g) * wg + F.col(b) * wb


def with_gradients(pixels: DataFrame, threshold: float = EDGE_THRESHOLD) -> DataFrame:
    """+ grey, gx, gy, magnitude, is_edge. Borders repeat the edge pixel."""
    p = pixels.repartition("image_id").withColumn("grey", grey())
    row = Window.partitionBy("image_id", "y").orderBy("x")
    col = Window.partitionBy("image_id", "x").orderBy("y")
    g = F.col("grey")
    p = p.withColumn("gx", F.coalesce(F.lead(g, 1).over(row), g) - F.coalesce(F.lag(g, 1).over(row), g))
    p = p.withColumn("gy", F.coalesce(F.lead(g, 1).over(col), g) - F.coalesce(F.lag(g, 1).over(col), g))
    mag = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    return p.withColumn("magnitude", mag).withColumn("is_edge", mag > threshold)


def image_stats(grad: DataFrame) -> DataFrame:
    """Per image: heat ratio mean(R/(B+1)), grey min/max/range, edge density, edge
    centroid (darkest pixel when no edge), edge box, pixel count."""
    e = F.col("is_edge")
    stats = grad.groupBy("image_id").agg(
        F.avg(F.col("r") / (F.col("b") + 1.0)).alias("heat_ratio"),
        F.min("grey").alias("grey_min"), F.max("grey").alias("grey_max"),
        F.avg(e.cast("double")).alias("edge_density"),
        F.count(F.when(e, 1)).alias("n_edges"),
        F.avg(F.when(e, F.col("y"))).alias("_ey"), F.avg(F.when(e, F.col("x"))).alias("_ex"),
        F.min_by(F.struct("y", "x"), F.struct("grey", "y", "x")).alias("_dark"),
        F.min(F.when(e, F.col("x"))).alias("_x0"), F.max(F.when(e, F.col("x"))).alias("_x1"),
        F.min(F.when(e, F.col("y"))).alias("_y0"), F.max(F.when(e, F.col("y"))).alias("_y1"),
        F.count(F.lit(1)).alias("n_pixels"))
    has = F.col("n_edges") > 0
    cy = F.when(has, F.floor("_ey")).otherwise(F.col("_dark.y")).cast("int")
    cx = F.when(has, F.floor("_ex")).otherwise(F.col("_dark.x")).cast("int")
    stats = stats.withColumn("center_y", cy).withColumn("center_x", cx)
    box_x = F.when(has, F.greatest(F.lit(5), "_x0")).otherwise(F.greatest(F.lit(10), F.col("center_x") - 20))
    box_y = F.when(has, F.greatest(F.lit(5), "_y0")).otherwise(F.greatest(F.lit(10), F.col("center_y") - 20))
    box_w = F.when(has, F.greatest(F.lit(20), F.col("_x1") - F.col("_x0"))).otherwise(F.lit(40))
    box_h = F.when(has, F.greatest(F.lit(20), F.col("_y1") - F.col("_y0"))).otherwise(F.lit(40))
    return stats.select(
        "image_id", "n_pixels", "heat_ratio", "grey_min", "grey_max",
        (F.col("grey_max") - F.col("grey_min")).alias("grey_range"),
        "edge_density", "n_edges", "center_y", "center_x",
        box_x.cast("int").alias("box_x"), box_y.cast("int").alias("box_y"),
        box_w.cast("int").alias("box_w"), box_h.cast("int").alias("box_h"))


def surface_verdicts(stats: DataFrame) -> DataFrame:
    return stats.select("*", *R.surface_verdict("heat_ratio", "edge_density", "grey_range"))


def heat_map(grad: DataFrame, stats: DataFrame) -> DataFrame:
    """Gaussian weight of every pixel around the edge centroid (sigma 28 px).
    ``stats`` has one row per image and joins on the shared image partitioning."""
    s = stats.select("image_id", "center_x", "center_y")
    j = grad.select("image_id", "x", "y").join(s, "image_id")
    d2 = (F.col("x") - F.col("center_x")) ** 2 + (F.col("y") - F.col("center_y")) ** 2
    return j.select("image_id", "x", "y",
                    F.exp(-d2 / (2 * K.HEAT_KERNEL_SIGMA ** 2)).alias("heat"))


def image_pixels(images: DataFrame) -> DataFrame:
    """Spark image-source rows (``image`` struct, BGR bytes) -> pixel rows, one Arrow batch
    per task; the numpy reshaping is the only Python step."""
    import numpy as np
    import pandas as pd

    def explode(batches):
        for pdf in batches:
            out = []
            for origin, h, w, nch, data in zip(pdf["origin"], pdf["height"], pdf["width"],
                                               pdf["nChannels"], pdf["data"]):
                arr = np.frombuffer(data, dtype=np.uint8).reshape(h, w, nch)
                ys, xs = np.mgrid[0:h, 0:w]
                bgr = arr[:, :, :3] if nch >= 3 else np.repeat(arr[:, :, :1], 3, axis=2)
                out.append(pd.DataFrame({
                    "image_id": origin, "x": xs.ravel().astype("int32"), "y": ys.ravel().astype("int32"),
                    "r": bgr[:, :, 2].ravel().astype("int32"), "g": bgr[:, :, 1].ravel().astype("int32"),
                    "b": bgr[:, :, 0].ravel().astype("int32")}))
            if out:
                yield pd.concat(out, ignore_index=True)

    flat = images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return flat.mapInPandas(explode, "image_id string, x int, y int, r int, g int, b int")
