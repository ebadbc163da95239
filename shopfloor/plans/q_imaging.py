"""Registered queries: pixel statistics, gradient edges and surface verdicts per image."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopfloor.functions import constants as K
from shopfloor.operators import imaging as I
from shopfloor.plans import sqltext as S
from shopfloor.plans.registry import register, round_doubles
from shopfloor.sources import bindings as B

_WR, _WG, _WB = K.GREY_WEIGHTS
_T = I.EDGE_THRESHOLD

_ROW = "PARTITION BY image_id, y ORDER BY x"
_COL = "PARTITION BY image_id, x ORDER BY y"

BASE = S.with_ctes(S.PIXELS, f"""gp AS (SELECT *, r * CAST({_WR} AS DOUBLE) + g * CAST({_WG} AS DOUBLE)
                                     + b * CAST({_WB} AS DOUBLE) AS grey FROM pixels),
gr AS (SELECT *, coalesce(lead(grey) OVER ({_ROW}), grey) - coalesce(lag(grey) OVER ({_ROW}), grey) AS gx,
                 coalesce(lead(grey) OVER ({_COL}), grey) - coalesce(lag(grey) OVER ({_COL}), grey) AS gy FROM gp),
ed AS (SELECT *, sqrt(gx * gx + gy * gy) AS magnitude, sqrt(gx * gx + gy * gy) > {_T} AS is_edge FROM gr),
dark AS (SELECT image_id, y AS dy, x AS dx FROM ed
         QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY grey, y, x) = 1),
agg AS (SELECT image_id, count(*) AS n_pixels, avg(r / CAST(b + 1 AS DOUBLE)) AS heat_ratio,
               min(grey) AS grey_min, max(grey) AS grey_max, max(grey) - min(grey) AS grey_range,
               avg(CAST(is_edge AS DOUBLE)) AS edge_density, count(*) FILTER (WHERE is_edge) AS n_edges,
               avg(y) FILTER (WHERE is_edge) AS ey, avg(x) FILTER (WHERE is_edge) AS ex,
               min(x) FILTER (WHERE is_edge) AS x0, max(x) FILTER (WHERE is_edge) AS x1,
               min(y) FILTER (WHERE is_edge) AS y0, max(y) FILTER (WHERE is_edge) AS y1
        FROM ed GROUP BY image_id),
st AS (SELECT agg.*, CAST(CASE WHEN n_edges > 0 THEN floor(ey) ELSE dy END AS INTEGER) AS center_y,
              CAST(CASE WHEN n_edges > 0 THEN floor(ex) ELSE dx END AS INTEGER) AS center_x
       FROM agg JOIN dark USING (image_id)),
bx AS (SELECT *, CAST(CASE WHEN n_edges > 0 THEN greatest(5, x0) ELSE greatest(10, center_x - 20) END AS INTEGER) AS box_x,
              CAST(CASE WHEN n_edges > 0 THEN greatest(5, y0) ELSE greatest(10, center_y - 20) END AS INTEGER) AS box_y,
              CAST(CASE WHEN n_edges > 0 THEN greatest(20, x1 - x0) ELSE 40 END AS INTEGER) AS box_w,
              CAST(CASE WHEN n_edges > 0 THEN greatest(20, y1 - y0) ELSE 40 END AS INTEGER) AS box_h FROM st),
vd AS (SELECT *,
  CASE WHEN heat_ratio > {K.HEAT_RATIO_LIMIT} THEN 'Overheat'
       WHEN (edge_density > {K.EDGE_DENSITY_LOW} OR grey_range > {K.GREY_RANGE_LOW})
        AND (edge_density > {K.EDGE_DENSITY_HIGH} OR grey_range > {K.GREY_RANGE_HIGH}) THEN 'Crack'
       WHEN edge_density > {K.EDGE_DENSITY_LOW} OR grey_range > {K.GREY_RANGE_LOW} THEN 'Scratch'
       ELSE 'Crack' END AS defect_type,
  CASE WHEN heat_ratio > {K.HEAT_RATIO_LIMIT} THEN least(0.98, round(0.88 + (heat_ratio - 1.4) * 0.1, 3))
       WHEN (edge_density > {K.EDGE_DENSITY_LOW} OR grey_range > {K.GREY_RANGE_LOW})
        AND (edge_density > {K.EDGE_DENSITY_HIGH} OR grey_range > {K.GREY_RANGE_HIGH})
         THEN least(0.96, round(0.86 + edge_density * 2.0, 3))
       WHEN edge_density > {K.EDGE_DENSITY_LOW} OR grey_range > {K.GREY_RANGE_LOW}
         THEN round(0.84 + edge_density * 1.5, 3)
       ELSE 0.91 END AS confidence,
  CASE WHEN heat_ratio > {K.HEAT_RATIO_LIMIT} THEN 'Critical'
       WHEN (edge_density > {K.EDGE_DENSITY_LOW} OR grey_range > {K.GREY_RANGE_LOW})
        AND (edge_density > {K.EDGE_DENSITY_HIGH} OR grey_range > {K.GREY_RANGE_HIGH}) THEN 'Critical'
       ELSE 'Moderate' END AS severity
  FROM bx)""")


def _grad(spark, sf_dir):
    return I.with_gradients(B.pixels(spark, sf_dir))


def _stats(spark, sf_dir):
    return I.image_stats(_grad(spark, sf_dir))


def _verdicts(spark, sf_dir):
    return I.surface_verdicts(_stats(spark, sf_dir))


@register("a_pixel_stats", BASE + """
SELECT image_id, n_pixels, round(heat_ratio, 6) AS heat_ratio, round(grey_min, 6) AS grey_min,
       round(grey_max, 6) AS grey_max, round(grey_range, 6) AS grey_range FROM bx""")
def q_pixel_stats(spark, sf_dir):
    return round_doubles(_stats(spark, sf_dir).select("image_id", "n_pixels", "heat_ratio", "grey_min",
                                                      "grey_max", "grey_range"))


@register("s_rgb_gray", BASE + " SELECT image_id, x, y, round(grey, 6) AS grey FROM gp")
def q_grey(spark, sf_dir):
    return round_doubles(B.pixels(spark, sf_dir).select("image_id", "x", "y", I.grey().alias("grey")))


@register("w_pixel_gradient", BASE + """
SELECT image_id, x, y, round(gx, 6) AS gx, round(gy, 6) AS gy, round(magnitude, 6) AS magnitude, is_edge FROM ed""")
def q_gradient(spark, sf_dir):
    return round_doubles(_grad(spark, sf_dir).select("image_id", "x", "y", "gx", "gy", "magnitude", "is_edge"))


@register("a_edge_density", BASE + " SELECT image_id, round(edge_density, 4) AS edge_density, n_edges FROM bx")
def q_edge_density(spark, sf_dir):
    return _stats(spark, sf_dir).select("image_id", F.round("edge_density", 4).alias("edge_density"), "n_edges")


@register("a_edge_centroid", BASE + " SELECT image_id, center_y, center_x FROM bx")
def q_centroid(spark, sf_dir):
    return _stats(spark, sf_dir).select("image_id", "center_y", "center_x")


@register("a_edge_bbox", BASE + " SELECT image_id, box_x, box_y, box_w, box_h FROM bx")
def q_bbox(spark, sf_dir):
    return _stats(spark, sf_dir).select("image_id", "box_x", "box_y", "box_w", "box_h")


@register("p_surface_verdict", BASE + " SELECT image_id, defect_type, severity FROM vd")
def q_verdict(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("image_id", "defect_type", "severity")


@register("p_surface_confidence", BASE + " SELECT image_id, defect_type, confidence FROM vd")
def q_confidence(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("image_id", "defect_type", "confidence")


@register("s_exp_kernel", BASE + f"""
SELECT e.image_id, e.x, e.y,
  round(exp(-(CAST((e.x - b.center_x) * (e.x - b.center_x) + (e.y - b.center_y) * (e.y - b.center_y) AS DOUBLE))
            / (2 * {K.HEAT_KERNEL_SIGMA} * {K.HEAT_KERNEL_SIGMA})), 6) AS heat
FROM ed e JOIN bx b USING (image_id)""")
def q_heat(spark, sf_dir):
    g = _grad(spark, sf_dir)
    return round_doubles(I.heat_map(g, I.image_stats(g)))
