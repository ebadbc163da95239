"""Registered queries: edge map with hysteresis, connected defect regions and the verdict from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopfloor.functions import constants as K
from shopfloor.operators import edges as E
from shopfloor.plans import q_imaging
from shopfloor.plans import sqltext as S
from shopfloor.plans.registry import register, round_doubles
from shopfloor.sources import bindings as B

_ROW, _COL = q_imaging._ROW, q_imaging._COL
_WR, _WG, _WB = K.GREY_WEIGHTS
_AT, _SIDE, _AROUND, _BOX = K.REGION_BOX

# The edge map by direct neighbour joins and a breadth-first walk from every strong pixel; regions by the pixels
# that a walk from each edge pixel reaches.
EDGES = S.with_ctes(S.PIXELS, f"""lv AS (SELECT image_id, x, y, r, b, CAST(floor(r * CAST({_WR} AS DOUBLE)
    + g * CAST({_WG} AS DOUBLE) + b * CAST({_WB} AS DOUBLE) + 0.5) AS INTEGER) AS v FROM pixels),
sl AS (SELECT *, coalesce(lead(v) OVER ({_ROW}), v) - coalesce(lag(v) OVER ({_ROW}), v) AS h,
    coalesce(lag(v) OVER ({_ROW}), v) + 2 * v + coalesce(lead(v) OVER ({_ROW}), v) AS s FROM lv),
sb AS (SELECT *, coalesce(lag(h) OVER ({_COL}), h) + 2 * h + coalesce(lead(h) OVER ({_COL}), h) AS gx,
    coalesce(lead(s) OVER ({_COL}), s) - coalesce(lag(s) OVER ({_COL}), s) AS gy FROM sl),
mg AS (SELECT *, abs(gx) + abs(gy) AS m FROM sb),
dr AS (SELECT *, CASE WHEN abs(gy) * 32768 < abs(gx) * {K.CANNY_TAN_22} THEN 1
    WHEN abs(gy) * 32768 > abs(gx) * {K.CANNY_TAN_22} + abs(gx) * 65536 THEN 2
    WHEN gx * gy < 0 THEN 3 ELSE 4 END AS d FROM mg),
nb AS (SELECT c.image_id, c.x, c.y, c.m, c.d, coalesce(p.m, 0) AS pm, coalesce(q.m, 0) AS qm FROM dr c
    LEFT JOIN mg p ON p.image_id = c.image_id AND p.x = c.x + CASE c.d WHEN 1 THEN -1 WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE -1 END
        AND p.y = c.y + CASE c.d WHEN 1 THEN 0 ELSE -1 END
    LEFT JOIN mg q ON q.image_id = c.image_id AND q.x = c.x - CASE c.d WHEN 1 THEN -1 WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE -1 END
        AND q.y = c.y - CASE c.d WHEN 1 THEN 0 ELSE -1 END),
rg AS (SELECT image_id, x, y, m FROM nb
    WHERE m > {K.CANNY_LOW} AND m > pm AND (m > qm OR (d <= 2 AND m = qm))),
eg AS (SELECT image_id, x, y FROM rg WHERE m > {K.CANNY_HIGH}
    UNION SELECT r.image_id, r.x, r.y FROM eg JOIN rg r ON r.image_id = eg.image_id AND abs(r.x - eg.x) <= 1 AND abs(r.y - eg.y) <= 1),
wk AS (SELECT image_id, y * 64 + x AS root, x, y FROM eg
    UNION SELECT w.image_id, w.root, e.x, e.y FROM wk w JOIN eg e ON e.image_id = w.image_id AND abs(e.x - w.x) <= 1 AND abs(e.y - w.y) <= 1),
lb AS (SELECT image_id, x, y, min(root) AS region FROM wk GROUP BY image_id, x, y),
rt AS (SELECT image_id, region, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM lb GROUP BY image_id, region),
bg AS (SELECT *, count(*) OVER (PARTITION BY image_id) AS n_regions, sum(n) OVER (PARTITION BY image_id) AS n_edges FROM rt
    QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, region) = 1),
mid AS (SELECT image_id, floor(avg(y)) AS my, floor(avg(x)) AS mx FROM lb GROUP BY image_id),
dk AS (SELECT image_id, x AS kx, y AS ky FROM lv QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY v, y, x) = 1),
wh AS (SELECT image_id, count(*) AS n_pixels, avg(r / CAST(b + 1 AS DOUBLE)) AS heat_ratio, max(v) - min(v) AS grey_range
    FROM lv GROUP BY image_id),
ds AS (SELECT wh.*, coalesce(n_edges, 0) AS n_edges, coalesce(n_edges, 0) / (n_pixels + CAST(1e-5 AS DOUBLE)) AS edge_density,
    coalesce(n_regions, 0) AS n_regions, coalesce(n, 0) AS region_pixels, CAST(coalesce(my, ky) AS INTEGER) AS center_y,
    CAST(coalesce(mx, kx) AS INTEGER) AS center_x,
    CASE WHEN n IS NULL THEN greatest({2 * _AT}, coalesce(mx, kx) - {_AROUND}) ELSE greatest({_AT}, x0) END AS box_x,
    CASE WHEN n IS NULL THEN greatest({2 * _AT}, coalesce(my, ky) - {_AROUND}) ELSE greatest({_AT}, y0) END AS box_y,
    CASE WHEN n IS NULL THEN {_BOX} ELSE greatest({_SIDE}, x1 - x0 + 1) END AS box_w,
    CASE WHEN n IS NULL THEN {_BOX} ELSE greatest({_SIDE}, y1 - y0 + 1) END AS box_h
    FROM wh JOIN dk USING (image_id) LEFT JOIN bg USING (image_id) LEFT JOIN mid USING (image_id))""").replace("WITH ", "WITH RECURSIVE ", 1)


def _stats(spark, sf_dir):
    return E.defect_stats(B.pixels(spark, sf_dir))


@register("w_canny_ridges", EDGES + f"""
SELECT image_id, x, y, m AS strength, m > {K.CANNY_HIGH} AS is_strong FROM rg""")
def q_ridges(spark, sf_dir):
    """Sobel gradients and non-maximum suppression: the pixels that may be edges."""
    return E.ridge_pixels(B.pixels(spark, sf_dir)).where("is_ridge").select("image_id", "x", "y", "strength", "is_strong")


@register("a_canny_edges", EDGES + """
SELECT image_id, CAST(n_edges AS BIGINT) AS n_edges, round(edge_density, 6) AS edge_density, center_y, center_x FROM ds""")
def q_edges(spark, sf_dir):
    return round_doubles(_stats(spark, sf_dir).select("image_id", "n_edges", "edge_density", "center_y", "center_x"))


@register("a_defect_region", EDGES + """
SELECT image_id, n_regions, region_pixels, CAST(box_x AS INTEGER) AS box_x, CAST(box_y AS INTEGER) AS box_y,
       CAST(box_w AS INTEGER) AS box_w, CAST(box_h AS INTEGER) AS box_h FROM ds""")
def q_region(spark, sf_dir):
    """The largest connected region of edge pixels of every image and its box."""
    return _stats(spark, sf_dir).select("image_id", "n_regions", "region_pixels", "box_x", "box_y", "box_w", "box_h")


def _verdict_sql() -> str:
    lo, hi = f"(edge_density > {K.EDGE_DENSITY_LOW} OR grey_range > {K.GREY_RANGE_LOW})", \
        f"(edge_density > {K.EDGE_DENSITY_HIGH} OR grey_range > {K.GREY_RANGE_HIGH})"
    hot = f"heat_ratio > {K.HEAT_RATIO_LIMIT}"
    return f"""SELECT image_id, CASE WHEN {hot} THEN 'Overheat' WHEN {lo} AND {hi} THEN 'Crack' WHEN {lo} THEN 'Scratch'
  ELSE 'Crack' END AS defect_type, CASE WHEN {hot} OR ({lo} AND {hi}) THEN 'Critical' ELSE 'Moderate' END AS severity FROM ds"""


@register("p_canny_verdict", EDGES + " " + _verdict_sql())
def q_canny_verdict(spark, sf_dir):
    """The surface verdict from the edge map with hysteresis."""
    return E.defect_verdicts(_stats(spark, sf_dir)).select("image_id", "defect_type", "severity")
