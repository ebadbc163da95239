"""Edge maps and regions against golden images and plain loops."""

import random

import pytest

from shopfloor.operators import edges as E

SCHEMA = "image_id long, x int, y int, r int, g int, b int"


def image(spark, pictures):
    """pictures: {image_id: rows of grey values}."""
    return spark.createDataFrame([(i, x, y, v, v, v) for i, rows in pictures.items() for y, row in enumerate(rows)
                                  for x, v in enumerate(row)], SCHEMA)


def brute_edges(rows, low=30, high=120):
    h, w = len(rows), len(rows[0])

    def at(x, y):
        return rows[min(max(y, 0), h - 1)][min(max(x, 0), w - 1)]

    gx, gy, m = {}, {}, {}
    for y in range(h):
        for x in range(w):
            gx[x, y] = sum(k * (at(x + 1, y + j) - at(x - 1, y + j)) for j, k in ((-1, 1), (0, 2), (1, 1)))
            gy[x, y] = sum(k * (at(x + j, y + 1) - at(x + j, y - 1)) for j, k in ((-1, 1), (0, 2), (1, 1)))
            m[x, y] = abs(gx[x, y]) + abs(gy[x, y])
    weak, strong = set(), set()
    for p, v in m.items():
        ax, ay = abs(gx[p]) * 13573, abs(gy[p]) * 32768
        if ay < ax:
            step, strict = (1, 0), False
        elif ay > ax + abs(gx[p]) * 65536:
            step, strict = (0, 1), False
        else:
            step, strict = ((-1, 1) if gx[p] * gy[p] < 0 else (1, 1)), True
        before, after = m.get((p[0] - step[0], p[1] - step[1]), 0), m.get((p[0] + step[0], p[1] + step[1]), 0)
        if v > low and v > before and (v > after or (v == after and not strict)):
            weak.add(p)
            if v > high:
                strong.add(p)
    found, todo = set(strong), list(strong)
    while todo:
        x, y = todo.pop()
        for q in ((x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
            if q in weak and q not in found:
                found.add(q)
                todo.append(q)
    return found


def brute_regions(edges):
    left, out = set(edges), []
    while left:
        todo = [left.pop()]
        region = set(todo)
        while todo:
            x, y = todo.pop()
            near = {(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            region |= near
            todo += near
        out.append(region)
    return out


def pictures():
    r = random.Random(4)
    out = {k: [[r.randrange(256) for _ in range(12)] for _ in range(9)] for k in range(12)}
    out |= {20 + k: [[r.choice([90, 100, 118]) for _ in range(14)] for _ in range(14)] for k in range(6)}
    out[40] = [[100] * 10 for _ in range(10)]
    out[41] = [[20] * 5 + [200] * 5 for _ in range(8)]
    out[42] = [[250 if x + y > 12 else 10 for x in range(14)] for y in range(14)]
    out[43] = [[7]]
    ramp = [[100 + min(40, max(0, (x - 4) * 9)) + (60 if y == 0 and x > 4 else 0) for x in range(12)] for y in range(12)]
    out[44] = ramp  # weak edges that hang on a strong one
    return out


def test_edges_and_regions_equal_loops(spark):
    pics = pictures()
    ridges = E.ridge_pixels(image(spark, pics))
    got, labels = {}, {}
    for r in E.edge_regions(ridges).collect():
        got.setdefault(r.image_id, set()).add((r.x, r.y))
        labels.setdefault((r.image_id, r.region), set()).add((r.x, r.y))
    for i, rows in pics.items():
        assert got.get(i, set()) == brute_edges(rows), i
        want = {frozenset(x) for x in brute_regions(got.get(i, set()))}
        assert {frozenset(v) for (k, _), v in labels.items() if k == i} == want
    assert any(not brute_edges(rows) for rows in pics.values())


def test_golden_step(spark):
    """A vertical step: one column of edge pixels, the left one of the two with equal strength."""
    edges = E.edge_regions(E.ridge_pixels(image(spark, {1: pictures()[41]}))).collect()
    assert sorted((r.x, r.y) for r in edges) == [(4, y) for y in range(8)]


def test_winding_region_is_one(spark):
    """A spiral of single pixels is one component, whatever its bends; a point apart is another."""
    n, points, seen = 21, [], set()
    x = y = 0
    dx, dy = 1, 0
    for _ in range(200):
        points.append((7, x, y))
        seen.add((x, y))
        ahead, beyond = (x + dx, y + dy), (x + 2 * dx, y + 2 * dy)
        if not (0 <= ahead[0] < n and 0 <= ahead[1] < n) or beyond in seen:
            dx, dy = -dy, dx
            if (x + 2 * dx, y + 2 * dy) in seen or not (0 <= x + dx < n and 0 <= y + dy < n):
                break
        x, y = x + dx, y + dy
    df = spark.createDataFrame([*points, (7, 40, 40), (8, 3, 3)], "image_id long, x int, y int")
    got = {(r.image_id, r.x, r.y): r.label for r in E.connected_pixels(df).collect()}
    assert {got[p] for p in points} == {0} and got[7, 40, 40] == 40 * E.LABEL_ROW + 40 and len(got) == len(points) + 2


def test_largest_region_and_defaults(spark):
    pics = pictures()
    got = {r.image_id: r for r in E.defect_stats(image(spark, pics)).collect()}
    for i, rows in pics.items():
        regions = brute_regions(brute_edges(rows))
        r = got[i]
        assert r.n_regions == len(regions) and r.region_pixels == max(map(len, regions), default=0)
        if not regions:
            assert (r.box_w, r.box_h, r.n_edges) == (40, 40, 0)
            dark = min((v, y, x) for y, row in enumerate(rows) for x, v in enumerate(row))
            assert (r.center_y, r.center_x) == dark[1:]
        else:
            big = min((x for x in regions if len(x) == r.region_pixels), key=lambda s: min((y, x) for x, y in s))
            assert (r.box_x, r.box_y) == (max(5, min(x for x, _ in big)), max(5, min(y for _, y in big)))
            assert r.box_w == max(20, max(x for x, _ in big) - min(x for x, _ in big) + 1)


def test_null_channels_and_empty(spark):
    df = image(spark, {1: [[10, 200], [10, 200]]}).unionByName(spark.createDataFrame([(1, 2, 0, None, 3, 3)], SCHEMA))
    assert E.defect_stats(df).first().n_pixels == 4
    assert E.defect_stats(df.where("false")).collect() == []


@pytest.mark.parametrize("low,high", [(30, 120), (100, 500)])
def test_thresholds(spark, low, high):
    rows = pictures()[3]
    got = E.edge_regions(E.ridge_pixels(image(spark, {3: rows}), low, high)).collect()
    assert {(r.x, r.y) for r in got} == brute_edges(rows, low, high)
