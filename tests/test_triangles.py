"""Delaunay triangulation: one tile and many against the definition, degenerate sets, and 100,000 points."""

import math

import numpy as np
import pytest

from cellweave.operators.triangles import HULL, Delaunay
from cellweave.plans.grid import Grid
from cellweave.plans.registry import create

@pytest.fixture()
def rng():
    return np.random.default_rng(7)


TURN = [2 * math.pi * k / 60 for k in range(60)]
SHAPES = {
    "lattice": lambda rng: rng.integers(0, 12, (200, 2)),
    "clusters": lambda rng: np.vstack([rng.random((150, 2)) * 0.01, rng.random((50, 2)), [[50, 50], [60, 1]]]),
    "circle": lambda rng: np.array([[math.cos(a), math.sin(a)] for a in TURN]),
    "lines": lambda rng: np.array([[k, y] for k in range(40) for y in (0, 7)]),
    "line": lambda rng: np.array([[k, 2 * k] for k in range(40)]),
    "two": lambda rng: np.array([[0, 0], [1, 0]]),
}


def corners(p):
    q = np.unique(np.array(p, float), axis=0)
    d = Delaunay(q[:, 0].copy(), q[:, 1].copy())
    return d, q, [t for t in d.triangles() if t[2] != HULL]


@pytest.mark.parametrize("shape", SHAPES)
def test_one_tile(rng, shape):
    """No point in any circle, and as many triangles as points and hull ask for."""
    d, q, found = corners(SHAPES[shape](rng)[:70])
    hull = sum(t[2] == HULL for t in d.triangles())
    assert len(found) == (2 * len(q) - 2 - hull if hull else 0)
    for a, b, c in found:
        assert d.turn(a, b, c) > 0 and not any(d._conflict(a, b, c, k) for k in range(len(q)) if k not in (a, b, c))


def frame(spark, p):
    return spark.createDataFrame([(k, float(x), float(y), float(k)) for k, (x, y) in enumerate(p)], "id long, x double, y double, value double")


@pytest.mark.parametrize("shape", ["lattice", "clusters", "lines", "two"])
def test_tiles_agree(spark, rng, shape):
    p = SHAPES[shape](rng)
    got = create("TIN")(frame(spark, p), tile_points=16).collect()
    _, q, want = corners(p)
    least = {tuple(map(float, x)): k for k, x in reversed(list(enumerate(p.tolist())))}
    assert sorted(((r.x0, r.y0), (r.x1, r.y1), (r.x2, r.y2)) for r in got) == sorted(tuple(map(tuple, q[list(t)].tolist())) for t in want)
    assert all((r.z0, r.z1, r.z2) == (least[r.x0, r.y0], least[r.x1, r.y1], least[r.x2, r.y2]) for r in got)


def test_odd_points(spark):
    rows = [(1, 0.0, 0.0, 1.0), (2, 4.0, 0.0, 2.0), (3, 0.0, 4.0, 3.0), (4, 0.0, 0.0, 9.0), (5, None, 1.0, 1.0), (6, 1.0, math.nan, 1.0), (7, 1.0, 1.0, None), (None, 4.0, 0.0, 7.0)]
    tin = create("TIN")(spark.createDataFrame(rows, "id long, x double, y double, value double"))
    assert tin.count() == 1
    grid = Grid(spark.range(9).selectExpr("cast(id / 3 as int) as row", "cast(id % 3 as int) as col", "0.0D as v"), 3, 3, (0.0, 2.0, 1.0, -1.0, 0.0, 0.0))
    z = {(r.row, r.col): r.v for r in create("TINSURF")(tin, grid).df.collect()}
    assert z[2, 0] == 1.0 and z[2, 2] is not None and math.isclose(z[1, 1], 1 + (7 - 1) / 4 + (3 - 1) / 4)
    assert create("TIN")(spark.createDataFrame(rows, "id long, x double, y double, value double").limit(0)).count() == 0


def test_many_points(spark):
    """Every edge of 100,000 points' triangles is locally Delaunay, which makes all circles empty."""
    n = 100_000
    p = spark.range(n).selectExpr("id", "rand(1) * 1000 as x", "rand(2) * 1000 as y", "rand(3) as value").toPandas()
    t = create("TIN")(spark.createDataFrame(p)).toPandas()
    x, y = (t[[f"{c}{k}" for k in range(3)]].to_numpy() for c in "xy")
    edges, third = [], []
    for a, b, c in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
        edges.append(np.column_stack([x[:, a], y[:, a], x[:, b], y[:, b]]))
        third.append(np.column_stack([x[:, c], y[:, c]]))
    edges, third = np.vstack(edges), np.vstack(third)
    back = np.where((edges[:, 0] > edges[:, 2])[:, None], edges[:, [2, 3, 0, 1]], edges)
    order = np.lexsort(back.T)
    back, edges, third = back[order], edges[order], third[order]
    same = (back[1:] == back[:-1]).all(axis=1)
    assert not (same[1:] & same[:-1]).any()
    hull = len(edges) - 2 * same.sum()
    assert len(t) == 2 * n - 2 - hull
    k = np.flatnonzero(same)
    (ax, ay, bx, by), (cx, cy), (dx, dy) = edges[k].T, third[k].T, third[k + 1].T
    ax, ay, bx, by, cx, cy = ax - dx, ay - dy, bx - dx, by - dy, cx - dx, cy - dy
    det = (ax * ax + ay * ay) * (bx * cy - by * cx) - (bx * bx + by * by) * (ax * cy - ay * cx) + (cx * cx + cy * cy) * (ax * by - ay * bx)
    assert (det <= 1e-6).all()
