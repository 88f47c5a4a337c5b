"""Delaunay triangulation of any number of points, by tiles.

Tiles are quadtree leaves of a bounded number of points. Each triangulates its own points and a halo, exactly (whole numbers,
ties between points on one circle broken the same way everywhere), so that tiles agree. A triangle is final if its
circle lies inside what the tile knows. Circles that reach farther, and hull edges, are sent to the leaves that they
meet, which answer with points inside; a tile with such points triangulates again. Triangles belong to the tile of their
first corner in order of x and y.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import discard, written
from .nearness import DEPTH, leaf_boxes

HULL = -1
#: Relative width of the band around a circle whose points are sent whatever side they seem to be on.
BAND, ROUNDING = 1e-9, 1e-15
ANSWERS = 8


def whole_numbers(x: np.ndarray) -> list[int]:
    """Doubles times one power of two, exactly."""
    ratios = [v.as_integer_ratio() for v in x.tolist()]
    top = max(d for _, d in ratios)
    return [n * (top // d) for n, d in ratios]


class Delaunay:
    """Triangles of distinct points in order: `opposite[a, b]` is the third corner left of the edge from a to b, HULL outside."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        """x, y ascending in order of (x, y): a point's number is its rank in breaking ties."""
        both = whole_numbers(np.concatenate([x, y]))
        self.p = list(zip(both[: len(x)], both[len(x) :]))
        self.opposite: dict[tuple[int, int], int] = {}
        third = next((k for k in range(2, len(self.p)) if self.turn(0, 1, k)), None)
        if third is None:
            return
        a, b, c = (0, 1, third) if self.turn(0, 1, third) > 0 else (1, 0, third)
        for t in ((a, b, c), (b, a, HULL), (c, b, HULL), (a, c, HULL)):
            self._add(*t)
        self.last = (a, b)
        # In order along a curve of cells, the next point is near to the last one.
        n = max(1, int(math.sqrt(len(self.p) / 4)))
        size = max(float(np.ptp(x)), float(np.ptp(y))) or 1.0
        gx, gy = ((x - x.min()) / size * n).astype(int), ((y - y.min()) / size * n).astype(int)
        order = np.lexsort((np.where(gx % 2, -gy, gy), gx))
        for k in order.tolist():
            if k not in (0, 1, third):
                self._insert(k)

    def turn(self, a: int, b: int, c: int) -> int:
        """Positive if a, b, c turn left."""
        (ax, ay), (bx, by), (cx, cy) = self.p[a], self.p[b], self.p[c]
        return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)

    def _conflict(self, a: int, b: int, c: int, k: int) -> bool:
        """Whether k lies in the circle of a, b, c; on it, the point of least rank is lifted before the others, so that four points never tie."""
        if HULL in (a, b, c):
            if a == HULL:
                a, b = b, c
            elif b == HULL:
                a, b = c, a
            side = self.turn(a, b, k)
            if side:
                return side > 0
            (ax, ay), (bx, by), (kx, ky) = self.p[a], self.p[b], self.p[k]
            return (kx - ax) * (kx - bx) + (ky - ay) * (ky - by) < 0
        (kx, ky) = self.p[k]
        (ax, ay), (bx, by), (cx, cy) = self.p[a], self.p[b], self.p[c]
        ax, ay, bx, by, cx, cy = ax - kx, ay - ky, bx - kx, by - ky, cx - kx, cy - ky
        det = (ax * ax + ay * ay) * (bx * cy - by * cx) - (bx * bx + by * by) * (ax * cy - ay * cx) + (cx * cx + cy * cy) * (ax * by - ay * bx)
        if det:
            return det > 0
        least = min(a, b, c, k)
        if least == k:
            return False
        return (self.turn(b, c, k) if least == a else self.turn(c, a, k) if least == b else self.turn(a, b, k)) > 0

    def _add(self, a: int, b: int, c: int) -> None:
        self.opposite[a, b], self.opposite[b, c], self.opposite[c, a] = c, a, b

    def _insert(self, k: int) -> None:
        a, b = self.last
        while True:  # walk towards k
            c = self.opposite[a, b]
            if c == HULL or self._conflict(a, b, c, k):
                break
            if self.turn(b, c, k) < 0:
                a, b = c, b
            elif self.turn(c, a, k) < 0:
                a, b = a, c
            elif self.turn(a, b, k) < 0:
                a, b = b, a
            else:
                break
        if not self._conflict(a, b, self.opposite[a, b], k):  # on the hull's far side: its edges one after the other
            start = (a, b) if self.opposite[a, b] == HULL else next(e for e, o in self.opposite.items() if o == HULL)
            a, b = start
            while not self._conflict(a, b, HULL, k):
                a, b = b, self.opposite[HULL, b]
                if (a, b) == start:
                    raise ArithmeticError("a point in no triangle")
        todo, rim = [(a, b), (b, self.opposite[a, b]), (self.opposite[a, b], a)], []
        for e in todo:
            self.opposite.pop(e)
        while todo:
            a, b = todo.pop()
            c = self.opposite.get((b, a))
            if c is None:
                continue  # the neighbour is gone too
            if self._conflict(b, a, c, k):
                for e in ((b, a), (a, c), (c, b)):
                    self.opposite.pop(e)
                todo += [(a, c), (c, b)]
            else:
                rim.append((a, b))
        for a, b in rim:
            self._add(a, b, k)
            if a != HULL and b != HULL:
                self.last = (a, b)

    def triangles(self) -> list[tuple[int, int, int]]:
        """Each once, from its least corner, leftwards; hull edges a, b as (a, b, HULL), with the points to their right."""
        out = []
        for (a, b), c in self.opposite.items():
            if c == HULL or (HULL not in (a, b) and a < b and a < c):
                out.append((a, b, c))
        return out


def circle(ax, ay, bx, by, cx, cy):
    """Centres, radii, and how far a point may seem on the wrong side by rounding, generously."""
    bx, by, cx, cy = bx - ax, by - ay, cx - ax, cy - ay
    d = 2 * (bx * cy - by * cx)
    bb, cc = bx * bx + by * by, cx * cx + cy * cy
    with np.errstate(all="ignore"):
        ux, uy = (cy * bb - by * cc) / d, (bx * cc - cx * bb) / d
        r = np.hypot(ux, uy)
        doubt = BAND * r + ROUNDING * ((np.abs(ax) + np.abs(ay)) + (np.abs(cy * bb) + np.abs(by * cc) + np.abs(bx * cc) + np.abs(cx * bb)) / np.abs(d) * (1 + r * (np.sqrt(bb) + np.sqrt(cc)) / np.abs(d)))
    return ax + ux, ay + uy, r, doubt


OUT = "tile int, kind int, " + ", ".join(f"{c}{k} double" for k in range(3) for c in "xyz")


def triangulate(points: DataFrame, bound: int = 1024) -> DataFrame:
    """tri, and x, y, z of its three corners (leftwards, from the first in order of x and y): Delaunay triangles of points (id, x, y, value).

    Of points in one place the one with the least id counts; those without a place or value are left out. Fewer than three
    points, or points on one line, have no triangles. Tiles hold `bound` points, or a 16,384th of all if that is more,
    with a halo of about four rows of points. What is broadcast are tiles' boxes. Rounds go on until no
    circle holds a point that its tile doesn't know.
    """
    spark = points.sparkSession
    clean = points.where("x is not null and y is not null and value is not null and not isnan(x) and not isnan(y)").selectExpr("id", "cast(x as double) + 0.0D as x", "cast(y as double) + 0.0D as y", "cast(value as double) as z")
    placed, boxes, counts = leaf_boxes(clean.groupBy("x", "y").agg(F.min_by("z", F.struct("id", "z")).alias("z")), bound)
    if boxes is None:
        return spark.createDataFrame([], "tri long, " + OUT.split("kind int, ")[1])
    low_x, high_x, low_y, high_y = boxes
    halo = 4 * np.maximum(high_x - low_x, high_y - low_y) / np.sqrt(np.maximum(counts, 1))
    halo = np.minimum(halo, np.maximum(high_x - low_x, high_y - low_y))
    edge = low_x.min(), high_x.max(), low_y.min(), high_y.max()
    model = spark.sparkContext.broadcast((boxes, halo))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Points with each tile that they are in the halo of."""
        (x0, x1, y0, y1), h = model.value
        for b in batches:
            x, y, leaf = (b.column(c).to_numpy() for c in ("x", "y", "leaf"))
            rows, tiles = [], []
            for own in np.unique(leaf):
                mine = np.flatnonzero(leaf == own)
                near = np.flatnonzero((x0 - h <= x[mine].max()) & (x1 + h >= x[mine].min()) & (y0 - h <= y[mine].max()) & (y1 + h >= y[mine].min()))
                px, py = x[mine, None], y[mine, None]
                r, t = np.nonzero((px >= x0[near] - h[near]) & (px <= x1[near] + h[near]) & (py >= y0[near] - h[near]) & (py <= y1[near] + h[near]) | (near == own))
                rows.append(mine[r])
                tiles.append(near[t])
            if rows:
                r, t = np.concatenate(rows), np.concatenate(tiles)
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(leaf[r] == t), *(b.column(c).take(pa.array(r)) for c in ("x", "y", "z"))], ["tile", "own", "x", "y", "z"])

    def solve(table: pa.Table) -> pa.Table:
        tile = table.column("tile")[0].as_py()
        (x0, x1, y0, y1), h = model.value
        x, y, z, own = (table.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "z", "own"))
        order = np.lexsort((y, x))
        x, y, z, own = x[order], y[order], z[order], own[order]
        found = Delaunay(x, y).triangles() if len(x) > 2 else []
        none = np.zeros((0, 9))
        if not found:  # too few points, or on one line: ask more and more of the nearest leaves
            before = table.column("asked")[0].as_py()
            if before < len(x0):
                return _rows(tile, 3, np.array([[(x0[tile] + x1[tile]) / 2, (y0[tile] + y1[tile]) / 2, min(len(x0), 8 * max(8, before)), *[0.0] * 6]]))
            return _rows(tile, 0, none)
        t = np.array(found)
        hull = t[:, 2] == HULL
        solid, edges = t[~hull], t[hull]
        solid = solid[own[solid].any(axis=1)]
        edges = edges[own[edges[:, :2]].any(axis=1)]
        a, b, c = solid.T
        mx, my, radius, doubt = circle(x[a], y[a], x[b], y[b], x[c], y[c])
        r = radius + doubt
        side = h[tile]
        # Beyond the outermost leaves there are no points.
        left, right = (-np.inf if x0[tile] - side <= edge[0] else x0[tile] - side), (np.inf if x1[tile] + side >= edge[1] else x1[tile] + side)
        down, up = (-np.inf if y0[tile] - side <= edge[2] else y0[tile] - side), (np.inf if y1[tile] + side >= edge[3] else y1[tile] + side)
        known = (mx - r >= left) & (mx + r <= right) & (my - r >= down) & (my + r <= up)
        everything = left == down == -np.inf and right == up == np.inf
        asks = np.zeros((0, 9)) if everything else np.column_stack([mx, my, radius, doubt, *[np.zeros(len(mx))] * 5])[~known]
        lines = np.zeros((0, 9)) if everything else np.column_stack([x[edges[:, 0]], y[edges[:, 0]], x[edges[:, 1]], y[edges[:, 1]], *[np.zeros(len(edges))] * 5])
        mine = solid[own[solid[:, 0]]]
        corners = np.column_stack([v[mine[:, k]] for k in range(3) for v in (x, y, z)])
        return pa.concat_tables([_rows(tile, 0, corners), _rows(tile, 1, asks), _rows(tile, 2, lines)])

    def asked_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Questions with each leaf that they concern."""
        (x0, x1, y0, y1), _ = model.value
        for b in batches:
            q = np.column_stack([b.column(f"{c}{k}").to_numpy() for k in range(3) for c in "xyz"])
            out = []
            for n, (kind, tile, v) in enumerate(zip(b.column("kind").to_numpy(), b.column("tile").to_numpy(), q)):
                if kind == 2:  # to the left of the edge a hull's outside lies
                    far = np.maximum((v[2] - v[0]) * (y0 - v[1]), (v[2] - v[0]) * (y1 - v[1])) - np.minimum((v[3] - v[1]) * (x0 - v[0]), (v[3] - v[1]) * (x1 - v[0]))
                    some = np.flatnonzero(far >= 0)
                else:
                    gap = np.maximum(0, np.maximum(x0 - v[0], v[0] - x1)) ** 2 + np.maximum(0, np.maximum(y0 - v[1], v[1] - y1)) ** 2
                    some = np.argsort(gap, kind="stable")[: int(v[2])] if kind == 3 else np.flatnonzero(gap <= (v[2] + v[3]) ** 2)
                out += [(n, int(leaf)) for leaf in some if leaf != tile]
            rows = pa.array([n for n, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([leaf for _, leaf in out], pa.int32()), b.column("tile").take(rows), b.column("kind").take(rows), *(b.column(f"{c}{k}").take(rows) for k in range(3) for c in "xyz")], ["leaf", "tile", "kind", *(f"{c}{k}" for k in range(3) for c in "xyz")])

    def answer(key, asks: pa.Table, own: pa.Table) -> pa.Table:
        """For each question the deepest points of the leaf, and those in the band of doubt."""
        x, y, z = (own.column(c).to_numpy() for c in "xyz")
        out = []
        for tile, kind, a, b, c, d in zip(*(asks.column(n).to_numpy() for n in ("tile", "kind", "x0", "y0", "z0", "x1"))):
            if kind == 2:
                deep = (c - a) * (y - b) - (d - b) * (x - a)
                slack = BAND * (abs(c - a) + abs(d - b)) * (np.abs(x - a) + np.abs(y - b))
                doubt = (np.abs(deep) <= slack) & ((x - a) * (x - c) + (y - b) * (y - d) < 0)
            else:
                deep = (np.inf if kind == 3 else c) - np.hypot(x - a, y - b)
                slack = d
                doubt = np.abs(deep) <= slack
            inside = deep > slack
            if kind == 3:
                deep = -np.hypot(x - a, y - b)
            best = np.flatnonzero(inside)
            best = best[np.argsort(-deep[best], kind="stable")[:ANSWERS]]
            out += [(int(tile), int(k)) for k in {*best.tolist(), *np.flatnonzero(doubt).tolist()}]
        k = np.array([k for _, k in out], np.int64)
        return pa.table({"tile": pa.array([t for t, _ in out], pa.int32()), "own": np.zeros(len(k), bool), "x": x[k], "y": y[k], "z": z[k]})

    kinds = "tile int, own boolean, x double, y double, z double"
    known = written(placed.mapInArrow(around, kinds).withColumn("asked", F.lit(0)))
    done, tables = [], 0
    while True:
        solved = written(known.groupBy("tile").applyInArrow(solve, OUT))
        asks = solved.where("kind > 0")
        new = written(asks.mapInArrow(asked_of, "leaf int, " + OUT).groupBy("leaf").cogroup(placed.groupBy("leaf")).applyInArrow(answer, kinds).distinct())
        asked = asks.groupBy("tile").agg(F.max(F.when(F.col("kind") == 3, F.col("z0")).otherwise(0)).cast("int").alias("asked"))
        fresh = new.join(known.select("tile", "x", "y"), ["tile", "x", "y"], "left_anti")
        open_ = written(fresh.select("tile").union(solved.where("kind = 3").select("tile")).distinct().join(asked, "tile"))
        done.append(solved.where("kind = 0").join(open_.select("tile"), "tile", "left_anti"))
        tables += 1
        if not open_.head(1):
            break
        more = known.drop("asked").join(open_.select("tile"), "tile", "left_semi").unionByName(fresh.join(open_.select("tile"), "tile", "left_semi").select("tile", "own", "x", "y", "z"))
        later = written(more.join(open_, "tile").select("tile", "own", "x", "y", "z", "asked"))
        discard(known, new)
        known = later
    out = reduce(DataFrame.unionByName, done)
    return out.select(F.monotonically_increasing_id().alias("tri"), *(f"{c}{k}" for k in range(3) for c in "xyz"))


def _rows(tile: int, kind: int, v: np.ndarray) -> pa.Table:
    n = len(v)
    names = [f"{c}{k}" for k in range(3) for c in "xyz"]
    return pa.table({"tile": np.full(n, tile, np.int32), "kind": np.full(n, kind, np.int32)} | {name: np.ascontiguousarray(v[:, k], float) for k, name in enumerate(names)})
