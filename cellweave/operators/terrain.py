"""Sight lines, paths, surfaces from points, projections and outlines."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.grid import KEY, Grid, align
from ..plans.registry import operator
from ..plans.scratch import written
from .focal import neighbours, square, tiled
from .iterate import FLOW_CODES, FOUR, components
from .triangles import triangulate
from .zonal import by_key, running_count


@operator("VIEWSHED", "gis", "dem", observer_x=0.0, observer_y=0.0, observer_height=1.7, max_distance=0.0)
def viewshed(dem: Grid, observer_x, observer_y, observer_height, max_distance, wedge_cells=1 << 20):
    """1 where no cell on the line from the observer stands at a steeper angle, else 0.

    Cells are dealt to wedges around the observer, of wedge_cells at most, and go to those wedges as well whose lines may touch
    them (half a cell to either side), which are few but beside the observer. So rows are shuffled about once, and a
    wedge walks all of its lines in arrays, step by step.
    """
    ox, oy, pw, ph, *_ = dem.transform
    oc, orow = int((observer_x - ox) / pw), int((observer_y - oy) / ph)
    eye = dem.df.where((F.col("row") == orow) & (F.col("col") == oc)).head()
    if eye is None or eye.v is None:
        raise ValueError("the observer stands outside the data")
    (dx, dy), height = dem.cell, eye.v + observer_height
    reach = max((r - orow) ** 2 + (c - oc) ** 2 for r in (0, dem.rows) for c in (0, dem.cols))
    wedges = max(1, math.ceil(math.pi * reach / wedge_cells))
    dr, dc = (F.col("row") - orow).cast("double"), (F.col("col") - oc).cast("double")
    place = (F.atan2(dr, dc) + math.pi) / (2 * math.pi / wedges)
    slack = 0.75 / F.sqrt(dr * dr + dc * dc) / (2 * math.pi / wedges)
    first = F.floor(place - slack)
    last = F.least(F.floor(place + slack), first + (wedges - 1))
    cells = dem.valid().where((F.col("row") != orow) | (F.col("col") != oc))
    dealt = cells.select(*KEY, "v", F.pmod(F.floor(place), F.lit(wedges)).alias("home"), F.explode(F.sequence(first, last)).alias("w")).select(*KEY, "v", "home", F.pmod("w", F.lit(wedges)).alias("wedge"))

    def run(table: pa.Table) -> pa.Table:
        row, col, v = (table.column(c).to_numpy() for c in ("row", "col", "v"))
        own = table.column("home").to_numpy() == table.column("wedge").to_numpy()
        angle = (v - height) / np.hypot(row - orow, col - oc)
        # A wedge's cells of one row lie between two columns: rows one after the other are an image without the rest.
        top, rows = row.min(), row.max() - row.min() + 1
        low, high = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
        np.minimum.at(low, row - top, col)
        np.maximum.at(high, row - top, col)
        start = np.concatenate(([0], np.cumsum(np.maximum(0, high - low + 1))))
        image = np.full(start[-1], -np.inf)
        image[start[row - top] + col - low[row - top]] = angle
        r, c, own_angle = row[own], col[own], angle[own]
        steps = np.maximum(np.abs(r - orow), np.abs(c - oc))
        order = np.argsort(-steps, kind="stable")
        r, c, own_angle, steps = r[order], c[order], own_angle[order], steps[order]
        step_r, step_c, most = (r - orow) / steps, (c - oc) / steps, np.full(len(r), -np.inf)

        def near(x: np.ndarray) -> np.ndarray:
            """Rounded, halves away from zero."""
            whole = np.floor(np.abs(x))
            return (np.sign(x) * (whole + (np.abs(x) - whole >= 0.5))).astype(np.int64)

        for s in range(1, int(steps[0]) if len(steps) else 0):
            m = int(np.searchsorted(-steps, -s))  # lines that go on beyond s
            i, j = near(step_r[:m] * s) + orow - top, near(step_c[:m] * s) + oc
            there = (i >= 0) & (i < rows)
            i = np.where(there, i, 0)
            there &= (j >= low[i]) & (j <= high[i])
            most[:m][there] = np.maximum(most[:m][there], image[start[i[there]] + j[there] - low[i[there]]])
        seen = own_angle >= most
        if max_distance > 0:
            seen &= np.hypot((r - orow) * dy, (c - oc) * dx) <= max_distance
        return pa.table({"row": pa.array(r, pa.int32()), "col": pa.array(c, pa.int32()), "seen": seen.astype(float)})

    found = dealt.groupBy("wedge").applyInArrow(run, "row int, col int, seen double")
    here = F.when((F.col("row") == orow) & (F.col("col") == oc), 1.0).otherwise(F.col("seen"))
    return dem.with_cells(dem.df.join(found, KEY, "left").select(*KEY, F.when(F.col("v").isNotNull(), here).alias("v")))


@operator("PATHWAY", "gis", "cost backlink", row=0, col=0, target_x=None, target_y=None)
def pathway(cost: Grid, backlink: Grid, row, col, target_x, target_y):
    """1 on the cells from a destination (a cell, or map coordinates if given) along backlink codes to cost zero; the path doubles its reach each round."""
    row, col = cost.cell_of(row, col, target_x, target_y)
    to = F.when(F.lit(False), F.struct(F.lit(0).alias("dr"), F.lit(0).alias("dc")))
    for (a, b), c in FLOW_CODES.items():
        to = to.when(F.col("v1").cast("int") == c, F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")))
    t = align([cost, backlink]).where("v0 > 0").withColumn("t", to).where("t is not null")
    ids = cost.cell_id()
    jump = written(t.select(ids.alias("id"), ((F.col("row") + F.col("t.dr")).cast("long") * cost.cols + F.col("col") + F.col("t.dc")).alias("next")))
    path = written(cost.df.where((F.col("row") == row) & (F.col("col") == col)).select(ids.alias("id")))
    while jump.head(1):
        n = path.count()
        path = written(path.union(path.join(jump, "id").select("next")).distinct())
        if path.count() == n:
            break
        jump = written(jump.join(jump.select(F.col("id").alias("next"), F.col("next").alias("then")), "next").select("id", F.col("then").alias("next")))
    hit = path.select("id", F.lit(1.0).alias("hit"))
    return cost.with_cells(cost.df.withColumn("id", ids).join(hit, "id", "left").select(*KEY, F.coalesce("hit", F.lit(0.0)).alias("v")))


def _edged(cells: DataFrame, rows: int, cols: int, reach: int) -> DataFrame:
    """cells, with those of the grid's edge repeated for `reach` cells beyond it."""

    def out(axis: str, size: int):
        beyond = F.sequence(F.lit(1), F.lit(reach))
        low = F.when(F.col(axis) == 0, F.transform(beyond, lambda k: -k)).otherwise(F.array().cast("array<int>"))
        high = F.when(F.col(axis) == size - 1, F.transform(beyond, lambda k: k + (size - 1))).otherwise(F.array().cast("array<int>"))
        return F.explode(F.concat(F.array(F.col(axis)), low, high))

    return cells.withColumn("row", out("row", rows)).withColumn("col", out("col", cols))


@operator("FRACTAL", "gis", "input", max_window=9)
def fractal(grid: Grid, max_window):
    """2 + |b - 2| within 2..3, b the slope of log surface area on log window size (3, 5, .. up to max_window, the next odd one).

    A window's area is that of its quads, each of two triangles of sides (cell, cell, slanted edge). Beyond the edge the
    edge's cells go on; where data is missing a quad's corner has the window's centre value. Windows without area add
    nothing to the slope's sums, which are divided by the number of windows all the same.
    """
    size, top = grid.cell[0], max_window + 1 - max_window % 2
    sizes = range(3, top + 1, 2)
    if len(sizes) < 2:
        raise ValueError("FRACTAL needs two window sizes")
    reach = top // 2
    x = np.log([w * size for w in sizes])
    spread = len(x) * (x * x).sum() - x.sum() ** 2

    def tri(dz):
        return np.sqrt(size**2 + dz * dz) / 4 * np.sqrt(np.maximum(0.0, 3 * size**2 - dz * dz))

    def quads(z):
        return tri(z[..., 1:, :-1] - z[..., :-1, :-1]) + tri(z[..., 1:, 1:] - z[..., :-1, 1:])

    def dimension(areas: list[np.ndarray]) -> np.ndarray:
        some = [a > 0 for a in areas]
        logs = [np.log(np.where(t, a, 1.0)) for t, a in zip(some, areas)]
        sx, sy = sum(t * k for t, k in zip(some, x)), sum(logs)
        sxy, sxx = sum(y * k for y, k in zip(logs, x)), sum(t * k * k for t, k in zip(some, x))
        d = len(x) * sxx - sx * sx
        slope = (len(x) * sxy - sx * sy) / np.where(np.abs(d) < 1e-15, 1.0, d)
        return np.where(np.abs(d) < 1e-15, 2.0, np.clip(2 + np.abs(slope - 2), 2.0, 3.0))

    def run(images: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        z = images["v"]
        side, gaps = len(z) - 2 * reach, np.isnan(z)
        flat = quads(np.where(gaps, 0.0, z))
        areas = []
        for w in sizes:  # quads from -h to h - 1 of each cell, added along one axis and then the other
            at = range(reach - w // 2, reach + w // 2)
            lines = sum(flat[k : k + side] for k in at)
            areas.append(sum(lines[:, k : k + side] for k in at))
        out = dimension(areas)
        # Windows with gaps have other quads for each centre.
        holes = np.pad(gaps.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        near = holes[top : top + side, top : top + side] - holes[:side, top : top + side] - holes[top : top + side, :side] + holes[:side, :side] > 0
        rows, cols = np.nonzero(near & ~gaps[reach : reach + side, reach : reach + side])
        view = np.lib.stride_tricks.sliding_window_view(z, (top, top))
        for k in range(0, len(rows), 4096):
            r, c = rows[k : k + 4096], cols[k : k + 4096]
            own = view[r, c]
            own = quads(np.where(np.isnan(own), own[:, reach : reach + 1, reach : reach + 1], own))
            out[r, c] = dimension([own[:, reach - w // 2 : reach + w // 2, reach - w // 2 : reach + w // 2].sum(axis=(1, 2)) for w in sizes])
        return {"b": out}

    inside = F.col("row").between(0, grid.rows - 1) & F.col("col").between(0, grid.cols - 1)
    b = tiled(_edged(grid.df.select(*KEY, "v"), grid.rows, grid.cols, reach), reach, run, ["b"]).where(inside)
    return grid.with_cells(b.select(*KEY, F.when(F.col("v").isNotNull(), F.col("b")).alias("v")))


def _upper_tail(z: np.ndarray) -> np.ndarray:
    """The normal distribution's upper tail, whole arrays at a time.

    Up to 2.5 by the series of the error function, whose terms fall fast there; beyond by Laplace's continued fraction.
    """
    x = np.abs(z) / math.sqrt(2)
    small = np.minimum(x, 2.5)
    term, total = small.copy(), small.copy()
    for k in range(1, 80):
        term = -term * small * small / k
        total = total + term / (2 * k + 1)
    large, f = np.maximum(x, 2.5), np.zeros_like(x)
    for k in range(120, 0, -1):
        f = k / 2 / (large + f)
    tail = np.where(x <= 2.5, 0.5 - total / math.sqrt(math.pi), 0.5 * np.exp(-large * large) / math.sqrt(math.pi) / (large + f))
    return np.where(z >= 0, tail, 1 - tail)


@operator("PCLASS", "gis", "input error", threshold=0.0)
def probability_class(grid: Grid, error: Grid, threshold):
    """Probability that the true value exceeds the threshold, for normal errors; a step where the error isn't positive."""
    t = align([grid, error])

    def run(batches):
        for b in batches:
            v, s = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("v0", "v1"))
            with np.errstate(divide="ignore", invalid="ignore"):
                out = np.where(s > 0, _upper_tail((threshold - v) / s), (v > threshold).astype(float))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("col"), pa.array(out, pa.float64(), mask=np.isnan(v) | np.isnan(s))], ["row", "col", "v"])

    return grid.with_cells(t.mapInArrow(run, "row int, col int, v double"))


def _concordance(x: np.ndarray, y: np.ndarray) -> int:
    """Concordant less discordant pairs: pairs in order of x and y, less twice the inversions, which are counted by merging."""
    order = np.lexsort((y, x))
    x, y, m = x[order], y[order], len(x)
    if m < 2:
        return 0

    def ties(*parts: np.ndarray) -> int:
        fresh = np.ones(m, bool)
        fresh[1:] = np.logical_or.reduce([p[1:] != p[:-1] for p in parts])
        n = np.diff(np.append(np.flatnonzero(fresh), m))
        return int((n * (n - 1) // 2).sum())

    level = np.unique(y, return_inverse=True)[1].astype(np.int64)
    inversions, side = 0, 1
    size = 1 << (m - 1).bit_length()
    keys = np.full(size, m, np.int64)  # the filling is the largest and comes last, so it is in no inversion
    keys[:m] = level
    while side < size:
        blocks = np.sort(keys.reshape(-1, side), axis=1)
        left, right = blocks[0::2], blocks[1::2]
        base = np.arange(len(left), dtype=np.int64)[:, None] * (m + 1)
        upto = np.searchsorted((left + base).ravel(), (right + base).ravel(), side="right").reshape(right.shape) - np.arange(len(left))[:, None] * side
        inversions += int((side - upto)[right < m].sum())
        keys, side = blocks.ravel(), 2 * side
    sorted_y = np.sort(y)
    own_y = sorted_y[1:] != sorted_y[:-1]
    runs = np.diff(np.concatenate([[0], np.flatnonzero(own_y) + 1, [m]]))
    ordered = m * (m - 1) // 2 - ties(x) - int((runs * (runs - 1) // 2).sum()) + ties(x, y)
    return ordered - 2 * inversions


@operator("KENDALL", "gis", "input1 input2")
def kendall(a: Grid, b: Grid, blocks=512):
    """n, tau-b, z and p over all cells with data in both.

    Values of each grid are dealt to blocks by rank; a value that fills a block by itself has one of its own. Pairs of
    cells that differ in both blocks are counted from the table of blocks by blocks, pairs within a block of either
    grid by merging, one task each, and what both count once less. Blocks of a single value have only ties.
    """
    t = align([a, b]).where("v0 is not null and v1 is not null").select("v0", "v1")
    t = written(t)
    n, parts, tied = t.count(), [], []
    if n < 2:
        return t.sparkSession.createDataFrame([(n, 0.0, 0.0, 1.0)], "n long, tau double, z double, p double")
    for c, k in (("v0", "i"), ("v1", "j")):
        counts = written(running_count(t, F.col(c)))
        tied.append(int(counts.agg(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("decimal(38,0)")).alias("s")).head().s))
        block = 2 * F.floor(F.col("before") * blocks / n) + (F.col("n") * blocks >= n).cast("int")
        parts.append(counts.select(F.col("key").alias(c), "n", block.cast("long").alias(k)))
    u = by_key(by_key(t, parts[0], "v0").drop("n"), parts[1], "v1").drop("n")
    u = written(u)
    table = u.groupBy("i", "j").agg(F.count("*").alias("n")).toPandas()  # at most (2 * blocks) squared rows
    side = 2 * blocks + 2
    h = np.zeros((side, side), object if n > 1 << 31 else np.int64)
    h[table["i"].astype(int), table["j"].astype(int)] = table["n"].to_numpy()
    below = lambda m: np.pad(m.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))[:-1, :-1]
    s = int((h * below(h)).sum()) - int((h * below(h[:, ::-1])[:, ::-1]).sum())

    def inside(other: str | None):
        def run(rows: pa.Table) -> pa.Table:
            x, y = rows.column("v0").to_numpy(), rows.column("v1").to_numpy()
            total = _concordance(x, y)
            if other:  # pairs that share the other block as well were counted there
                parts = rows.column(other).to_numpy()
                order = np.argsort(parts, kind="stable")
                cuts = np.flatnonzero(np.diff(parts[order])) + 1
                total -= sum(_concordance(x[k], y[k]) for k in np.split(order, cuts))
            return pa.table({"s": [total]})

        return run

    strips = (("i", None), ("j", "i"))
    s += sum(u.where(f"{k} % 2 = 0").groupBy(k).applyInArrow(inside(other), "s long").agg(F.coalesce(F.sum(F.col("s").cast("decimal(38,0)")), F.lit(0)).alias("s")).head().s for k, other in strips)
    pairs = n * (n - 1) // 2
    tau = float(s) / math.sqrt(float(pairs - tied[0]) * float(pairs - tied[1])) if pairs > tied[0] and pairs > tied[1] else 0.0
    z = tau / math.sqrt(2 * (2 * n + 5) / (9 * n * (n - 1)))
    return t.sparkSession.createDataFrame([(n, tau, z, math.erfc(abs(z) / math.sqrt(2)))], "n long, tau double, z double, p double")


@operator("POLLINATION", "esm", "landcover", nesting=(), floral=(), foraging_distance=10.0)
def pollination(land: Grid, nesting, floral, foraging_distance):
    """Abundance: supply (nesting times the weighted mean of flowers in reach) shared among flowers in reach, by distance decay.

    nesting, floral: (class, value). Decay is exp(-d / (foraging distance / 2)), distances in cells.
    """

    def by_class(table):
        c = F.when(F.lit(False), F.lit(0.0))
        for k, x in table:
            c = c.when(F.col("v").cast("int") == k, float(x))
        return F.coalesce(c, F.lit(0.0))

    h, alpha = int(foraging_distance), foraging_distance / 2
    kernel = [(a, b, math.exp(-math.hypot(a, b) / alpha)) for a, b in square(2 * h + 1) if math.hypot(a, b) <= foraging_distance]

    def reach(images: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        there, x = ~np.isnan(images["x"]), np.nan_to_num(images["x"])
        side = len(x) - 2 * h
        out = {n: np.zeros((side, side)) for n in ("xw", "w")} | {"f": images["x"][h : h + side, h : h + side]}
        for a, b, k in kernel:
            part = (slice(h + a, h + a + side), slice(h + b, h + b + side))
            out["xw"] += k * x[part]
            out["w"] += k * there[part]
        return out

    t = land.valid().select(*KEY, by_class(nesting).alias("v"), by_class(floral).alias("x"))
    near = tiled(t, h, reach, ["xw", "w", "f"])
    supply = F.col("v") * F.col("xw") / F.col("w")
    given = near.select(*KEY, F.col("f").alias("v"), F.when(F.col("xw") > 0, supply / F.col("xw")).otherwise(0.0).alias("x"))
    out = tiled(given, h, reach, ["xw", "w"]).select(*KEY, (F.col("v") * F.col("xw")).alias("x"))
    return land.with_cells(land.df.join(out, KEY, "left").select(*KEY, "x").withColumnRenamed("x", "v"))


# Triangles


@operator("TIN", "gis", "points", tile_points=1024)
def tin(points: DataFrame, tile_points):
    """tri, and x, y, z of its corners: the Delaunay triangulation of points (id, x, y, value), by tiles; see triangles.triangulate."""
    return triangulate(points, tile_points)


@operator("TINSURF", "gis", "triangles reference")
def tin_surface(triangles: DataFrame, grid: Grid):
    """Planes of triangles at the cells whose corners they hold; of several, the last triangle's."""
    ox, oy, pw, ph, *_ = grid.transform
    c = [F.col(f"x{k}") for k in range(3)]
    r = [F.col(f"y{k}") for k in range(3)]
    lo_c, hi_c = (F.greatest(F.lit(0), F.floor((F.least(*c) - ox) / pw)), F.least(F.lit(grid.cols - 1), F.ceil((F.greatest(*c) - ox) / pw)))
    lo_r, hi_r = (F.greatest(F.lit(0), F.floor((F.greatest(*r) - oy) / ph)), F.least(F.lit(grid.rows - 1), F.ceil((F.least(*r) - oy) / ph)))
    det = (c[1] - c[0]) * (r[2] - r[0]) - (c[2] - c[0]) * (r[1] - r[0])
    t = triangles.where(F.abs(det) > 1e-20).withColumns({"lr": lo_r.cast("int"), "hr": hi_r.cast("int"), "lc": lo_c.cast("int"), "hc": hi_c.cast("int")}).where("lr <= hr and lc <= hc")
    t = t.withColumn("row", F.explode(F.sequence("lr", "hr"))).withColumn("col", F.explode(F.sequence("lc", "hc")))
    x, y = grid.x() - c[0], grid.y() - r[0]
    u = (x * (r[2] - r[0]) - y * (c[2] - c[0])) / det
    w = (y * (c[1] - c[0]) - x * (r[1] - r[0])) / det
    inside = t.withColumns({"u": u, "w": w}).where("u >= -1e-10 and w >= -1e-10 and u + w <= 1 + 1e-10")
    z = F.col("z0") + F.col("u") * (F.col("z1") - F.col("z0")) + F.col("w") * (F.col("z2") - F.col("z0"))
    return grid.with_cells(inside.groupBy(*KEY).agg(F.max_by(z, "tri").alias("v")))


@operator("LOCALAFFINE", "imgproc", "input points")
def local_affine(grid: Grid, gcps: DataFrame):
    """gcps (id, sx, sy, dx, dy): each target cell's source place is affine in its triangle of target points, global outside them; nearest cell."""
    # The global plane, from moments about the means.
    pairs = [("dx", "dx"), ("dx", "dy"), ("dy", "dy"), ("dx", "sx"), ("dy", "sx"), ("dx", "sy"), ("dy", "sy")]
    m = gcps.agg(*(F.avg(c).alias(c) for c in ("sx", "sy", "dx", "dy")), *(F.covar_pop(p, q).alias(f"{p}_{q}") for p, q in pairs)).head()
    if m.dx is None:
        raise ValueError("LOCALAFFINE needs control points")
    spread = np.array([[m.dx_dx, m.dx_dy], [m.dx_dy, m.dy_dy]])
    bx, by = ((m[s] - v[0] * m.dx - v[1] * m.dy, *v) for s, v in ((s, np.linalg.lstsq(spread, np.array([m[f"dx_{s}"], m[f"dy_{s}"]]), rcond=None)[0]) for s in ("sx", "sy")))
    parts = [tin_surface(triangulate(gcps.select("id", F.col("dx").alias("x"), F.col("dy").alias("y"), F.col(s).alias("value"))), grid).df.withColumnRenamed("v", s) for s in ("sx", "sy")]
    t = grid.every_cell().join(parts[0], KEY, "left").join(parts[1], KEY, "left")
    x = F.coalesce("sx", float(bx[0]) + float(bx[1]) * grid.x() + float(bx[2]) * grid.y())
    y = F.coalesce("sy", float(by[0]) + float(by[1]) * grid.x() + float(by[2]) * grid.y())
    ox, oy, pw, ph, *_ = grid.transform
    at = t.select(*KEY, F.round((y - oy) / ph).cast("int").alias("sr"), F.round((x - ox) / pw).cast("int").alias("sc"))
    source = grid.df.select(F.col("row").alias("sr"), F.col("col").alias("sc"), "v")
    return grid.with_cells(at.join(source, ["sr", "sc"], "left").select(*KEY, "v"))


# The ellipsoid of WGS 84 and the scale of its transverse Mercator zones.
RADIUS, FLATTENING, ZONE_SCALE = 6378137.0, 1 / 298.257223563, 0.9996


def _series() -> tuple[float, float, tuple, tuple, tuple]:
    """Kruger's series to the third order: the third flattening, the rectifying radius, and coefficients forward, back and for latitude."""
    n = FLATTENING / (2 - FLATTENING)
    forward = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    latitude = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    return n, RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64), forward, back, latitude


def _zone(epsg: int) -> tuple[float, float] | None:
    """Central meridian and false northing of a UTM code (326 and 327 with the zone's number)."""
    hundred, zone = divmod(epsg, 100)
    return (zone * 6 - 183.0, 0.0 if hundred == 326 else 1e7) if hundred in (326, 327) and 1 <= zone <= 60 else None


def _to_geographic(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    if epsg == 4326:
        return x, y
    if epsg == 3857:
        return F.degrees(x / RADIUS), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - math.pi / 2)
    meridian, north = _zone(epsg)
    _, size, _, back, latitude = _series()
    xi, eta = (y - north) / (ZONE_SCALE * size), (x - 500000.0) / (ZONE_SCALE * size)
    xi1 = xi - sum((b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(back, 1)), F.lit(0.0))
    eta1 = eta - sum((b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(back, 1)), F.lit(0.0))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi + sum((d * F.sin(2 * j * chi) for j, d in enumerate(latitude, 1)), F.lit(0.0))
    return meridian + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(phi)


def _from_geographic(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    if epsg == 4326:
        return x, y
    if epsg == 3857:
        return F.radians(x) * RADIUS, F.log(F.tan(math.pi / 4 + F.radians(y) / 2)) * RADIUS
    meridian, north = _zone(epsg)
    n, size, forward, _, _ = _series()
    e, s, turn = 2 * math.sqrt(n) / (1 + n), F.sin(F.radians(y)), F.radians(x - meridian)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
    east = eta + sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(forward, 1)), F.lit(0.0))
    up = xi + sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(forward, 1)), F.lit(0.0))
    return 500000.0 + ZONE_SCALE * size * east, north + ZONE_SCALE * size * up


@operator("PROJECT", "gis", "input", source_epsg=3857, target_epsg=4326, cell_size=0.0)
def project(grid: Grid, source_epsg, target_epsg, cell_size):
    """Between geographic (4326), Web Mercator (3857) and UTM (326zz, 327zz) grids, nearest cell; other codes raise, for want of a projection library.

    The target's extent is that of a lattice of 21 x 21 places of the source.
    """
    if any(e not in (3857, 4326) and not _zone(e) for e in (source_epsg, target_epsg)):
        raise ValueError("only EPSG 3857, 4326 and UTM zones are known here")
    at = lambda c, n: (c / 20) * n
    lim = grid.df.sparkSession.range(441).select((grid.transform[0] + at(F.col("id") % 21, grid.cols) * grid.transform[2]).alias("x"), (grid.transform[1] + at(F.floor(F.col("id") / 21), grid.rows) * grid.transform[3]).alias("y"))
    gx, gy = _to_geographic(F.col("x"), F.col("y"), source_epsg)
    tx, ty = _from_geographic(gx, gy, target_epsg)
    e = lim.agg(F.min(tx).alias("x0"), F.max(tx).alias("x1"), F.min(ty).alias("y0"), F.max(ty).alias("y1")).head()
    size = cell_size if cell_size > 0 else (e.x1 - e.x0) / grid.cols
    target = grid.with_cells(grid.df, rows=max(1, round((e.y1 - e.y0) / size)), cols=max(1, round((e.x1 - e.x0) / size)), transform=(e.x0, e.y1, size, -size, 0.0, 0.0), srs=f"EPSG:{target_epsg}")
    mx, my = target.x() + size / 2, target.y() - size / 2
    sx, sy = _from_geographic(*_to_geographic(mx, my, target_epsg), source_epsg)
    at = target.every_cell().select(*KEY, F.floor((sy - grid.transform[1]) / grid.transform[3]).cast("int").alias("sr"), F.floor((sx - grid.transform[0]) / grid.transform[2]).cast("int").alias("sc"))
    source = grid.df.select(F.col("row").alias("sr"), F.col("col").alias("sc"), "v")
    return target.with_cells(at.join(source, ["sr", "sc"], "left").select(*KEY, "v"))


#: The order in which a trace looks at a cell's neighbours: clockwise from the east, rows downward.
AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


@operator("TINPREP", "gis", "contours", angle_tolerance=5.0)
def thin_contours(grid: Grid, angle_tolerance):
    """chain, no, x, y, value: cells of contours (connected cells of one value) but those where the trace runs nearly straight on.

    A chain is traced breadth first from its first cell in row order; its ends stay, and so do chains of one or two
    cells. Each chain is one task's work: the raster is to hold contours, whose background has no data.
    """
    t = components(grid.valid(), AROUND, grid.cols)
    limit = math.cos(math.radians(180 - angle_tolerance))
    pw, ph = grid.transform[2], grid.transform[3]

    def run(table: pa.Table) -> pa.Table:
        row, col = table.column("row").to_pylist(), table.column("col").to_pylist()
        open_ = set(zip(row, col))
        chain = [min(open_)]
        open_.discard(chain[0])
        for r, c in chain:  # grows while it is walked
            for dr, dc in AROUND:
                if (r + dr, c + dc) in open_:
                    open_.discard((r + dr, c + dc))
                    chain.append((r + dr, c + dc))
        p = np.array(chain, float) * [ph, pw]
        stay = np.ones(len(p), bool)
        if len(p) > 2:
            a, b = p[:-2] - p[1:-1], p[2:] - p[1:-1]
            cos = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
            stay[1:-1] = np.clip(cos, -1, 1) > limit
        kept = np.flatnonzero(stay)
        rows = np.array(chain, np.int32)[kept]
        return pa.table({"chain": pa.array([table.column("label")[0].as_py()] * len(kept), pa.int64()), "no": pa.array(kept, pa.int64()), "row": rows[:, 0], "col": rows[:, 1], "value": pa.array([table.column("v")[0].as_py()] * len(kept), pa.float64())})

    points = t.groupBy("label").applyInArrow(run, "chain long, no long, row int, col int, value double")
    return points.select("chain", "no", grid.x().alias("x"), grid.y().alias("y"), "value")


@operator("RASTERVECTOR", "files", "input")
def outlines_of(grid: Grid):
    """Edges (label, value, x1, y1, x2, y2) around connected cells of one value: the raster-to-vector form."""
    t = components(grid.valid(), FOUR, grid.cols)
    own = grid.with_cells(written(t.select(*KEY, F.col("label").cast("double").alias("v"))))
    sides = {"n": (-1, 0), "s": (1, 0), "w": (0, -1), "e": (0, 1)}
    ends = {"n": ((0, 0), (0, 1)), "s": ((1, 1), (1, 0)), "w": ((1, 0), (0, 0)), "e": ((0, 1), (1, 1))}
    ox, oy, pw, ph, *_ = grid.transform

    def at(r, c):
        return F.lit(ox) + (F.col("col") + c) * pw, F.lit(oy) + (F.col("row") + r) * ph

    side = [F.when(F.coalesce(F.col(k) != F.col("v"), F.lit(True)), F.struct(*(p.alias(n) for n, p in zip(("x1", "y1", "x2", "y2"), (*at(*a), *at(*b)))))) for k, (a, b) in ends.items()]
    edges = neighbours(own, sides).select(F.col("v").cast("long").alias("label"), F.explode(F.filter(F.array(*side), lambda e: e.isNotNull())).alias("e")).select("label", "e.*")
    values = t.groupBy("label").agg(F.first("v").alias("value"))
    return edges.join(values, "label").select("label", "value", "x1", "y1", "x2", "y2")


@operator("VECTORRASTER", "files", "edges reference")
def rasterize(edges: DataFrame, grid: Grid):
    """1 at cells whose centre lies inside the polygons of the edges (even-odd rule). Edges meet only the rows that they cross."""
    ox, oy, pw, ph, *_ = grid.transform
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = F.greatest(F.lit(0), F.ceil((hi - oy) / ph - 0.5)).cast("int"), F.least(F.lit(grid.rows - 1), F.ceil((lo - oy) / ph - 0.5) - 1).cast("int")
    t = edges.where("y1 <> y2").select("x1", "y1", "x2", "y2", first.alias("a"), last.alias("b")).where("a <= b").withColumn("row", F.explode(F.sequence("a", "b")))
    yc = oy + (F.col("row") + 0.5) * ph
    cross = t.select("row", (F.col("x1") + (yc - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))).alias("x"))
    # A crossing flips all cells to its right: sums of flips run along a row, from one flip per crossing.
    flips = cross.select("row", F.greatest(F.lit(0), F.ceil((F.col("x") - ox) / pw - 0.5)).cast("int").alias("col")).groupBy(*KEY).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    run = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("row").orderBy("col"))
    return grid.with_cells(grid.every_cell().join(flips, KEY, "left").select(*KEY, (run % 2).cast("double").alias("v")))
