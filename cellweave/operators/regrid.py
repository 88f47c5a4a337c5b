"""Operators that change the grid, and operators between grids and points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.grid import KEY, Grid
from ..plans.registry import operator
from ..plans.scratch import written
from .nearness import nearest_points
from .zonal import at_ranks


@operator("FLIP", "gis", "input", direction=("horizontal", "vertical", "both"))
def flip(grid: Grid, direction):
    row = grid.rows - 1 - F.col("row") if direction != "horizontal" else F.col("row")
    col = grid.cols - 1 - F.col("col") if direction != "vertical" else F.col("col")
    return grid.with_cells(grid.df.select(row.alias("row"), col.alias("col"), "v"))


@operator("CONCAT", "gis", "inputs")
def concat(grids: list[Grid]) -> DataFrame:
    """row, col, band, v of all grids, bands from 0."""
    out = None
    for k, g in enumerate(grids):
        part = g.df.select(*KEY, F.lit(k).alias("band"), "v")
        out = part if out is None else out.unionByName(part)
    return out


@operator("SEPARATE", "gis", "cells", band=0)
def separate(cells: DataFrame, band):
    """row, col, v of a band; with band=None those of all, as band, row, col, v: written with partitionBy("band") they are a folder each."""
    return cells.select("band", *KEY, "v") if band is None else cells.where(F.col("band") == band).select(*KEY, "v")


def _layers(grid: Grid, category: Column, max_classes: int) -> DataFrame:
    """Cells times classes. Layers are as many as classes, so a continuous raster is an error, by a declared bound."""
    classes = written(grid.valid().select(category.cast("int").alias("category")).distinct().limit(max_classes + 1))
    if classes.count() > max_classes:
        raise ValueError(f"more than {max_classes} classes")
    return grid.df.crossJoin(F.broadcast(classes))


@operator("BREAKOUT", "gis", "input", max_classes=1000)
def breakout(grid: Grid, max_classes) -> DataFrame:
    """row, col, category, v: one Boolean layer per class, no data where there is none."""
    return _layers(grid, F.col("v"), max_classes).select(*KEY, "category", (F.col("v").cast("int") == F.col("category")).cast("double").alias("v"))


@operator("SPLIT", "gis", "input", max_classes=1000)
def split(grid: Grid, max_classes) -> DataFrame:
    """As BREAKOUT, by rounded values, with 0 where there is no data."""
    return _layers(grid, F.round("v"), max_classes).select(*KEY, "category", F.coalesce((F.round("v") == F.col("category")).cast("double"), F.lit(0.0)).alias("v"))


@operator("SUBSAMPLE", "imgproc", "input", factor=2)
def subsample(grid: Grid, factor):
    cells = grid.df.where((F.col("row") % factor == 0) & (F.col("col") % factor == 0)).select(*((F.col(c) / factor).cast("int").alias(c) for c in KEY), "v")
    ox, oy, pw, ph, rx, ry = grid.transform
    return grid.with_cells(cells, rows=math.ceil(grid.rows / factor), cols=math.ceil(grid.cols / factor), transform=(ox, oy, pw * factor, ph * factor, rx, ry))


@operator("PYRAMID", "imgproc", "input", num_levels=4)
def pyramid(grid: Grid, num_levels) -> list[Grid]:
    """Levels of repeated 2 x 2 means over cells with data."""
    out = []
    for _ in range(num_levels):
        half = [(F.col(c) / 2).cast("int").alias(c) for c in KEY]
        ox, oy, pw, ph, rx, ry = grid.transform
        grid = grid.with_cells(grid.df.groupBy(*half).agg(F.avg("v").alias("v")), rows=-(-grid.rows // 2), cols=-(-grid.cols // 2), transform=(ox, oy, pw * 2, ph * 2, rx, ry))
        out.append(grid)
    return out


@operator("ZEROPAD", "imgproc", "input")
def zero_pad(grid: Grid):
    """Centred in the next powers of two, with zeros around."""
    rows, cols = (1 << max(0, n - 1).bit_length() for n in (grid.rows, grid.cols))
    up, left = (rows - grid.rows) // 2, (cols - grid.cols) // 2
    moved = grid.df.select((F.col("row") + up).alias("row"), (F.col("col") + left).alias("col"), "v", F.lit(True).alias("own"))
    big = grid.with_cells(grid.df, rows=rows, cols=cols)
    cells = big.every_cell().join(moved, KEY, "left").select(*KEY, F.when(F.col("own"), F.col("v")).otherwise(0.0).alias("v"))
    return big.with_cells(cells)


@operator("RELOCATE", "gis", "input", shift_x=0.0, shift_y=0.0)
def relocate(grid: Grid, shift_x, shift_y):
    ox, oy, *rest = grid.transform
    return grid.with_cells(grid.df, transform=(ox + shift_x, oy + shift_y, *rest))


@operator("METAUPDATE", "gis", "input", nodata=-9999.0, projection="", cell_size=0.0)
def metadata_update(grid: Grid, nodata, projection, cell_size):
    ox, oy, pw, ph, rx, ry = grid.transform
    transform = (ox, oy, cell_size, -cell_size, rx, ry) if cell_size > 0 else grid.transform
    return grid.with_cells(grid.df, nodata=nodata, srs=projection or grid.srs, transform=transform)


def _sampled(grid: Grid, target: Grid, r, c, method: str) -> Grid:
    """target cells with values at the (fractional) source places r, c: nearest, or bilinear with all four cells needed."""
    t = target.every_cell().withColumns({"fr": r, "fc": c})
    source = grid.df.select(F.col("row").alias("sr"), F.col("col").alias("sc"), F.col("v").alias("sv"))
    if method.lower() == "nearest":
        place = t.withColumns({"sr": F.floor(F.col("fr")).cast("int"), "sc": F.floor(F.col("fc")).cast("int")})
        return target.with_cells(place.join(source, ["sr", "sc"], "left").select(*KEY, F.col("sv").alias("v")))
    corners = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1))))
    base = t.withColumns({"r0": F.floor("fr").cast("int"), "c0": F.floor("fc").cast("int")}).withColumn("k", corners)
    place = base.withColumns({"sr": F.col("r0") + F.col("k.a"), "sc": F.col("c0") + F.col("k.b")})
    wr = F.when(F.col("k.a") == 1, F.col("fr") - F.col("r0")).otherwise(1 - (F.col("fr") - F.col("r0")))
    wc = F.when(F.col("k.b") == 1, F.col("fc") - F.col("c0")).otherwise(1 - (F.col("fc") - F.col("c0")))
    w = wr * wc
    sums = place.join(source, ["sr", "sc"], "left").groupBy(*KEY).agg(F.sum(w * F.col("sv")).alias("s"), F.max(((w > 0) & F.col("sv").isNull()).cast("int")).alias("lost"))
    return target.with_cells(sums.select(*KEY, F.when(F.col("lost") == 0, F.col("s")).alias("v")))


#: By method: places of the source cells that a target's value is made of, counted from the one at or before it.
TAPS = {"nearest": (0, 0), "bilinear": (0, 1), "cubic": (-1, 2)}


def _along(cells: DataFrame, axis: str, ratio: float, size: int, method: str) -> DataFrame:
    """Cells resampled along one axis: each goes to the targets that it is a part of, and one aggregation sums them. A target lacks data if a part does."""
    first, last = TAPS[method]
    at = F.col("__t")
    place = (at + 0.5) * ratio - 0.5 + (0.5 if method == "nearest" else 0.0)
    base = F.floor(place)
    f, j = place - base, F.col(axis) - base
    if method == "nearest":
        weight = F.lit(1.0)
    elif method == "bilinear":
        weight = F.when(j == 1, f).otherwise(1 - f)
    else:  # Catmull-Rom
        ends, inner = [((-0.5 * f + 1) * f - 0.5) * f, (0.5 * f - 0.5) * f * f], [(1.5 * f - 2.5) * f * f + 1, ((-1.5 * f + 2) * f + 0.5) * f]
        weight = F.when(j == -1, ends[0]).when(j == 0, inner[0]).when(j == 1, inner[1]).otherwise(ends[1])
    low, high = F.ceil((F.col(axis) - last - 0.5) / ratio - 0.5) - 1, F.floor((F.col(axis) - first + 1.5) / ratio - 0.5) + 1
    low, high = F.greatest(F.lit(0), low).cast("int"), F.least(F.lit(size - 1), high).cast("int")
    t = cells.where(low <= high).withColumn("__t", F.explode(F.sequence(low, high))).where((j >= first) & (j <= last))
    other = KEY[1 - KEY.index(axis)]
    sums = t.groupBy(other, "__t").agg(F.sum(weight * F.col("v")).alias("v"), F.count("*").alias("n"))
    return sums.where(F.col("n") == last - first + 1).select(other, F.col("__t").alias(axis), "v")


@operator("RESAMPLE", "gis", "input", cell_size=30.0, method=("nearest", "bilinear", "cubic"))
def resample(grid: Grid, cell_size, method):
    """A new cell size over the same extent, by cell centres: target k lies at (k + 0.5) * ratio - 0.5 of the source.

    Nearest rounds that place, bilinear takes 2 x 2 cells, cubic (Catmull-Rom) 4 x 4, all of which must be there and have data: cells
    too near to the edge have none. Only cells with data are returned. The two axes are resampled one after the other,
    an aggregation each.
    """
    dx, dy = grid.cell
    ox, oy, pw, ph, rx, ry = grid.transform
    rows, cols = max(1, int(grid.rows * dy / cell_size + 0.5)), max(1, int(grid.cols * dx / cell_size + 0.5))
    t = _along(_along(grid.valid().select(*KEY, "v"), "col", cell_size / dx, cols, method), "row", cell_size / dy, rows, method)
    return grid.with_cells(t.select(*KEY, "v"), rows=rows, cols=cols, transform=(ox, oy, math.copysign(cell_size, pw), math.copysign(cell_size, ph), rx, ry))


@operator("TRANSFORM", "gis", "input", rotation_degrees=0.0, scale_x=1.0, scale_y=1.0, translate_x=0.0, translate_y=0.0, method=("Nearest", "Bilinear"))
def transform(grid: Grid, rotation_degrees, scale_x, scale_y, translate_x, translate_y, method):
    """Rotation about the centre, then scale and translation in cells; each target cell looks its source up."""
    a = math.radians(rotation_degrees)
    x, y = F.col("col") - grid.cols / 2 - translate_x, F.col("row") - grid.rows / 2 - translate_y
    sx = (x * math.cos(a) + y * math.sin(a)) / scale_x + grid.cols / 2
    sy = (y * math.cos(a) - x * math.sin(a)) / scale_y + grid.rows / 2
    return _sampled(grid, grid, sy + (0.5 if method == "Nearest" else 0), sx + (0.5 if method == "Nearest" else 0), method)


@operator("LANDSAT_UPSAMPLE", "imgproc", "low reference")
def upsample(low: Grid, reference: Grid):
    """Bilinear, by cell centres, clamped at the edge."""
    r = F.least(F.lit(low.rows - 1.0), F.greatest(F.lit(0.0), (F.col("row") + 0.5) * (low.rows / reference.rows) - 0.5))
    c = F.least(F.lit(low.cols - 1.0), F.greatest(F.lit(0.0), (F.col("col") + 0.5) * (low.cols / reference.cols) - 0.5))
    return _sampled(low, reference, r, c, "Bilinear")


@operator("DISAGGREGATE", "gis", "input template", method=("Proportional", "Equal Distribution"))
def disaggregate(coarse: Grid, fine: Grid, method):
    """Each coarse value is shared among its fine cells, by weight or evenly; the sum stays."""
    ky, kx = fine.rows // coarse.rows, fine.cols // coarse.cols
    t = fine.valid().withColumns({"cr": (F.col("row") / ky).cast("int"), "cc": (F.col("col") / kx).cast("int")})
    size = t.groupBy("cr", "cc").agg(F.sum("v").alias("w"), F.count("*").alias("n"))
    source = coarse.df.select(F.col("row").alias("cr"), F.col("col").alias("cc"), F.col("v").alias("cv")).join(size, ["cr", "cc"])
    even = F.col("cv") / F.col("n")
    share = even if method != "Proportional" else F.when(F.col("w") > 0, F.col("cv") * F.col("v") / F.col("w")).otherwise(even)
    got = t.join(source, ["cr", "cc"]).select(*KEY, share.alias("x"))
    return fine.with_cells(fine.df.select(*KEY).join(got, KEY, "left").select(*KEY, F.col("x").alias("v")))


@operator("MOSAIC", "imgproc", "inputs", method=("first", "last", "average", "max"))
def mosaic(grids: list[Grid], method):
    """Grids of one cell size over their common extent."""
    dx, dy = grids[0].cell
    left, top = min(g.transform[0] for g in grids), max(g.transform[1] for g in grids)
    cells, rows, cols = None, 0, 0
    for k, g in enumerate(grids):
        r0, c0 = round((top - g.transform[1]) / dy), round((g.transform[0] - left) / dx)
        rows, cols = max(rows, r0 + g.rows), max(cols, c0 + g.cols)
        part = g.valid().select((F.col("row") + r0).alias("row"), (F.col("col") + c0).alias("col"), "v", F.lit(k).alias("k"))
        cells = part if cells is None else cells.unionByName(part)
    agg = {"first": F.min_by("v", "k"), "last": F.max_by("v", "k"), "average": F.avg("v"), "max": F.max("v")}[method]
    return grids[0].with_cells(cells.groupBy(*KEY).agg(agg.alias("v")), rows=rows, cols=cols, transform=(left, top, *grids[0].transform[2:]))


@operator("ORTHO", "imgproc", "input dem", sensor_height=700000.0, focal_length=0.15)
def ortho(grid: Grid, dem: Grid, sensor_height, focal_length):
    """Relief displacement away from the centre, nearest cell."""
    shift = F.coalesce(F.col("v"), F.lit(0.0)) / sensor_height
    src = dem.df.select(*KEY, *((F.round(F.col(c) + (F.col(c) - n / 2) * shift)).cast("int").alias(s) for c, n, s in (("row", grid.rows, "sr"), ("col", grid.cols, "sc"))))
    source = grid.df.select(F.col("row").alias("sr"), F.col("col").alias("sc"), "v")
    return grid.with_cells(src.join(source, ["sr", "sc"], "left").select(*KEY, "v"))


@operator("PANSHARPEN", "imgproc", "red green blue pan")
def pansharpen(red: Grid, green: Grid, blue: Grid, pan: Grid):
    """Bands at the resolution of the panchromatic grid, each with (pan - intensity) added."""
    fr, fc = red.rows / pan.rows, red.cols / pan.cols
    t = pan.df.select(*KEY, F.col("v").alias("p"), F.floor(F.col("row") * fr).cast("int").alias("sr"), F.floor(F.col("col") * fc).cast("int").alias("sc"))
    for n, g in (("r", red), ("g", green), ("b", blue)):
        t = t.join(g.df.select(F.col("row").alias("sr"), F.col("col").alias("sc"), F.col("v").alias(n)), ["sr", "sc"])
    add = F.col("p") - (F.col("r") + F.col("g") + F.col("b")) / 3
    return pan.with_cells(t.select(*KEY, (F.col("r") + add).alias("v"), (F.col("g") + add).alias("green"), (F.col("b") + add).alias("blue")))


# Points: tables (id, x, y, value)


@operator("POINTTORASTER", "gis", "points reference", method=("Mean", "Sum", "Max", "Min", "Count"))
def points_to_grid(points: DataFrame, grid: Grid, method):
    c, r = grid.col_row(F.col("x"), F.col("y"))
    agg = {"Mean": F.avg("value"), "Sum": F.sum("value"), "Max": F.max("value"), "Min": F.min("value"), "Count": F.count("*").cast("double")}[method]
    return grid.with_cells(points.select(r.alias("row"), c.alias("col"), "value").where(F.col("row").between(0, grid.rows - 1) & F.col("col").between(0, grid.cols - 1)).groupBy(*KEY).agg(agg.alias("v")))


@operator("RASTERTOPOINT", "gis", "input")
def grid_to_points(grid: Grid):
    return grid.valid().select(grid.x().alias("x"), grid.y().alias("y"), F.col("v").alias("value"))


@operator("QUERY", "gis", "input points")
def query_points(grid: Grid, points: DataFrame):
    """id, x, y, value and status (ok, NoData or OutOfBounds) of the grid at points."""
    c, r = grid.col_row(F.col("x"), F.col("y"))
    t = points.select("id", "x", "y", r.alias("row"), c.alias("col")).join(grid.df, KEY, "left")
    inside = F.col("row").between(0, grid.rows - 1) & F.col("col").between(0, grid.cols - 1)
    return t.select("id", "x", "y", F.col("v").alias("value"), F.when(~inside, "OutOfBounds").when(F.col("v").isNull(), "NoData").otherwise("ok").alias("status"))


@operator("PROFILE", "gis", "input", start_x=0.0, start_y=0.0, end_x=0.0, end_y=0.0)
def profile(grid: Grid, start_x, start_y, end_x, end_y):
    """id, distance, value and status along a line, one sample per cell size."""
    length, step = math.hypot(end_x - start_x, end_y - start_y), grid.cell[0]
    n = int(length / step) + 1
    part = F.col("id") * step / (length or 1.0)
    points = grid.df.sparkSession.range(n).select("id", (start_x + part * (end_x - start_x)).alias("x"), (start_y + part * (end_y - start_y)).alias("y"))
    return query_points(grid, points).select("id", (F.col("id") * step).alias("distance"), "value", "status")


@operator("THIESSEN", "gis", "points reference")
def thiessen(points: DataFrame, grid: Grid):
    """The nearest point's id; ties go to the least id."""
    return grid.with_cells(nearest_points(grid, points, 1).select(*KEY, F.col("id").cast("double").alias("v")))


@operator("INTERPOL", "gis", "points reference", power=2.0, search_radius=0.0, num_neighbors=12)
def inverse_distance(points: DataFrame, grid: Grid, power, search_radius, num_neighbors):
    """Inverse distance weights of the nearest points; at a point, its value."""
    n = nearest_points(grid, points, num_neighbors, search_radius)
    w = 1 / F.pow("d", F.lit(power))
    s = n.groupBy(*KEY).agg(F.max(F.when(F.col("d") < 1e-10, F.col("value"))).alias("hit"), (F.sum(F.when(F.col("d") >= 1e-10, w * F.col("value"))) / F.sum(F.when(F.col("d") >= 1e-10, w))).alias("m"))
    return grid.with_cells(grid.df.select(*KEY).join(s, KEY, "left").select(*KEY, F.coalesce("hit", "m").alias("v")))


@operator("TREND", "gis", "points reference", order=2)
def trend_surface(points: DataFrame, grid: Grid, order):
    """A polynomial surface of order 1..6 by least squares: all moments come from one aggregation, the small system is solved on the driver."""
    import numpy as np

    terms = [(i, j) for n in range(order + 1) for j in range(n + 1) for i in (n - j,)]
    lim = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).head()

    def scaled(x, lo, hi):
        return (x - lo) / ((hi - lo) or 1.0)

    def base(x, y):
        u, v = scaled(x, lim.x0, lim.x1), scaled(y, lim.y0, lim.y1)
        return [F.pow(u, F.lit(i)) * F.pow(v, F.lit(j)) for i, j in terms]

    b = base(F.col("x"), F.col("y"))
    m = points.agg(*(F.sum(p * q).alias(f"a{i}_{j}") for i, p in enumerate(b) for j, q in enumerate(b) if j >= i), *(F.sum(p * F.col("value")).alias(f"b{i}") for i, p in enumerate(b))).head()
    n = len(b)
    a = np.array([[m[f"a{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
    beta = np.linalg.lstsq(a, np.array([m[f"b{i}"] for i in range(n)]), rcond=None)[0]
    value = sum((p * float(c) for p, c in zip(base(grid.x(), grid.y()), beta)), F.lit(0.0))
    return grid.with_cells(grid.df.select(*KEY, value.alias("v")))


@operator("SPECIES_DISTRIBUTION", "hbm", "presence envelopes", percentile=5.0)
def species_distribution(presence: DataFrame, envelopes: list[Grid], percentile):
    """Share of the environment grids whose value lies between percentiles of those at presence points."""
    parts = []
    for k, g in enumerate(envelopes):
        at = query_points(g, presence).where("status = 'ok'")
        ends = {}
        for name, share in (("lo", percentile / 100), ("hi", 1 - percentile / 100)):  # between the two values around it
            place = (F.col("all") - 1) * share
            ends |= {f"{name}0": F.floor(place), f"{name}1": F.ceil(place)}
        q = at_ranks(at.where("value is not null"), F.col("value"), **ends).crossJoin(at.where("value is not null").agg(F.count("*").alias("all")))
        part = lambda share: (F.col("all") - 1) * share - F.floor((F.col("all") - 1) * share)
        q = q.select((F.col("lo0") + (F.col("lo1") - F.col("lo0")) * part(percentile / 100)).alias("lo"), (F.col("hi0") + (F.col("hi1") - F.col("hi0")) * part(1 - percentile / 100)).alias("hi"))
        parts.append(g.df.crossJoin(F.broadcast(q)).select(*KEY, F.col("v").between(F.col("lo"), F.col("hi")).cast("double").alias(f"s{k}")))
    t = parts[0]
    for p in parts[1:]:
        t = t.join(p, KEY)
    return envelopes[0].with_cells(t.select(*KEY, (sum((F.col(f"s{k}") for k in range(len(parts))), F.lit(0.0)) / len(parts)).alias("v")))
