"""Neighbourhood operators.

Those of 3 x 3 cells send each cell to the cells that need it, and one aggregation, partial before the shuffle, gathers
a neighbourhood. Windows of any size work on tiles: a cell goes to its tile and to those whose halo holds it, so what is
shuffled hardly grows with the window, and a tile's windows are arrays.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.grid import KEY, Grid
from ..plans.registry import operator
from ..plans.scratch import written
from .nearness import squared_distances

Z = {f"z{k + 1}": (k // 3 - 1, k % 3 - 1) for k in range(9)}


def neighbours(grid: Grid, places: dict[str, tuple[int, int]]) -> DataFrame:
    """row, col, v of every cell and, by name, the values at (row + dr, col + dc): null off the grid and without data."""
    sent = [(n, dr, dc) for n, (dr, dc) in places.items()]
    to = F.explode(F.array(*(F.struct(F.lit(n).alias("at"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for n, dr, dc in [("v", 0, 0), *sent])))
    moved = grid.df.select(*KEY, "v", to.alias("t")).select((F.col("row") - F.col("t.dr")).alias("row"), (F.col("col") - F.col("t.dc")).alias("col"), F.col("t.at").alias("at"), "v")
    agg = [F.max(F.when(F.col("at") == n, F.col("v"))).alias(n) for n in ["v", *places]]
    return moved.groupBy(*KEY).agg(*agg, F.max((F.col("at") == "v").cast("int")).alias("__own")).where("__own = 1").drop("__own")


def moving(grid: Grid, offsets: list[tuple[int, int]]) -> DataFrame:
    """row, col, x: the values at all offsets of each cell, one per row; nulls left out."""
    to = F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets)))
    return grid.valid().select(*KEY, F.col("v").alias("x"), to.alias("t")).select((F.col("row") - F.col("t.dr")).alias("row"), (F.col("col") - F.col("t.dc")).alias("col"), "x")


def tiled(cells: DataFrame, halo: int, fn: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], names: list[str], tile: int = 256) -> DataFrame:
    """row, col, v and `names` of all cells (row, col, v and other numbers), by fn over images of a tile with `halo` cells around.

    fn gets an image per column, NaN where there is no data, and gives an array per name for the images without
    their halo. NaN becomes null. Memory is that of a few images of (tile + 2 halo) squared.
    """
    tile, columns = max(tile, halo), [c for c in cells.columns if c not in KEY]
    near = F.explode(F.array_distinct(F.array(*(F.struct(F.floor((F.col("row") + a * halo) / tile).cast("int").alias("tr"), F.floor((F.col("col") + b * halo) / tile).cast("int").alias("tc")) for a in (-1, 0, 1) for b in (-1, 0, 1)))))

    def run(table: pa.Table) -> pa.Table:
        tr, tc = table.column("tr")[0].as_py(), table.column("tc")[0].as_py()
        row, col = table.column("row").to_numpy(), table.column("col").to_numpy()
        own = (row // tile == tr) & (col // tile == tc)
        if not own.any():
            return pa.table({"row": pa.array([], pa.int32()), "col": pa.array([], pa.int32()), **{n: pa.array([], pa.float64()) for n in ["v", *names]}})
        at, images = (row - tr * tile + halo, col - tc * tile + halo), {}
        for c in columns:
            images[c] = np.full((tile + 2 * halo, tile + 2 * halo), np.nan)
            images[c][at] = table.column(c).to_numpy(zero_copy_only=False)
        out, here = fn(images), (row[own] - tr * tile, col[own] - tc * tile)
        values = {"v": images["v"][at][own], **{n: out[n][here] for n in names}}
        return pa.table({"row": pa.array(row[own], pa.int32()), "col": pa.array(col[own], pa.int32()), **{n: pa.array(x, pa.float64(), mask=np.isnan(x)) for n, x in values.items()}})

    dealt = cells.select(*KEY, *(F.col(c).cast("double").alias(c) for c in columns), near.alias("t")).select(*KEY, *columns, "t.*")
    return dealt.groupBy("tr", "tc").applyInArrow(run, "row int, col int, " + ", ".join(f"{n} double" for n in ["v", *names]))


def focal(cells: DataFrame, size: int, measure: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]], names: list[str]) -> DataFrame:
    """row, col, v and `names` of all cells, measured over windows of size x size values of column x (v where there is none).

    measure gets, for cells with v, their windows (one row each, in order of value, those without data last as NaN),
    how many values each has, and the cells' own v. Other cells get null.
    """
    h, width = size // 2, 2 * (size // 2) + 1

    def run(images: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        image = images.get("x", images["v"])
        centre = images["v"][h : len(image) - h, h : len(image) - h]
        out = {n: np.full(centre.shape, np.nan) for n in names}
        view = np.lib.stride_tricks.sliding_window_view(image, (width, width))
        rows, cols = np.nonzero(~np.isnan(centre))
        step = max(1, (4 << 20) // width**2)
        for k in range(0, len(rows), step):
            r, c = rows[k : k + step], cols[k : k + step]
            w = np.sort(view[r, c].reshape(len(r), -1), axis=1)
            for n, x in measure(w, (~np.isnan(w)).sum(axis=1), centre[r, c]).items():
                out[n][r, c] = x
        return out

    return tiled(cells, h, run, names)


def class_runs(w: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For windows in order of value: at the last of equal values, how many there are; else 0."""
    m, k = w.shape
    if k == 0:
        return np.zeros(w.shape, np.int64)
    place = np.arange(k)
    fresh = np.ones((m, k), bool)
    fresh[:, 1:] = w[:, 1:] != w[:, :-1]
    first = np.maximum.accumulate(np.where(fresh, place, 0), axis=1)
    last = np.ones((m, k), bool)
    last[:, :-1] = fresh[:, 1:]
    return np.where(last & (place < n[:, None]), place - first + 1, 0)


def _statistic(name: str) -> Callable:
    """A measure s of windows, by name."""

    def of(w, n, centre):
        last = lambda: np.take_along_axis(w, n[:, None] - 1, axis=1)[:, 0]
        total = lambda x: np.nansum(x, axis=1)

        def spread(free: int):
            d = w - (total(w) / n)[:, None]
            return total(d * d) / np.maximum(n - free, 1)

        if name == "median":
            s = (np.take_along_axis(w, (n[:, None] - 1) // 2, axis=1) + np.take_along_axis(w, n[:, None] // 2, axis=1))[:, 0] / 2
        elif name == "mode":
            s = np.take_along_axis(w, class_runs(w, n).argmax(axis=1)[:, None], axis=1)[:, 0]
        elif name == "cv":
            mean = total(w) / n
            s = np.where(np.abs(mean) > 1e-10, np.sqrt(spread(0)) / np.where(np.abs(mean) > 1e-10, mean, 1.0), 0.0)
        elif name == "asm":
            runs = class_runs(w, n).astype(float)
            s = (runs * runs).sum(axis=1) / (1.0 * n * n)
        else:
            s = {
                "mean": lambda: total(w) / n, "sum": lambda: total(w), "min": lambda: w[:, 0], "max": last, "range": lambda: last() - w[:, 0], "variety": lambda: (class_runs(w, n) > 0).sum(axis=1).astype(float),
                "var": lambda: spread(0), "std": lambda: np.sqrt(spread(0)), "laplacian": lambda: total(w) - n * centre, "contrast": lambda: np.where(n > 1, 2 * spread(1), 0.0),
            }[name]()
        return {"s": s}

    return of


def _windowed(grid: Grid, size: int, measure: Callable | str, value: Column | None = None, names: tuple[str, ...] = ("s",)) -> Grid:
    """A measure of each cell's window where the grid has data."""
    t = focal(grid.df.select(*KEY, "v"), size, _statistic(measure) if isinstance(measure, str) else measure, list(names))
    return grid.with_cells(t.select(*KEY, F.when(F.col("v").isNotNull(), F.col("s") if value is None else value).alias("v")))


def square(size: int) -> list[tuple[int, int]]:
    h = size // 2
    return [(a, b) for a in range(-h, h + 1) for b in range(-h, h + 1)]


def _interior(grid: Grid) -> Column:
    return F.col("row").between(1, grid.rows - 2) & F.col("col").between(1, grid.cols - 2)


def _gradient(dx: float, dy: float, z=F.col) -> tuple[Column, Column]:
    """Horn's weighted differences to the east and south."""
    east = (z("z3") + 2 * z("z6") + z("z9") - z("z1") - 2 * z("z4") - z("z7")) / (8 * dx)
    south = (z("z7") + 2 * z("z8") + z("z9") - z("z1") - 2 * z("z2") - z("z3")) / (8 * dy)
    return east, south


def clamped(grid: Grid) -> DataFrame:
    """3 x 3 values where the grid's edge is repeated outward, and cells without data take the centre's value."""
    n = neighbours(grid, Z)
    top, bottom, left, right = F.col("row") == 0, F.col("row") == grid.rows - 1, F.col("col") == 0, F.col("col") == grid.cols - 1

    def at(dr, dc):
        return F.col(f"z{(dr + 1) * 3 + dc + 2}")

    out = {}
    for name, (dr, dc) in Z.items():
        value = at(dr, dc)
        edge_row, edge_col = top if dr < 0 else bottom, left if dc < 0 else right
        if dr and dc:
            value = F.when(edge_row & edge_col, at(0, 0)).when(edge_row, at(0, dc)).when(edge_col, at(dr, 0)).otherwise(value)
        elif dr:
            value = F.when(edge_row, at(0, 0)).otherwise(value)
        elif dc:
            value = F.when(edge_col, at(0, 0)).otherwise(value)
        out[name] = F.coalesce(value, F.col("v"))
    return n.select(*KEY, "v", *(c.alias(k) for k, c in out.items()))


def curved(grid: Grid) -> DataFrame:
    """row, col, v, bend (the negative second derivatives' sum), p (squared slope), along and across: profile and plan curvature.

    Zevenbergen and Thorne's polynomial over clamped neighbourhoods; both curvatures are 0 on flat ground. Each step is
    a projection of its own, so that nothing is computed twice.
    """
    size, z = grid.cell[0], {k: F.col(k) for k in Z}
    t = clamped(grid).select(
        *KEY, "v", ((z["z4"] + z["z6"]) / 2 - F.col("v")).alias("d"), ((z["z2"] + z["z8"]) / 2 - F.col("v")).alias("e"), ((z["z3"] + z["z7"] - z["z1"] - z["z9"]) / 4).alias("f"),
        ((z["z6"] - z["z4"]) / (2 * size)).alias("g"), ((z["z2"] - z["z8"]) / (2 * size)).alias("h"),
    )
    d, e, f, g, h = (F.col(c) for c in "defgh")
    t = t.select(*KEY, "v", (-2 * (d + e) / size**2).alias("bend"), (g * g + h * h).alias("p"), (d * g * g + e * h * h + f * g * h).alias("s"), (d * h * h + e * g * g - f * g * h).alias("c"))
    flat, k = F.col("p") < 1e-15, -2 / size**2
    along = F.when(flat, 0.0).otherwise(k * F.col("s") / (F.col("p") * F.sqrt(1 + F.col("p"))))
    return t.select(*KEY, "v", "bend", "p", along.alias("along"), F.when(flat, 0.0).otherwise(k * F.col("c") / F.pow("p", F.lit(1.5))).alias("across"))


def sloped(df: DataFrame, dx: float, dy: float, factor: float = 1.0) -> DataFrame:
    """df with east and south, Horn's gradient, as columns."""
    east, south = _gradient(dx, dy, lambda k: F.col(k) * factor)
    return df.withColumns({"east": east, "south": south})


@operator("ASPECT", "gis", "input")
def aspect(grid: Grid):
    """Azimuth of the steepest descent; -1 where flat or without data."""
    flat = (F.abs("east") < 1e-10) & (F.abs("south") < 1e-10)
    turn = F.pmod(90 - F.degrees(F.atan2(F.col("south"), -F.col("east"))), F.lit(360.0))
    return grid.with_cells(sloped(clamped(grid), *grid.cell).select(*KEY, F.when(F.col("v").isNull() | flat, -1.0).otherwise(turn).alias("v")))


@operator("CURVATURE", "gis", "input", type=("Total", "Profile", "Plan"))
def curvature(grid: Grid, type):
    return grid.with_cells(curved(grid).select(*KEY, F.when(F.col("v").isNotNull(), F.col({"Total": "bend", "Profile": "along", "Plan": "across"}[type])).alias("v")))


@operator("TOPOSHAPE", "gis", "input", tolerance=0.0001)
def toposhape(grid: Grid, tolerance):
    """Landforms 1 peak, 2 ridge, 3 saddle, 4 flat, 5 ravine, 6 valley, 7 pit, 8 convex, 9 concave, 10 inflection; 0 without data."""
    t = curved(grid).select(*KEY, "v", "p", *(F.when(F.abs(c) < tolerance, 0).otherwise(F.signum(c)).cast("int").alias(n) for c, n in (("along", "a"), ("across", "b"))))
    a, b = F.col("a"), F.col("b")
    level = F.when((a > 0) & (b > 0), 1).when((a < 0) & (b < 0), 7).when(a * b < 0, 3).otherwise(4)
    slope = F.when((a > 0) & (b > 0), 2).when((a < 0) & (b < 0), 6).when(a * b < 0, 5).when((a > 0) & (b == 0), 8).when((a < 0) & (b == 0), 9).otherwise(10)
    form = F.when(F.col("v").isNull(), 0).when(F.sqrt("p") < tolerance * 10, level).otherwise(slope)
    return grid.with_cells(t.select(*KEY, form.cast("double").alias("v")))


@operator("SURFACE", "gis", "input", mode=("Slope (degrees)", "Slope (percent)", "Aspect (degrees)", "Hillshade", "Profile Curvature", "Plan Curvature"), azimuth=315.0, altitude=45.0, z_factor=1.0)
def surface(grid: Grid, mode, azimuth, altitude, z_factor):
    """Border cells, and those next to cells without data, are 0.

    Shading uses the sun's height as the angle from the zenith is used elsewhere: so do the published tables of this mode.
    Profile curvature takes the eastern neighbour, as its formula says.
    """
    dx, dy = grid.cell
    t = sloped(neighbours(grid, Z), dx, dy, z_factor)
    z, east, south = {k: F.col(k) * z_factor for k in Z}, F.col("east"), F.col("south")
    mid = F.col("v") * z_factor
    t = t.select(*KEY, "east", "south", (east * east + south * south).alias("p"), ((z["z6"] - 2 * mid + z["z4"]) / dx**2).alias("xx"), ((z["z2"] - 2 * mid + z["z8"]) / dy**2).alias("yy"), ((z["z3"] - z["z1"] - z["z9"] + z["z7"]) / (4 * dx * dy)).alias("xy"))
    p, xx, yy, xy = (F.col(c) for c in ("p", "xx", "yy", "xy"))
    tilt, way, sun, up = F.atan(F.sqrt(p)), F.atan2(south, -east), math.radians(azimuth), math.radians(altitude)
    value = {
        "Slope (degrees)": F.degrees(tilt), "Slope (percent)": F.sqrt(p) * 100, "Aspect (degrees)": F.when(F.degrees(way) < 0, F.degrees(way) + 360).otherwise(F.degrees(way)),
        "Hillshade": F.greatest(F.lit(0.0), F.least(F.lit(255.0), 255 * (math.cos(up) * F.cos(tilt) + math.sin(up) * F.sin(tilt) * F.cos(sun - way)))),
        "Profile Curvature": F.when(p < 1e-10, 0.0).otherwise(-(east * east * xx + 2 * east * south * xy + south * south * yy) / (p * F.pow(1 + p, 1.5))),
        "Plan Curvature": F.when(p < 1e-10, 0.0).otherwise((south * south * xx - 2 * east * south * xy + east * east * yy) / (p * F.sqrt(1 + p))),
    }[mode]
    return grid.with_cells(t.select(*KEY, F.when(_interior(grid) & p.isNotNull(), F.coalesce(value, F.lit(0.0))).otherwise(0.0).alias("v")))


@operator("HILLSHADE", "gis", "dem", sun_azimuth=315.0, sun_elevation=45.0, z_factor=1.0)
def hillshade(grid: Grid, sun_azimuth, sun_elevation, z_factor):
    """0..255; no data on the border and next to cells without data."""
    east, south = _gradient(*grid.cell, lambda k: F.col(k) * z_factor)
    tilt, way, zenith = F.atan(F.sqrt(east * east + south * south)), F.atan2(south, -east), math.radians(90 - sun_elevation)
    light = math.cos(zenith) * F.cos(tilt) + math.sin(zenith) * F.sin(tilt) * F.cos(math.radians(sun_azimuth) - way)
    whole = _interior(grid) & light.isNotNull() & F.col("v").isNotNull()
    return grid.with_cells(neighbours(grid, Z).select(*KEY, F.when(whole, F.greatest(F.lit(0.0), F.least(F.lit(255.0), light * 255))).alias("v")))


@operator("FACET", "gis", "dem", slope_threshold=5.0)
def facet(grid: Grid, slope_threshold):
    """1 flat, 2..9 for eight directions from 0 degrees on; 0 on the border and without data."""
    east, south = _gradient(*grid.cell)
    turn = F.degrees(F.atan2(south, -east))
    turn = F.when(turn < 0, turn + 360).otherwise(turn)
    sector = 2 + F.floor((turn + 22.5) / 45) % 8
    value = F.when(F.degrees(F.atan(F.sqrt(east * east + south * south))) < slope_threshold, 1).otherwise(sector)
    return grid.with_cells(neighbours(grid, Z).select(*KEY, F.when(_interior(grid) & F.col("v").isNotNull() & east.isNotNull() & south.isNotNull(), value).otherwise(0).cast("double").alias("v")))


@operator("ILLUMINATE", "imgproc", "input dem", sun_elevation=45.0, sun_azimuth=180.0, k_coefficient=0.5)
def illuminate(grid: Grid, dem: Grid, sun_elevation, sun_azimuth, k_coefficient):
    east, south = _gradient(*dem.cell)
    tilt, way, zenith = F.atan(F.sqrt(east * east + south * south)), F.atan2(south, -east), math.radians(90 - sun_elevation)
    light = F.when(_interior(dem), math.cos(zenith) * F.cos(tilt) + math.sin(zenith) * F.sin(tilt) * F.cos(math.radians(sun_azimuth) - way)).otherwise(math.cos(zenith))
    lit = neighbours(dem, Z).select(*KEY, light.alias("light"))
    return grid.with_cells(grid.df.join(lit, KEY).select(*KEY, F.when(F.col("light") > 0, F.col("v") * F.pow(math.cos(zenith) / F.col("light"), F.lit(k_coefficient))).alias("v")))


@operator("SEDIMENTATION", "gis", "dem accumulation", k_factor=0.03, m_exp=1.6, n_exp=1.3)
def sedimentation(dem: Grid, acc: Grid, k_factor, m_exp, n_exp):
    size = dem.cell[0]
    east, south = _gradient(size, size)
    t = clamped(dem).join(acc.df.select(*KEY, F.col("v").alias("a")), KEY)
    value = k_factor * F.pow(F.greatest(F.col("a") * size, F.lit(0.0)), F.lit(m_exp)) * F.pow(F.sqrt(east * east + south * south), F.lit(n_exp))
    return dem.with_cells(t.select(*KEY, F.when(F.col("v").isNotNull() & F.col("a").isNotNull(), value).alias("v")))


def _painted(grid: Grid, values: DataFrame, value: Column) -> Grid:
    """values, keyed by cell, where the grid has data."""
    return grid.with_cells(grid.df.join(values, KEY, "left").select(*KEY, F.when(F.col("v").isNotNull(), value).alias("v")))


@operator("FILTER", "gis", "input", filter_type=("Mean", "Median", "Mode", "Min", "Max", "Laplacian"), kernel_size=3)
def filter_grid(grid: Grid, filter_type, kernel_size):
    """Windows are partial at edges, and cells without data are left out; the mode's ties go to the smallest value."""
    return _windowed(grid, kernel_size, filter_type.lower())


@operator("WINDOW", "gis", "input", statistic=("mean", "median", "min", "max", "range", "std", "sum", "variety"), window_size=3)
def window(grid: Grid, statistic, window_size):
    return _windowed(grid, window_size, statistic)


def _diversity(w, n, centre) -> dict[str, np.ndarray]:
    """Entropy h, Simpson's index s and number k of a window's classes: H = ln N - sum(n ln n) / N."""
    runs = class_runs(np.trunc(w), n).astype(float)
    h = np.log(n) - (runs * np.log(np.where(runs > 0, runs, 1.0))).sum(axis=1) / n
    return {"h": h, "s": 1 - (runs * runs).sum(axis=1) / (1.0 * n * n), "k": (runs > 0).sum(axis=1).astype(float)}


@operator("PATTERN", "gis", "input", metric=("Entropy", "Dominance", "Diversity"), kernel_size=3)
def pattern(grid: Grid, metric, kernel_size):
    return _windowed(grid, kernel_size, _diversity, {"Entropy": F.col("h"), "Dominance": F.log("k") - F.col("h"), "Diversity": F.col("k")}[metric], ("h", "s", "k"))


@operator("BIODIVERSITY_METRICS", "hbm", "input", metric=("Shannon", "Simpson", "Richness"), window_size=3)
def biodiversity(grid: Grid, metric, window_size):
    return _windowed(grid, window_size, _diversity, {"Shannon": F.col("h"), "Simpson": F.col("s"), "Richness": F.col("k")}[metric], ("h", "s", "k"))


@operator("TEXTURE", "gis", "input", metric=("Variance", "Coefficient of Variation", "Range", "Contrast", "Angular Second Moment"), kernel_size=3)
def texture(grid: Grid, metric, kernel_size):
    """Contrast is the mean squared difference of all pairs of a window, which is twice n/(n-1) times its variance."""
    return _windowed(grid, kernel_size, {"Variance": "var", "Coefficient of Variation": "cv", "Range": "range", "Contrast": "contrast", "Angular Second Moment": "asm"}[metric])


@operator("DENOISE", "imgproc", "input", window_size=5, noise_variance=0.0)
def lee_filter(grid: Grid, window_size, noise_variance):
    """Lee filter; without a noise variance, the mean of local (sample) variances."""

    def local(w, n, centre):
        return {"m": np.nansum(w, axis=1) / n, "s": _statistic("contrast")(w, n, centre)["s"] / 2}

    t = focal(grid.df.select(*KEY, "v"), window_size, local, ["m", "s"])
    t = written(t) if noise_variance <= 0 else t
    noise = t.agg(F.avg("s").alias("noise")) if noise_variance <= 0 else t.sparkSession.range(1).select(F.lit(float(noise_variance)).alias("noise"))
    k = F.when(F.col("s") + F.col("noise") > 0, F.col("s") / (F.col("s") + F.col("noise"))).otherwise(0.0)
    return grid.with_cells(t.crossJoin(F.broadcast(noise)).select(*KEY, F.when(F.col("v").isNotNull(), F.col("m") + k * (F.col("v") - F.col("m"))).alias("v")))


@operator("EXPAND", "gis", "input", radius=1)
def expand(grid: Grid, radius):
    """Cells within the radius (in cells) of a non-zero one become 1; what is shuffled doesn't grow with the radius."""
    hit = squared_distances(grid, grid.df.where("v <> 0"), radius, (1.0, 1.0)).select(*KEY, F.lit(1.0).alias("near"))
    return _painted(grid, hit, F.when(F.col("v") != 0, F.col("v")).otherwise(F.coalesce("near", F.lit(0.0))))


@operator("CONTRACT", "gis", "input", radius=1)
def contract(grid: Grid, radius):
    """Cells next to zero, to no data or to the edge become zero."""
    empty = grid.every_cell().join(grid.df.where("v <> 0").select(*KEY), KEY, "left_anti")
    hit = squared_distances(grid, empty, radius, (1.0, 1.0)).select(*KEY, F.lit(1.0).alias("near"))
    edge = (F.col("row") < radius) | (F.col("col") < radius) | (F.col("row") >= grid.rows - radius) | (F.col("col") >= grid.cols - radius)
    return _painted(grid, hit, F.when(F.col("near").isNotNull() | edge, 0.0).otherwise(F.col("v")))


@operator("BUFFER", "gis", "input", buffer_distance=100.0)
def buffer(grid: Grid, buffer_distance):
    """1 within the distance of a non-zero cell, else 0."""
    hit = squared_distances(grid, grid.df.where("v <> 0"), buffer_distance).select(*KEY, F.lit(1.0).alias("near"))
    return _painted(grid, hit, F.coalesce("near", F.lit(0.0)))


@operator("CONTOUR", "gis", "input", contour_interval=100.0)
def contour(grid: Grid, contour_interval):
    level = lambda c: F.floor(F.col(c) / contour_interval)
    crosses = F.coalesce(level("e") != level("v"), F.lit(False)) | F.coalesce(level("s") != level("v"), F.lit(False))
    return grid.with_cells(neighbours(grid, {"e": (0, 1), "s": (1, 0)}).select(*KEY, F.when(F.col("v").isNotNull(), crosses.cast("double")).alias("v")))


@operator("POLY2LINE", "files", "input")
def outlines(grid: Grid):
    differs = [F.coalesce(F.col(k) != F.col("v"), F.lit(True)) for k in "ewsn"]
    line = differs[0] | differs[1] | differs[2] | differs[3]
    return grid.with_cells(neighbours(grid, {"e": (0, 1), "w": (0, -1), "s": (1, 0), "n": (-1, 0)}).select(*KEY, F.when(F.col("v").isNotNull(), line.cast("double")).alias("v")))


@operator("AUTOCORR", "gis", "input", lag_distance=1)
def moran(grid: Grid, lag_distance):
    """Moran's I over a square window of the lag, its expectation and the number of pairs."""
    stats = grid.valid().agg(F.avg("v").alias("m"), F.count("*").alias("n"), F.var_pop("v").alias("s2"))
    z = grid.with_cells(grid.valid().crossJoin(F.broadcast(stats)).select(*KEY, (F.col("v") - F.col("m")).alias("v")))
    near = focal(z.df, 2 * int(lag_distance) + 1, lambda w, n, centre: {"x": np.nansum(w, axis=1) - centre, "w": n - 1.0}, ["x", "w"])
    t = near.agg(F.sum(F.col("v") * F.col("x")).alias("zx"), F.sum("w").cast("long").alias("pairs")).crossJoin(F.broadcast(stats))
    return t.select((F.col("zx") / F.col("pairs") / F.col("s2")).alias("moran_i"), (-1 / (F.col("n") - 1)).alias("expected"), "pairs", "n")


@operator("INTERCON", "gis", "input")
def between_contours(grid: Grid):
    """Cells between contours (non-zero cells) by the steepest of four axes' linear interpolation; windows run along each axis."""
    from pyspark.sql import Window

    dx, dy = grid.cell
    diag = math.hypot(dx, dy)
    line = F.when(F.col("v") != 0, F.struct(F.col("v").alias("z"), "row", "col"))
    t, best = grid.df.withColumn("line", line), []
    for k, (part, step) in enumerate(((F.col("row"), dx), (F.col("col"), dy), (F.col("row") - F.col("col"), diag), (F.col("row") + F.col("col"), diag))):
        w = Window.partitionBy(part).orderBy(F.col("col") if k != 1 else F.col("row"))
        t = t.withColumns({f"a{k}": F.last("line", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), f"b{k}": F.first("line", True).over(w.rowsBetween(1, Window.unboundedFollowing))})
        c = "row" if k == 1 else "col"
        da, db = (F.col(c) - F.col(f"a{k}.{c}")) * step, (F.col(f"b{k}.{c}") - F.col(c)) * step
        za, zb = F.col(f"a{k}.z"), F.col(f"b{k}.z")
        best.append(F.when(za.isNotNull() & zb.isNotNull(), F.struct((F.abs(zb - za) / (da + db)).alias("slope"), F.lit(-k).alias("order"), ((za * db + zb * da) / (da + db)).alias("z"))))
    return grid.with_cells(t.select(*KEY, F.when(F.col("v") != 0, F.col("v")).when(F.col("v").isNotNull(), F.coalesce(F.array_max(F.array(*best))["z"], F.lit(0.0))).alias("v")))


@operator("HABITAT_QUALITY", "hbm", "landcover threats", habitat=(), sensitivity=(), half_saturation=0.5)
def habitat_quality(land: Grid, threats: list, habitat, sensitivity, half_saturation):
    """threats: (grid, max distance in cells, weight, 'linear' or 'exponential'); habitat and sensitivity: by class."""
    top = sum(w for _, _, w, _ in threats)
    out = land.df
    for k, (grid, reach, weight, decay) in enumerate(threats):
        h = int(reach)
        kernel = [(a, b, 1 - d / reach if decay == "linear" else math.exp(-2.99 * d / reach)) for a, b in square(2 * h + 1) if (d := math.hypot(a, b)) <= reach]
        to = F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(float(x)).alias("k")) for a, b, x in kernel)))
        felt = grid.valid().where("v > 0").select(*KEY, "v", to.alias("t")).select((F.col("row") + F.col("t.dr")).alias("row"), (F.col("col") + F.col("t.dc")).alias("col"), (F.col("v") * F.col("t.k")).alias("x")).groupBy(*KEY).agg(F.sum("x").alias(f"t{k}"))
        out = out.join(felt, KEY, "left")
    cls = F.col("v").cast("int")

    def by_class(table, k=None):
        c = F.when(F.lit(False), F.lit(0.0))
        for name, x in dict(table).items():
            c = c.when(cls == name, float(x if k is None else x[k]))
        return F.coalesce(c, F.lit(0.0))

    d = sum((F.coalesce(f"t{k}", F.lit(0.0)) * by_class(sensitivity, k) * (w / top) for k, (_, _, w, _) in enumerate(threats)), F.lit(0.0))
    q = by_class(habitat) * (1 - F.pow(d, 2.5) / (F.pow(d, 2.5) + half_saturation**2.5))
    return land.with_cells(out.select(*KEY, F.when(F.col("v").isNotNull(), q).alias("v")))
