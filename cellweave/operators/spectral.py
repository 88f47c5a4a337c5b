"""Two-dimensional Fourier transforms: lines in tasks, one shuffle that turns rows into columns, filters as projections between.

Cells are (row, col, re, im), both axes padded to powers of two; a cell that isn't there is 0, so rows of padding are never made. A
group holds some lines, of LINE values each at most: longer lines are split by the four-step form into two rounds of
short ones, so no group grows with the image.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.grid import KEY, Grid
from ..plans.registry import operator
from ..plans.scratch import written

#: Values of a line that is transformed in one piece, and about those of a group.
LINE, GROUP = 1 << 16, 1 << 18
CELLS = "row int, col int, re double, im double"


def padded(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def _lines(cells: DataFrame, axis: str, n: int, inverse: bool) -> DataFrame:
    """Transforms of n values along an axis, some lines a group. Forward: sums with exp(+2 pi i jk / n); inverse: with the other sign, over n."""
    other = KEY[1 - KEY.index(axis)]
    many = max(1, GROUP // n)

    def run(table: pa.Table) -> pa.Table:
        line, at = table.column(other).to_numpy(), table.column(axis).to_numpy()
        lines, mine = np.unique(line, return_inverse=True)
        x = np.zeros((len(lines), n), complex)
        x[mine, at] = table.column("re").to_numpy() + 1j * table.column("im").to_numpy()
        x = np.fft.fft(x, axis=1, norm="forward") if inverse else np.fft.ifft(x, axis=1, norm="forward")
        out = {other: np.repeat(lines, n).astype(np.int32), axis: np.tile(np.arange(n, dtype=np.int32), len(lines)), "re": x.real.ravel(), "im": x.imag.ravel()}
        return pa.table({k: out[k] for k in ("row", "col", "re", "im")})

    group = F.floor(F.col(other) / many).alias("g")
    return cells.select(group, *KEY, "re", "im").groupBy("g").applyInArrow(lambda t: run(t.drop_columns(["g"])), CELLS)


def _long_lines(cells: DataFrame, axis: str, n: int, inverse: bool, bound: int) -> DataFrame:
    """As _lines, a line of n = p * q values as p transforms of q values and q of p: places j = a + p b become k = c + q d.

    Lines get numbers of their own, (line, a) and then (line, c), so both rounds are plain ones.
    """
    other = KEY[1 - KEY.index(axis)]
    p = 1 << (n.bit_length() - 1) // 2
    q = n // p
    if max(p, q) > bound:
        raise ValueError(f"lines of {n} values are longer than the square of {bound}")
    first = cells.select((F.col(other).cast("long") * p + F.col(axis) % p).alias("line"), F.floor(F.col(axis) / p).cast("int").alias("at"), "re", "im")
    t = _numbered(first, q, inverse)
    angle = F.lit((-2 if inverse else 2) * math.pi / n) * (F.col("line") % p) * F.col("at")
    c, s = F.cos(angle), F.sin(angle)
    turned = t.select((F.floor(F.col("line") / p) * q + F.col("at")).alias("line"), (F.col("line") % p).cast("int").alias("at"), (F.col("re") * c - F.col("im") * s).alias("re"), (F.col("re") * s + F.col("im") * c).alias("im"))
    t = _numbered(turned, p, inverse)
    return t.select(F.floor(F.col("line") / q).cast("int").alias(other), (F.col("line") % q + q * F.col("at")).cast("int").alias(axis), "re", "im").select(*KEY, "re", "im")


def _numbered(cells: DataFrame, n: int, inverse: bool) -> DataFrame:
    """Transforms of lines (line, at, re, im) of n values."""
    many = max(1, GROUP // n)

    def run(table: pa.Table) -> pa.Table:
        lines, mine = np.unique(table.column("line").to_numpy(), return_inverse=True)
        x = np.zeros((len(lines), n), complex)
        x[mine, table.column("at").to_numpy()] = table.column("re").to_numpy() + 1j * table.column("im").to_numpy()
        x = np.fft.fft(x, axis=1, norm="forward") if inverse else np.fft.ifft(x, axis=1, norm="forward")
        return pa.table({"line": np.repeat(lines, n), "at": np.tile(np.arange(n, dtype=np.int32), len(lines)), "re": x.real.ravel(), "im": x.imag.ravel()})

    return cells.withColumn("g", F.floor(F.col("line") / many)).groupBy("g").applyInArrow(lambda t: run(t.drop_columns(["g"])), "line long, at int, re double, im double")


def transform(cells: DataFrame, rows: int, cols: int, inverse: bool = False, bound: int = LINE) -> DataFrame:
    """row, col, re, im: the transform of cells over rows x cols places, powers of two. Along columns first forward, along rows first back, so that a filter's rows of zeros stay out."""
    for axis, n in (("col", cols), ("row", rows)):
        cells = _lines(cells, axis, n, inverse) if n <= bound else _long_lines(cells, axis, n, inverse, bound)
    return cells


def _spectrum(grid: Grid, bound: int) -> DataFrame:
    cells = grid.valid().select(*(F.col(k).cast("int") for k in KEY), F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im"))
    return transform(cells, padded(grid.rows), padded(grid.cols), bound=bound)


@operator("FOURIER", "imgproc", "input", direction=("forward", "inverse"), rows=0, cols=0, line_bound=LINE)
def fourier(grid, direction, rows, cols, line_bound):
    """forward: magnitude and phase of a grid's transform, over sizes padded to powers of two; cells without data count as 0.

    inverse: v, the real part of the inverse of a table (row, col, magnitude, phase) over rows x cols places (powers of
    two; by default what its cells reach). The inverse of a forward transform is the grid, with zeros where it was padded.
    """
    if direction == "forward":
        f = _spectrum(grid, line_bound)
        return f.select(*KEY, F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("magnitude"), F.atan2("im", "re").alias("phase"))
    t = getattr(grid, "df", grid)
    if not rows or not cols:
        top = t.agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols")).head()
        rows, cols = rows or padded(top.rows or 1), cols or padded(top.cols or 1)
    if rows & (rows - 1) or cols & (cols - 1):
        raise ValueError("an inverse transform needs powers of two")
    cells = t.where("magnitude <> 0").select(*(F.col(k).cast("int") for k in KEY), (F.col("magnitude") * F.cos("phase")).alias("re"), (F.col("magnitude") * F.sin("phase")).alias("im"))
    return transform(cells, rows, cols, inverse=True, bound=line_bound).select(*KEY, F.col("re").alias("v"))


def butterworth(kind: str, d, cutoff: float, width: float, order: int):
    """The share of a frequency at distance d from the centre that passes."""
    if kind.startswith("Low"):
        return 1 / (1 + F.pow(d / cutoff, F.lit(2 * order)))
    if kind.startswith("High"):
        return 1 - 1 / (1 + F.pow(d / cutoff, F.lit(2 * order)))
    square = d * d - cutoff**2
    reject = 1 / (1 + F.pow(d * width / F.when(square == 0, 1e-9).otherwise(square), F.lit(2 * order)))
    return reject if kind == "Band-reject" else 1 - reject


@operator("FILTFQ", "imgproc", "input", filter_type=("Low-pass", "High-pass", "Band-pass", "Band-reject"), cutoff_frequency=30.0, bandwidth=15.0, order=2, line_bound=LINE)
def frequency_filter(grid: Grid, filter_type, cutoff_frequency, bandwidth, order, line_bound):
    """The grid through a Butterworth filter of its frequencies; cells without data count as 0, and stay without data."""
    rows, cols = padded(grid.rows), padded(grid.cols)
    r, c = (F.least(F.col(k), F.lit(n) - F.col(k)) for k, n in (("row", rows), ("col", cols)))
    h = butterworth(filter_type, F.sqrt((r * r + c * c).cast("double")), cutoff_frequency, bandwidth, order)
    f = _spectrum(grid, line_bound).select(*KEY, (F.col("re") * h).alias("re"), (F.col("im") * h).alias("im"))
    back = written(transform(f, rows, cols, inverse=True, bound=line_bound).where((F.col("row") < grid.rows) & (F.col("col") < grid.cols)))
    return grid.with_cells(grid.valid().select(*KEY).join(back, KEY).select(*KEY, F.col("re").alias("v")))
