"""The grid: cells of a DataFrame (row, col, v) with its geometry. A null v, or a cell that isn't there, has no data."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["row", "col"]


@dataclass(frozen=True)
class Grid:
    """transform: origin x, origin y, pixel width, pixel height, rotation x, rotation y."""

    df: DataFrame
    rows: int
    cols: int
    transform: tuple[float, ...] = (0.0, 0.0, 1.0, -1.0, 0.0, 0.0)
    nodata: float = -9999.0
    srs: str = ""

    def with_cells(self, df: DataFrame, **changes) -> Grid:
        return replace(self, df=df, **changes)

    @property
    def cell(self) -> tuple[float, float]:
        return abs(self.transform[2]), abs(self.transform[3])

    def x(self) -> Column:
        """Of a cell's upper-left corner."""
        return F.lit(self.transform[0]) + F.col("col") * self.transform[2] + F.col("row") * self.transform[4]

    def y(self) -> Column:
        return F.lit(self.transform[1]) + F.col("col") * self.transform[5] + F.col("row") * self.transform[3]

    def col_row(self, x: Column, y: Column) -> tuple[Column, Column]:
        """The cell of a place: offsets are truncated toward zero and rotation plays no part."""
        return ((x - self.transform[0]) / self.transform[2]).cast("int"), ((y - self.transform[1]) / self.transform[3]).cast("int")

    def cell_of(self, row: int, col: int, x: float | None, y: float | None) -> tuple[int, int]:
        """The cell of map coordinates, or (row, col) where they aren't given."""
        if x is None or y is None:
            return row, col
        return int((y - self.transform[1]) / self.transform[3]), int((x - self.transform[0]) / self.transform[2])

    def cell_id(self) -> Column:
        return F.col("row").cast("long") * self.cols + F.col("col")

    def valid(self) -> DataFrame:
        return self.df.where("v is not null")

    def every_cell(self) -> DataFrame:
        """row, col of all rows * cols cells."""
        ids = self.df.sparkSession.range(self.rows * self.cols)
        return ids.select((F.col("id") / self.cols).cast("int").alias("row"), (F.col("id") % self.cols).cast("int").alias("col"))


def from_sentinel(df: DataFrame, nodata: float | None) -> DataFrame:
    return df if nodata is None else df.withColumn("v", F.when(F.col("v") != nodata, F.col("v")))


def to_sentinel(df: DataFrame, nodata: float) -> DataFrame:
    return df.withColumn("v", F.coalesce("v", F.lit(float(nodata))))


def align(grids: list[Grid]) -> DataFrame:
    """One row per cell that all grids have, with values v0, v1, ...; sizes must be the same, georeference isn't compared."""
    if len({(g.rows, g.cols) for g in grids}) > 1:
        raise ValueError("grids differ in size")
    parts = [g.df.select(*KEY, F.col("v").alias(f"v{k}")) for k, g in enumerate(grids)]
    return reduce(lambda a, b: a.join(b, KEY), parts)
