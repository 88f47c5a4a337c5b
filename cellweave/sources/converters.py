"""Converters by name: files in, cells or edges out, and back.

Tables of files are (path, content). A form that has a header beside its data is two files of one name, which are
brought together by that name; other forms are read file by file, where they lie. A file is one task's work, in both
directions.
"""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.grid import KEY, Grid
from ..plans.registry import operator
from . import formats, vectors

CELLS = "path string, row int, col int, band int, v double"
EDGES = "path string, label long, value double, x1 double, y1 double, x2 double, y2 double"
FILES = "path string, content binary"


def _cells(path: str, bands: np.ndarray, band: int):
    """Rows of all bands, or of the one asked for (from 1)."""
    r, c = np.indices(bands.shape[1:], np.int32)
    for k, m in enumerate(bands):
        if band in (0, k + 1):
            v = np.ascontiguousarray(m, float).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([path] * v.size, pa.string()), pa.array(r.ravel()), pa.array(c.ravel()), pa.array(np.full(v.size, k, np.int32)), pa.array(v, mask=np.isnan(v))], ["path", "row", "col", "band", "v"])


def _edges(path: str, parts: list[vectors.Part]):
    rows = list(vectors.edges_of(parts))
    kinds = (pa.int64(), *(pa.float64(),) * 5)
    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *columns], ["path", "label", "value", "x1", "y1", "x2", "y2"])


def _suffix(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[1].lower() if "." in name else ""


def _stem(path: str) -> str:
    return path[: -len(_suffix(path)) - 1] if _suffix(path) else path


def decoded(files: DataFrame, read: Callable[[formats.Parts], list], emit: Callable, schema: str, paired: bool) -> DataFrame:
    """emit(path, read(parts)) of files. Paired: files of one stem are one; a path then is the stem. Without a path, it is empty."""
    files = files if "path" in files.columns else files.withColumn("path", F.lit(""))
    if not paired:

        def alone(batches):
            for b in batches:
                for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                    if content is not None:
                        yield from emit(path, read({_suffix(path or ""): content}))

        return files.select("path", "content").mapInArrow(alone, schema)

    def together(table: pa.Table) -> pa.Table:
        paths = table.column("path").to_pylist()
        parts = {_suffix(p): x for p, x in zip(paths, table.column("content").to_pylist())}
        return pa.Table.from_batches(list(emit(_stem(paths[0]), read(parts))))

    stem = F.when(F.col("path").rlike(r"\.[^./]*$"), F.regexp_extract("path", r"(?s)^(.*)\.[^./]*$", 1)).otherwise(F.col("path"))
    return files.where("content is not null").select("path", "content", stem.alias("stem")).groupBy("stem").applyInArrow(together, schema)


def encoded(grid: Grid, write: Callable[[np.ndarray, tuple, float], formats.Parts], name: str = "grid") -> DataFrame:
    """Files of a grid, or of its bands where its cells have a band column."""
    rows, cols, transform, nodata = grid.rows, grid.cols, grid.transform, grid.nodata
    cells = grid.df if "band" in grid.df.columns else grid.df.withColumn("band", F.lit(0))

    def run(table: pa.Table) -> pa.Table:
        band, row, col = (table.column(c).to_numpy() for c in ("band", "row", "col"))
        bands = np.full((int(band.max()) + 1, rows, cols), np.nan)
        bands[band, row, col] = table.column("v").to_numpy(zero_copy_only=False).astype(float)
        parts = write(bands, transform, nodata)
        return pa.table({"path": pa.array([f"{name}.{k}" if k else name for k in parts], pa.string()), "content": pa.array(list(parts.values()), pa.binary())})

    return cells.select(*KEY, F.col("band").cast("int").alias("band"), "v", F.lit(name).alias("file")).groupBy("file").applyInArrow(run, FILES)


def encoded_edges(edges: DataFrame, write: Callable[[list], dict[str, bytes]], name: str = "edges") -> DataFrame:
    """Files of edges (label, value, x1, y1, x2, y2), in order of label."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("label", "ascending"), ("no", "ascending")])
        rows = list(zip(*(table.column(c).to_pylist() for c in ("label", "value", "x1", "y1", "x2", "y2"))))
        parts = write(vectors.parts_of(rows))
        return pa.table({"path": pa.array([f"{name}.{k}" for k in parts], pa.string()), "content": pa.array(list(parts.values()), pa.binary())})

    return edges.select("label", *(F.col(c).cast("double").alias(c) for c in ("value", "x1", "y1", "x2", "y2")), F.monotonically_increasing_id().alias("no"), F.lit(name).alias("file")).groupBy("file").applyInArrow(run, FILES)


def cells_of(files: DataFrame, band: int = 0, read: Callable = formats.read_any, paired: bool = False) -> DataFrame:
    """path, row, col, band, v of files (path, content): all bands, or the one asked for (from 1)."""
    return decoded(files, read, lambda path, bands: _cells(path, bands, band), CELLS, paired)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def write_files(files: DataFrame, folder: str) -> None:
    """Each file of a table (path, content) into a folder that all executors reach, by Hadoop's file systems through a Parquet-free sink."""
    spark = files.sparkSession
    for r in files.toLocalIterator():  # file by file
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{r.path}")
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
        source = io.BytesIO(bytes(r.content))
        while part := source.read(1 << 20):
            out.write(bytearray(part))
        out.close()


WAYS = ("import", "export")


def _grid_form(name: str, read: Callable, write: Callable | None = None, paired: bool = False, **params) -> None:
    """Register a form of grids: files in, cells out; with direction "export" a grid in, files out."""
    if write is None:
        operator(name, "io", "files", **params)(lambda files: cells_of(files, 0, read, paired))
    else:
        operator(name, "io", "files", direction=WAYS, **params)(lambda x, direction: cells_of(x, 0, read, paired) if direction == "import" else encoded(x, write))


def _edge_form(name: str, read: Callable, write: Callable, paired: bool = False) -> None:
    def run(x, direction):
        return decoded(x, read, _edges, EDGES, paired) if direction == "import" else encoded_edges(x, write)

    operator(name, "io", "files", direction=WAYS)(run)


_grid_form("RST", formats.read_rst, formats.write_rst, True)
_grid_form("GEOTIFF", formats.read_tiff, formats.write_tiff)
_grid_form("BMPIDRIS", formats.read_bitmap, formats.write_bitmap)
_grid_form("JPGIDRIS", formats.read_jpeg, formats.write_jpeg)
_grid_form("SRFIDRIS", formats.read_surfer, formats.write_surfer)
_grid_form("ENVIIDRIS", formats.read_envi, formats.write_envi, True)
_grid_form("ERMIDRIS", formats.read_ers, formats.write_ers, True)
_grid_form("ERDIDRIS", formats.read_lan, formats.write_lan)
_grid_form("GRASSIDR", formats.read_grass, formats.write_grass)
_grid_form("SPLUSIDRIS", formats.read_ascii, formats.write_ascii)
_grid_form("STATIDRIS", formats.read_ascii, formats.write_ascii)
_grid_form("DEMIDRIS", formats.read_dem)
_grid_form("ASDIDRISI", formats.read_asd)
_grid_form("PSDIDRISI", formats.read_psd)
_grid_form("SSTIDRIS", formats.read_matrix)
_grid_form("XYZMONTHLY", formats.read_months)
# Satellite scenes: TIFF images, whichever the sensor; other forms of theirs need a native library.
for _name in "DIGITALGLOBE GEOEYE IKONOS LANDSAT QUICKBIRD RADARSAT SENTINEL SPOT WORLDVIEW".split():
    _grid_form(_name, formats.read_any)
operator("NETCDF", "io", "files", direction=WAYS, band=1)(lambda x, direction, band: cells_of(x, band, formats.read_netcdf) if direction == "import" else encoded(x, formats.write_netcdf))
operator("NDVI3G", "io", "files", rows=2160, cols=4320)(lambda files, rows, cols: cells_of(files, 0, lambda parts: formats.read_ndvi3g(parts, rows, cols)))
operator("GPCIDRISI", "io", "files", rows=72, cols=144)(lambda files, rows, cols: cells_of(files, 0, lambda parts: formats.read_gpcp(parts, rows, cols)))
_edge_form("ARCIDRIS", vectors.read_gen, vectors.write_gen)
_edge_form("DXFIDRIS", vectors.read_dxf, vectors.write_dxf)
_edge_form("KMLIDRIS", vectors.read_kml, vectors.write_kml)
_edge_form("MIFIDRIS", vectors.read_mif, vectors.write_mif, True)
_edge_form("SHAPEIDR", vectors.read_shape, vectors.write_shape, True)


def _same_size(*grids: Grid) -> bool:
    if len({(g.rows, g.cols) for g in grids}) > 1:
        raise ValueError("grids differ in size")
    return True


operator("FLYTHROUGH", "files", "dem drape")(_same_size)
operator("VFIELD", "files", "u v")(_same_size)
operator("DBWORKSHOP", "files", "database", table="")(lambda database, table: table in database.tables())
