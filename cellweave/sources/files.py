"""Scans and sinks of grids and text forms. Line-oriented forms are read and written by Spark's own readers."""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.grid import KEY, Grid, from_sentinel, to_sentinel
from ..plans.registry import operator

#: Formats by suffix; the rest count as GTiff.
DRIVERS = {"tif": "GTiff", "tiff": "GTiff", "rst": "RST", "img": "HFA", "nc": "netCDF", "hdf": "HDF4", "png": "PNG", "jpg": "JPEG", "jpeg": "JPEG", "asc": "AAIGrid", "xyz": "XYZ", "bmp": "BMP"}


def detect_driver(path: str) -> str:
    return DRIVERS.get(path.rsplit(".", 1)[-1].lower(), "GTiff")


@operator("XYZIDRIS", "io", "points", rows=0, cols=0, cell=1.0)
def from_xyz(points: DataFrame, rows, cols, cell):
    """A grid from x, y, value rows of cell corners."""
    lim = points.agg(F.min("x").alias("x"), F.max("y").alias("y")).head()
    base = Grid(points, rows, cols, (lim.x, lim.y, cell, -cell, 0.0, 0.0))
    return base.with_cells(points.select(F.round((lim.y - F.col("y")) / cell).cast("int").alias("row"), F.round((F.col("x") - lim.x) / cell).cast("int").alias("col"), F.col("value").alias("v")))


def read_xyz(spark: SparkSession, path: str, rows: int, cols: int, cell: float) -> Grid:
    """Lines of three numbers parted by white space or commas; others, such as a header, are passed over."""
    parts = F.split(F.trim("value"), r"[\s,]+")
    numbers = spark.read.text(path).select(*(F.try_element_at(parts, F.lit(k + 1)).try_cast("double").alias(n) for k, n in enumerate(("x", "y", "value"))))
    return from_xyz(numbers.where("x is not null and y is not null"), rows, cols, cell)


def write_xyz(grid: Grid, path: str) -> None:
    grid.valid().select(F.concat_ws(" ", grid.x(), grid.y(), "v")).write.text(path)


@operator("ARCRASTER", "io", "lines")
def from_ascii_grid(lines: DataFrame):
    """A grid from the lines (no, value) of an ASCII grid: header words, then rows from the top."""
    head = {r.k.lower(): float(r.v) for r in lines.where(r"value rlike '^\\s*[A-Za-z]'").select(F.split(F.trim("value"), r"\s+")[0].alias("k"), F.split(F.trim("value"), r"\s+")[1].alias("v")).collect()}
    rows, cols, cell = int(head["nrows"]), int(head["ncols"]), head["cellsize"]
    skip = lines.where(r"value rlike '^\\s*[A-Za-z]'").count()
    top = head.get("yllcorner", 0.0) + rows * cell
    cells = lines.where(r"not value rlike '^\\s*[A-Za-z]' and trim(value) <> ''").select((F.col("no") - skip).cast("int").alias("row"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("col", "x"))
    g = Grid(lines, rows, cols, (head.get("xllcorner", 0.0), top, cell, -cell, 0.0, 0.0), head.get("nodata_value", -9999.0))
    return g.with_cells(from_sentinel(cells.select("row", "col", F.col("x").cast("double").alias("v")), g.nodata))


def read_ascii_grid(spark: SparkSession, path: str) -> Grid:
    """Line numbers come from the file's byte order within one file, split by its reader at will."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("no", "value"))
    return from_ascii_grid(whole)


@operator("ASCII_GRID", "io", "input")
def ascii_lines(grid: Grid):
    """Lines (no, value) of an ASCII grid, header first: one line per row of cells."""
    ox, oy, pw, ph, *_ = grid.transform
    head = [f"ncols {grid.cols}", f"nrows {grid.rows}", f"xllcorner {ox}", f"yllcorner {oy + grid.rows * ph}", f"cellsize {abs(pw)}", f"NODATA_value {grid.nodata}"]
    full = to_sentinel(grid.every_cell().join(grid.df, KEY, "left"), grid.nodata)
    body = full.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "v"))), lambda x: x["v"].cast("string")), " ").alias("value"))
    spark = grid.df.sparkSession
    return spark.createDataFrame(list(enumerate(head)), "no int, value string").unionByName(body.select((F.col("row") + len(head)).alias("no"), "value"))


def write_ascii_grid(grid: Grid, path: str) -> None:
    ascii_lines(grid).orderBy("no").select("value").coalesce(1).write.text(path)  # the form is one file in order


# Flat binary: rows of one type, read by whole files, decoded in Arrow batches

TYPES = {"Byte": "u1", "Int16": "<i2", "Int32": "<i4", "Float32": "<f4", "Float64": "<f8", "UInt16": "<u2", "UInt32": "<u4"}


@operator("GENERICRASTER", "io", "files", interleave=("BIL", "BIP", "BSQ"), cols=0, rows=0, bands=1, data_type="Byte", header_bytes=0)
def decode_flat(files: DataFrame, interleave, cols, rows, bands, data_type, header_bytes):
    """row, col, band, v from files (path, content) of a plain layout."""
    kind = TYPES[data_type]

    def run(batches):
        for b in batches:
            for content in b.column("content").to_pylist():
                x = np.frombuffer(content, kind, rows * cols * bands, header_bytes)
                m = {"BSQ": lambda: x.reshape(bands, rows, cols), "BIL": lambda: x.reshape(rows, bands, cols).transpose(1, 0, 2), "BIP": lambda: x.reshape(rows, cols, bands).transpose(2, 0, 1)}[interleave]()
                for k in range(bands):
                    r, c = np.indices((rows, cols), np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(r.ravel()), pa.array(c.ravel()), pa.array(np.full(rows * cols, k, np.int32)), pa.array(m[k].ravel().astype(float))], ["row", "col", "band", "v"])

    return files.select("content").mapInArrow(run, "row int, col int, band int, v double")


def read_flat(spark: SparkSession, path: str, **layout) -> DataFrame:
    from ..plans.registry import create

    return create("GENERICRASTER")(spark.read.format("binaryFile").load(path), **layout)


def _unpacked_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant first; 256 clears the table, 257 ends."""
    out, table, wide, last = [], [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
    held = bits = 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= wide:
            bits -= wide
            code = held >> bits
            held &= (1 << bits) - 1
            if code == 256:
                del table[258:]
                wide, last = 9, b""
                continue
            if code == 257:
                return b"".join(out)
            entry = table[code] if code < len(table) else last + last[:1]
            out.append(entry)
            if last:
                table.append(last + entry[:1])
            last = entry
            wide = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def _unpacked(data: bytes, packing: int) -> bytes:
    """A strip or tile: plain (1), LZW (5), deflate (8 and 32946) or PackBits (32773)."""
    import zlib

    from .formats import unpack_bits

    return {1: bytes, 5: _unpacked_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}[packing](data)


def _flat_tiff(content: bytes) -> tuple[np.ndarray, dict]:
    """Bands (band, row, col) and tags of a TIFF: strips or tiles, plain, deflate, LZW or PackBits, also as horizontal differences."""
    e = "<" if content[:2] == b"II" else ">"
    if struct.unpack_from(e + "H", content, 2)[0] != 42:
        raise ValueError("not a TIFF")
    at = struct.unpack_from(e + "I", content, 4)[0]
    size = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d"}
    tags = {}
    for k in range(struct.unpack_from(e + "H", content, at)[0]):
        tag, kind, n = struct.unpack_from(e + "HHI", content, at + 2 + 12 * k)
        form = e + (f"{n}s" if kind == 2 else size.get(kind, "B") * n)
        where = at + 10 + 12 * k if struct.calcsize(form) <= 4 else struct.unpack_from(e + "I", content, at + 10 + 12 * k)[0]
        tags[tag] = struct.unpack_from(form, content, where)
    cols, rows = tags[256][0], tags[257][0]
    bands, bits, fmt = tags.get(277, (1,))[0], tags.get(258, (8,))[0], tags.get(339, (1,))[0]
    kind, packed = e + {1: "u", 2: "i", 3: "f"}[fmt] + str(bits // 8), tags.get(259, (1,))[0]
    differences = tags.get(317, (1,))[0]
    if packed not in (1, 5, 8, 32946, 32773) or differences not in (1, 2) or bits % 8:
        raise ValueError("this TIFF's compression isn't read here")
    tiled = 322 in tags
    tw, th = (tags[322][0], tags[323][0]) if tiled else (cols, min(tags.get(278, (rows,))[0], rows))
    offsets, counts = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    planar, out = tags.get(284, (1,))[0] == 2 and bands > 1, np.zeros((bands, rows, cols))
    across, down = -(-cols // tw), -(-rows // th)
    for k, (o, n) in enumerate(zip(offsets, counts)):
        raw = _unpacked(content[o : o + n], packed)
        plane, place = divmod(k, across * down) if planar else (0, k)
        r0, c0 = place // across * th, place % across * tw
        depth = 1 if planar else bands
        x = np.frombuffer(raw, kind, len(raw) // (bits // 8 * tw * depth) * tw * depth).reshape(-1, tw, depth)
        x = np.cumsum(x, axis=1, dtype=x.dtype) if differences == 2 else x
        h, w = min(x.shape[0], rows - r0), min(tw, cols - c0)
        if planar:
            out[plane, r0 : r0 + h, c0 : c0 + w] = x[:h, :w, 0]
        else:
            out[:, r0 : r0 + h, c0 : c0 + w] = x[:h, :w].transpose(2, 0, 1)
    return out, tags


def encode_tiff(bands: np.ndarray, transform: tuple[float, ...], nodata: float) -> bytes:
    """An uncompressed 64-bit TIFF with scale, tie point and no-data tags."""
    n, rows, cols = bands.shape
    data = np.ascontiguousarray(bands.transpose(1, 2, 0), "<f8").tobytes()
    extra, entries = bytearray(), []
    base = 8 + 2 + 12 * 13 + 4

    def put(tag, kind, values):
        form = {2: lambda: values, 3: lambda: struct.pack(f"<{len(values)}H", *values), 4: lambda: struct.pack(f"<{len(values)}I", *values), 12: lambda: struct.pack(f"<{len(values)}d", *values)}[kind]()
        if len(form) <= 4:
            entries.append(struct.pack("<HHI", tag, kind, len(values)) + form.ljust(4, b"\0"))
        else:
            entries.append(struct.pack("<HHII", tag, kind, len(values), base + len(extra)))
            extra.extend(form + b"\0" * (len(form) % 2))

    text = f"{nodata}".encode() + b"\0"
    for tag, kind, values in ((256, 4, (cols,)), (257, 4, (rows,)), (258, 3, (64,) * n), (259, 3, (1,)), (262, 3, (1,)), (273, 4, None), (277, 3, (n,)), (278, 4, (rows,)), (279, 4, (len(data),)), (339, 3, (3,) * n), (33550, 12, (abs(transform[2]), abs(transform[3]), 0.0)), (33922, 12, (0.0, 0.0, 0.0, transform[0], transform[1], 0.0)), (42113, 2, text)):
        if tag == 273:
            spot = len(entries)
            entries.append(b"")
        else:
            put(tag, kind, values)
    entries[spot] = struct.pack("<HHII", 273, 4, 1, base + len(extra))
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries)) + b"".join(entries) + bytes(4) + bytes(extra) + data


# Text utilities over lines (value)


@operator("AVL2CSV", "io", "lines", write_header=True)
def values_to_csv(lines: DataFrame, write_header):
    """id and value of white-space parted lines; the header is the writer's."""
    p = F.split(F.trim("value"), r"\s+")
    return lines.where(F.size(p) >= 2).select(p[0].alias("ID"), p[1].alias("Value"))


@operator("CSV2AVL", "io", "table", id_column=0, value_column=1, has_header=True)
def csv_to_values(table: DataFrame, id_column, value_column, has_header):
    """A table, or text lines of a CSV file (one string column named value): with a header, the file's first line goes."""
    if table.columns == ["value"]:
        fields = F.split(F.regexp_replace("value", "\r$", ""), ",", -1)
        lines = table.where(F.length("value") > 0)
        if has_header:  # what equals the first line of the file, which comes first in its first split
            lines = lines.where(F.col("value") != F.lit((table.head() or [""])[0]))
        return lines.select(F.concat_ws(" ", F.trim(F.get(fields, F.lit(id_column))), F.trim(F.get(fields, F.lit(value_column)))).alias("value"))
    return table.select(F.concat_ws(" ", F.col(f"`{table.columns[id_column]}`").cast("string"), F.col(f"`{table.columns[value_column]}`").cast("string")).alias("value"))


@operator("CRLF", "files", "texts", mode=("Unix to Windows", "Windows to Unix"))
def line_ends(texts: DataFrame, mode):
    unix = F.regexp_replace("value", "\r\n", "\n")
    return texts.withColumn("value", F.regexp_replace(unix, "\n", "\r\n") if mode.startswith("Unix") else unix)


@operator("VAR2FIX", "files", "lines", record_length=80)
def fixed_records(lines: DataFrame, record_length):
    return lines.withColumn("value", F.rpad("value", record_length, " "))


@operator("CREATE_TSF", "files", "", start_date="", interval=1.0, num_images=1)
def time_series_file(spark: SparkSession, start_date, interval, num_images):
    """Lines of a time-series descriptor."""
    return spark.createDataFrame([(f"start_date: {start_date}",), (f"interval: {interval}",), (f"num_images: {num_images}",)], "value string")


@operator("COLLECTION_EDITOR", "files", "names")
def collection(spark: SparkSession, names: list[str]):
    return spark.createDataFrame([("collection",), (f"entries: {len(names)}",), *((n,) for n in names)], "value string")


@operator("UTMREF", "files", "", min_lon=-180.0, max_lon=180.0, min_lat=-90.0, max_lat=90.0)
def utm_reference(min_lon, max_lon, min_lat, max_lat):
    """Zone, hemisphere and central meridian of the middle of a box."""
    zone = min(60, max(1, int(((min_lon + max_lon) / 2 + 180) // 6) + 1))
    return {"zone": zone, "hemisphere": "N" if (min_lat + max_lat) / 2 >= 0 else "S", "central_meridian": zone * 6 - 183}
