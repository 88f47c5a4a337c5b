"""File forms of grids: bytes in, bands out, and back.

A reader gets a file's parts, by suffix (a header and its data, or one part), and gives bands (band, row, col) as
float64 with NaN where there is no data. A writer gets bands, the transform and the no-data value, and gives parts.
"""

from __future__ import annotations

import re
import struct

import numpy as np

from . import jpeg
from .files import _flat_tiff, encode_tiff

Parts = dict[str, bytes]


def _only(parts: Parts, *suffixes: str) -> bytes:
    """The part with one of the suffixes; the only part there is, whatever it's called."""
    for s in suffixes:
        if s in parts:
            return parts[s]
    if len(parts) == 1:
        return next(iter(parts.values()))
    raise ValueError(f"none of {suffixes} among {sorted(parts)}")


def _blank(m: np.ndarray, nodata: float | None) -> np.ndarray:
    m = np.asarray(m, float)
    return m if nodata is None or np.isnan(nodata) else np.where(m == nodata, np.nan, m)


def _filled(bands: np.ndarray, nodata: float) -> np.ndarray:
    return np.where(np.isnan(bands), nodata, bands)


def _pairs(text: str, sep: str) -> dict[str, str]:
    """Lines `key sep value`, keys in lower case; braces may run over lines."""
    text = re.sub(r"\{[^}]*\}", lambda m: m[0].replace("\n", " "), text)
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(sep) for line in text.splitlines()) if v.strip()}


def _laid_out(data: bytes, kind: str, rows: int, cols: int, bands: int, interleave: str, skip: int = 0) -> np.ndarray:
    x = np.frombuffer(data, kind, rows * cols * bands, skip)
    if interleave == "bil":
        return x.reshape(rows, bands, cols).transpose(1, 0, 2)
    return x.reshape(rows, cols, bands).transpose(2, 0, 1) if interleave == "bip" else x.reshape(bands, rows, cols)


# TIFF


def read_tiff(parts: Parts) -> np.ndarray:
    bands, tags = _flat_tiff(_only(parts, "tif", "tiff"))
    return _blank(bands, float(tags[42113][0].rstrip(b"\0 ")) if 42113 in tags else None)


def write_tiff(bands: np.ndarray, transform, nodata: float) -> Parts:
    return {"tif": encode_tiff(_filled(bands, nodata), transform, nodata)}


# Windows bitmaps


def read_bitmap(parts: Parts) -> np.ndarray:
    """Bitmaps of 8 bits (palette numbers) or 24 bits (red, green, blue)."""
    b = _only(parts, "bmp")
    start, width, height, bits = struct.unpack_from("<I", b, 10)[0], *struct.unpack_from("<ii", b, 18), struct.unpack_from("<H", b, 28)[0]
    if b[:2] != b"BM" or bits not in (8, 24) or struct.unpack_from("<I", b, 30)[0]:
        raise ValueError("only plain bitmaps of 8 or 24 bits are read")
    depth = bits // 8
    line = (width * depth + 3) // 4 * 4
    m = np.frombuffer(b, np.uint8, line * abs(height), start).reshape(abs(height), line)[:, : width * depth].reshape(abs(height), width, depth)
    return (m[::-1] if height > 0 else m)[:, :, ::-1].transpose(2, 0, 1).astype(float)


def write_bitmap(bands: np.ndarray, transform, nodata: float) -> Parts:
    """24 bits: the first three bands, or one as grey; values are rounded into 0..255, no data is 0."""
    m = np.clip(np.round(np.nan_to_num(bands[:3] if len(bands) >= 3 else bands[[0, 0, 0]])), 0, 255).astype(np.uint8)
    _, rows, cols = m.shape
    line = (cols * 3 + 3) // 4 * 4
    body = np.zeros((rows, line), np.uint8)
    body[:, : cols * 3] = m[::-1, ::-1].transpose(1, 2, 0).reshape(rows, -1)
    return {"bmp": b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + body.size, 0, 0, 54, 40, cols, rows, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()}


# JPEG


def read_jpeg(parts: Parts) -> np.ndarray:
    try:
        return jpeg.decode(_only(parts, "jpg", "jpeg"))
    except (IndexError, KeyError, struct.error) as e:
        raise ValueError("broken JPEG") from e


def write_jpeg(bands: np.ndarray, transform, nodata: float) -> Parts:
    return {"jpg": jpeg.encode(bands)}


# Surfer grids


def read_surfer(parts: Parts) -> np.ndarray:
    """Binary (DSBB) and text (DSAA) grids, rows from the south; values from 1.70141e38 on are blank."""
    b = _only(parts, "grd")
    if b[:4] == b"DSAA":
        words = b.split()
        nx, ny = int(words[1]), int(words[2])
        m = np.array(words[9 : 9 + nx * ny], float)
    else:
        nx, ny = struct.unpack_from("<hh", b, 4)
        m = np.frombuffer(b, "<f4", nx * ny, 56).astype(float)
    m = m.reshape(ny, nx)[::-1]
    return np.where(m >= 1.70141e38, np.nan, m)[None]


def write_surfer(bands: np.ndarray, transform, nodata: float) -> Parts:
    m = bands[0]
    ox, oy, pw, ph, *_ = transform
    rows, cols = m.shape
    z = (np.nanmin(m), np.nanmax(m)) if not np.isnan(m).all() else (0.0, 0.0)
    head = struct.pack("<hh6d", cols, rows, ox + pw / 2, ox + (cols - 0.5) * pw, oy + (rows - 0.5) * ph, oy + ph / 2, *z)
    return {"grd": b"DSBB" + head + np.where(np.isnan(m), 1.70141e38, m)[::-1].astype("<f4").tobytes()}


# Text grids


def read_ascii(parts: Parts) -> np.ndarray:
    """An ASCII grid: header words, then values from the top."""
    words = _only(parts, "asc", "txt").decode("ascii", "replace").split()
    head: dict[str, float] = {}
    while words and words[0][0].isalpha():
        head[words[0].lower()] = float(words[1])
        words = words[2:]
    rows, cols = int(head["nrows"]), int(head["ncols"])
    return _blank(np.array(words[: rows * cols], float).reshape(1, rows, cols), head.get("nodata_value", -9999.0))


def write_ascii(bands: np.ndarray, transform, nodata: float) -> Parts:
    ox, oy, pw, ph, *_ = transform
    m = _filled(bands[0], nodata)
    head = f"ncols {m.shape[1]}\nnrows {m.shape[0]}\nxllcorner {ox}\nyllcorner {oy + m.shape[0] * ph}\ncellsize {abs(pw)}\nNODATA_value {nodata}\n"
    return {"asc": (head + "\n".join(" ".join(map(repr, row)) for row in m.tolist()) + "\n").encode()}


def read_matrix(parts: Parts) -> np.ndarray:
    """Lines of numbers parted by blanks, tabs or commas; empty fields between commas or tabs have no data."""
    rows = []
    for line in _only(parts, "txt", "csv").decode("ascii", "replace").splitlines():
        sep = next((s for s in ",\t" if s in line), None)
        fields = [f.strip() for f in (line.split(sep) if sep else line.split())]
        if any(fields):
            rows.append([float(f) if f else np.nan for f in fields])
    return np.array(rows, float)[None]


def read_grass(parts: Parts) -> np.ndarray:
    """A GRASS ASCII raster: north, south, east, west, rows and cols lines, then values; * has no data."""
    lines = _only(parts, "txt", "asc").decode("ascii", "replace").splitlines()
    head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if ":" in line)}
    words = " ".join(line for line in lines if ":" not in line).split()
    null = head.get("null", "*")
    rows, cols = int(head["rows"]), int(head["cols"])
    return np.array([np.nan if w in (null, "*") else float(w) for w in words[: rows * cols]]).reshape(1, rows, cols)


def write_grass(bands: np.ndarray, transform, nodata: float) -> Parts:
    ox, oy, pw, ph, *_ = transform
    m = bands[0]
    head = f"north: {oy}\nsouth: {oy + m.shape[0] * ph}\neast: {ox + m.shape[1] * pw}\nwest: {ox}\nrows: {m.shape[0]}\ncols: {m.shape[1]}\n"
    return {"txt": (head + "\n".join(" ".join("*" if v != v else repr(v) for v in row) for row in m.tolist()) + "\n").encode()}


def read_months(parts: Parts) -> np.ndarray:
    """Lines x, y and a value per month: a band per month, rows from the largest y, places that aren't named without data."""
    t = np.array([[float(w) for w in re.split(r"[\s,]+", line.strip())] for line in _only(parts, "txt", "xyz", "csv").decode().splitlines() if re.match(r"\s*[-+.\d]", line)])
    xs, col = np.unique(t[:, 0], return_inverse=True)
    ys, row = np.unique(-t[:, 1], return_inverse=True)
    out = np.full((t.shape[1] - 2, len(ys), len(xs)), np.nan)
    out[:, row, col] = t[:, 2:].T
    return out


# Flat binary with a text header

# Data types of ENVI headers by number, and of ER Mapper and Idrisi headers by name.
ENVI_TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}
ERS_TYPES = {"unsigned8bitinteger": "u1", "signed8bitinteger": "i1", "unsigned16bitinteger": "u2", "signed16bitinteger": "i2", "unsigned32bitinteger": "u4", "signed32bitinteger": "i4", "ieee4bytereal": "f4", "ieee8bytereal": "f8"}
RST_TYPES = {"byte": "u1", "integer": "<i2", "real": "<f4"}


def read_envi(parts: Parts) -> np.ndarray:
    head = _pairs(parts["hdr"].decode("ascii", "replace"), "=")
    data = next(v for k, v in parts.items() if k != "hdr")
    kind = "<>"[int(head.get("byte order", 0))] + ENVI_TYPES[int(head["data type"])]
    m = _laid_out(data, kind, int(head["lines"]), int(head["samples"]), int(head.get("bands", 1)), head.get("interleave", "bsq").lower(), int(head.get("header offset", 0)))
    return _blank(m, float(head["data ignore value"]) if "data ignore value" in head else None)


def write_envi(bands: np.ndarray, transform, nodata: float) -> Parts:
    ox, oy, pw, ph, *_ = transform
    n, rows, cols = bands.shape
    head = f"ENVI\nsamples = {cols}\nlines = {rows}\nbands = {n}\nheader offset = 0\nfile type = ENVI Standard\ndata type = 5\ninterleave = bsq\nbyte order = 0\ndata ignore value = {nodata!r}\nmap info = {{Arbitrary, 1, 1, {ox}, {oy}, {abs(pw)}, {abs(ph)}}}\n"
    return {"hdr": head.encode(), "img": _filled(bands, nodata).astype("<f8").tobytes()}


def read_ers(parts: Parts) -> np.ndarray:
    """An ER Mapper header and its lines, whose bands are interleaved by line."""
    head = _pairs(parts["ers"].decode("ascii", "replace"), "=")
    data = next(v for k, v in parts.items() if k != "ers")
    kind = (">" if head.get("byteorder", "LSBFirst").lower() == "msbfirst" else "<") + ERS_TYPES[head["celltype"].lower()]
    m = _laid_out(data, kind, int(head["nroflines"]), int(head["nrofcellsperline"]), int(head.get("nrofbands", 1)), "bil", int(head.get("headeroffset", 0)))
    return _blank(m, float(head["nullcellvalue"]) if "nullcellvalue" in head else None)


def write_ers(bands: np.ndarray, transform, nodata: float) -> Parts:
    ox, oy, pw, ph, *_ = transform
    n, rows, cols = bands.shape
    head = f'DatasetHeader Begin\n\tVersion = "6.0"\n\tDataSetType = ERStorage\n\tDataType = Raster\n\tByteOrder = LSBFirst\n\tRasterInfo Begin\n\t\tCellType = IEEE8ByteReal\n\t\tNullCellValue = {nodata!r}\n\t\tCellInfo Begin\n\t\t\tXdimension = {abs(pw)}\n\t\t\tYdimension = {abs(ph)}\n\t\tCellInfo End\n\t\tNrOfLines = {rows}\n\t\tNrOfCellsPerLine = {cols}\n\t\tRegistrationCoord Begin\n\t\t\tEastings = {ox}\n\t\t\tNorthings = {oy}\n\t\tRegistrationCoord End\n\t\tNrOfBands = {n}\n\tRasterInfo End\nDatasetHeader End\n'
    return {"ers": head.encode(), "": _filled(bands, nodata).transpose(1, 0, 2).astype("<f8").tobytes()}


def read_rst(parts: Parts) -> np.ndarray:
    """An Idrisi image (rst) with its description (rdc)."""
    head = _pairs(parts["rdc"].decode("latin-1"), ":")
    rows, cols, kind = int(head["rows"]), int(head["columns"]), head["data type"].lower()
    if kind == "rgb24":
        return _laid_out(parts["rst"], "u1", rows, cols, 3, "bip")[::-1].astype(float)
    flag = head.get("flag value", "none")
    return _blank(_laid_out(parts["rst"], RST_TYPES[kind], rows, cols, 1, "bsq"), None if flag.lower() in ("none", "") else float(np.float32(float(flag))))


def write_rst(bands: np.ndarray, transform, nodata: float) -> Parts:
    """One band of 32-bit reals, which is what that form holds."""
    ox, oy, pw, ph, *_ = transform
    m = _filled(bands[0], nodata).astype("<f4")
    rows, cols = m.shape
    rows_ = [("file format", "IDRISI Raster A.1"), ("file title", ""), ("data type", "real"), ("file type", "binary"), ("columns", cols), ("rows", rows), ("ref. system", "plane"), ("ref. units", "m"), ("unit dist.", 1), ("min. X", ox), ("max. X", ox + cols * pw), ("min. Y", oy + rows * ph), ("max. Y", oy), ("min. value", float(m.min())), ("max. value", float(m.max())), ("flag value", nodata), ("flag def'n", "missing data")]
    return {"rdc": "".join(f"{k:<12}: {v}\r\n" for k, v in rows_).encode("latin-1"), "rst": m.tobytes()}


def read_lan(parts: Parts) -> np.ndarray:
    """An ERDAS 7 file (LAN or GIS): a header of 128 bytes, then bands interleaved by line, of 4, 8 or 16 bits."""
    b = _only(parts, "lan", "gis", "img")
    if b[:6] == b"HEAD74":
        depth, bands, cols, rows = *struct.unpack_from("<hh", b, 6), *struct.unpack_from("<ii", b, 16)
    elif b[:6] == b"HEADER":
        depth, bands = struct.unpack_from("<hh", b, 6)
        cols, rows = (int(x) for x in struct.unpack_from("<ff", b, 16))
    else:
        raise ValueError("not an ERDAS 7 file (the later, hierarchical form isn't read)")
    if depth == 1:
        line = (cols + 1) // 2
        x = np.frombuffer(b, "u1", rows * bands * line, 128).reshape(rows, bands, line)
        return np.stack([x & 15, x >> 4], axis=-1).reshape(rows, bands, -1)[:, :, :cols].transpose(1, 0, 2).astype(float)
    return _laid_out(b, {0: "u1", 2: "<u2"}[depth], rows, cols, bands, "bil", 128).astype(float)


def write_lan(bands: np.ndarray, transform, nodata: float) -> Parts:
    """Values are rounded into 0..65535, no data is 0."""
    ox, oy, pw, ph, *_ = transform
    n, rows, cols = bands.shape
    head = b"HEAD74" + struct.pack("<hh6xii", 2, n, cols, rows) + bytes(88) + struct.pack("<4f", ox + pw / 2, oy + ph / 2, abs(pw), abs(ph))
    return {"lan": head.ljust(128, b"\0") + np.clip(np.round(np.nan_to_num(bands)), 0, 65535).transpose(1, 0, 2).astype("<u2").tobytes()}


def read_ndvi3g(parts: Parts, rows: int = 2160, cols: int = 4320) -> np.ndarray:
    """Half-monthly global images: big-endian 16-bit numbers, column by column; raw values."""
    return np.frombuffer(_only(parts), ">i2", rows * cols).reshape(cols, rows).T[None].astype(float)


def read_gpcp(parts: Parts, rows: int = 72, cols: int = 144) -> np.ndarray:
    """A year of monthly images: a text header as long as a row of numbers, then big-endian 32-bit reals; -99999 has no data."""
    x = np.frombuffer(_only(parts), ">f4", offset=4 * cols)
    return _blank(x[: len(x) // (rows * cols) * rows * cols].reshape(-1, rows, cols), -99999.0)


def read_asd(parts: Parts) -> np.ndarray:
    """A field spectrometer's spectrum: a header of 484 bytes, then a number per channel; one row of cells."""
    b = _only(parts, "asd")
    if b[:3].lower() != b"asd":
        raise ValueError("not an ASD file")
    kind, channels = {0: "<f4", 1: "<i4", 2: "<f8"}[b[199]], struct.unpack_from("<H", b, 204)[0]
    return np.frombuffer(b, kind, channels, 484).reshape(1, 1, channels).astype(float)


def read_dem(parts: Parts) -> np.ndarray:
    """A USGS digital elevation model: records of 1024 characters, profiles from west to east, each from the south."""
    text = _only(parts, "dem").decode("ascii", "replace")
    number = lambda s: float(s.replace("D", "E"))
    step_y, profiles = number(text[828:840]), int(text[858:864])
    scale, columns, at = number(text[840:852]), [], 1024
    for _ in range(profiles):
        head = text[at : at + 144]
        n, south, datum = int(head[12:18]), number(head[48:72]), number(head[72:96])
        values = [int(text[k : k + 6]) for k in range(at + 144, at + 144 + 6 * min(n, 146), 6)]
        at += 1024
        while len(values) < n:
            part = min(n - len(values), 170)
            values += [int(text[k : k + 6]) for k in range(at, at + 6 * part, 6)]
            at += 1024
        columns.append((south, [np.nan if v == -32767 else v * scale + datum for v in values]))
    low = min(s for s, _ in columns)
    starts = [round((s - low) / step_y) for s, _ in columns]
    rows = max(k + len(v) for k, (_, v) in zip(starts, columns))
    out = np.full((rows, len(columns)), np.nan)
    for c, (k, (_, v)) in enumerate(zip(starts, columns)):
        out[k : k + len(v), c] = v
    return out[::-1][None]


def read_psd(parts: Parts) -> np.ndarray:
    """The merged image of a Photoshop file: plain or packed by rows, of 8 or 16 bits."""
    b = _only(parts, "psd")
    if b[:6] != b"8BPS\0\1":
        raise ValueError("not a Photoshop file")
    bands, rows, cols, depth = *struct.unpack_from(">HII", b, 12), struct.unpack_from(">H", b, 22)[0]
    at = 26
    for _ in range(3):  # colours, resources, layers
        at += 4 + struct.unpack_from(">I", b, at)[0]
    packed, at = struct.unpack_from(">H", b, at)[0], at + 2
    kind, line = {8: "u1", 16: ">u2"}[depth], cols * depth // 8
    if packed == 0:
        return np.frombuffer(b, kind, bands * rows * cols, at).reshape(bands, rows, cols).astype(float)
    if packed != 1:
        raise ValueError("this Photoshop file's packing isn't read")
    sizes = struct.unpack_from(f">{bands * rows}H", b, at)
    at += 2 * bands * rows
    raw = bytearray()
    for n in sizes:
        raw += unpack_bits(b[at : at + n])[:line]
        at += n
    return np.frombuffer(bytes(raw), kind).reshape(bands, rows, cols).astype(float)


def unpack_bits(b: bytes) -> bytes:
    """Runs: n + 1 bytes as they are for n up to 127, one byte 257 - n times from 129 on."""
    out, at = bytearray(), 0
    while at < len(b):
        n, at = b[at], at + 1
        if n < 128:
            out += b[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += b[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


# netCDF, the classic form

NC_TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


def _netcdf(b: bytes):
    """Dimensions [(name, length)] and variables {name: (dimensions, attributes, type, offset)} of a classic file."""
    if b[:3] != b"CDF" or b[3] not in (1, 2):
        raise ValueError("only the classic form of netCDF is read")
    at, wide = 4, b[3] == 2

    def take(form: str):
        nonlocal at
        out = struct.unpack_from(">" + form, b, at)
        at += struct.calcsize(">" + form)
        return out[0] if len(out) == 1 else out

    def name() -> str:
        nonlocal at
        n = take("i")
        text = b[at : at + n].decode()
        at += (n + 3) // 4 * 4
        return text

    def attributes() -> dict:
        nonlocal at
        _, n = take("ii")
        out = {}
        for _ in range(n):
            key, kind, count = name(), take("i"), take("i")
            kind = NC_TYPES[kind]
            out[key] = np.frombuffer(b, kind, count, at)
            at += (np.dtype(kind).itemsize * count + 3) // 4 * 4
        return out

    records = take("i")
    _, n = take("ii")
    dims = [(name(), take("i")) for _ in range(n)]
    attributes()
    _, n = take("ii")
    variables = {}
    for _ in range(n):
        key = name()
        ids = [take("i") for _ in range(take("i"))]
        attrs, kind, size = attributes(), NC_TYPES[take("i")], take("i")
        variables[key] = (ids, attrs, kind, take("q") if wide else take("i"), size)
    return records, dims, variables


def read_netcdf(parts: Parts) -> np.ndarray:
    """The first variable of two dimensions or more, its last two as rows and columns, the others as bands; scaled as its attributes say."""
    b = _only(parts, "nc")
    records, dims, variables = _netcdf(b)
    grids = [v for v in variables.values() if len(v[0]) >= 2]
    if not grids:
        raise ValueError("no variable has two dimensions")
    ids, attrs, kind, start, size = grids[0]
    shape = [dims[i][1] for i in ids]
    if dims[ids[0]][1] == 0:  # records of all such variables take turns
        several = [v for v in variables.values() if v[0] and dims[v[0][0]][1] == 0]
        stride = size if len(several) == 1 else sum(v[4] for v in several)
        each = int(np.prod(shape[1:])) if len(shape) > 1 else 1
        shape[0] = records
        m = np.array([np.frombuffer(b, kind, each, start + r * stride) for r in range(records)])
    else:
        m = np.frombuffer(b, kind, int(np.prod(shape)), start)
    m = m.reshape(-1, *shape[-2:])
    out = m.astype(float)
    for key in ("_FillValue", "missing_value"):
        if key in attrs:
            out[m == attrs[key][0]] = np.nan
    return out * float(attrs.get("scale_factor", [1.0])[0]) + float(attrs.get("add_offset", [0.0])[0])


def write_netcdf(bands: np.ndarray, transform, nodata: float) -> Parts:
    """One variable v (band, y, x) of 64-bit reals."""
    n, rows, cols = bands.shape

    def name(text: str) -> bytes:
        raw = text.encode()
        return struct.pack(">i", len(raw)) + raw + bytes(-len(raw) % 4)

    dims = struct.pack(">ii", 10, 3) + b"".join(name(k) + struct.pack(">i", x) for k, x in (("band", n), ("y", rows), ("x", cols)))
    fill = struct.pack(">ii", 12, 1) + name("_FillValue") + struct.pack(">iid", 6, 1, nodata)
    size = 8 * n * rows * cols
    head = b"CDF\1" + struct.pack(">i", 0) + dims + struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, 1) + name("v") + struct.pack(">4i", 3, 0, 1, 2) + fill + struct.pack(">ii", 6, min(size, (1 << 31) - 4))
    return {"nc": head + struct.pack(">i", len(head) + 4) + _filled(bands, nodata).astype(">f8").tobytes()}


def read_any(parts: Parts) -> np.ndarray:
    """By first bytes, or by the suffix of a header."""
    for suffix, read in (("rdc", read_rst), ("hdr", read_envi), ("ers", read_ers)):
        if suffix in parts:
            return read(parts)
    b = _only(parts, "tif", "tiff", "img")
    known = (
        (b[:4] in (b"II*\0", b"MM\0*"), read_tiff), (b[:2] == b"BM", read_bitmap), (b[:2] == b"\xff\xd8", read_jpeg), (b[:4] in (b"DSBB", b"DSAA"), read_surfer), (b[:3] == b"CDF", read_netcdf), (b[:4] == b"8BPS", read_psd),
        (b[:6] in (b"HEAD74", b"HEADER"), read_lan), (b[:16].lstrip()[:5].lower() == b"ncols", read_ascii), (b[:64].lstrip()[:6].lower() == b"north:", read_grass),
    )
    for is_it, read in known:
        if is_it:
            return read(parts)
    raise ValueError("this form isn't read here")
