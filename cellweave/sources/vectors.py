"""File forms of points and lines: text or bytes in, edges out, and back.

Edges are (label, value, x1, y1, x2, y2): a part's label, its value and one segment; a point is an edge from a place to
itself. VECTORRASTER makes a grid of closed parts, RASTERVECTOR edges of a grid.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

Edge = tuple[int, float, float, float, float, float]
Part = tuple[float, list[tuple[float, float]]]


def edges_of(parts: Iterable[Part]) -> Iterator[Edge]:
    """Segments of parts (value, places), numbered from 1."""
    for label, (value, places) in enumerate(parts, 1):
        for (x1, y1), (x2, y2) in zip(places, places[1:]) if len(places) > 1 else [(p, p) for p in places]:
            yield label, value, x1, y1, x2, y2


def parts_of(edges: Iterable[Edge]) -> list[Part]:
    """Edges of a label as parts: chains of edges of which each starts where the last ended."""
    out: list[Part] = []
    last = None
    for label, value, x1, y1, x2, y2 in edges:
        if last == (label, x1, y1) and (x1, y1) != (x2, y2):
            out[-1][1].append((x2, y2))
        else:
            out.append((value, [(x1, y1)] if (x1, y1) == (x2, y2) else [(x1, y1), (x2, y2)]))
        last = (label, x2, y2)
    return out


def _text(parts: dict[str, bytes], suffix: str) -> str:
    return (parts[suffix] if suffix in parts else next(iter(parts.values()))).decode("utf-8", "replace")


def read_gen(parts: dict[str, bytes]) -> list[Part]:
    """ArcInfo's ungenerate form: a number, lines `x,y`, and END; points are lines `number,x,y`."""
    out: list[Part] = []
    open_: Part | None = None
    for line in _text(parts, "gen").splitlines():
        words = re.split(r"[\s,]+", line.strip())
        if words[0].upper() == "END":
            open_ = None
        elif len(words) == 1 and words[0]:
            open_ = (float(words[0]), [])
            out.append(open_)
        elif len(words) == 2 and open_:
            open_[1].append((float(words[0]), float(words[1])))
        elif len(words) >= 3 and not open_:
            out.append((float(words[0]), [(float(words[1]), float(words[2]))]))
    return [p for p in out if p[1]]


def write_gen(parts: list[Part]) -> dict[str, bytes]:
    lines = []
    for value, places in parts:
        lines += [f"{value!r},{places[0][0]!r},{places[0][1]!r}"] if len(places) == 1 else [f"{value!r}", *(f"{x!r},{y!r}" for x, y in places), "END"]
    return {"gen": ("\n".join([*lines, "END"]) + "\n").encode()}


def read_dxf(parts: dict[str, bytes]) -> list[Part]:
    """POINT, LINE, LWPOLYLINE and POLYLINE entities; the value is the height (38 or 30)."""
    lines = [x.strip() for x in _text(parts, "dxf").splitlines()]
    codes = [(int(a), b) for a, b in zip(lines[::2], lines[1::2]) if re.fullmatch(r"-?\d+", a)]
    out: list[Part] = []
    kind, own, poly = "", [], None

    def close() -> None:
        nonlocal poly
        get = lambda c, d=0.0: float(next((v for k, v in own if k == c), d))
        if kind == "POINT":
            out.append((get(30), [(get(10), get(20))]))
        elif kind == "LINE":
            out.append((get(30), [(get(10), get(20)), (get(11), get(21))]))
        elif kind == "LWPOLYLINE":
            xs, ys = ([float(v) for k, v in own if k == c] for c in (10, 20))
            places = list(zip(xs, ys))
            out.append((get(38), places + places[:1] if int(get(70)) & 1 else places))
        elif kind == "POLYLINE":
            poly = (get(30), [], int(get(70)) & 1)
        elif kind == "VERTEX" and poly:
            poly[1].append((get(10), get(20)))
        elif kind == "SEQEND" and poly:
            out.append((poly[0], poly[1] + poly[1][:1] if poly[2] else poly[1]))
            poly = None

    for code, word in codes:
        if code == 0:
            close()
            kind, own = word.upper(), []
        else:
            own.append((code, word))
    close()
    return [p for p in out if p[1]]


def write_dxf(parts: list[Part]) -> dict[str, bytes]:
    lines = ["0", "SECTION", "2", "ENTITIES"]
    for value, places in parts:
        if len(places) == 1:
            lines += ["0", "POINT", "8", "0", "10", repr(places[0][0]), "20", repr(places[0][1]), "30", repr(value)]
        else:
            lines += ["0", "LWPOLYLINE", "8", "0", "90", str(len(places)), "70", "0", "38", repr(value)]
            for x, y in places:
                lines += ["10", repr(x), "20", repr(y)]
    return {"dxf": ("\n".join([*lines, "0", "ENDSEC", "0", "EOF"]) + "\n").encode()}


def read_kml(parts: dict[str, bytes]) -> list[Part]:
    """Coordinates of points, lines and rings in document order; the value is a placemark's number in its name, else 0."""
    import xml.etree.ElementTree as ET

    out: list[Part] = []
    plain = lambda tag: tag.rsplit("}", 1)[-1]
    for mark in (e for e in ET.fromstring(_text(parts, "kml")).iter() if plain(e.tag) == "Placemark"):
        named = next((e.text or "" for e in mark.iter() if plain(e.tag) == "name"), "")
        number = re.search(r"[-+]?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?", named)
        for e in mark.iter():
            if plain(e.tag) == "coordinates":
                places = [tuple(float(x) for x in w.split(",")[:2]) for w in (e.text or "").split()]
                if places:
                    out.append((float(number[0]) if number else 0.0, places))
    return out


def write_kml(parts: list[Part]) -> dict[str, bytes]:
    def mark(value: float, places: list) -> str:
        kind = "Point" if len(places) == 1 else "LineString"
        return f"<Placemark><name>{value!r}</name><{kind}><coordinates>{' '.join(f'{x!r},{y!r}' for x, y in places)}</coordinates></{kind}></Placemark>"

    return {"kml": ('<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document>' + "\n".join(mark(*p) for p in parts) + "</Document></kml>\n").encode()}


def read_mif(parts: dict[str, bytes]) -> list[Part]:
    """MapInfo's exchange form: Point, Line, Pline and Region; values are the first column of the mid part, else 0."""
    words = _text(parts, "mif").split()
    start = next((k for k, w in enumerate(words) if w.upper() == "DATA"), -1) + 1
    rows = [re.split(r"[,\t]", line) for line in parts.get("mid", b"").decode("utf-8", "replace").splitlines()]
    out: list[Part] = []
    k, n = start, 0

    def value() -> float:
        try:
            return float(rows[n][0].strip('"'))
        except (IndexError, ValueError):
            return 0.0

    def places(at: int, count: int) -> list[tuple[float, float]]:
        return [(float(words[at + 2 * i]), float(words[at + 2 * i + 1])) for i in range(count)]

    while k < len(words):
        w = words[k].upper()
        if w == "POINT":
            out.append((value(), places(k + 1, 1)))
            k, n = k + 3, n + 1
        elif w == "LINE":
            out.append((value(), places(k + 1, 2)))
            k, n = k + 5, n + 1
        elif w in ("PLINE", "REGION"):
            several = w == "REGION" or words[k + 1].upper() == "MULTIPLE"
            k += 2 if w == "PLINE" and several else 1
            count, k = (int(words[k]), k + 1) if several else (1, k)
            for _ in range(count):
                size = int(words[k])
                out.append((value(), places(k + 1, size)))
                k += 1 + 2 * size
            n += 1
        elif w == "NONE":
            k, n = k + 1, n + 1
        else:
            k += 1
    return out


def write_mif(parts: list[Part]) -> dict[str, bytes]:
    lines = ["Version 300", "Delimiter \",\"", "Columns 1", "  value Float", "Data", ""]
    for _, places in parts:
        lines += [f"Point {places[0][0]!r} {places[0][1]!r}"] if len(places) == 1 else [f"Pline {len(places)}", *(f"{x!r} {y!r}" for x, y in places)]
    return {"mif": ("\n".join(lines) + "\n").encode(), "mid": "".join(f"{v!r}\n" for v, _ in parts).encode()}


def _table(dbf: bytes) -> list[float]:
    """The first numeric column of a dBase table."""
    rows, head, size = struct.unpack_from("<IHH", dbf, 4)
    at, start = 32, 1
    while dbf[at] != 13:
        kind, wide = chr(dbf[at + 11]), dbf[at + 16]
        if kind in "NF":
            return [float(dbf[head + r * size + start :][:wide].strip() or b"nan") for r in range(rows)]
        start, at = start + wide, at + 32
    return [0.0] * rows


def read_shape(parts: dict[str, bytes]) -> list[Part]:
    """Points, multipoints, lines and polygons of a shapefile (also with z or m, which are passed over); values from the table's first number."""
    b = parts["shp"]
    values = _table(parts["dbf"]) if "dbf" in parts else []
    out: list[Part] = []
    at, n = 100, 0
    while at + 12 <= len(b):
        size, kind = struct.unpack_from(">i", b, at + 4)[0] * 2, struct.unpack_from("<i", b, at + 8)[0] % 10
        value, p = values[n] if n < len(values) else 0.0, at + 12
        if kind == 1:
            out.append((value, [struct.unpack_from("<dd", b, p)]))
        elif kind == 8:
            count = struct.unpack_from("<i", b, p + 32)[0]
            out += [(value, [struct.unpack_from("<dd", b, p + 36 + 16 * k)]) for k in range(count)]
        elif kind in (3, 5):
            rings, count = struct.unpack_from("<ii", b, p + 32)
            first = [*struct.unpack_from(f"<{rings}i", b, p + 40), count]
            xy = struct.unpack_from(f"<{2 * count}d", b, p + 40 + 4 * rings)
            out += [(value, list(zip(xy[2 * i : 2 * j : 2], xy[2 * i + 1 : 2 * j : 2]))) for i, j in zip(first, first[1:])]
        at, n = at + 8 + size, n + 1
    return out


def write_shape(parts: list[Part]) -> dict[str, bytes]:
    """Points if all parts are points, else lines, with a table of one column."""
    points = all(len(p) == 1 for _, p in parts)
    body, index, at = bytearray(), bytearray(), 50
    every = [xy for _, p in parts for xy in p] or [(0.0, 0.0)]
    box = [f(p[k] for p in every) for f in (min, max) for k in (0, 1)]
    for n, (_, places) in enumerate(parts, 1):
        if points:
            record = struct.pack("<idd", 1, *places[0])
        else:
            places = places * 2 if len(places) == 1 else places
            own = [f(p[k] for p in places) for f in (min, max) for k in (0, 1)]
            record = struct.pack("<i4diii", 3, *own, 1, len(places), 0) + b"".join(struct.pack("<dd", *p) for p in places)
        body += struct.pack(">ii", n, len(record) // 2) + record
        index += struct.pack(">ii", at, len(record) // 2)
        at += 4 + len(record) // 2
    head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + size // 2) + struct.pack("<ii8d", 1000, 1 if points else 3, *box, 0, 0, 0, 0)
    column = b"value\0\0\0\0\0\0N" + bytes(4) + struct.pack("<BB", 24, 15) + bytes(14)
    dbf = struct.pack("<BBBBIHH20x", 3, 99, 1, 1, len(parts), 65, 25) + column + b"\r" + b"".join(b" " + f"{v:24.15g}".encode()[:24] for v, _ in parts) + b"\x1a"
    return {"shp": head(len(body)) + bytes(body), "shx": head(len(index)) + bytes(index), "dbf": dbf}
