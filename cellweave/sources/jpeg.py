"""Sequential JPEG images of 8 bits: bytes in, bands out, and back.

The reader takes baseline and extended sequential files of one or three components (grey, or luminance and two colour
differences) with any sampling factors and restart markers; progressive, lossless and arithmetic ones raise. The writer
keeps all frequencies to the nearest whole number, without sampling colours down, so that images come back nearly as
they were; its code tables are of equal lengths, simple instead of short.
"""

from __future__ import annotations

import struct

import numpy as np

#: Places of a block's frequencies in the order of a file: along diagonals, to and fro.
ZIGZAG = np.array([i * 8 + j for i, j in sorted(((i, j) for i in range(8) for j in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])
_K = np.arange(8)
#: The cosine transform of 8 samples: rows are frequencies.
COSINE = np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _K[None] + 1) * _K[:, None] * np.pi / 16)


class Bits:
    """The bits of a scan between two markers, without stuffed zeros."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def peek(self, k: int) -> int:
        while self.n < k:  # beyond the end, ones
            self.held = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 255)
            self.at, self.n = self.at + 1, self.n + 8
        return self.held >> (self.n - k) & ((1 << k) - 1)

    def take(self, k: int) -> int:
        out = self.peek(k) if k else 0
        self.n -= k
        self.held &= (1 << self.n) - 1
        return out


def _lookup(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """For every 16 bits, the length and symbol of the code that they begin with."""
    table, code, at = [(0, 0)] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            start = code << (16 - length)
            table[start : start + (1 << (16 - length))] = [(length, symbol)] * (1 << (16 - length))
            code += 1
        at, code = at + n, code << 1
    return table


def _number(bits: Bits, size: int) -> int:
    x = bits.take(size)
    return x if not size or x >> (size - 1) else x - (1 << size) + 1


def _block(bits: Bits, dc: list, ac: list, before: int, out: np.ndarray) -> int:
    """One block's numbers, in the order of the file, into out; the first is the difference from the block before."""

    def symbol(table: list) -> int:
        length, s = table[bits.peek(16)]
        if not length:
            raise ValueError("broken JPEG code")
        bits.take(length)
        return s

    out[0] = before = before + _number(bits, symbol(dc))
    k = 1
    while k < 64:
        run, size = divmod(symbol(ac), 16)
        if not size:
            if run < 15:
                break
            k += 16
            continue
        k += run
        if k > 63:
            raise ValueError("broken JPEG block")
        out[k] = _number(bits, size)
        k += 1
    return before


def decode(b: bytes) -> np.ndarray:
    """Bands (band, row, col): one, or red, green and blue."""
    if b[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, steps, tables, parts, every, blocks = 2, {}, {}, [], 0, {}
    rows = cols = 0
    while at < len(b):
        if b[at] != 0xFF:
            raise ValueError("no JPEG marker")
        mark = b[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if mark == 0xD9:
            break
        size = struct.unpack_from(">H", b, at + 2)[0]
        body, at = b[at + 4 : at + 2 + size], at + 2 + size
        if mark == 0xDB:
            while body:
                wide, own = body[0] >> 4, body[0] & 15
                steps[own] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif mark in (0xC0, 0xC1):
            depth, rows, cols, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or n not in (1, 3) or not rows:
                raise ValueError("only JPEG of 8 bits and one or three components is read")
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC2 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
            raise ValueError("only sequential JPEG is read")
        elif mark == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif mark == 0xDA:
            at = _scan(b, at, body, parts, tables, every, rows, cols, blocks)
    top_h, top_v = max(p[1] for p in parts), max(p[2] for p in parts)
    planes = []
    for name, h, v, q in parts:
        x = np.zeros(blocks[name].shape)
        x[..., ZIGZAG] = blocks[name] * steps[q]
        x = COSINE.T @ x.reshape(*x.shape[:2], 8, 8) @ COSINE
        plane = x.transpose(0, 2, 1, 3).reshape(x.shape[0] * 8, -1) + 128
        planes.append(np.repeat(np.repeat(plane, top_v // v, axis=0), top_h // h, axis=1)[:rows, :cols])
    if len(planes) == 1:
        return np.clip(np.round(planes[0]), 0, 255)[None]
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    return np.clip(np.round(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb])), 0, 255)


def _scan(b: bytes, at: int, head: bytes, parts: list, tables: dict, every: int, rows: int, cols: int, blocks: dict) -> int:
    """Blocks of a scan's components into `blocks` (by component: down, across, 64); returns where the scan ends."""
    top_h, top_v = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-cols // (8 * top_h)), -(-rows // (8 * top_v))
    named = {p[0]: p for p in parts}
    own = [(named[head[1 + 2 * k]], tables[head[2 + 2 * k] >> 4], tables[16 | head[2 + 2 * k] & 15]) for k in range(head[0])]
    for (name, h, v, _), _, _ in own:
        blocks[name] = np.zeros((down * v, across * h, 64), np.int64)
    if len(own) == 1:  # a component by itself goes block by block over its own size
        (name, h, v, _), dc, ac = own[0]
        units = [[(name, r, c, dc, ac)] for r in range(-(-rows * v // (8 * top_v))) for c in range(-(-cols * h // (8 * top_h)))]
    else:
        units = [[(name, r * v + i, c * h + j, dc, ac) for (name, h, v, _), dc, ac in own for i in range(v) for j in range(h)] for r in range(down) for c in range(across)]
    pieces, end = [], at
    while True:
        stop = b.find(b"\xff", end)
        if stop < 0 or stop + 1 >= len(b):
            stop = len(b)
        elif b[stop + 1] == 0:
            end = stop + 2
            continue
        pieces.append(b[at:stop])
        if stop >= len(b) or not 0xD0 <= b[stop + 1] <= 0xD7:
            break
        at = end = stop + 2
    if every and len(pieces) < -(-len(units) // every):
        raise ValueError("JPEG scan is cut short")
    for k, piece in enumerate(pieces):
        bits, before = Bits(piece), dict.fromkeys(named, 0)
        for unit in units[k * every : (k + 1) * every] if every else units:
            for name, r, c, dc, ac in unit:
                before[name] = _block(bits, dc, ac, before[name], blocks[name][r, c])
        if bits.at > len(bits.data) + 4:
            raise ValueError("JPEG scan is cut short")
    return stop


def encode(bands: np.ndarray) -> bytes:
    """Grey for one band, else colours of the first three; values are rounded into 0..255, no data is 0."""
    m = np.clip(np.round(np.nan_to_num(bands[:3] if len(bands) >= 3 else bands[:1])), 0, 255)
    n, rows, cols = m.shape
    if n == 3:
        r, g, blue = m
        m = np.stack([0.299 * r + 0.587 * g + 0.114 * blue, 128 - 0.168736 * r - 0.331264 * g + 0.5 * blue, 128 + 0.5 * r - 0.418688 * g - 0.081312 * blue])
    m = np.pad(m, ((0, 0), (0, -rows % 8), (0, -cols % 8)), mode="edge") - 128
    x = m.reshape(n, m.shape[1] // 8, 8, m.shape[2] // 8, 8).transpose(1, 3, 0, 2, 4)
    numbers = np.round(COSINE @ x @ COSINE.T).astype(int).reshape(-1, n, 64)[..., ZIGZAG]
    # Codes of equal length, none of ones alone: 4 bits for sizes, 8 for runs and sizes.
    sizes, pairs = list(range(12)), [0, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))]
    code = {s: k for k, s in enumerate(pairs)}
    out: list[str] = []

    def put(value: int) -> str:
        size = abs(value).bit_length()
        return f"{value if value > 0 else value + (1 << size) - 1:0{size}b}" if size else ""

    before = [0] * n
    for unit in numbers.tolist():
        for k, block in enumerate(unit):
            step, before[k] = block[0] - before[k], block[0]
            out.append(f"{abs(step).bit_length():04b}" + put(step))
            run, last = 0, max((i for i in range(1, 64) if block[i]), default=0)
            for value in block[1 : last + 1]:
                if not value:
                    run += 1
                    continue
                while run > 15:
                    out.append(f"{code[0xF0]:08b}")
                    run -= 16
                out.append(f"{code[run << 4 | abs(value).bit_length()]:08b}" + put(value))
                run = 0
            if last < 63:
                out.append(f"{code[0]:08b}")
    bits = "".join(out)
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")

    def segment(mark: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body

    counts = lambda length, k: bytes(k if i == length else 0 for i in range(1, 17))
    head = segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + segment(0xDB, b"\0" + bytes([1] * 64)) + segment(0xC0, struct.pack(">BHHB", 8, rows, cols, n) + b"".join(bytes([k + 1, 0x11, 0]) for k in range(n)))
    head += segment(0xC4, b"\0" + counts(4, len(sizes)) + bytes(sizes)) + segment(0xC4, b"\x10" + counts(8, len(pairs)) + bytes(pairs))
    return b"\xff\xd8" + head + segment(0xDA, bytes([n]) + b"".join(bytes([k + 1, 0]) for k in range(n)) + b"\0\x3f\0") + scan + b"\xff\xd9"
