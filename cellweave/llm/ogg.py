"""Ogg media columns: pages with checksums, packets from lacing values, logical streams, times from granule positions."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import map_arrow, slices

HEAD = struct.Struct("<4sBBqIIIB")
MAGIC = b"PCM8RAW\x00"
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """The CRC of an Ogg page: polynomial 04C11DB7, most significant bit first, from 0.

    zlib has the mirrored form of the same polynomial, so mirrored bytes give the mirrored sum.
    """
    raw = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    page = bytearray(HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body)
    page[22:26] = page_checksum(bytes(page)).to_bytes(4, "little")
    return bytes(page)


def _stream(serial: int, packets: list[tuple[bytes, int]]) -> list[tuple[int, bytes]]:
    """Pages (granule, bytes) of a logical stream. packets: bytes and the granule position at their end."""
    pages, lacing, body, granule, flags = [], bytearray(), bytearray(), -1, 2
    last = len(packets) - 1
    for k, (packet, end) in enumerate(packets):
        at = 0
        while True:
            part = min(255, len(packet) - at)
            lacing.append(part)
            body += packet[at : at + part]
            at += part
            if part < 255:
                granule = end
            if len(lacing) == 255 or part < 255 and (k in (0, last)):
                over = part < 255 and k == last
                pages.append((granule, _page(flags | 4 * over, granule, serial, len(pages), bytes(lacing), bytes(body))))
                lacing, body, granule, flags = bytearray(), bytearray(), -1, int(part == 255)
            if part < 255:
                break
    return pages


def write_ogg(payload: bytes, streams: int = 2, packet_bytes: int = 4096, rate: int = 8000) -> bytes:
    """8-bit samples as an Ogg file: packets dealt in turn to logical streams, whose pages are interleaved.

    A packet's granule position is the number of the file's samples up to its end.
    """
    header = struct.pack("<8sIB", MAGIC, rate, streams)
    lists = [[(header, 0)] for _ in range(streams)]
    for k, at in enumerate(range(0, len(payload), packet_bytes)):
        lists[k % streams].append((payload[at : at + packet_bytes], min(at + packet_bytes, len(payload))))
    pages = [_stream(n + 1, packets) for n, packets in enumerate(lists)]
    first = [own[0][1] for own in pages]
    rest = sorted((g if g >= 0 else 1 << 62, n, k, page) for n, own in enumerate(pages) for k, (g, page) in enumerate(own) if k)
    ordered, turn = [], [1] * streams
    for _, n, _, _ in rest:  # by time, but each stream's pages in their own order
        ordered.append(pages[n][turn[n]][1])
        turn[n] += 1
    return b"".join(first + ordered)


@dataclass
class Packet:
    serial: int
    number: int
    data: bytes
    granule: int | None
    seconds: float | None
    codec: str | None = None


def clock_of(head: bytes) -> tuple[str, int, int] | None:
    """(codec, granules a second, granules before the first sample that sounds) from a stream's first packet: Opus, Vorbis, FLAC, Speex, and write_ogg's own; None for others.

    Opus counts at 48,000 a second whatever it was made from, with a pre-skip; the others' granules are samples. A
    head of a known codec that is too short, or has no rate, raises ValueError.
    """
    try:
        if head[:8] == MAGIC:
            if len(head) != 13:
                raise ValueError("broken header")
            found = "pcm8", struct.unpack_from("<I", head, 8)[0], 0
        elif head[:8] == b"OpusHead":
            found = "opus", 48000, struct.unpack_from("<H", head, 10)[0]
        elif head[:7] == b"\x01vorbis":
            found = "vorbis", struct.unpack_from("<I", head, 12)[0], 0
        elif head[:5] == b"\x7fFLAC":
            if head[9:13] != b"fLaC":
                raise ValueError("broken header")
            found = "flac", struct.unpack_from(">I", head, 27)[0] >> 12, 0  # 20 bits after the block and frame sizes
        elif head[:8] == b"Speex   ":
            found = "speex", struct.unpack_from("<I", head, 36)[0], 0
        else:
            return None
    except struct.error:
        raise ValueError("broken header") from None
    if not found[1]:
        raise ValueError("broken header")
    return found


def read_ogg(media: bytes) -> list[Packet]:
    """Packets of all logical streams. Raises ValueError at a wrong checksum, a lost page or a broken packet.

    Every stream must end with a page that says so, and granule positions mustn't run back; where a header of
    write_ogg tells how many streams there are, all of them must be there. A file cut at any place thus raises. A
    page's granule position belongs to the last packet that ends on it; packets before it get none. No bytes: no
    packets.
    """
    at, out, parts, expect, count, clocks = 0, [], {}, {}, {}, {}
    ended, times, told, own_streams = set(), {}, 0, 0
    while at < len(media):
        if len(media) - at < HEAD.size:
            raise ValueError("short page")
        mark, version, flags, granule, serial, number, checksum, n = HEAD.unpack_from(media, at)
        if mark != b"OggS" or version:
            raise ValueError("not a page")
        lacing = media[at + HEAD.size : at + HEAD.size + n]
        end = at + HEAD.size + n + sum(lacing)
        page = bytearray(media[at:end])
        page[22:26] = bytes(4)
        if len(page) != end - at or page_checksum(bytes(page)) != checksum:
            raise ValueError("wrong checksum")
        if number != expect.get(serial, 0) or bool(flags & 2) != (number == 0) or bool(flags & 1) != bool(parts.get(serial)):
            raise ValueError("lost page")
        if serial in ended:
            raise ValueError("page after the end of its stream")
        if granule >= 0:
            if granule < times.get(serial, 0):
                raise ValueError("granule position runs back")
            times[serial] = granule
        if flags & 4:
            ended.add(serial)
        expect[serial] = number + 1
        pos, done = at + HEAD.size + n, []
        held = parts.pop(serial, bytearray())
        open_ = bool(flags & 1)
        for part in lacing:
            held += media[pos : pos + part]
            pos += part
            open_ = part == 255
            if not open_:
                done.append(bytes(held))
                held = bytearray()
        if open_:
            parts[serial] = held
        for k, data in enumerate(done):
            no = count[serial] = count.get(serial, -1) + 1
            if no == 0 and (clock := clock_of(data)):
                clocks[serial] = clock
                if clock[0] == "pcm8":
                    told, own_streams = max(told, data[12]), own_streams + 1
            own = granule if k == len(done) - 1 and granule >= 0 else None
            codec, rate, skip = clocks.get(serial, (None, 0, 0))
            out.append(Packet(serial, no, data, own, max(0, own - skip) / rate if own is not None and rate else None, codec))
        at = end
    if parts:
        raise ValueError("open packet")
    if expect.keys() - ended:
        raise ValueError("stream without its end")
    if own_streams < told:
        raise ValueError("missing stream")
    return out


def payload_of(packets: list[Packet]) -> bytes:
    """Samples of a file made by write_ogg: the data packets of all streams, dealt back in turn."""
    own: dict[int, list[bytes]] = {}
    for p in packets:
        if p.number:
            own.setdefault(p.serial, []).append(p.data)
    lists = [own[s] for s in sorted(own)]
    return b"".join(x[k] for k in range(max(map(len, lists), default=0)) for x in lists if k < len(x))


def encode_ogg(df: DataFrame, payload_col: str, media_col: str = "media") -> DataFrame:
    """df with a binary column of Ogg files; null payloads count as empty. An existing column of that name is replaced.

    A few megabytes of payloads are held at a time, or one payload.
    """
    fields = [f for f in df.schema if f.name != media_col]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, payload_col):
            media = [write_ogg(x or b"") for x in batch.column(payload_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(media, pa.binary())], [*names, media_col])

    return map_arrow(df, run, StructType([*fields, StructField(media_col, BinaryType())]))


PACKETS = "serial long, number long, granule long, seconds double, codec string, data binary, error string"


def _every_packet(packets: list[Packet] | None, media: bytes, error: str | None) -> list[tuple]:
    if error:
        return [(None, None, None, None, None, None, error)]
    return [(p.serial, p.number, p.granule, p.seconds, p.codec, p.data, None) for p in packets] or [(None, None, None, None, None, None, "empty")]


def decode_ogg(df: DataFrame, media_col: str = "media", id_col: str = "doc_id", keep: tuple[str, ...] = (), finish: Callable = _every_packet, schema: str = PACKETS) -> DataFrame:
    """id, the columns to keep, and the packets (serial, number, granule, seconds, codec, data, error) of every file.

    finish makes other rows of (packets, the file's bytes, an error or None), by `schema`. A damaged file gives one
    row with an error, a null or empty one a row with the error `empty`; repeated rows and null ids are read like
    others, an empty table gives none, and other columns of df aren't looked at. A few megabytes of files are held at a time, or one file.
    """
    names = ["id", *keep, *(x.split()[0] for x in schema.split(", "))]
    own = df.select(F.col(id_col).alias("id"), *keep, F.col(media_col).alias("__media"))
    out = df.sparkSession.createDataFrame([], schema).schema
    kinds = to_arrow_schema(out).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__media"):
            at, rows = [], []
            for k, media in enumerate(batch.column("__media").to_pylist()):
                packets, error = None, None
                try:
                    packets = read_ogg(media or b"")
                except ValueError as e:
                    error = str(e)
                found = finish(packets, media or b"", error)
                rows += found
                at += [k] * len(found)
            take = pa.array(at, pa.int64())
            columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(take) for n in ("id", *keep)), *columns], names)

    return map_arrow(own, run, StructType([*own.schema.fields[:-1], *out.fields]))
