"""What the operators of this subpackage share: Arrow batches, bounded memos, hashing, scratch tables, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from ..plans.components import connected_components
from ..plans.scratch import discard, written

__all__ = ["U64", "Memo", "as_bytes", "as_text", "connected_components", "discard", "map_arrow", "materialize", "mix", "release", "slices", "unused", "windows"]
U64 = np.uint64
#: Rows and bytes that go to Python at once, and rows that a scan holds, where a table is written here: texts and sets are wide rows.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "spark.sql.parquet.columnarReaderBatchSize": 512}


def materialize(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, see plans.scratch; its rows meet Python in batches of bounded rows and bytes."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in BATCHES}
    for k, v in BATCHES.items():
        conf.set(k, str(v))
    try:
        return written(df)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def release() -> None:
    """Give memory that isn't used back to the system; allocators keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class Memo(dict):
    """A map filled on demand, in two generations of at most `limit` entries and `volume` bytes or items of keys and values each.

    Bounds are kept by `trim`, between batches, so that a batch's own keys stay.
    """

    every: ClassVar[list] = []
    owners: ClassVar[list | None] = None

    def __init__(self, make: Callable | None = None, limit: int = 100_000, volume: int = 8 << 20):
        super().__init__()
        self.make, self.limit, self.volume, self.held, self.old = make, limit, volume, 0, {}
        Memo.every.append(self)

    def __setitem__(self, key, value):
        self.held += len(key) + (len(value) if hasattr(value, "__len__") else 1)
        super().__setitem__(key, value)

    @staticmethod
    def focus(*own: Memo) -> None:
        """Empty all other memos and give back what is free: a worker that goes from one stage to the next keeps only what this one needs."""
        if Memo.owners == [*map(id, own)]:
            return
        Memo.owners = [*map(id, own)]
        for m in Memo.every:
            if not any(m is o for o in own):
                m.clear()
                m.old, m.held = {}, 0
        release()

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def unseen(self, keys: set) -> list:
        """Keys without a value; those of the old generation move to the young one."""
        out = []
        for k in keys - self.keys():
            v = self.old.get(k)
            if v is None:
                out.append(k)
            else:
                self[k] = v
        return out

    def trim(self) -> None:
        if len(self) > self.limit or self.held > self.volume:
            self.old = dict(self) if self.held <= 2 * self.volume else {}
            self.held = 0
            self.clear()


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores in front until df has no column so named, whatever the case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def map_arrow(df: DataFrame, run: Callable, schema: StructType) -> DataFrame:
    """df.mapInArrow for columns of any name: names with dots or backticks never meet Spark's parser, run sees batches with df's own."""
    names = df.columns

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(b.rename_columns(names) for b in batches):
            yield out.rename_columns([f"c{k}" for k in range(out.num_columns)])

    kinds = StructType([StructField(f"c{k}", f.dataType) for k, f in enumerate(schema)])
    return df.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(plain, kinds).toDF(*schema.names)


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list:
    """Strings of an Arrow column as UTF-8 bytes; nulls as empty bytes."""
    return [x or b"" for x in pc.cast(column, pa.large_binary()).to_pylist()]


def as_text(column: pa.ChunkedArray | pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, target: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about `target` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(pc.cast(batch.column(column), pa.large_binary())), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // target
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of k word hashes; of the whole sequence if it is shorter; none if it is empty."""
    n = len(words)
    if not n:
        return words
    with np.errstate(over="ignore"):
        w, k = (words, k) if n >= k else (words, n)
        out = np.full(n - k + 1, U64(k), dtype=U64)
        for j in range(k):
            out = out * U64(0x9E3779B97F4A7C15) + w[j : n - k + 1 + j]
    return mix(out)
