"""What operators on vectors share: whole-number vectors, exact squared distances and sums that meet once a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 2**63


def quoted(*names: str) -> list[Column]:
    return [F.col(f"`{n.replace('`', '``')}`") for n in names]


def whole_vectors(df: DataFrame, vector: str, scale: int, out: str) -> DataFrame:
    """df without its vectors, and with out: floor(scale * x) of each component as long. Null vectors and those with a null or non-finite component go.

    Scaled components must fit a long, larger ones raise.
    """
    v, (own,) = F.col("__v"), quoted(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.when(F.abs(x * scale) < 2.0**62, F.floor(x * scale)).otherwise(F.raise_error(F.lit("a scaled component doesn't fit a long")).cast("long")))
    kept = df.select(*quoted(*(c for c in df.columns if c != vector)), own.cast("array<double>").alias("__v")).where(v.isNotNull() & fine)
    return kept.withColumn(out, whole).drop("__v")


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Arrays of one size as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of a's vectors to b's (both (..., size), broadcast): exact; in Python's numbers where longs might not do."""
    if not a.size or not b.size:
        return np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1], np.int64)
    far = int(np.abs(a).max()) + int(np.abs(b).max())
    if far * far * a.shape[-1] >= LIMIT:
        a, b = a.astype(object), b.astype(object)
    d = a - b
    return (d * d).sum(-1)


class Totals:
    """Sums of whole vectors and their number by group."""

    schema = "group int, n long, totals array<long>"

    def __init__(self, groups: int, size: int):
        self.n, self.sums, self.most = np.zeros(groups, np.int64), np.zeros((groups, size), np.int64), 0

    def add(self, group: np.ndarray, vectors: np.ndarray, sign: int = 1) -> None:
        if not len(vectors):
            return
        self.most += len(vectors) * int(np.abs(vectors).max(initial=0))
        if self.most >= LIMIT:
            raise OverflowError("sums of components don't fit a long")
        np.add.at(self.n, group, sign)
        np.add.at(self.sums, group, sign * vectors)

    def batch(self) -> pa.RecordBatch:
        seen = np.flatnonzero((self.n != 0) | (self.sums != 0).any(1))
        return pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(self.n[seen]), pa.array(list(self.sums[seen]), pa.list_(pa.int64()))], ["group", "n", "totals"])


def met(partial: DataFrame, groups: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Totals of all tasks by Spark's own sums: (number by group, sums by group); groups * size numbers reach the driver."""
    n, sums = np.zeros(groups, np.int64), np.zeros((groups, size), np.int64)
    parts = partial.select("group", "n", F.posexplode_outer("totals").alias("pos", "total"))
    for r in parts.groupBy("group", "pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        n[r["group"]] = r["n"]
        if r["pos"] is not None:
            sums[r["group"], r["pos"]] = r["total"]
    return n, sums


def partial_sums(groups: int, size: int, assign) -> callable:
    """A task's Totals; assign gives (groups, vectors, sign) of a batch, more than once if need be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Totals(groups, size)
        for batch in batches:
            for group, vectors, sign in assign(batch):
                out.add(group, vectors, sign)
        yield out.batch()

    return run
