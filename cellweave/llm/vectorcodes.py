"""Vector code compression: a codebook for each part of a vector, its nearest entries found in a kd-tree that is broadcast each round."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.zonal import by_key
from .common import discard, map_arrow, materialize, unused
from .vectors import matrix, met, partial_sums, quoted, squared, whole_vectors

LEAF, ROWS = 8, 8192


class Tree:
    """A kd-tree over a codebook's entries; nodes hold the box of their entries, leaves their numbers in ascending order."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.nodes = entries, []
        if len(entries):
            self._grow(np.arange(len(entries)))

    def _grow(self, members: np.ndarray) -> int:
        own = self.entries[members]
        low, high = (own.min(0), own.max(0)) if own.shape[1] else (own[0], own[0])
        here = len(self.nodes)
        self.nodes.append(None)
        children = None
        if len(members) > LEAF and (high > low).any():
            axis = int(np.argmax(high - low))
            order = np.argsort(own[:, axis], kind="stable")
            half = len(members) // 2
            children = self._grow(np.sort(members[order[:half]])), self._grow(np.sort(members[order[half:]]))
        self.nodes[here] = low, high, children, members
        return here

    def _bound(self, node: int, q: np.ndarray) -> np.ndarray:
        """Squared distance to a node's box, which no entry inside is nearer than."""
        return squared(q, np.clip(q, self.nodes[node][0], self.nodes[node][1]))

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the nearest entries and squared distances; of equally near entries the lower number."""
        index, best = np.full(len(q), len(self.entries), np.int64), np.full(len(q), -1, object)
        for k in range(0, len(q), ROWS):
            index[k : k + ROWS], best[k : k + ROWS] = self._search(q[k : k + ROWS])
        return index, best.astype(np.int64)

    def _search(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Branch and bound, with all vectors that visit a node at once. A node whose bound equals the best distance is visited: it may hold a lower number."""
        index = np.full(len(q), len(self.entries), np.int64)
        best = squared(q, self.entries[0])  # any entry's distance is a bound from above

        def visit(node: int, who: np.ndarray) -> None:
            if not len(who):
                return
            _, _, children, members = self.nodes[node]
            if children is None:
                d = squared(q[who, None, :], self.entries[members][None, :, :])
                at = d.argmin(1)  # the first of equal ones, and members ascend
                near, number = d[np.arange(len(who)), at], members[at]
                better = (near < best[who]) | ((near == best[who]) & (number < index[who]))
                best[who[better]], index[who[better]] = near[better], number[better]
                return
            a, b = children
            to_a, to_b = self._bound(a, q[who]), self._bound(b, q[who])
            first = to_a <= to_b
            visit(a, who[first & (to_a <= best[who])])
            visit(b, who[~first & (to_b <= best[who])])
            visit(b, who[first & (to_b <= best[who])])
            visit(a, who[~first & (to_a <= best[who])])

        visit(0, np.arange(len(q)))
        return index, best


def _parts(batch: pa.RecordBatch, column: str, parts: int, size: int) -> list[np.ndarray]:
    v = matrix(batch.column(column), parts * size)
    return [v[:, p * size : (p + 1) * size] for p in range(parts)]


def fit_codebooks(kept: DataFrame, vector: str, key: str, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """Codebooks of whole vectors of one length: parts of the vectors with the least keys (equal keys by their vectors), then rounds of nearest entries and means rounded down."""
    (k,) = quoted(key)
    seeds = np.array([r[0] for r in kept.where(k.isNotNull()).orderBy(k, vector).limit(entries).select(vector).collect()], np.int64)
    size = seeds.shape[1] // parts
    books = [seeds[:, p * size : (p + 1) * size].copy() for p in range(parts)]
    for _ in range(rounds):
        shared = kept.sparkSession.sparkContext.broadcast([Tree(b) for b in books])

        def assign(batch, shared=shared):
            for p, (tree, own) in enumerate(zip(shared.value, _parts(batch, vector, parts, size))):
                yield tree.nearest(own)[0] + p * len(seeds), own, 1

        n, sums = met(kept.select(vector).mapInArrow(partial_sums(parts * len(seeds), size, assign), "group int, n long, totals array<long>"), parts * len(seeds), size)
        shared.destroy()
        for p, book in enumerate(books):
            own = slice(p * len(seeds), (p + 1) * len(seeds))
            used = n[own] > 0
            book[used] = sums[own][used] // n[own][used, None]
    return books


def encode_vectors(kept: DataFrame, vector: str, books: list[np.ndarray], columns: list[str]) -> DataFrame:
    """columns of kept, code (two hex digits a part) and error (squared distances summed over parts)."""
    size = books[0].shape[1]
    shared = kept.sparkSession.sparkContext.broadcast([Tree(b) for b in books])
    digits = max(2, len(f"{len(books[0]) - 1:x}"))

    def run(batches):
        for batch in batches:
            found = [tree.nearest(own) for tree, own in zip(shared.value, _parts(batch, vector, len(books), size))]
            codes = ["".join(f"{i:0{digits}x}" for i in row) for row in zip(*(i.tolist() for i, _ in found))]
            error = pa.array([sum(row) for row in zip(*(d.tolist() for _, d in found))], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(codes, pa.string()), error], [*columns, "code", "error"])

    fields = [kept.schema[c] for c in columns] + [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    return map_arrow(kept.select(*quoted(*columns), vector), run, T.StructType(fields))


def compress_vectors(df: DataFrame, vector: str = "embedding", key: str = "vec_id", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, list[np.ndarray]]:
    """(df without its vectors, with code and error; the codebooks).

    Rows go whose vector is null or holds null or non-finite components. The first vector in order of keys sets the
    length, which parts must divide (else ValueError); vectors of another length stay, with null code and error. Rows with a null
    key are coded like others, but never start an entry; repeated keys and vectors count as often as they occur. Fewer
    vectors than entries make smaller codebooks; without any vector that has a key, all codes are null and there are no codebooks. Columns of df
    named code or error are replaced. A round is one pass without a shuffle of vectors: entries' sums meet once a task.
    """
    columns = [c for c in df.columns if c != vector and c.lower() not in ("code", "error")]
    (own,) = unused(df, "v")
    kept = materialize(whole_vectors(df.select(*quoted(*columns, vector)), vector, scale, own))
    (k,) = quoted(key)
    first = kept.where(k.isNotNull()).orderBy(k, own).select(F.size(own)).head()
    blank = [F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")]
    if first is None:
        return kept.select(*quoted(*columns), *blank), []
    if first[0] % parts:
        raise ValueError(f"{parts} parts don't divide vectors of {first[0]} components")
    same = kept.where(F.size(own) == first[0])
    books = fit_codebooks(same, own, key, parts, entries, rounds)
    return encode_vectors(same, own, books, columns).unionByName(kept.where(F.size(own) != first[0]).select(*quoted(*columns), *blank)), books


def digest(books: list[np.ndarray]) -> str:
    """Of all components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def digest_codes(coded: DataFrame, books: list[np.ndarray], label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error (error summed over equal labels, nulls together), codebooks_sha256; a label of any share of the rows is spread over tasks."""
    rows = materialize(coded.select("vec_id", "code", "error", F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("")).alias("__label")))
    sums = rows.groupBy("__label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    return by_key(rows, sums, "__label").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
