"""Line deduplication by a log-template tree.

Lines are parsed to a fixed depth: the leaf of a line is its token count and its leading tokens, with variable tokens
(numbers, hexadecimal strings, addresses) masked. Within a leaf, lines that agree in enough places share a template,
whose other places are variable fields. Templates that recur across documents are dropped, but for the document
with the least id, which keeps its lines. The depth is the same at every size; the heads of a large leaf are searched
by keys that no agreeing head escapes. Lines too short for any place to differ are compared by their numbers alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Memo, as_bytes, discard, materialize, slices, unused

MASK = re.compile(rb"(?:https?://\S+)|[\w.+-]+@[\w.-]+|0x[0-9a-fA-F]+|[0-9]+(?:[.,:/-][0-9]+)*")
DIGIT = re.compile(rb"[0-9@]|://")
CODES = Memo(xxhash.xxh3_64_intdigest)
SEEN, WORDS = 250_000, 1 << 18


def parse_line(line: bytes) -> tuple[int, list[bytes]]:
    """A line's number (a hash of its masked tokens) and these tokens. Lines without tokens have none."""
    tokens = (MASK.sub(b"<*>", line) if DIGIT.search(line) else line).split()
    return xxhash.xxh3_64_intdigest(b" ".join(tokens)), tokens


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, U64).view(np.int64))


@lru_cache(4096)
def least_equal(n: int, similarity: float) -> int:
    """In how many of n places lines of one template agree at least."""
    k = max(0, min(n + 1, math.ceil(similarity * n)) - 1)
    while k <= n and k / n < similarity:
        k += 1
    return k


def _lines(depth: int, similarity: float):
    """Line numbers by document. Lines that may agree with others in part have a leaf; where a task meets such a line first, it gives the tokens after the leaf's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.focus()
        seen: set[int] = set()
        for batch in slices(batches, "text"):
            row, number, leaf, rest = [], [], [], []
            for r, text in enumerate(as_bytes(batch.column("text"))):
                for line in dict.fromkeys(text.split(b"\n")):
                    h, tokens = parse_line(line)
                    n = len(tokens)
                    if not n:
                        continue
                    row.append(r)
                    number.append(h)
                    if h in seen or n <= depth or least_equal(n, similarity) >= n:
                        leaf.append(0)
                        rest.append(None)
                    else:
                        seen.add(h)
                        leaf.append(xxhash.xxh3_64_intdigest(b" ".join([b"%d" % n, *tokens[:depth]])))
                        rest.append(b" ".join(tokens[depth:]))
            if len(seen) > SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(row, pa.int32())), _signed(number), _signed(leaf), pa.array(rest, pa.binary())], ["doc", "line", "leaf", "rest"])

    return run


class Leaf:
    """The templates of a leaf's lines that have `width` places after the leaf's own `depth`.

    A line goes to the head that it agrees with in most places, the first of these; if none agrees in enough, it is
    a head itself. Beyond `many` heads, only those are compared that share one of d + 1 runs of places with the
    line, where d places may differ: no other head can agree in enough.
    """

    def __init__(self, width: int, depth: int, similarity: float, many: int):
        self.least, self.many = least_equal(width + depth, similarity) - depth, many
        self.names: list[int] = []
        self.heads = np.empty((1, width), U64)
        cuts = np.linspace(0, width, min(width, width - self.least + 1) + 1).astype(int)
        self.parts = list(zip(cuts, cuts[1:])) if self.least > 0 else []
        self.index: dict[tuple[int, bytes], list[int]] = {}

    def _keys(self, own: np.ndarray) -> list[tuple[int, bytes]]:
        return [(int(a), xxhash.xxh3_64_digest(own[a:b].tobytes())) for a, b in self.parts]

    def name(self, line: int, own: np.ndarray) -> int:
        n, keys = len(self.names), None
        near: np.ndarray | slice = slice(0, n)
        if n >= self.many and self.parts:
            keys = self._keys(own)
            near = np.array(sorted({k for x in keys for k in self.index.get(x, ())}), np.int64)
        same = (self.heads[near] == own).sum(axis=1)
        if len(same):
            best = int(same.argmax())
            if same[best] >= self.least:
                return self.names[best if keys is None else near[best]]
        if n == len(self.heads):
            self.heads = np.concatenate([self.heads, np.empty_like(self.heads)])
        self.heads[n] = own
        self.names.append(line)
        if self.parts and n + 1 >= self.many:
            for k in range(n + 1) if n + 1 == self.many else (n,):
                for x in self._keys(self.heads[k]):
                    self.index.setdefault(x, []).append(k)
        return line


def _templates(depth: int, similarity: float, leaf_lines: int):
    """For each leaf, whose rows come together and in order of line: lines that aren't the first of their template, and that first line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.focus(CODES)
        last, first, groups = None, None, {}

        def name(line: int, rest: bytes) -> int:
            tokens = rest.split(b" ")
            own = np.fromiter(map(CODES.__getitem__, tokens), U64, len(tokens))
            CODES.trim()
            if len(tokens) not in groups:
                groups[len(tokens)] = Leaf(len(tokens), depth, similarity, max(1, leaf_lines))
            return groups[len(tokens)].name(line, own)

        for batch in batches:
            leaf, line, rest = batch.column("leaf").to_numpy(), batch.column("line").to_numpy(), batch.column("rest")
            if not len(leaf):
                continue
            before = np.empty(len(leaf), bool)
            before[0], before[1:] = last is not None and leaf[0] == last[0], leaf[1:] == leaf[:-1]
            copy = np.empty(len(leaf), bool)
            copy[0], copy[1:] = last is not None and line[0] == last[1], line[1:] == line[:-1]
            out, names = [], []
            for i in np.flatnonzero(before & ~copy).tolist():
                # The first line of a leaf is named only where a second one comes.
                k = i - 1
                while k >= 0 and before[k] and copy[k]:
                    k -= 1
                if k >= 0 and not before[k]:
                    groups.clear()
                    name(int(line[k]), rest[k].as_py())
                elif k < 0 and first is not None:
                    groups.clear()
                    name(*first)
                first = None
                own = int(line[i])
                template = name(own, rest[i].as_py())
                if template != own:
                    out.append(own)
                    names.append(template)
            start = len(leaf) - 1
            while start >= 0 and before[start] and copy[start]:
                start -= 1
            if start >= 0 and not before[start]:
                first = (int(line[start]), rest[start].as_py())
            last = (leaf[-1], line[-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(names, pa.int64())], ["line", "template"])

    return run


def recurring_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 4, similarity: float = 0.85, leaf_lines: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(lines, drops): lines (doc, line) of all documents; drops (line, first_doc) for lines whose template recurs.

    A template recurs if two documents at least have it; first_doc is the least of them. The heads of a leaf are
    searched by keys once there are leaf_lines of them; results don't depend on that. Rows with a null id or text have
    no lines, and lines without a token are none; repeated rows of an id are one document.
    """
    docs = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where("text is not null and doc is not null")
    kind = docs.schema["doc"].dataType.simpleString()
    lines = materialize(docs.mapInArrow(_lines(depth, similarity), f"doc {kind}, line long, leaf long, rest binary"))
    # Only leaves of two lines or more are dealt out. They are marked in a bitmap of fixed size; leaves that it lets through besides do no harm.
    some = lines.where("rest is not null")
    word, bit = f"shiftrightunsigned(leaf, 6) & {WORDS - 1}L", "shiftleft(1L, cast(leaf & 63 as int))"
    marks = some.groupBy("leaf").agg(F.min("line").alias("a"), F.max("line").alias("z")).where("a <> z").groupBy(F.expr(word).alias("word")).agg(F.expr(f"bit_or({bit})").alias("bits"))
    shared = some.select("leaf", "line", "rest").join(F.broadcast(marks), F.expr(f"word = ({word}) and ({bit} & bits) <> 0"), "left_semi")
    grouped = shared.repartition("leaf").sortWithinPartitions("leaf", "line")
    named = grouped.mapInArrow(_templates(depth, similarity, leaf_lines), "line long, template long")
    docs_of = lines.groupBy("line").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"))
    told = materialize(docs_of.join(named, "line", "left").select("line", F.coalesce("template", "line").alias("template"), "first_doc", "last_doc"))
    spread = told.groupBy("template").agg(F.min("first_doc").alias("a"), F.max("last_doc").alias("z")).where("a <> z")
    return lines.select("doc", "line"), told.join(spread, "template").select("line", F.col("a").alias("first_doc"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 4, similarity: float = 0.85, drop_empty: bool = False, leaf_lines: int = 4096) -> DataFrame:
    """df with recurring lines taken out of the texts, and n_lines and n_dropped (lines with a token) as columns.

    Columns of these two names are replaced; others may have any name. Repeated rows of one id count as one document;
    rows with a null id or text stay as they are, and so do empty texts; of equal lines, the one in the document of the
    least id stays, and that document keeps all of its own. Whole texts are read, of any length; an empty table gives
    none. drop_empty leaves out rows that lost all their lines.
    """
    lines, drops = recurring_lines(df, id_col, text_col, depth, similarity, leaf_lines)
    rows = df.drop("n_lines", "n_dropped")
    key, drop = unused(rows, "doc", "drop")
    hit = lines.select("doc", "line").join(drops, "line").where("doc <> first_doc").groupBy(F.col("doc").alias(key)).agg(F.collect_set("line").alias(drop))
    rows = rows.join(hit, F.col(id_col) == F.col(key), "left").drop(key)
    names = [c for c in rows.columns if c != drop]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts, counts, gone = [], [], []
            for text, own in zip(batch.column(text_col).to_pylist(), batch.column(drop).to_pylist()):
                parts = text.encode().split(b"\n") if text is not None else []
                if own is None:
                    counts.append(sum(1 for x in parts if x and not x.isspace()))
                    gone.append(0)
                    texts.append(text)
                    continue
                bad = {x & 0xFFFFFFFFFFFFFFFF for x in own}
                parsed = [(x, *parse_line(x)) for x in parts]
                kept = [x for x, h, tokens in parsed if not (tokens and h in bad)]
                counts.append(sum(1 for *_, tokens in parsed if tokens))
                gone.append(len(parts) - len(kept))
                texts.append(b"\n".join(kept).decode())
            columns = [pa.array(texts, batch.schema.field(n).type) if n == text_col else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_lines", "n_dropped"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != drop)
    out = rows.mapInArrow(run, f"{schema}, n_lines long, n_dropped long")
    return out.where("n_dropped = 0 or n_dropped < n_lines") if drop_empty else out
