"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by offsets.

Slices are found without regular expressions. Most boundaries are changes of code-point class, seen by comparing
shifted arrays. Contractions ('s, 't, 're ...) depend on where an apostrophe stands, so they are found by a finite
automaton, whose per-character transition functions are composed by an associative scan in doubling steps.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, as_text, slices

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
_CLASSES: dict = {}
# States of the automaton after a character: nothing special; an apostrophe at a slice's start; one that r or v
# follows; one that l follows; a contraction's end; inside a run of other characters; after a blank.
PLAIN, APOS, HALF, ELL, DONE, RUN, BLANK = range(7)


def class_table() -> np.ndarray:
    """The class of every code point."""
    if "table" not in _CLASSES:
        white = {9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        table[list(white)] = SPACE
        _CLASSES["table"] = table
    return _CLASSES["table"]


def _transitions(cp: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """The transition function of each character as a column: row s holds the state that follows state s."""
    f = np.zeros((7, len(cp)), np.uint8)
    f[:, cls == OTHER] = RUN
    f[:, cp == 32] = BLANK
    apos = np.flatnonzero(cp == 39)
    f[:, apos] = APOS
    f[np.ix_([APOS, RUN, BLANK], apos)] = RUN
    f[APOS, np.isin(cp, [115, 116, 109, 100])] = DONE
    f[APOS, np.isin(cp, [114, 118])] = HALF
    f[APOS, cp == 108] = ELL
    f[HALF, cp == 101] = DONE
    f[ELL, cp == 108] = DONE
    return f


def scan(f: np.ndarray) -> np.ndarray:
    """State after each character, from PLAIN: an inclusive scan under composition, doubling until all prefixes are constant."""
    f, step, n = f.copy(), 1, f.shape[1]
    f[:, :1] = f[PLAIN, 0] if n else 0
    while step < n and not (f == f[0]).all():
        f[:, step:] = np.take_along_axis(f[:, step:], f[:, :-step].astype(np.intp), axis=0)
        step *= 2
    return f[0]


def slice_starts(cp: np.ndarray) -> np.ndarray:
    """Where slices start in an array of code points."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    cls = class_table()[cp]
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(cls[1:], cls[:-1], out=start[1:])
    ends = np.flatnonzero((cls[:-1] == SPACE) & (cls[1:] != SPACE))  # a last white-space character before something else
    start[ends] = True
    start[ends[cp[ends] == 32] + 1] = False  # a blank goes with what follows
    apos = np.flatnonzero(cp == 39)
    if len(apos):
        near = np.unique(np.concatenate([apos - 1, apos, apos + 1, apos + 2, apos + 3]))
        near = near[(near >= 0) & (near < n)]
        f = _transitions(cp[near], cls[near])
        fresh = np.flatnonzero(np.diff(near, prepend=-2) > 1)  # what stands before is no part of a contraction
        f[:, fresh] = f[PLAIN, fresh]
        done = near[scan(f) == DONE]
        two = np.isin(cp[done], [101, 108])
        start[done] = False
        start[done[two] - 1] = False
        after = done + 1
        start[after[after < n]] = True
    return np.flatnonzero(start)


class ByteBpe:
    """Encoder and decoder over the ranks of a file of base64 tokens and numbers."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        # The library's merge loop is used on single slices; its own splitting pattern is never applied.
        core = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.vocab = {i: b for b, i in ranks.items()}
        self.decimal = {i: str(i) for i in self.vocab}
        self.memo = Memo(core.encode_single_piece)

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids, and the byte offset of each slice."""
        data = text.encode()
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = slice_starts(cp)
        if len(data) != len(cp):
            width = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
            starts = (np.cumsum(width) - width)[starts]
        offsets = starts.tolist()
        pieces = [data[a:b] for a, b in zip(offsets, [*offsets[1:], len(data)])]
        return list(chain.from_iterable(map(self.memo.__getitem__, pieces))), offsets

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


_LOADED: dict[str, ByteBpe] = {}


def codec(path: str) -> ByteBpe:
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def encode_bpe(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", finish=None, schema: str = "ids array<int>, offsets array<int>") -> DataFrame:
    """doc_id and the encoding of every text; null text counts as empty, which has no ids.

    Whole texts are encoded, of any length; repeated rows have equal results, null ids stay null, an empty table gives
    none, and other columns of df aren't looked at.

    finish(codec, ids, offsets) may turn an encoding into other columns (of `schema`) inside the worker, so that
    ids need not travel.
    """
    kind = df.schema[id_col].dataType.simpleString()
    finish = finish or (lambda _, ids, offsets: (ids, offsets))
    types = [(f.name, f.dataType) for f in df.sparkSession.createDataFrame([], schema).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        bpe, kinds = codec(path), [to_arrow_type(t) for _, t in types]
        Memo.focus(bpe.memo)
        for batch in slices(batches, "text", 1 << 20):
            rows = [finish(bpe, *bpe.encode(t)) for t in as_text(batch.column("text"))]
            bpe.memo.trim()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(zip(*rows), kinds))], ["doc_id", *(n for n, _ in types)])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, {schema}")


def decode_bpe(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with the decoded bytes of an id column; null ids give null, no ids no bytes; an unknown id raises. A column of the new one's name is replaced."""
    decode = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else codec(path).decode(x.tolist())), "binary")
    return df.withColumn(text_col, decode(F.col(ids_col)))
