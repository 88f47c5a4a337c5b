"""Best-fit packing by a configuration linear program.

Items are only counted by length, so the program doesn't grow with the data. A configuration is a multiset of
lengths that fits the capacity; the program asks for as few configurations as cover the histogram. Multiplicative
weights price lengths, a knapsack dynamic program finds the best configuration under these prices, and the mixture
is rounded: whole copies first, then what is left by best fit over counts. Items are matched to places by their rank
within a length, found in salted groups.
"""

from __future__ import annotations

import itertools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Memo, as_text, materialize, release, slices, unused


def best_configuration(weights: np.ndarray, capacity: int) -> list[int]:
    """Lengths of the multiset of largest weight that fits: an unbounded knapsack by dynamic programming.

    weights[l] is the price of length l.
    """
    lengths = np.flatnonzero(weights > 0)
    value, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    price = weights[lengths]
    for c in range(1, capacity + 1):
        n = np.searchsorted(lengths, c, side="right")
        value[c] = value[c - 1]
        if n:
            gain = value[c - lengths[:n]] + price[:n]
            k = int(gain.argmax())
            if gain[k] > value[c]:
                value[c], choice[c] = gain[k], lengths[k]
    out, c = [], capacity
    while c:
        if choice[c]:
            out.append(int(choice[c]))
            c -= choice[c]
        else:
            c -= 1
    return out


def configuration_program(histogram: np.ndarray, capacity: int, rounds: int = 1000, step: float = 0.5) -> dict[tuple[int, ...], float]:
    """A fractional cover of the histogram by configurations, near the least number of them.

    Multiplicative weights: a length's price starts a little above its size and falls as exp(-covered share). Each round buys the
    configuration of the largest price, a `step` of what the scarcest of its lengths needs, which lowers the
    prices of what it covers. Lengths that are covered are no longer offered, so none is covered twice.
    """
    need = histogram.astype(float)
    covered, mixture = np.zeros(len(need)), {}
    size = (np.arange(len(need)) / capacity) ** 1.2  # convex: long items first, short ones fill up
    for _ in range(rounds):
        spare = need - covered
        share = np.divide(covered, need, out=np.ones(len(need)), where=need > 0)
        config = best_configuration(np.where(spare > 1e-9, size * np.exp(-share), 0.0), capacity)
        if not config:
            break
        lengths, times = np.unique(config, return_counts=True)
        amount = float(np.minimum(spare[lengths], np.maximum(step * need[lengths], 1.0)).__truediv__(times).min())
        key = tuple(sorted(config, reverse=True))
        mixture[key] = mixture.get(key, 0.0) + amount
        covered[lengths] += amount * times
    return mixture


def least_sequences(histogram: np.ndarray, capacity: int, weights: np.ndarray | None = None) -> int:
    """A bound from below on the sequences that any packing needs, by the program's dual.

    Prices of lengths, divided by the price of the best configuration, are a solution of the dual, so their total over
    all items is a bound; sizes as prices give the volume bound, which always holds too.
    """
    size = np.arange(capacity + 1) / capacity
    bound = float(histogram @ size)
    if weights is not None and weights.any():
        best = sum(weights[x] for x in best_configuration(weights, capacity))
        bound = max(bound, float(histogram @ weights) / best)
    # Items over half of the capacity need a sequence each.
    return max(int(np.ceil(bound - 1e-9)), int(histogram[capacity // 2 + 1 :].sum()))


def best_fit(counts: np.ndarray, capacity: int, begun: list[tuple[tuple[int, ...], int]] = ()) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts, into what room bins that are begun have, first: (contents, bins) entries that hold each item once. Bins of equal contents are one entry."""
    open_: dict[int, list[list]] = {}  # by room: entries of contents and bins
    rooms = np.zeros(capacity + 1, np.int64)  # bins by room
    for contents, bins in begun:
        open_.setdefault(capacity - sum(contents), []).append([contents, bins])
        rooms[capacity - sum(contents)] += bins
    for length in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[length])
        while n:
            fits = np.flatnonzero(rooms[length:])
            room = int(fits[0]) + length if len(fits) else capacity
            if len(fits):
                contents, bins = open_[room].pop()
                rooms[room] -= bins
            else:
                contents, bins = (), -(-n // (capacity // length))
            # Each of the bins takes as many as fit, but for what would be more than there is.
            each = min(room // length, -(-n // bins))
            full = min(bins, n // each)
            rest = n - full * each if full < bins else 0
            groups = [(each, full), (min(rest, each), 1 if rest else 0), (0, bins - full - (1 if rest else 0))]
            for times, amount in groups:
                if amount > 0:
                    left = room - times * length
                    if contents or times:
                        open_.setdefault(left, []).append([(*contents, *[length] * times), amount])
                        rooms[left] += amount
                    n -= times * amount
    return [(tuple(c), b) for entries in open_.values() for c, b in entries]


def round_program(histogram: np.ndarray, mixture: dict[tuple[int, ...], float], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Configurations with whole numbers of copies that hold each item exactly once.

    Whole copies of the mixture come first, the fullest of them, and best fit takes the rest, into the room that these
    leave and then into sequences of its own. Of a few shares of the mixture, of all configurations or only of those without
    room, the plan with the fewest sequences is taken.
    """
    plans = []
    for share, all_ in itertools.product((1.0, 0.9, 0.5), (True, False)):
        left, plan = histogram.astype(np.int64).copy(), []
        for config, amount in sorted(mixture.items(), key=lambda x: (-sum(x[0]), -x[1], x[0])):
            lengths, times = np.unique(config, return_counts=True)
            copies = min(int(amount * share), int((left[lengths] // times).min()))
            if copies > 0 and (all_ or sum(config) == capacity):
                plan.append((config, copies))
                left[lengths] -= copies * times
        plans.append(best_fit(left, capacity, plan))
    return min(plans, key=lambda plan: sum(n for _, n in plan))


def pack(df: DataFrame, capacity: int, length_col: str = "length", order_cols: tuple[str, ...] = ("doc_id", "piece"), group_rows: int = 20000) -> DataFrame:
    """df with sequence_id and offset: items of 1..capacity tokens in as few sequences as the program finds.

    Offsets are gapless from 0. Rank groups are (length, salt), about group_rows items each at most, so a length
    that most items share is split. Equal rows are interchangeable. An empty table gives an empty one; null or
    out-of-range lengths raise. Existing columns of these two names are replaced; others may have any name.
    """
    items = df.drop("sequence_id", "offset")
    salt, rank, before = unused(items, "salt", "rank", "before")
    counts = {r[0]: r[1] for r in items.groupBy(length_col).count().collect()}  # at most `capacity` rows
    if any(k is None or not 1 <= k <= capacity for k in counts):
        raise ValueError("a length is null or out of range")
    histogram = np.zeros(capacity + 1, np.int64)
    for k, v in counts.items():
        histogram[k] = v
    plan = round_program(histogram, configuration_program(histogram, capacity), capacity)
    salts = max(1, -(-int(histogram.max()) // group_rows))
    tagged = items.withColumn(salt, F.pmod(F.xxhash64(*order_cols), F.lit(salts)))
    sizes = tagged.groupBy(length_col, salt).agg(F.count("*").alias("n"))
    starts = sizes.select(length_col, salt, (F.sum("n").over(Window.partitionBy(length_col).orderBy(salt)) - F.col("n")).alias(before))
    ranked = tagged.withColumn(rank, F.row_number().over(Window.partitionBy(length_col, salt).orderBy(*order_cols)) - 1).join(starts, [length_col, salt])
    ranked = ranked.select(*items.columns, (F.col(rank) + F.col(before)).alias(rank))
    return _place(ranked, plan, length_col, rank).select(*items.columns, "sequence_id", "offset")


def _place(ranked: DataFrame, plan: list, length_col: str, rank_col: str) -> DataFrame:
    """Look ranks up in the plan, which has some thousand entries whatever the data."""
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    cursor: dict[int, int] = {}
    base = 0
    for config, copies in plan:
        at = 0
        for length in sorted(set(config), reverse=True):
            times = config.count(length)
            table.setdefault(length, []).append((cursor.get(length, 0), times, base, at))
            cursor[length] = cursor.get(length, 0) + times * copies
            at += times * length
        base += copies
    index = {k: np.array(v, np.int64) for k, v in table.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (length_col, rank_col))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                mine = np.flatnonzero(length == k)
                rows = index[int(k)]
                row = rows[np.searchsorted(rows[:, 0], rank[mine], side="right") - 1]
                nth = rank[mine] - row[:, 0]
                sequence[mine] = row[:, 2] + nth // row[:, 1]
                offset[mine] = row[:, 3] + nth % row[:, 1] * k
            names = [n for n in batch.schema.names if n != rank_col]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != rank_col)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")
#: A blank before white space: only there do slices reach over the blanks at which texts are cut.
RUNS = re.compile(r" \s")
SPECIAL = "<|endoftext|>"


def _byte_signs() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Tokens:
    """Ids of a byte-level BPE file, as little-endian 32-bit words, by a memo of blank-parted units.

    The units of a text without runs of blanks are encoded alike wherever they stand; other texts, and those that
    name the special token, are encoded by the library as a whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        # The same vocabulary as ranks, for a faster merge loop over single units: ids follow the order of merges.
        sign = {c: b for b, c in _byte_signs().items()}
        ranks = {bytes(sign[c] for c in t): i for t, i in self.library.get_vocab(with_added_tokens=False).items()}
        import tiktoken

        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        ranked = tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        whole, single = ranked.encode_ordinary, ranked._core_bpe.encode_single_piece
        self.units = Memo(lambda u: np.array(single(u.encode()) if WORD.fullmatch(u) else whole(u), "<u4").tobytes())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes. One text's units are held at a time."""
        out = []
        for t in texts:
            if SPECIAL in t or RUNS.search(t):
                out.append(np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
            else:
                units = [" " + u for u in t.split(" ")]
                units[0] = units[0][1:]
                out.append(b"".join(map(self.units.__getitem__, units)))
        self.units.trim()
        return out


_LOADED: dict[str, Tokens] = {}


def _load(path: str) -> Tokens:
    """The worker's vocabulary, loaded once.

    Nested functions come to workers with copies of the module's variables that they name, a new copy for each task, and
    a vocabulary in a copy is loaded anew and stays, by its memo. Functions of the module see the variable itself.
    """
    if path not in _LOADED:
        Memo.focus()  # what other stages held goes before the vocabulary comes
        _LOADED[path] = Tokens(path)
        release()
    Memo.focus(_LOADED[path].units)
    return _LOADED[path]


def cut_pieces(df: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most `capacity` tokens: doc_id, piece, start, length, ids_crc32.

    A document is its ids and end_id; null text counts as empty, so it is end_id alone. A longer one is cut into pieces
    of `capacity` tokens, of which the first takes what remains. Whole texts are encoded; repeated rows and null ids
    are documents like others; an empty table gives none; other columns of df aren't looked at.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = _load(path), struct.pack("<I", end_id)
        for batch in slices(batches, "text", 1 << 20):
            row, piece, start, length, crc = [], [], [], [], []
            for r, ids in enumerate(tokens.encode(as_text(batch.column("text")))):
                ids += end
                n = len(ids) // 4
                at, k, size = 0, 0, n % capacity or capacity
                while at < n:
                    row.append(r)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    at, k, size = at + size, k + 1, capacity
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_documents(df: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with sequence_id and offset; see cut_pieces and pack. The pieces are written once, for they are counted and then placed."""
    return pack(materialize(cut_pieces(df, path, capacity, end_id, id_col, text_col)), capacity, order_cols=("doc_id", "piece", "start", "ids_crc32"))
