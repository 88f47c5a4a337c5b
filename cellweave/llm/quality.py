"""Quality rules with tokeniser fertility.

A public vocabulary measures how well a text's words fit it: characters per token, the share of tokens that are
byte fallbacks, and the entropy of the token distribution. Each script has bands outside of which a document is
rejected. Word-window repetition and length are checked before that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Memo, as_bytes, slices, windows

# Scripts by code-point ranges of their letters; every other letter counts as "other".
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF),
    ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("cjk", 0x3040, 0x30FF), ("cjk", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7A3),
)
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Least and most characters per token, most byte-fallback share, least entropy in bits.

    Entropy grows with the length of a text, so its band is a line through (tokens, bits), over the logarithm of tokens;
    shorter texts than the first point have no such band, and longer ones than the last have its value.
    """

    chars: tuple[float, float] = (1.0, 12.0)
    fallback: float = 0.5
    entropy: tuple[tuple[int, float], ...] = ((100, 3.0),)

    def least_entropy(self, tokens: int) -> float:
        if tokens < self.entropy[0][0]:
            return 0.0
        return float(np.interp(np.log(tokens), [np.log(n) for n, _ in self.entropy], [bits for _, bits in self.entropy]))


def script_bands() -> dict[str, Bands]:
    """Bands by script for a vocabulary of 32,000 pieces that is made for Latin script, with byte fallback.

    Latin's are set on the tables' documents. For the others, what counts is how the vocabulary holds a script: Cyrillic
    has 1,700 pieces, so words take fewer tokens than letters; alphabets have their single letters, so there is about
    a token a letter and one a word, and hardly a byte; ideographs and syllables have the common ones, and each
    missing one takes three bytes.
    """
    letters = Bands(chars=(0.5, 2.0), fallback=0.2)
    own = {"latin": Bands(chars=(1.6, 9.0), fallback=0.1, entropy=((50, 4.2), (180, 5.3), (600, 5.95), (2000, 6.2))), "cyrillic": Bands(chars=(1.0, 6.0), fallback=0.1)}
    own |= dict.fromkeys(("greek", "armenian", "hebrew", "arabic", "devanagari", "thai", "georgian"), letters)
    return own | {"cjk": Bands(chars=(0.5, 2.0), fallback=0.6), "hangul": Bands(chars=(0.35, 2.0), fallback=0.85), "none": Bands(chars=(0.0, 0.0))}


@dataclass(frozen=True)
class FertilityRules:
    """Bands by script; scripts without any have `default`, which lets all of a text be bytes. A text without letters is never kept."""

    bands: dict = field(default_factory=script_bands)
    default: Bands = Bands(chars=(0.2, 3.0), fallback=1.0)
    min_words: int = 20
    repeat_percent: int = 30
    window: int = 8


_LOADED: dict = {}


def _load(path: str):
    if path not in _LOADED:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        fallback = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
        _LOADED[path] = (model, Memo(), fallback)
    return _LOADED[path]


HASHES = Memo(xxhash.xxh3_64_intdigest)


def repeated_words(hashes: np.ndarray, k: int) -> int:
    """Words in k-word windows that stand twice or more in the text."""
    n = len(hashes)
    if n <= k:
        return 0
    _, inverse, counts = np.unique(windows(hashes, k), return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[inverse] > 1)
    if not len(again):
        return 0
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + k, -1)
    return int(np.count_nonzero(np.cumsum(cover)))


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def script_of(text: str) -> str:
    """The script of most letters, judged by distinct letters' counts; `none` without letters."""
    counts: dict[str, int] = {}
    for c in set(text):
        if c.isalpha():
            name = next((s for s, a, b in SCRIPTS if a <= ord(c) <= b), "other")
            counts[name] = counts.get(name, 0) + text.count(c)
    return max(sorted(counts), key=counts.__getitem__) if counts else "none"


def measure(batch_texts: list[bytes], path: str, rules: FertilityRules) -> list[tuple]:
    """One row of figures per text, in the order of FIELDS."""
    model, memo, fallback = _load(path)
    Memo.focus(memo, HASHES)
    split = [t.split() for t in batch_texts]
    new = memo.unseen(set().union(*split))
    for word, ids in zip(new, model.encode([w.decode() for w in new], num_threads=1) if new else []):
        memo[word] = np.array(ids, np.uint16 if model.get_piece_size() <= 65536 else np.uint32).tobytes()
    kind, out = np.uint16 if model.get_piece_size() <= 65536 else np.uint32, []
    for text, words in zip(batch_texts, split):
        n = len(words)
        hashes = np.fromiter(map(HASHES.__getitem__, words), U64, n)
        repeat = repeated_words(hashes, rules.window)
        joined = b"".join(words)
        chars = len(joined) if joined.isascii() else len(joined.decode())
        symbols = len(text) - len(text.translate(None, SYMBOLS))
        ids = np.frombuffer(b"".join(map(memo.__getitem__, words)), kind)
        count = np.bincount(ids)
        p = count[count > 0] / max(1, len(ids))
        entropy = float(-(p * np.log2(p)).sum()) + 0.0
        share = float(fallback[ids].mean()) if len(ids) else 0.0
        fertility = chars / len(ids) if len(ids) else 0.0
        failed = n < rules.min_words or 100 * repeat > rules.repeat_percent * n
        script = script_of(text.decode())
        band = rules.bands.get(script, rules.default)
        fits = band.chars[0] <= fertility <= band.chars[1] and share <= band.fallback and entropy >= band.least_entropy(len(ids))
        out.append((n, chars, symbols, duplicate_lines(text), repeat, len(ids), fertility, share, entropy, script, failed, fits and not failed))
    memo.trim()
    HASHES.trim()
    return out


FIELDS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "n_tokens": "long", "chars_per_token": "double", "fallback_share": "double", "token_entropy": "double", "script": "string", "base_failed": "boolean", "kept": "boolean"}
_ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def score_quality(df: DataFrame, path: str, rules: FertilityRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and FIELDS for every row. Null or empty text: no words, so base_failed and not kept.

    Whole texts are read, whatever their length; repeated rows have equal figures, an empty table gives none, null ids
    stay null, and other columns of df aren't looked at. Ties between scripts go to the first by name.
    """
    kind, r = df.schema[id_col].dataType.simpleString(), rules or FertilityRules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            rows = measure(as_bytes(batch.column("text")), path, r)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, _ARROW[k]) for x, k in zip(zip(*rows), FIELDS.values()))], ["doc_id", *FIELDS])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} {k}" for n, k in FIELDS.items()))


def keep_quality(df: DataFrame, path: str, rules: FertilityRules | None = None, text_col: str = "text") -> DataFrame:
    """The rows of df that the rules keep, null and empty texts not among them; columns are those of df, whatever their names.

    Repeated rows stay or go alike; only the text is looked at.
    """
    r = rules or FertilityRules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 2 << 20):
            yield batch.filter(pa.array([x[-1] for x in measure(as_bytes(batch.column(text_col)), path, r)], pa.bool_()))

    return df.mapInArrow(run, df.schema)
