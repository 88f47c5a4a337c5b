"""Token counts by overlap resynchronisation.

Huge documents are encoded in overlapping chunks with offsets. Two neighbouring encodings are spliced where both
have the same tokens at the same places and the pre-tokeniser starts afresh, so that what follows can't depend on what
came before: after white space, and where letters, digits and other signs change (but for apostrophes, which may begin
a contraction, and marks, which may join a letter). If an overlap holds no such place, it is widened; a stretch without
any is encoded as one, in twice the length each time. Encodings of white-space parted words don't depend on their
neighbours either, so counts of short documents (up to `chunk` characters, which most are) are sums over a memo of
words. Both are proven for one pre-tokeniser, which drops white space and splits at it (WORDS); a file with another one, or a
sentencepiece model, goes to its library text by text, whatever their length.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, as_text, slices

_LOADED: dict = {}
#: Characters at which str.split parts words, but not the library.
ODD = re.compile("[\x1c-\x1f]")


#: The pre-tokeniser and the normaliser for which splices and sums over words are proven.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def parts_words(settings: dict) -> bool:
    """Whether a tokenizers file drops white space, splits at it and at changes of kind, and looks at nothing beyond a split."""
    before, after = settings.get("normalizer") or {}, settings.get("pre_tokenizer") or {}
    steps = after.get("pretokenizers") or [{}]
    split = {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}
    plain = all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex", True) for x in steps[1:])
    return before.get("normalizers") == NORMAL and steps[0] == split and plain and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in settings.get("added_tokens", []))


def load_tokenizer(path: str):
    """(the library's tokenizer, a memo of words or None if it doesn't part words): tokenizers for .json, sentencepiece for .model; other kinds raise."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _LOADED:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _LOADED[path] = (tokenizer, Memo() if parts_words(json.loads(tokenizer.to_str())) else None)
        elif path.endswith(".model"):
            import sentencepiece

            _LOADED[path] = (sentencepiece.SentencePieceProcessor(model_file=path), None)
        else:
            raise ValueError(f"{path} is neither a .json nor a .model file")
    return _LOADED[path]


def _encode(tokenizer, text: str, base: int) -> list[tuple[int, int, int]]:
    e = tokenizer.encode(text, add_special_tokens=False)
    return [(base + a, base + b, i) for i, (a, b) in zip(e.ids, e.offsets)]


def _kind(c: str) -> str:
    """L for letters, N for numbers, M for marks, O for the rest."""
    k = unicodedata.category(c)[0]
    return k if k in "LNM" else "O"


def _fresh(text: str, k: int) -> bool:
    """Whether the pre-tokeniser starts afresh at place k, whatever stands before k - 1."""
    before, after = text[k - 1], text[k]
    if before in " \n\t\r":
        return True
    a, b = _kind(before), _kind(after)
    return a != b and "M" not in (a, b) and not (before == "'" and b == "L")


def _splice(left: list, right: list, text: str, low: int, high: int, agree: int = 4) -> tuple[int, int] | None:
    """Positions in left and right of the first token in low..high from which both agree and at which pre-tokenising starts afresh."""
    at = {t[0]: k for k, t in reversed(list(enumerate(right)))}
    for k in range(len(left)):
        start = left[k][0]
        if low < start <= high and start < len(text) and (j := at.get(start)) is not None and _fresh(text, start):
            same = [t for t in left[k : k + agree] if t[1] <= high]
            if same and same == right[j : j + len(same)]:
                return k, j
    return None


def count_long(tokenizer, text: str, chunk: int, overlap: int) -> int:
    """Tokens of a text in chunks of `chunk` characters; equal to the count of the whole."""
    total, start, end = 0, 0, min(chunk, len(text))
    tokens = _encode(tokenizer, text[:end], 0)
    while end < len(text):
        width = overlap
        while True:
            low = max(start, end - width)
            new_end = min(len(text), end + chunk)
            after = _encode(tokenizer, text[low:new_end], low)
            cut = _splice(tokens, after, text, low, end)
            if cut:
                total += cut[0]
                tokens, start, end = after[cut[1] :], after[cut[1]][0], new_end
                break
            if low == start:  # no place to splice since the last one: encode that stretch as one
                new_end = min(len(text), end + max(chunk, end - start))
                tokens = _encode(tokenizer, text[start:new_end], start)
                end = new_end
                break
            width *= 2
    return total + len(tokens)


def count_texts(path: str, texts: list[str], chunk: int = 32768, overlap: int = 512) -> list[int]:
    """The library's count of tokens of each text, without added ones."""
    tokenizer, memo = load_tokenizer(path)
    if memo is None:
        Memo.focus()
        if path.endswith(".model"):
            return [len(tokenizer.encode(t)) for t in texts]
        return [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    Memo.focus(memo)
    split = [t.split() if len(t) <= chunk and not ODD.search(t) else None for t in texts]
    new = memo.unseen(set().union(*(w for w in split if w)))
    for word, e in zip(new, tokenizer.encode_batch_fast(new, add_special_tokens=False) if new else []):
        memo[word] = len(e.ids)
    out = [sum(map(memo.__getitem__, w)) if w is not None else count_long(tokenizer, t, chunk, overlap) for w, t in zip(split, texts)]
    memo.trim()
    return out


def count_tokens(df: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", chunk: int = 32768, overlap: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; null text counts as empty, with 0 tokens.

    Whole texts are encoded, of any length; repeated rows have equal results, null ids stay null, an empty table gives
    none, and other columns of df aren't looked at.
    """
    ids = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            n = pa.array(count_texts(path, as_text(batch.column("text")), chunk, overlap), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")
    rows = df.select(F.col(id_col).alias("doc_id"), size, F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {ids}, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
