"""Language identification by compression: the zstandard dictionary that makes a text smallest names its language.

Each language has a few dictionaries of raw content, of the beginnings of labelled texts, in a bounded sample. A text's size under
a language is the median over its dictionaries, so that a copy with a wrong label in one of them has no say. A text
is rejected where the two smallest sizes are nearly equal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Memo, as_text, slices

LETTERS = re.compile(r"[^\W\d_]")
SIGNS = re.compile(r"[\W\d_]+")
#: Margins up to this are rejected; README has what it rejects.
MIN_MARGIN = 0.02


@dataclass(frozen=True)
class CompressionModel:
    dictionaries: tuple[tuple[str, tuple[bytes, ...]], ...]
    level: int = 3


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def normalize(text: str) -> bytes:
    """Lower case, with single blanks for all that isn't a letter."""
    return SIGNS.sub(" ", text.lower()).encode()


def fit_languages(df: DataFrame, text_col: str = "text", lang_col: str = "lang", texts: int = 384, longest: int = 8192, size: int = 131072, parts: int = 3, languages: int = 200) -> CompressionModel:
    """`parts` dictionaries of `size` bytes each from at most `texts` labelled texts per language, by their first `longest` characters.

    These are the bounds of the sample: texts with the least hashes are taken, so the choice depends on the texts
    alone, and equal texts count once, in the counts of each language over all rows as well. Null texts and labels
    are left out; more than `languages` labels are an error, and so is a label without a drawn text. The driver gets
    `size * parts` characters or so per language, whatever the texts' lengths: texts beyond that aren't collected.
    """
    rows = df.select(F.substring(text_col, 1, longest).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and length(text) > 0")
    rows = rows.withColumn("h", F.xxhash64("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(languages + 1).collect()}
    if len(counts) > languages:
        raise ValueError(f"more than {languages} languages")
    if not counts:
        return CompressionModel(())
    # A hash threshold leaves a few times the texts that are needed, whatever a language's share of the rows and of copies.
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, 4 * texts / n)))), F.col("lang"))
    draw = rows.where((F.pmod("h", F.lit(1 << 30)) / float(1 << 30)) < share).distinct()
    order = Window.partitionBy("lang").orderBy("h", "text")
    first = draw.withColumn("r", F.row_number().over(order)).where(F.col("r") <= texts)
    # A text that comes when the ones before fill all dictionaries adds nothing.
    first = first.withColumn("before", F.sum(F.length("text")).over(order) - F.length("text")).where(F.col("before") < 2 * size * parts)
    content: dict[str, list[bytearray]] = {k: [bytearray() for _ in range(parts)] for k in counts}
    for r in first.orderBy("lang", "r").select("lang", "text").collect():
        least = min(content[r["lang"]], key=len)
        if len(least) < size:
            least += normalize(r["text"])
    if bare := [k for k, v in content.items() if not any(v)]:
        raise ValueError(f"no text drawn for {sorted(bare)}")
    return CompressionModel(tuple((k, tuple(bytes(x[:size]) for x in v if x)) for k, v in sorted(content.items())))


def compressed_sizes(model: CompressionModel):
    """A function that gives a text's compressed size under each language."""
    compressors = []
    for _, contents in model.dictionaries:
        own = []
        for content in contents:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=model.level)
            own.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        compressors.append(own)
    return lambda data: [sorted(len(c.compress(data)) for c in own)[len(own) // 2] for own in compressors]


def predict_languages(df: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, margin and rejected for every row.

    margin: by how much of its size the second-smallest encoding is larger; score: 1 - exp(-20 margin). Equal sizes
    go to the first language by name, with margin 0. Whole texts are read; repeated rows have equal results, null ids
    stay null, an empty table gives none, and other columns of df aren't looked at. Null texts and texts without a letter, and all texts under an
    empty model, are `und`, with score 0, and rejected, as are texts with a margin of min_margin or less.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.focus()
        sizes, names = compressed_sizes(model), [k for k, _ in model.dictionaries]
        for batch in slices(batches, "text"):
            best, margin = [], []
            for text in as_text(batch.column("text")):
                if not names or not LETTERS.search(text):
                    best.append("und")
                    margin.append(0.0)
                    continue
                size = sizes(normalize(text))
                low = min(range(len(size)), key=size.__getitem__)
                rest = size[:low] + size[low + 1 :]
                best.append(names[low])
                margin.append((min(rest) - size[low]) / min(rest) if rest else 1.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(best, pa.string()), pa.array(margin, pa.float64())], ["doc_id", "lang_pred", "margin"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, margin double")
    return rows.select("doc_id", "lang_pred", (1 - F.exp(F.col("margin") * -20)).alias("score"), "margin", ((F.col("lang_pred") == "und") | (F.col("margin") <= min_margin)).alias("rejected"))


def keep_identified(df: DataFrame, model: CompressionModel, text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of df whose text isn't rejected; columns are those of df, whatever their names.

    Null and empty texts, texts without a letter and, under an empty model, all texts are rejected; so are ties and
    margins of min_margin or less. Whole texts are read; repeated rows stay or go alike.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.focus()
        sizes = compressed_sizes(model)
        for batch in slices(batches, text_col):
            keep = []
            for text in as_text(batch.column(text_col)):
                size = sorted(sizes(normalize(text))) if model.dictionaries and LETTERS.search(text) else []
                keep.append(bool(size) and (len(size) == 1 or (size[1] - size[0]) / size[1] > min_margin))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema).select(*names)
