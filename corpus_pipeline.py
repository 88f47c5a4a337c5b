"""The corpus pipeline: quality rules, language ID, line dedup, near duplicates, packing.

Every stage works on whole texts of all rows it gets, of any length, takes null ids, empty tables and further columns
of any name, and treats repeated rows alike. Null and empty texts go in the first stage, which needs words.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import jaccard, langid, linededup, packing, quality
from cellweave.llm.common import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep: words enough, little repetition, and a tokeniser's figures within their script's bands."""
    return quality.keep_quality(docs, public_tokenizers.path("piece_bpe_32k.model"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compressors tell apart, fitted on those not held out; ties and narrow margins go."""
    model = langid.fit_languages(docs.where(~F.coalesce(langid.held_out("doc_id"), F.lit(False))))
    return langid.keep_identified(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document (by id) has; documents of nothing but such lines go. Rows with a null id stay as they are."""
    rows = linededup.dedup_lines(docs, drop_empty=True)
    columns = [F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return rows.select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, a similarity of 0.8 or more; the least id stays, null ids last, one of equal rows."""
    return jaccard.drop_near_duplicates(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their places in sequences; equal pieces are interchangeable."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("best_fit_packing", best_fit_packing)]
#: No SQL: tokenisers, compressors and template trees aren't expressible there; tests/llm hold the stages, one by one and in a row, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
