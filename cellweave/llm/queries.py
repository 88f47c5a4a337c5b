"""The contract queries over the driver's tables: thin digests of the operators' outputs."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, centroids, chat, decontaminate, jaccard, langid, linededup, ogg, oracles, packing, quality, tokencount, urlfilter, vectorcodes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return chat.digest_chat(chat.format_chat(rows.unionByName(extra)), in_order=True)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit_languages(docs.where(~F.coalesce(langid.held_out("doc_id"), F.lit(False))))
    out = langid.predict_languages(docs, model)
    return out.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs)


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def _bpe_digest(codec: bytebpe.ByteBpe, ids: list[int], _offsets: list[int]) -> tuple:
    text = ",".join(map(codec.decimal.__getitem__, ids))
    return len(ids), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bytebpe.encode_bpe(docs, path, finish=_bpe_digest, schema="n_tokens long, ids_sha256 string, decoded_sha256 string")


def _media_digest(packets: list[ogg.Packet], media: bytes, error: str | None) -> list[tuple]:
    if error:
        raise ValueError(error)
    payload = ogg.payload_of(packets)
    samples = np.frombuffer(payload, np.uint8)
    seconds = max((p.seconds or 0.0) for p in packets)
    feature = f"{len({p.serial for p in packets})} streams, {len(packets)} packets, {seconds:.4f} s, mean {samples.mean():.3f}, peak {samples.max()}"
    return [(len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature)]


def op9_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length(F.coalesce("text", F.lit("")))
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), size.cast("long").alias("n_bytes"), F.expr("rpad(cast(coalesce(text, '') as binary), greatest(64, cast(ceil(octet_length(coalesce(text, '')) / 64) * 64 as int)), X'00')").alias("payload"))
    media = ogg.encode_ogg(docs, "payload").drop("payload")
    digests = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return ogg.decode_ogg(media, keep=("n_bytes",), finish=_media_digest, schema=digests).withColumnRenamed("id", "doc_id")


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(_table(spark, sf_dir, "pages"), RULES)


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest_leaks(decontaminate.find_leaks(docs, _table(spark, sf_dir, "benchmark")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return vectorcodes.digest_codes(*vectorcodes.compress_vectors(vectors))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digest_clusters(*centroids.cluster_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_chat_format, op2_ngram_jaccard, op3_pack, op4_language, op5_quality, op6_line_dedup, op7_token_count, op8_byte_bpe, op9_ogg_media, op10_url_filter, op11_decontaminate, op12_vector_codes, op13_centroids)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    """Queries that SQL can express in full and soon enough; the others are tested against brute force in tests/llm."""
    return {"op1_chat_format": oracles.chat_sql(), "op2_ngram_jaccard": oracles.jaccard_sql(), "op10_url_filter": oracles.url_sql(RULES), "op11_decontaminate": oracles.leak_sql(), "op12_vector_codes": oracles.codes_sql(), "op13_centroids": oracles.clusters_sql()}
