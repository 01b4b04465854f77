"""Registered queries of the training-data operators: thin digests of the operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import conversation_repair, language_id, lexical_search, licenses, media, mixing, near_dedup, pii, quality, sentencepiece_codec, sharding, token_counts, url_filters
from factloom.llm.common import documents, text_of


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.span_digest(pii.KINDS), 256).alias("base_sha256"),
        pii.span_digest((*pii.KINDS, "generalised", "removed")).alias("spans"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.encode_texts(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.xxhash64("begins", "ends").alias("spans_hash"),
    )


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    stored = docs.select("doc_id", F.octet_length(text_of(docs)).cast("long").alias("n_bytes"), media.text_media(docs["text"]).alias("media"))
    read = media.media_columns(stored.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)}), keep=("doc_id", "n_bytes", "media_bytes", "media_sha256"))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -16, 16)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.col("dhash").alias("feature"),
        F.sha2("tile_npy", 256).alias("tile_sha256"),
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(documents(spark, sf_dir))
    return found.select("doc_id", "license", F.round("dice", 6).alias("dice"), F.array_join(F.array_distinct(F.transform("matches", lambda m: m["license"])), ",").alias("licenses"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), words=2)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = language_id.train(docs.where(~F.coalesce(held_out, F.lit(False))))
    found = language_id.language_spans(docs, model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir), cleaned=False)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation_repair.repair_conversations(conversation_repair.damaged(rows), rows)


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(url_filters.RULES), "host string, path string, verdict string")
    return url_filters.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


QUERIES = {
    "op1_pii": op1_pii,
    "op2_sharding": op2_sharding,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_media": op4_media,
    "op5_licenses": op5_licenses,
    "op6_token_counts": op6_token_counts,
    "op7_near_dedup": op7_near_dedup,
    "op8_language_id": op8_language_id,
    "op9_quality": op9_quality,
    "op10_mixing": op10_mixing,
    "op11_lexical_search": op11_lexical_search,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_url_filters": op13_url_filters,
}
