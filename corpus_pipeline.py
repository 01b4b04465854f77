"""A corpus pipeline of five stages over ``documents``.

Quality rules, near-duplicates, personal data, mixing to target weights, SentencePiece encoding. Each
stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents`` (doc_id, text, lang, source, n_chars).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import mixing, near_dedup, pii, quality, sentencepiece_codec
from factloom.llm.common import forget, scratch, scratch_dir
from factloom.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame, text: str) -> DataFrame:
    """The columns of documents with another text."""
    return df.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes failed lines; documents that the rules reject go. A text is not bad for being short: one word is enough."""
    judged = quality.quality_rules(docs, keep=("doc_id", "lang", "source"), min_words=1)
    return _documents(judged.where("kept"), "clean_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: five-word shingles, similarity of 0.8 or more. Rows that
    share an id stay or go together."""
    kept = near_dedup.near_duplicates(docs, words=5, percent=80).where("kept").select(F.col("doc_id").alias("kept_id"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by labels, and generalises or removes words that reveal it."""
    found = pii.find_pii(docs, carry=("lang", "source"))
    return _documents(found.withColumn("clean", pii.masked(F.col("text"))), "clean")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document: whole epochs, then the fraction chosen."""
    mixed = mixing.mix_sources(docs, carry=("text", "lang", "source", "n_chars"))
    times = (F.col("epochs") + F.col("chosen").cast("long")).cast("int")
    return mixed.where(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), times))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every row."""
    coded = sentencepiece_codec.encode_texts(docs, tokenizer_path("piece_bpe_32k.model"), keep=("doc_id", "source"))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: SentencePiece encoding cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{scratch_dir(spark)}/factloom/stage-{i}-{uuid.uuid4().hex}"
        # what a stage saved on its way goes as soon as its result is written, and so does its input
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(path)
        if i:
            forget(before)
        docs = before = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
