"""Documents to tokens in five stages; each works on everything its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersift.cluster import stored
from ledgersift.llm.line_dedup import dedup_lines
from ledgersift.llm.piece_tokens import MODEL, token_digest
from ledgersift.llm.quality_rules import quality_filter
from ledgersift.llm.similar_texts import drop_similar_texts
from ledgersift.llm.source_mixing import mix_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go, but for the first of each; n_chars follows the text."""
    cut = dedup_lines(docs).drop("__n_lines", "__dropped")
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: SimHash and MinHash candidates whose five-word shingles agree to 0.8 or more."""
    return drop_similar_texts(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents as the mix takes them, repeats included."""
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, a digest of the ids and the round trip of every piece."""
    return token_digest(docs, MODEL, "doc_id", "source")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("SimHash near-dedup by shingles", near_duplicates),
    ("source mixing", mixture),
    ("SentencePiece tokens", tokens),
]
ORACLE_SQL = None  # estimates, permutations and tokens are beyond SQL; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; every result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
