"""From documents to packed training sequences: five stages, each on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents. Rows that
share a doc_id but not their text are documents of their own. A null doc_id passes the near-duplicate stage and is never
earlier than another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hippospark.llm import mixing, packing, parity_join, quality, suffix_dedup

#: Near duplicates: five-word shingles with a Jaccard similarity of 0.8 or more.
SHINGLE, SIMILAR = 5, (80, 100)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit the ordinal classifier on the labelled documents and drop those that it rejects.

    Null and empty texts are graded like any other; repeated rows are graded alike; a null doc_id is never labelled but
    graded; extra columns are carried as they are.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.grade(docs, model).where("keep").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least doc_id of each component of near duplicates; other texts under a doc_id stand for themselves."""
    groups = parity_join.jaccard_components(docs, SHINGLE, *SIMILAR, with_keys=True)
    others = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    return docs.join(others, (docs["doc_id"].cast("long") == others["_id"]) & (parity_join.text_key(docs["text"]) == others["_key"]), "left_anti").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove bytes that repeat an earlier document's; a character that is cut through goes as a whole."""
    out = suffix_dedup.suffix_dedup(docs)
    # a text without removals stays as it is
    clean = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "�", ""))
    columns = {"doc_id": F.col("doc_id"), "text": clean, "n_chars": F.char_length(F.coalesce(clean, F.lit(""))).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*[(columns[c] if c in columns else F.col("rest")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix draws it, shard by shard in the order of the slots.

    A null or empty text is never taken; a null source is a source of its own; documents without an id, repeated rows and
    extra columns are carried as they are.
    """
    return mixing.in_order(mixing.mix(docs, mixing.word_count("text")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack token pieces into sequences of 1024. A null text is empty and yields its end token; repeated rows are packed each; a null doc_id is carried; extra columns go."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", classify),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_passages),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The classifier, the draws and the tokenizer are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
