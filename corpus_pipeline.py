"""A training corpus made of `documents`: filtered, deduplicated, decontaminated and packed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but
the last return the columns of `documents`; the last returns pieces of packed sequences. Every
stage's rows are written as Parquet before the next one reads them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.decontamination import CONTAMINATED_RATE, LEAST_EDITS, without_contamination
from ledgerloom.llm.near_duplicates import jaccard_join
from ledgerloom.llm.packing import pack_documents
from ledgerloom.llm.substrings import deduplicate_substrings
from ledgerloom.llm.tables import shared_folder, table
from ledgerloom.llm.toxicity import fitted_on_labels, score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine doesn't find toxic (score below 0.5)."""
    model = fitted_on_labels(spark, docs, sf_dir)
    return score_toxicity(docs, model, carry=COLUMNS).where("predicted = 0").select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the least doc_id; one without an id only where none has one.

    Rows are told apart by a 64-bit hash of all their columns, in which a null counts as a value
    of its own, so those that share an id, or have none, are each judged by their own text; rows
    equal in every column count as one.
    """
    rows = docs.select(*COLUMNS).withColumn("row_key", F.xxhash64(*COLUMNS, *(F.col(c).isNull() for c in COLUMNS)))
    classes = jaccard_join(rows.select(F.col("row_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("row_key"), "class_id").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    first = classes.join(rows.select("row_key", "doc_id").distinct(), "row_key").groupBy("class_id").agg(F.min(order).alias("first"))
    kept = rows.join(first.select(F.col("first.row_key").alias("row_key")), "row_key", "left_semi").dropDuplicates(["row_key"])
    return kept.select(*COLUMNS)


def remove_repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words that an earlier document holds too; emptied ones go."""
    kept = deduplicate_substrings(docs, carry=("lang", "source", "n_chars"))
    changed = F.col("n_removed") > 0
    n_chars = F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars").cast("long"))
    rows = kept.where(~changed | (F.col("n_removed") < F.col("n_words")))
    return rows.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), CONTAMINATED_RATE, least_edits=LEAST_EDITS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    pieces = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_near_duplicates),
    ("substring_dedup", remove_repeated_substrings),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus of a folder of tables; stages are written to the cluster's shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Fitted models and tokenizers are beyond SQL; the pipeline is tested stage by stage.
ORACLE_SQL: str | None = None
