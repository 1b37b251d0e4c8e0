"""From raw documents to token files: the stages of a training-data pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealdex.llm.decontamination import contaminated
from sealdex.llm.mixing import mixed_rows
from sealdex.llm.near_duplicates import near_duplicate_groups
from sealdex.llm.quality import accepted, train
from sealdex.llm.queries import VOCABULARY
from sealdex.llm.tables import ship, table
from sealdex.llm.token_files import written_and_read
from sealdex.session import scratch_path, staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go; those without an id stay."""
    ship(spark)
    return accepted(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, and one row of a repeated id; those without an id stay.

    Decisions are made on ids alone. Texts are shuffled once, to meet them; rows of
    a repeated id, which only a table with such ids has, are sorted out after that.
    """
    ship(spark)
    ids = near_duplicate_groups(docs).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("rows"))
    ids = staged(ids, "near-duplicate-ids")
    kept = docs.join(ids.where("NOT kept").select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    if ids.where("kept AND rows > 1").isEmpty():
        return kept
    repeated = ids.where("kept AND rows > 1").select("doc_id")
    single = kept.join(repeated, "doc_id", "left_anti").select(docs.columns)
    return single.unionByName(kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ship(spark)
    held = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(held, "doc_id", "left_anti").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target wants it: not at all, once, or repeated."""
    ship(spark)
    return mixed_rows(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, and their digest read back: doc_id, start, n_tokens, ids_crc32."""
    ship(spark)
    return written_and_read(docs, VOCABULARY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

#: A trained model and a tokenizer decide: no SQL. The tests run each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = scratch_path(spark, "pipeline")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{root}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{name}")
    return docs
