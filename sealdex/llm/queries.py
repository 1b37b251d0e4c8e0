"""The registered queries of this folder: thin, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealdex.llm.clustering import clusters
from sealdex.llm.decontamination import contaminated
from sealdex.llm.manifest import manifest, without_line_ends
from sealdex.llm.mixing import mixed
from sealdex.llm.near_duplicates import near_duplicate_groups
from sealdex.llm.oracles import clusters_sql, manifest_sql, near_duplicates_sql, repeats_sql, vector_search_sql
from sealdex.llm.page_text import main_texts
from sealdex.llm.prefix_counts import token_counts
from sealdex.llm.quality import scored, train
from sealdex.llm.repeats import without_repeats
from sealdex.llm.secrets import secrets_found
from sealdex.llm.tables import table
from sealdex.llm.token_files import written_and_read
from sealdex.llm.toxicity import scored as toxicity_scored
from sealdex.llm.toxicity import train as train_toxicity
from sealdex.llm.vector_search import QUERY_EVERY, exact_top_k

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_found(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_and_read(table(spark, sf_dir, "documents"), VOCABULARY)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), VOCABULARY)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


def op9_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return manifest(docs, without_line_ends(docs)).drop("proof")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_scored(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_page_text, op2_secrets, op3_near_duplicates, op4_token_files, op5_token_counts, op6_quality, op7_decontamination,
        op8_repeats, op9_vector_search, op10_mixing, op11_manifest, op12_toxicity, op13_clusters,
    )
}

#: SQL over the same tables, where SQL can say it.
ORACLES: dict[str, str] = {
    "op3_near_duplicates": near_duplicates_sql(),
    "op8_repeats": repeats_sql(),
    "op9_vector_search": vector_search_sql(),
    "op11_manifest": manifest_sql(),
    "op13_clusters": clusters_sql(),
}
