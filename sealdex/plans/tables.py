"""Record kinds laid over the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealdex.functions.policy import Axis, Policy, Rule
from sealdex.functions.terms import IndexSpec, Term, text_words
from sealdex.functions.uid import uid_bytes
from sealdex.operators.specs import PartSpec, RecordSpec

DEPARTMENTS = Axis("Department", ("Marketing", "HR", "Security", "Other"))
REGIONS = Axis("Region", ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))
EVENT_TYPES = Axis("Type", ("click", "error", "purchase", "signup", "view"))

REGION_POLICY = Policy(rows=REGIONS, columns=DEPARTMENTS)
EVENT_POLICY = Policy(rows=EVENT_TYPES, columns=DEPARTMENTS)

# A person record over customer, nation and region.
DIRECTORY = RecordSpec(
    fields=("custkey", "name", "region", "segment", "nation", "acctbal"),
    row_field="region",
    policy=REGION_POLICY,
    parts=(
        PartSpec("common", ("custkey", "name", "region"), ("Marketing", "HR")),
        PartSpec("marketing", ("segment",), ("Marketing",)),
        PartSpec("hr", ("nation",), ("HR",)),
        PartSpec("security", ("acctbal",), ("Security",)),
    ),
    index=IndexSpec(
        (
            Term("nation"),
            Term("segment"),
            Term("nation", "nation"),
            Term("segment", "segment"),
            Term("region", "region"),
        )
    ),
)

# The same policy over a fact table, with a derived column and a derived term.
ORDER_RECORDS = RecordSpec(
    fields=("orderkey", "custkey", "region", "status", "priority", "orderdate", "totalprice"),
    row_field="region",
    policy=REGION_POLICY,
    parts=(
        PartSpec("common", ("orderkey", "region", "status"), ("Marketing", "HR")),
        PartSpec(
            "marketing",
            ("priority", ("urgency", "substring(priority, 1, 1)")),
            ("Marketing",),
        ),
        PartSpec("hr", ("custkey", "orderdate"), ("HR",)),
        PartSpec("security", ("totalprice",), ("Security",)),
    ),
    index=IndexSpec(
        (
            Term("region", "region"),
            Term("status", "status"),
            Term("substring(orderdate, 1, 7)", "month"),
            Term("custkey", "cust"),
        )
    ),
)

EVENT_RECORDS = RecordSpec(
    fields=("event_id", "ts", "user_id", "type", "value"),
    row_field="type",
    policy=EVENT_POLICY,
    parts=(
        PartSpec("common", ("event_id", "type"), ("Marketing", "HR")),
        PartSpec("marketing", ("value",), ("Marketing",)),
        PartSpec("hr", ("user_id",), ("HR",)),
        PartSpec("security", ("ts",), ("Security",)),
    ),
    index=IndexSpec((Term("type"), Term("type", "type"), Term("user_id", "user"))),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_all_cores(df: DataFrame) -> DataFrame:
    """Spread an input of fewer files than cores, whose splits could not fill them.

    The test tables are single small files. Inputs of many files pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("custkey"),
            F.col("c_name").alias("name"),
            F.col("r_name").alias("region"),
            F.col("c_mktsegment").alias("segment"),
            F.col("n_name").alias("nation"),
            F.col("c_acctbal").alias("acctbal"),
        )
    )


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    people = directory(spark, sf_dir).select("custkey", "region")
    joined = on_all_cores(orders.join(people, F.col("o_custkey") == F.col("custkey")))
    return joined.select(
        F.col("o_orderkey").cast("string").alias("orderkey"),
        F.col("custkey").cast("string").alias("custkey"),
        "region",
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderdate").cast("string").alias("orderdate"),
        F.col("o_totalprice").cast("string").alias("totalprice"),
    )


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").cast("string").alias("ts"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("event_type").alias("type"),
        F.col("value").cast("string").alias("value"),
    )


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uid, lang, source, words) of every whole document text."""
    docs = on_all_cores(table(spark, sf_dir, "documents"))
    return docs.select(
        uid_bytes(F.lit("documents"), F.col("doc_id")).alias("uid"),
        "lang",
        "source",
        text_words(F.col("text")).alias("words"),
    )


def region_rules() -> dict[str, Rule]:
    allow = REGION_POLICY.allow
    dept = DEPARTMENTS.attribute
    region = REGIONS.attribute
    return {
        "super": allow(DEPARTMENTS.values, REGIONS.values),
        "asia_marketing": allow(["Marketing"], ["ASIA"]),
        "europe_hr": allow(["HR"], ["EUROPE"]),
        "security_only": allow(["Security"], REGIONS.values),
        "hr_and_security": allow(["HR", "Security"], ["AFRICA", "ASIA"]),
        "nobody": allow(["Other"], ["AMERICA"]),
        "nested": (dept("Marketing") & (region("ASIA") | region("EUROPE")))
        | (dept("HR") & region("AFRICA")),
    }
