"""Kafka topics as line sources and sinks (options only; the broker is yours)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealdex.sources.lines import without_blank


def topic_set(topics, configured: str | None = None) -> list[str]:
    """The given topics and the configured one, each once; none at all is an error."""
    names = {t.strip() for t in [*topics, configured or ""]} - {""}
    if not names:
        raise ValueError("no topic given and none configured")
    return sorted(names)


def topic_options(servers: str, topics, configured: str | None = None,
                  max_lines_per_batch: int | None = None, **extra: str) -> dict[str, str]:
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": ",".join(topic_set(topics, configured)),
        "startingOffsets": "earliest",
    }
    if max_lines_per_batch is not None:
        options["maxOffsetsPerTrigger"] = str(max_lines_per_batch)
    return options | extra


def read_topic_lines(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Streamed (value, partition, offset); the last two order lines of a partition."""
    stream = spark.readStream.format("kafka").options(**options).load()
    return stream.select(F.col("value").cast("string").alias("value"), "partition", "offset")


def publish_lines(lines: DataFrame, servers: str, topic: str, **extra: str) -> None:
    """Send every non-blank line to a topic."""
    (
        without_blank(lines)
        .select("value")
        .write.format("kafka")
        .options(**{"kafka.bootstrap.servers": servers, "topic": topic, **extra})
        .save()
    )
