"""Processed-row counters and per-stage timings."""

from __future__ import annotations

import time
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sealdex.functions.crypto import local_frame


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """``df`` with a row count that is read off the job that writes it."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def stage_totals(timings: DataFrame) -> DataFrame:
    """Events, total time and rounded mean of each stage of (stage, events, micros)."""
    totals = timings.groupBy("stage").agg(F.sum("events").alias("events"), F.sum("micros").alias("micros"))
    return totals.withColumn("mean_micros", F.round(F.col("micros") / F.col("events")).cast("bigint"))


def stage_shares(totals: DataFrame, whole: str) -> DataFrame:
    """Add each stage's share, in percent, of the stage named ``whole``."""
    base = totals.where(F.col("stage") == whole).select("micros").scalar()
    return totals.withColumn("share", F.round(F.col("micros") * 100 / base, 2))


class StageClock:
    """Driver-side times of whole jobs, as (stage, events, micros) rows."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._rows: list[tuple[str, int, int]] = []

    @contextmanager
    def stage(self, name: str, events: int = 1):
        start = time.perf_counter()
        yield
        self._rows.append((name, events, int((time.perf_counter() - start) * 1e6)))

    def mark(self) -> tuple[int, float]:
        """A point to measure a whole job from."""
        return len(self._rows), time.perf_counter()

    def since(self, mark: tuple[int, float]) -> dict[str, int]:
        """Micros of each stage since a mark, and of all of it as ``total``."""
        taken: dict[str, int] = {}
        for name, _, micros in self._rows[mark[0] :]:
            taken[name] = taken.get(name, 0) + micros
        return taken | {"total": int((time.perf_counter() - mark[1]) * 1e6)}

    def timings(self) -> DataFrame:
        schema = {"stage": pa.string(), "events": pa.int64(), "micros": pa.int64()}
        return local_frame(self._spark, self._rows, schema)
