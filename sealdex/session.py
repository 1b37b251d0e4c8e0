"""Session set-up and the shared workspace every job stages its tables in."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from pathlib import Path

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Settings the jobs rely on. Cluster sizing (executors, memory, shuffle
# partitions) is left to whoever submits the application.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "sealdex", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**ENGINE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_PACKAGE = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()

# Workspaces chosen for applications whose cluster names none, by application.
_CHOSEN: dict[str, str] = {}


def workspace(spark: SparkSession) -> str:
    """Shared folder for staged tables.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset,
    as in a local test session, a temporary folder is chosen and remembered.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        folder = _CHOSEN.setdefault(app, "") or tempfile.mkdtemp(prefix="sealdex-")
        _CHOSEN[app] = folder
    return f"{folder.rstrip('/')}/sealdex"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the workspace, unique to this application and call."""
    app = spark.sparkContext.applicationId
    return os.path.join(workspace(spark), app, f"{name}-{uuid.uuid4().hex[:12]}")


def ship(spark: SparkSession) -> None:
    """Let the workers import this package, wherever the driver found it: once an application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as archive:
        for file in sorted(_PACKAGE.rglob("*.py")):
            archive.write(file, str(file.relative_to(_PACKAGE.parent)))
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "package") + ".zip")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(body.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(path.toString())
    _SHIPPED.add(app)


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once as a workspace table, in a folder for each value ``by`` has, and return the table.

    Cuts the lineage with files every executor can read again, so a lost
    executor costs a re-read rather than a recomputation.
    """
    return _write_table(df, scratch_path(df.sparkSession, name), by)


def side_by_side(spark: SparkSession, jobs: list[Callable[[], None]]) -> None:
    """Run jobs at once and wait for all; the first to fail, in their order, is raised then."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        done = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
    for job in done:
        job.result()


@contextmanager
def staging(spark: SparkSession, name: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Like :func:`staged`, for tables of one job that go away when it is done."""
    root = scratch_path(spark, name)
    try:
        yield lambda df, table: _write_table(df, f"{root}/{table}")
    finally:
        delete_path(spark, root)


def _write_table(df: DataFrame, path: str, by: str | None = None) -> DataFrame:
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def published_folders(spark: SparkSession, path: str, key: str) -> list[str]:
    """Values of the ``<key>=<value>`` folders of ``path`` whose write was committed."""
    pattern, fs = _resolve(spark, f"{path}/{key}=*/_SUCCESS")
    found = fs.globStatus(pattern) or []
    return sorted(s.getPath().getParent().getName().split("=", 1)[1] for s in found)


def started_folders(spark: SparkSession, path: str, key: str) -> list[str]:
    """Values of all such folders, unfinished ones included."""
    pattern, fs = _resolve(spark, f"{path}/{key}=*")
    return sorted(s.getPath().getName().split("=", 1)[1] for s in fs.globStatus(pattern) or [])


def list_names(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the files and folders that match."""
    glob, fs = _resolve(spark, pattern)
    return sorted(s.getPath().getName() for s in fs.globStatus(glob) or [])


def read_file(spark: SparkSession, path: str) -> str:
    """A small file, whole."""
    file, fs = _resolve(spark, path)
    stream = fs.open(file)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_file(spark: SparkSession, path: str, text: str) -> None:
    file, fs = _resolve(spark, path)
    stream = fs.create(file, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def move_file(spark: SparkSession, source: str, target: str) -> bool:
    """Give a file its name, unless that is taken."""
    old, fs = _resolve(spark, source)
    new, _ = _resolve(spark, target)
    return not fs.exists(new) and fs.rename(old, new)


def delete_path(spark: SparkSession, path: str) -> None:
    old, fs = _resolve(spark, path)
    fs.delete(old, True)


def _resolve(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
