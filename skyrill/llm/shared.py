"""Shared-folder staging: tables cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from ``spark.checkpoint.dir``. Only where that is unset (a
    single-machine test session) a temporary folder is made and recorded.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="skyrill-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return qualified(spark, path)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme: one without means the default file system, to Spark and to tasks that open files alike."""
    if ":" not in path:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        path = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
        path = path.replace("file:/", "file:///", 1) if not path.startswith("file://") else path
    return path.rstrip("/")


class _Scratch(threading.local):
    """Paths and named tables of the open ``scratch`` blocks of a thread, innermost last."""

    def __init__(self):
        self.open: list[list[tuple[str, str | None]]] = []


_scratch = _Scratch()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within it, staged tables are temporary: they are dropped and deleted at its end, but for those staged with ``keep``."""
    _scratch.open.append([])
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path, title in _scratch.open.pop():
            if title:
                spark.sql(f"DROP TABLE IF EXISTS {title}")
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def _record(path: str, title: str | None = None) -> None:
    if _scratch.open:
        _scratch.open[-1].append((path, title))


def free_name(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores in front until no frame has such a column in any case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The reread plan has no lineage beyond the files, so a lost executor costs
    only the tasks that read them, never the stages that made them.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if not keep:
        _record(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """All rows of ``df`` if there are at most ``rows``, else about ``rows`` of them, those of small hash of ``key``; never over twice as many.

    A count and a threshold on the hash take the place of a sort, so no task
    or driver gathers the candidates of all tasks.
    """
    n = df.count()
    if n <= rows:
        return df
    cut = int(rows / n * 2**64) - 2**63
    return df.where(F.xxhash64(*key) < cut).limit(2 * rows)


def stage_bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """``stage`` as a table bucketed and sorted by ``key``: joins on the key read it without a shuffle.

    Best for rows that are hash-partitioned by the key already: then each task writes its own buckets.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    title = f"{name}_{uuid.uuid4().hex}"
    _record(path, title)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, key).sortBy(key).option("compression", "zstd").option("path", path).saveAsTable(title)
    return spark.table(title)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
