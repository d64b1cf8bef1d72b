"""Tables that are built once and read by many queries: feature matrices, template libraries, snapshots of the last day."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Where a session has written what: (application, name, source) to path.
_WRITTEN: dict[tuple[str, str, str], str] = {}
#: The same for tables in buckets: to their names and paths.
_TABLES: dict[tuple[str, str, str], tuple[str, str]] = {}


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; a temporary one where it is unset and all tasks run on this machine."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (top or "file://" + tempfile.mkdtemp(prefix="quantloom-")).rstrip("/")


def _there(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def snapshot(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What `build` gives for the tables at `source`, written as Parquet when a session first asks for it and read from there on.

    Tables at `source` must not change meanwhile; forget() makes the next reader build anew, and so does a cleared folder.
    """
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _WRITTEN or not _there(spark, _WRITTEN[key]):
        path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
        build().write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def bucketed(spark: SparkSession, name: str, source: str, by: str, order: str, build: Callable[[], DataFrame]) -> DataFrame:
    """snapshot() as a table in buckets of `by`, each in order: windows, aggregates and joins by it read their bucket, and nothing is shuffled again.

    It has as many buckets as shuffles have partitions when it is built.
    """
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _TABLES or not _there(spark, _TABLES[key][1]):
        table, n = f"{name}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
        path = f"{folder(spark)}/{table}"
        build().repartition(n, by).write.bucketBy(n, by).sortBy(by, order).format("parquet").option("path", path).saveAsTable(table)
        _TABLES[key] = table, path
    return spark.table(_TABLES[key][0])


def forget(spark: SparkSession, name: str | None = None) -> None:
    """Drops what the session knows of snapshots, of one name or all; the files stay."""
    for known in (_WRITTEN, _TABLES):
        for key in [k for k in known if k[0] == spark.sparkContext.applicationId and name in (None, k[1])]:
            del known[key]
