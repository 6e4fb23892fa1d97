"""Tables written to the shared folder and read from there, and what is kept for a session."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_app_dirs: set[str] = set()
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_kept: dict[tuple, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a session that is a single process may go without:
    it gets a temporary folder; on a cluster the executors couldn't read each other's files there."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = _local_dirs.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="quillstack-"))
    return path.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost
    executors. What drop() didn't delete goes when the application ends."""
    spark = df.sparkSession
    app = f"{shared_dir(spark)}/quillstack/{spark.sparkContext.applicationId}"
    if app not in _app_dirs:
        _app_dirs.add(app)
        atexit.register(_delete_at_exit, spark, app)
    path = f"{app}/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        _delete(spark, path)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that written() returned, once no plan needs them; others are left alone."""
    for df in tables:
        if (path := _paths.pop(df, None)) is not None:
            _delete(df.sparkSession, path)


def once(spark: SparkSession, name: str, sf_dir: str, make: Callable[[], object]) -> object:
    """What make returns, made once a session and folder."""
    key = (spark.sparkContext.applicationId, name, sf_dir)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def spread(df: DataFrame) -> DataFrame:
    """df over all cores when it comes from fewer pieces than there are cores, as one small file does; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
