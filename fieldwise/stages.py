"""Written intermediate tables.

A staged table is a parquet directory in the shared folder the cluster names
in ``spark.checkpoint.dir``.  Staging does three jobs at once: it cuts lineage
so a lost executor never recomputes more than one step, it fixes the result of
steps whose partitioning is sampled (a range sort), and it gives Catalyst the
real byte size of the result, so that a small table is broadcast by
``spark.sql.autoBroadcastJoinThreshold`` and a large one is not.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_drops: dict[str, int] = {}
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged tables: all executors must share it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return named.rstrip("/")


def times_dropped(spark: SparkSession) -> int:
    """How often the application has dropped its stages: what was staged before is gone."""
    return _drops.get(spark.sparkContext.applicationId, 0)


def stage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of what was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    named = sc._jvm.org.apache.hadoop.fs.Path(path)
    named.getFileSystem(sc._jsc.hadoopConfiguration()).delete(named, True)


def _count_drop(spark: SparkSession) -> None:
    app = spark.sparkContext.applicationId
    _drops[app] = times_dropped(spark) + 1


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end, also after an error.

    Write what is to stay before the end: frames that read the stages are of no use after it.
    """
    mine: list[str] = []
    _scopes.append(mine)
    try:
        yield
    finally:
        _scopes.remove(mine)
        for path in mine:
            _delete(spark, path)
        if mine:
            _count_drop(spark)


def drop_stages(spark: SparkSession) -> None:
    """Delete every staged table this application wrote."""
    _delete(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    _count_drop(spark)
