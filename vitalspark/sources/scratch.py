"""Intermediate tables in the folder that all executors share: lineage ends there, for any executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset a local master gets a temporary folder, a cluster one of the warehouse."""
    if own := spark.conf.get("spark.checkpoint.dir", None):
        return own
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        own = tempfile.mkdtemp(prefix="vitalspark-")
        atexit.register(shutil.rmtree, own, True)
        path = "file://" + own
    else:
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: Tables that this driver has settled and not removed.
_WRITTEN: list[str] = []


def settle(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet and read back."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """A mark for `remove_written`: the number of tables settled and not removed so far."""
    return len(_WRITTEN)


def remove_written(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Remove the tables that were settled after a mark, all but the last `but`, once nothing reads them any more."""
    end = len(_WRITTEN) - but
    for name in _WRITTEN[since:end]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del _WRITTEN[since:end]
