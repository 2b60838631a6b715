"""Shared helpers of the training-data operators: tables, materialisation, Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Largest measured size in bytes of a table that an operator broadcasts; beyond it the join shuffles.
BROADCAST_BYTES = 8 << 20
#: Largest size in bytes of the Arrow batches that go to Python workers.
ARROW_BYTES = 4 << 20
#: Separator characters of words: space and the six ASCII controls \\t \\n \\v \\f \\r.
WORD_PATTERN = "[^\x20\x09-\x0d]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, and only where that is unset our own choice.

    Unset, a local master gets a temporary folder and a cluster a folder of the warehouse.
    """
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local-cluster") and spark.sparkContext.master.startswith("local"):
        own = tempfile.mkdtemp(prefix="vitalspark-")
        atexit.register(shutil.rmtree, own, True)
        path = "file://" + own
    else:
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: Tables that this driver has written in the shared folder and not removed.
_WRITTEN: list[str] = []


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, for any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written() -> int:
    """A mark for `remove_written`: the number of tables written and not removed so far."""
    return len(_WRITTEN)


def remove_written(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Remove the tables that were written after a mark, all but the last `but`: for when what needed them is written."""
    end = len(_WRITTEN) - but
    for name in _WRITTEN[since:end]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del _WRITTEN[since:end]


def maybe_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its measured row count times row_bytes keeps the bound, else as it is."""
    most = BROADCAST_BYTES // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of the session's Arrow batches, which are else bounded by rows of any length alone."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(name)  # a number of bytes with or without a unit
    if not size.removesuffix("b").isdigit() or int(size.removesuffix("b")) > ARROW_BYTES:
        spark.conf.set(name, ARROW_BYTES)


def release() -> None:
    """Give freed memory back to the system: workers outlive their tasks, and the next task may be another query's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow over batches of bounded bytes; the worker's freed memory goes back when a task ends."""
    bounded_batches(df.sparkSession)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(bounded, schema)


def arrow_map(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]]) -> DataFrame:
    """mapInArrow where make() runs once a task and gives a function from a batch to dicts of columns."""
    kinds = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch):
                for columns in work(part):
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in arrow], schema=arrow)

    return map_arrow(df, run, kinds)


def slices(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about `most` bytes each (one row at least), so that memory follows bytes and not rows."""
    if not batch.num_rows:
        return
    size = max(1, batch.nbytes)
    step = max(1, batch.num_rows * most // size)
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column as strings, null as the empty one."""
    return [x or "" for x in batch.column(name).to_pylist()]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
