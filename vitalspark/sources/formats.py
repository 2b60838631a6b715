"""Data sources for spark.read.format: SAS transport files, and folders of centre files of any of several formats.

Both plan their partitions from headers or folder names on the driver's side, read only the columns of the schema they are
asked for, and take over filters: of transport files, records that fail are not decoded further; of centre files, folders
of other centres are not opened at all.

    register(spark)
    spark.read.format("sas_transport").schema("AGE double, SEX string").load("/data/dm.xpt").where("AGE > 60")
    spark.read.format("centers").schema("center string, time double").option("files", "csv").load("/data").where("center = 'a'")

Files must be readable under their paths by every executor (a shared mount).
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .xpt import CHUNK, Layout, layout, ranges, read_range

TRANSPORT, CENTERS = "sas_transport", "centers"
_COMPARED = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


def register(spark: SparkSession) -> None:
    """Make the formats known to a session and let it push filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (TransportSource, CentersSource):
        spark.dataSource.register(source)


def transport_schema(own: Layout, columns: Sequence[str] | None = None) -> StructType:
    numeric = dict(zip(own.names, own.numeric))
    return StructType([StructField(n, DoubleType() if numeric[n] else StringType()) for n in columns or own.names])


def _understood(f: Filter) -> bool:
    return isinstance(f, (*_COMPARED, In, IsNull, IsNotNull)) and len(f.attribute) == 1


def _mask(f: Filter, values: pa.Array) -> pa.Array:
    """Where a filter is true; a null is neither equal to nor more or less than anything."""
    if isinstance(f, IsNull):
        return pc.is_null(values)
    if isinstance(f, IsNotNull):
        return pc.is_valid(values)
    if isinstance(f, In):
        return pc.fill_null(pc.and_(pc.is_in(values, pa.array([v for v in f.value if v is not None], values.type)), pc.is_valid(values)), False)
    return pc.fill_null(_COMPARED[type(f)](values, pa.scalar(f.value, values.type)), False)


def _all(filters: Sequence[Filter], column) -> pa.Array | None:
    mask = None
    for f in filters:
        own = _mask(f, column(f.attribute[0]))
        mask = own if mask is None else pc.and_(mask, own)
    return mask


def _files(options: dict[str, str]) -> list[str]:
    """The files of `paths` (a JSON list) or `path`: a file, a folder or a pattern, in order."""
    named = json.loads(options["paths"]) if "paths" in options else [options["path"]]
    out = []
    for name in (n.removeprefix("file://") for n in named):
        out += sorted(p for p in glob.glob(os.path.join(name, "**"), recursive=True) if os.path.isfile(p) and not os.path.basename(p).startswith(("_", "."))) if os.path.isdir(name) else sorted(glob.glob(name)) or [name]
    return out


class TransportSource(DataSource):
    """SAS transport files of version 5. Options: path or paths, chunk (bytes of records that a task reads)."""

    @classmethod
    def name(cls) -> str:
        return TRANSPORT

    def schema(self) -> StructType:
        return transport_schema(layout(_files(self.options)[0]))

    def reader(self, schema: StructType) -> TransportReader:
        return TransportReader(self.options, schema)


class TransportReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.files, self.chunk = _files(options), int(options.get("chunk", CHUNK))
        self.columns, self.filters = schema.names, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if _understood(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Ranges of records, from the headers; no file has a range without records."""
        found = [InputPartition((own, *r)) for p in self.files for own in [layout(p)] for r in ranges(p, own, self.chunk)]
        return found or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value:
            own, path, at, count = partition.value
            yield read_range(path, own, at, count, self.columns, lambda column: _all(self.filters, column))


class CentersSource(DataSource):
    """A folder of one folder a centre (`name` or `center=name`), with CSV, Parquet or transport files.

    Options: path; files: csv, parquet or xpt; center: the name of the centre's column, which is the folder's name where the
    files do not have it. A schema must be given, as the files of a centre may lack columns: those are null.
    """

    @classmethod
    def name(cls) -> str:
        return CENTERS

    def schema(self) -> StructType:
        raise ValueError("centre files are read under a given schema")

    def reader(self, schema: StructType) -> CentersReader:
        return CentersReader(self.options, schema)


class CentersReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.root, self.kind, self.center = options["path"].removeprefix("file://").rstrip("/"), options.get("files", "csv"), options.get("center", "center")
        self.arrow, self.filters = to_arrow_schema(schema), []
        if self.kind not in ("csv", "parquet", "xpt"):
            raise ValueError(f"unknown kind of files {self.kind!r}")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters of the centre choose folders and hold for all their rows; the others are Spark's."""
        for f in filters:
            if _understood(f) and f.attribute[0] == self.center:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        found = []
        for path in _files({"path": self.root}):
            folder = os.path.relpath(path, self.root).split(os.sep)[0]
            center = folder.removeprefix(f"{self.center}=")
            mask = _all(self.filters, lambda _, c=center: pa.array([c], pa.string()))
            if mask is None or mask[0].as_py():
                found.append(InputPartition((center, path)))
        return found or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.value:
            return
        center, path = partition.value
        for batch in self._batches(path):
            columns = []
            for field in self.arrow:
                if field.name == self.center and field.name not in batch.schema.names:
                    columns.append(pa.array([center] * batch.num_rows, pa.string()).cast(field.type))
                elif field.name in batch.schema.names:
                    columns.append(batch.column(field.name).cast(field.type))
                else:
                    columns.append(pa.nulls(batch.num_rows, field.type))
            yield pa.RecordBatch.from_arrays(columns, schema=self.arrow)

    def _batches(self, path: str) -> Iterator[pa.RecordBatch]:
        """The file's columns that are asked for, a block at a time."""
        wanted = [f.name for f in self.arrow]
        if self.kind == "csv":
            from pyarrow import csv

            names = csv.open_csv(path).schema.names if os.path.getsize(path) else []
            own = [n for n in names if n in wanted]
            if own:
                yield from csv.open_csv(path, convert_options=csv.ConvertOptions(include_columns=own, column_types={f.name: f.type for f in self.arrow if f.name in own}, strings_can_be_null=True))
        elif self.kind == "parquet":
            import pyarrow.parquet as pq

            file = pq.ParquetFile(path)
            own = [n for n in file.schema_arrow.names if n in wanted]
            yield from file.iter_batches(columns=own)
        else:
            own = layout(path)
            for _, at, count in ranges(path, own, CHUNK):
                yield read_range(path, own, at, count, [n for n in own.names if n in wanted])
