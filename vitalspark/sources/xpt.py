"""Reader of SAS transport files (version 5): the header gives the schema, ranges of records are read side by side.

Files must be readable under their paths by every executor (a shared mount). Only the wanted columns are decoded.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of records that a task reads at a time.
CHUNK = 8 << 20
#: Fixed values of the format: record size, and the marks of the headers.
RECORD, NAMESTR, OBS = 80, b"HEADER RECORD*******NAMESTR HEADER RECORD!!!!!!!", b"HEADER RECORD*******OBS     HEADER RECORD!!!!!!!"


@dataclass(frozen=True)
class Layout:
    names: tuple[str, ...]
    numeric: tuple[bool, ...]
    lengths: tuple[int, ...]
    places: tuple[int, ...]
    start: int  # of the first record
    width: int  # of a record


def layout(path: str) -> Layout:
    """The columns of a file's first member and where its records begin."""
    with open(path, "rb") as file:
        head = file.read(1 << 20)
    at = head.find(NAMESTR)
    if at < 0:
        raise ValueError(f"{path}: no transport file of version 5")
    count = int(head[at + 54 : at + 58])
    size = 136 if b"MEMBER  HEADER RECORD!!!!!!!000000000000000001600000000136" in head[:at] else 140
    own = [struct.unpack_from(">hhhh8s", head, at + RECORD + k * size) + struct.unpack_from(">l", head, at + RECORD + k * size + 84) for k in range(count)]
    obs = head.find(OBS, at)
    if obs < 0:
        raise ValueError(f"{path}: no records")
    return Layout(tuple(o[4].decode("ascii").strip() for o in own), tuple(o[0] == 1 for o in own), tuple(o[2] for o in own), tuple(o[5] for o in own), obs + RECORD, sum(o[2] for o in own))


def _numbers(raw: np.ndarray) -> pa.Array:
    """Base-16 floating point numbers of up to 8 bytes, big-endian; a missing value has a letter, '.' or '_' and zeros."""
    whole = np.zeros((len(raw), 8), np.uint8)
    whole[:, : raw.shape[1]] = raw
    bits = whole.view(">u8").ravel().astype(np.uint64)
    fraction = (bits & np.uint64((1 << 56) - 1)).astype(float) / float(1 << 56)
    power = ((bits >> np.uint64(56)) & np.uint64(127)).astype(int) - 64
    value = np.where(bits >> np.uint64(63), -1.0, 1.0) * np.ldexp(fraction, 4 * power)
    first = whole[:, 0]
    missing = ((first == 46) | (first == 95) | ((first >= 65) & (first <= 90))) & ~whole[:, 1:].any(axis=1)
    return pa.array(value, mask=missing)


def _records(path: str, own: Layout) -> int:
    """Number of records; the last file block is filled with blanks, which may look like records."""
    size = os.path.getsize(path) - own.start
    count = size // own.width
    with open(path, "rb") as file:
        file.seek(own.start + max(0, count - RECORD) * own.width)
        tail = file.read(min(count, RECORD) * own.width)
    while count and size - (count - 1) * own.width <= RECORD and not tail[-own.width :].strip(b" "):
        count, tail = count - 1, tail[: -own.width]
    return count


def ranges(path: str, own: Layout, chunk: int) -> list[tuple[str, int, int]]:
    """(path, first record, number of records) of runs of about `chunk` bytes."""
    step, count = max(1, chunk // own.width), _records(path, own)
    return [(path, at, min(step, count - at)) for at in range(0, count, step)]


def read_range(path: str, own: Layout, at: int, count: int, names: Sequence[str], keep: Callable[[Callable[[str], pa.Array]], pa.Array | None] = lambda column: None) -> pa.RecordBatch:
    """Some columns of a run of records; keep(column) may give a mask from the columns it asks for, and only the records
    of the mask are decoded for the others."""
    with open(path, "rb") as file:
        file.seek(own.start + at * own.width)
        raw = np.frombuffer(file.read(count * own.width), np.uint8).reshape(count, own.width)
    known: dict[str, pa.Array] = {}

    def column(name: str) -> pa.Array:
        if name not in known:
            k = own.names.index(name)
            part = np.ascontiguousarray(raw[:, own.places[k] : own.places[k] + own.lengths[k]])
            known[name] = _numbers(part) if own.numeric[k] else pa.array([t or None for t in (x.decode("utf-8", "replace").rstrip(" ") for x in part.view(f"S{own.lengths[k]}").ravel().tolist())], pa.string())
        return known[name]

    mask = keep(column)
    if mask is not None:
        raw = raw[np.asarray(mask)]
        known = {n: c.filter(mask) for n, c in known.items()}
    return pa.RecordBatch.from_arrays([column(n) for n in names], names=list(names))


def read_xpt(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of one or several files of the same columns: numbers as doubles, texts without trailing blanks, missing as null."""
    from .formats import TRANSPORT, register, transport_schema

    register(spark)
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.format(TRANSPORT).option("paths", json.dumps(paths)).option("chunk", CHUNK)
    return reader.schema(transport_schema(layout(paths[0]), columns)).load()
