"""SimHash near-duplicates, searched with the binary Golay code.

Method: a text's fingerprint is the majority of the XXH64 hashes of its three-word shingles, bit by bit. The 64 bits are
cut into segments of 22, 21 and 21. A perfect Golay code of length 23 has one codeword within three bits of any word; the
keys of a segment are the codewords that it and its one-bit neighbours decode to, one or up to six. Two segments that
differ by one bit have each the other's own codeword among their keys.

Pigeonhole: at most two bits of 64 differ, so of three segments one is equal at least. Either two are equal, and the two
together are a key; or one is equal and the others differ by one bit each, and a key is the equal one with the codeword of
the second and a key of the third, or the other way round. About 30 keys of 40 bits or more find every link. Fingerprints
that share a key are compared exactly, and links are closed to components by label propagation with shortcuts.

Skew: equal fingerprints are one node. A key has a bounded number of different fingerprints by construction (what is left
open are 22 bits at most). Up to BLOCK of them are compared directly; those of fuller keys are all dealt to the 65 points
within one bit of each: two that differ by two bits or fewer share a point, and all that share a point differ by two at
most, so a point links its members to its least one, without pairs. Both ways close to the same components.

Defined results: a null or empty text, or one of separators alone, has fingerprint zero; texts of fewer than three words
are one shingle; component_id is the least doc_id that is not null, null only if all are; repeated rows are rows of their
own; a very long text is read in pieces; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, map_arrow, materialise, table, texts
from .near_dedup import components

SHINGLE, SEED, BITS = 3, 42, 2
#: Widths of the segments, from the lowest bit on.
SEGMENTS = (22, 21, 21)
#: Fingerprints of a key that are compared pair by pair; beyond, points replace pairs.
BLOCK = 64
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20
#: Fixed value: the generator polynomial of the Golay code, degree 11.
GENERATOR = 0b110001110101
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of the runs of `width` words, which are slices of the joined text."""
    joined = b" ".join(words)
    at = np.cumsum([0] + [len(w) + 1 for w in words])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(at[:-width].tolist(), (at[width:] - 1).tolist())], np.uint64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """The number of hashes that have each bit."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprint(text: str) -> int:
    raw = text.encode().lower()  # bytes have ASCII letters only to lower
    ones, total, held, at, n = np.zeros(64, np.int64), 0, [], 0, len(raw)
    while at < n:
        end = _SPACE.search(raw, min(n, at + PIECE))
        end = end.end() if end else n
        words = held + raw[at:end].split()
        if len(words) >= SHINGLE:
            hashes = _hashes(words, SHINGLE)
            ones, total, words = ones + _ones(hashes), total + len(hashes), words[len(words) - SHINGLE + 1 :]
        held, at = words, end
    if not total and held:
        ones, total = _ones(_hashes(held, len(held))), 1
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


@cache
def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and high 11 bits by the generator; and the error of each remainder."""

    def remainder(x: np.ndarray) -> np.ndarray:
        for bit in range(22, 10, -1):
            x = np.where(x >> bit & 1, x ^ GENERATOR << bit - 11, x)
        return x

    low, high = remainder(np.arange(1 << 12)), remainder(np.arange(1 << 11) << 12)
    one = [0] + [1 << i for i in range(23)]
    errors = np.array(sorted({a ^ b ^ c for a in one for b in one for c in one}))  # of up to three bits: one for each remainder
    table_ = np.zeros(1 << 11, np.int64)
    table_[low[errors & 0xFFF] ^ high[errors >> 12]] = errors
    return low, high, table_


def decode(x: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords nearest to 23-bit words."""
    low, high, errors = _code()
    return (x ^ errors[low[x & 0xFFF] ^ high[x >> 12]]) >> 11


def near_codes(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Codewords that words and their one-bit neighbours decode to: sorted by row, and which are a row's first of a value."""
    near = np.sort(decode(x[:, None] ^ np.array([0] + [1 << i for i in range(width)])), axis=1)
    return near, np.c_[np.ones(len(x), bool), near[:, 1:] != near[:, :-1]]


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of the fingerprint): any two fingerprints at two bits or fewer share a key."""
    at, parts = 0, []
    for width in SEGMENTS:
        parts.append((prints >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64))
        at += width
    every, own = np.arange(len(prints)), [decode(p) for p in parts]
    near = [near_codes(p, width) for p, width in zip(parts, SEGMENTS)]
    found, whose = [], []
    for x, y, z in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
        found.append(x << 60 | parts[x] << 22 | parts[y])
        whose.append(every)
        for one, other, places in ((y, z, (12, 0)), (z, y, (0, 12))):
            codes, first = near[other]
            if one == z:  # the pair of own codewords is there already
                first = first & (codes != own[other][:, None])
            row, column = np.nonzero(first)
            found.append(x + 3 << 60 | parts[x][row] << 24 | own[one][row] << places[0] | codes[row, column] << places[1])
            whose.append(row)
    return np.concatenate(found), np.concatenate(whose)


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) → doc_id, print (the fingerprint as a signed long)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            own = np.array([fingerprint(t) for t in texts(batch)], np.uint64)
            yield {"doc_id": batch.column("doc_id"), "print": pa.array(own.view(np.int64))}

        return work

    return arrow_map(docs.select("doc_id", "text"), f"doc_id {kind}, print bigint", make)


def _keyed(nodes: DataFrame) -> DataFrame:
    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            own = batch.column("print").to_numpy(zero_copy_only=False)
            for at in range(0, len(own), 4096):
                key, whose = keys(own[at : at + 4096].view(np.uint64))
                yield {"key": pa.array(key), "print": pa.array(own[at : at + 4096][whose])}

        return work

    return arrow_map(nodes.select("print"), "key bigint, print bigint", make)


def _chain(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all fingerprints that are joined by pairs at BITS bits or fewer."""
    near = np.bitwise_count((prints[:, None] ^ prints[None, :]).view(np.uint64)) <= BITS  # of signed longs it would count the bits of their size
    left, found = set(range(len(prints))), []
    while left:
        todo = [left.pop()]
        while todo:
            i = todo.pop()
            for j in [j for j in np.flatnonzero(near[i]).tolist() if j in left]:
                left.remove(j)
                todo.append(j)
                found.append((int(prints[i]), int(prints[j])))
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, print) → (a, b): links; of keys with more than BLOCK fingerprints (a, null) for each of them."""
    key, prints, full = np.empty(0, np.int64), np.empty(0, np.int64), -1  # the last key, if it is full; keys are positive

    def give(links: list[tuple[int, int]], hot: list[np.ndarray]) -> pa.RecordBatch:
        a, b = [x for x, _ in links], [y for _, y in links]
        for x in hot:
            a, b = a + x.tolist(), b + [None] * len(x)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def settled(prints: np.ndarray, links: list, hot: list) -> None:
        if len(prints) > BLOCK:
            hot.append(prints)
        elif len(prints) > 1:
            links += _chain(prints)

    for batch in batches:
        key = np.r_[key, batch.column("key").to_numpy(zero_copy_only=False)]
        prints = np.r_[prints, batch.column("print").to_numpy(zero_copy_only=False)]
        links, hot = [], []
        if not len(key):
            continue
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[starts[1:], len(key)]
        several = (ends - starts > 1) | (key[starts] == full)
        for s, e in zip(starts[several].tolist(), ends[several].tolist()):
            if key[s] == full:
                hot.append(prints[s:e])
            elif e < len(key):
                settled(prints[s:e], links, hot)
            elif e - s > BLOCK:
                hot.append(prints[s:e])
                full = int(key[s])
        s = int(starts[-1])  # the last key may go on in the next batch
        key, prints = (key[:0], prints[:0]) if key[s] == full else (key[s:], prints[s:])
        if links or hot:
            yield give(links, hot)
    links, hot = [], []
    settled(prints, links, hot)
    yield give(links, hot)


def links(nodes: DataFrame) -> DataFrame:
    """nodes(print), each fingerprint once → (a, b): links that join all fingerprints at BITS bits or fewer."""
    met = map_arrow(_keyed(nodes).repartition("key").sortWithinPartitions("key", "print"), _scan, "a bigint, b bigint")
    met = materialise(met, "simhash-links")
    hot = met.where("b is null").select(F.col("a").alias("print")).distinct()
    flips = F.array(F.lit(0).cast("bigint"), *[F.shiftleft(F.lit(1).cast("bigint"), i) for i in range(64)])
    points = hot.select("print", F.explode(flips).alias("flip")).groupBy(F.col("print").bitwiseXOR(F.col("flip")).alias("point")).agg(F.collect_list("print").alias("prints"))  # 65 at most
    by_point = points.where("size(prints) > 1").select(F.array_min("prints").alias("a"), F.explode("prints").alias("b")).where("a <> b")
    return met.where("b is not null").unionByName(by_point).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) → doc_id, print, component_id."""
    ids = materialise(fingerprints(docs), "simhash-ids")
    nodes = materialise(ids.groupBy("print").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    label = components(links(nodes), "a", "b").withColumnRenamed("node", "print")
    named = materialise(nodes.join(label, "print", "left").select("print", "least", F.coalesce("label", "print").alias("label")), "simhash-labels")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return ids.join(named.join(least, "label").select("print", "component_id"), "print")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
