"""Removal of passages that an earlier document has already, by seed and extend.

Method: anchors are winnowed: of each run of LENGTH words the SEED_WORDS-gram with the least hash (rightmost if tied).
Two equal runs have the same anchor at the same place, so documents that share a run share an anchor. Anchors are joined
by hash. The occurrences of an anchor that several documents have then extend their matches over the words on both
sides, one word at a time: occurrences that agree stay in one class, others part, until each place of a run around the
anchor is matched with the least doc_id that has it, or with none. Matched runs that follow each other form maximal
repeats of at least LENGTH words; their words are removed where a document with a smaller id has the run. All is
judged on the input.

Exactness: the anchor's own words and those on both sides are compared word by word, by codes of CODE bits; a wrong match
needs two different words of one code in runs that agree in all others and in the 64-bit hash of the anchor.

Layout: documents are packed, compressed, into buckets of about PACK bytes; a bucket sends each distinct anchor once to
the part (a hash range) it falls in, and then each distinct occurrence (anchor with the words on both sides and the
least doc_id in the bucket) of those that are shared; both as one block of bytes per part. So a passage that a third of
all documents share is one row per bucket, and no pairs of documents are made. An anchor of more than HOT_BUCKETS
buckets or HOT occurrences is dealt by run and not by anchor: each run around it goes to the part of its own hash, where
the same comparison takes place, so that no part holds all occurrences of a frequent phrase. Parts grow in number with the data.

Defined results: a null text has no word; doc_id is an integer; a null doc_id is smaller than any other (the least
64-bit integer counts as null); rows that repeat a doc_id do not remove each other's words (only a smaller id does) but
do remove them from larger ids; texts shorter than LENGTH words stay; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_PATTERN, map_arrow, materialise, shuffle_width, slices, table
from .near_dedup import Words

LENGTH, SEED_WORDS, PACK = 13, 7, 4 << 20
#: Parts for each shuffle partition, and bytes of hashes a part holds at most on average.
PARTS, PART_BYTES = 4, 32 << 20
#: Occurrences of shared anchors in a part on average, about 100 bytes each sent and 150 more while they are compared.
PART_OCCURRENCES = 500_000
#: Buckets and occurrences from which an anchor's runs are dealt apart; bits of a word's code.
HOT_BUCKETS, HOT, CODE = 4096, 200_000, 40
#: Words on either side of an anchor that a run around it can reach, and words of an occurrence in all.
SIDE = LENGTH - SEED_WORDS
AROUND = SIDE + LENGTH
_WORD = re.compile(WORD_PATTERN)
_C1, _C2, _C3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_NONE = -(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _C1
    x = (x ^ (x >> np.uint64(29))) * _C2
    return x ^ (x >> np.uint64(32))


def _grams(words: np.ndarray, n: int, factor: np.uint64) -> np.ndarray:
    """Hashes of the n-grams that start at each place (the last n - 1 places left out)."""
    count = max(0, len(words) - n + 1)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = out * factor + words[k : k + count]
    return _mix(out)


class Anchors:
    """The anchors of a bucket's documents, and for each run of LENGTH words its anchor and where that stands in it."""

    def __init__(self, texts: list[str], words: Words):
        found = [words(t) for t in texts]
        self.lengths = np.array([len(own) for own in found], np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.flat = flat = np.fromiter((x for own in found for x in own), np.uint64, int(self.lengths.sum()))
        count = max(0, len(flat) - LENGTH + 1)
        with np.errstate(over="ignore"):
            seeds = _grams(flat, SEED_WORDS, _C3)
        best, offset = seeds[:count].copy(), np.zeros(count, np.int8)
        for k in range(1, SIDE + 1):
            later = seeds[k : k + count]
            better = later <= best
            best[better] = later[better]
            offset[better] = k
        doc = np.repeat(np.arange(len(self.lengths)), self.lengths)[:count]
        self.run = np.flatnonzero(np.arange(count) + LENGTH <= (self.first + self.lengths)[doc])  # word number where a run starts
        self.offset = offset[self.run].astype(np.int64)
        at = self.run + self.offset
        new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
        self.at, self.doc = at[new], doc[self.run[new]]
        self.seed = seeds[self.at]
        self.of = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(at)]))  # the anchor of each run
        self.places = np.zeros(len(new), np.uint8)  # a bit for each run around the anchor that has it as its own
        np.bitwise_or.at(self.places, self.of, (1 << self.offset).astype(np.uint8))

    def around(self, anchors: np.ndarray) -> np.ndarray:
        """(anchors, AROUND) word codes from SIDE words before an anchor to as many after it, 0 outside the document."""
        place = self.at[anchors].astype(np.int32)[:, None] + np.arange(-SIDE, LENGTH, dtype=np.int32)
        low = self.first[self.doc[anchors]].astype(np.int32)[:, None]
        inside = (place >= low) & (place < low + self.lengths[self.doc[anchors]].astype(np.int32)[:, None])
        codes = np.maximum(self.flat[np.clip(place, 0, max(0, len(self.flat) - 1))] >> np.uint64(64 - CODE), np.uint64(1))
        codes[~inside] = 0
        return codes


def _fold(codes: np.ndarray) -> np.ndarray:
    """A hash of each row of codes."""
    out = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(codes.shape[1]):
            out = out * _C1 + codes[:, k]
        return _mix(out)


def _distinct(codes: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the first of equal rows, by least rank, and for each row which of them it equals."""
    fold = _fold(codes)
    order = np.lexsort((rank, fold))
    if not len(order):
        return order, order
    f = fold[order]
    start = np.maximum.accumulate(np.where(np.r_[True, f[1:] != f[:-1]], np.arange(len(f)), 0))
    own = (codes[order] != codes[order[start]]).any(axis=1) | (start == np.arange(len(f)))  # a row of equal hash and other words is its own
    back = np.empty(len(f), np.int64)
    number = np.cumsum(own) - 1
    back[order] = np.where(own, number, number[start])
    return order[own], back


def match(key: np.ndarray, ids: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For occurrences of anchors: a bit for each run around the anchor that an occurrence with a smaller id has too.

    Seeds: occurrences of one key whose anchor words agree form a class. Extension: classes part by the next word to the
    right, up to SIDE words, and by the next to the left; run `o` has o words to the left and SIDE - o to the right.
    """
    order = np.argsort(ids, kind="stable")  # the first of a class is then one of least id
    key, ids, codes = key[order], ids[order], codes[order]
    seed = np.unique(key, return_inverse=True)[1]
    first = np.full(int(seed.max(initial=-1)) + 1, len(seed), np.int64)
    np.minimum.at(first, seed, np.arange(len(seed)))
    if (codes[:, SIDE:LENGTH] != codes[first[seed], SIDE:LENGTH]).any():  # two anchors of one hash
        for k in range(SIDE, LENGTH):
            seed = _part(seed, codes[:, k])
    right, left = [seed], [seed]
    for k in range(SIDE):
        right.append(_part(right[-1], codes[:, LENGTH + k]))
        left.append(_part(left[-1], codes[:, SIDE - 1 - k]))
    out = np.zeros(len(ids), np.uint8)
    for o in range(SIDE + 1):
        both = left[o].astype(np.uint64) << np.uint64(32) | right[SIDE - o].astype(np.uint64)
        _, at, back = np.unique(both, return_index=True, return_inverse=True)
        whole = (codes[:, SIDE - o] != 0) & (codes[:, AROUND - 1 - o] != 0)
        out |= ((ids[at][back] < ids) & whole).astype(np.uint8) << np.uint8(o)
    answer = np.empty_like(out)
    answer[order] = out
    return answer


def _part(classes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Classes divided by a word. Class and code fit one integer below 2**(64 - CODE) classes; of more, by sorting both."""
    if int(classes.max(initial=0)) < 1 << 64 - CODE:
        return np.unique(classes.astype(np.uint64) << np.uint64(CODE) | word, return_inverse=True)[1]
    order = np.lexsort((word, classes))
    c, w = classes[order], word[order]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.r_[False, (c[1:] != c[:-1]) | (w[1:] != w[:-1])])
    return out


def _send(bucket: bytes, keys: np.ndarray, payload: list[np.ndarray], parts: int) -> Iterator[dict]:
    """A row for each part with the keys that fall in it and their rows of the payload arrays."""
    order, first, size = _dealt(keys, parts)
    for part in np.flatnonzero(size).tolist():
        own = order[first[part] : first[part] + size[part]]
        yield {"part": part, "bucket": bucket, "hashes": keys[own].tobytes(), "ids": zstandard.compress(b"".join(x[own].tobytes() for x in payload), 1)}


def _dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key numbers in order of their part, and where each part begins and how many it has."""
    part = (keys % np.uint64(parts)).astype(np.int64)
    size = np.bincount(part, minlength=parts)
    return np.argsort(part, kind="stable"), np.cumsum(size) - size, size


def _read(answers: pa.Table, kind: str, keys: np.ndarray, parts: int) -> np.ndarray:
    """The byte that came back for each key that a bucket sent."""
    order, first, size = _dealt(keys, parts)
    out = np.zeros(len(keys), np.uint8)
    for k, p, raw in zip(*(answers.column(c).to_pylist() for c in ("kind", "part", "bits"))):
        if k == kind:
            out[order[first[p] : first[p] + size[p]]] = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return out


_SENT = pa.schema([("part", pa.int32()), ("bucket", pa.binary()), ("hashes", pa.binary()), ("ids", pa.binary())])
_BITS = pa.schema([("bucket", pa.binary()), ("kind", pa.string()), ("part", pa.int32()), ("bits", pa.binary()), ("shared", pa.int64())])
_SENT_DDL, _BITS_DDL = "part int, bucket binary, hashes binary, ids binary", "bucket binary, kind string, part int, bits binary, shared bigint"


def _pack(docs: DataFrame) -> DataFrame:
    """(bucket, ids, texts): documents of a slice of rows, ascending by id, texts compressed as one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in (s for b in batches for s in slices(b, PACK)):
            ids = np.array([_NONE if i is None else i for i in batch.column("doc_id").to_pylist()], np.int64)
            texts = batch.column("text").to_pylist()
            order = np.argsort(ids, kind="stable")
            raw = [(texts[k] or "").encode() for k in order]
            sizes = np.array([len(r) for r in raw], np.int64)
            block = press.compress(sizes.tobytes() + b"".join(raw))
            known = np.array([batch.column("doc_id")[int(k)].is_valid for k in order], np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().bytes], pa.binary()), pa.array([ids[order].tobytes() + known.tobytes()], pa.binary()), pa.array([block], pa.binary()), pa.array([int(sizes.sum())])], names=["bucket", "ids", "texts", "size"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "bucket binary, ids binary, texts binary, size long")


def _unpack(ids: bytes, block: bytes) -> tuple[np.ndarray, np.ndarray, list[str]]:
    n = len(ids) // 9
    raw = zstandard.decompress(block)
    ends = np.cumsum(np.frombuffer(raw[: 8 * n], np.int64)) + 8 * n
    starts = np.r_[8 * n, ends[:-1]]
    return np.frombuffer(ids[: 8 * n], np.int64), np.frombuffer(ids[8 * n :], np.uint8).astype(bool), [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]


def _counted(anchors: Anchors, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchor hashes, their occurrences, whether several of the bucket's ids have them, and the index back."""
    seeds, back, count = np.unique(anchors.seed, return_inverse=True, return_counts=True)
    own = rank[anchors.doc]
    low, high = np.full(len(seeds), len(rank), np.int64), np.full(len(seeds), -1, np.int64)
    np.minimum.at(low, back, own)
    np.maximum.at(high, back, own)
    return seeds, count, high > low, back


def _seeds(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for bucket, ids, texts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "ids", "texts"))):
                own, _, texts = _unpack(ids, texts)
                seeds, count, _, _ = _counted(Anchors(texts, words), np.unique(own, return_inverse=True)[1])
                yield pa.RecordBatch.from_pylist(list(_send(bucket, seeds, [np.minimum(count, 65_535).astype(np.uint16)], parts)), schema=_SENT)

    return run


def _blocks(rows: pa.Table, width: int) -> tuple[np.ndarray, list[bytes], list[int]]:
    """The keys of a part's blocks, their payloads (`width` bytes a key), and the keys of each block."""
    keys = [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]
    payload = [zstandard.decompress(x, max_output_size=width * len(k)) for x, k in zip(rows.column("ids").to_pylist(), keys)]
    return np.concatenate(keys), payload, [len(k) for k in keys]


def _shared(hot_buckets: int, hot: int):
    def run(rows: pa.Table) -> pa.Table:
        """Of one part: for each bucket's anchors, 0 if no other bucket has it, 1 if one has, 2 if it is hot."""
        keys, payload, sizes = _blocks(rows, 2)
        count = np.concatenate([np.frombuffer(p, np.uint16) for p in payload]).astype(np.int64)
        _, back, buckets = np.unique(keys, return_inverse=True, return_counts=True)
        total = np.bincount(back, count)
        state = (buckets > 1).astype(np.uint8) + ((buckets > 1) & ((buckets > hot_buckets) | (total > hot)))
        state = state[back].astype(np.uint8)
        return _answer("seed", rows, sizes, state, np.add.reduceat(np.where(state > 0, count, 0), np.cumsum([0, *sizes[:-1]])))

    return run


def _matched(rows: pa.Table) -> pa.Table:
    """Of one part: for each bucket's occurrences, the runs that a document with a smaller id than theirs has."""
    step = CODE // 8
    keys, payload, sizes = _blocks(rows, 8 + step * AROUND)
    ids = np.concatenate([np.frombuffer(p, np.int64, n) for p, n in zip(payload, sizes)])
    raw = np.concatenate([np.frombuffer(p, np.uint8, offset=8 * n) for p, n in zip(payload, sizes)]).reshape(-1, step)
    codes = np.zeros((len(raw), 8), np.uint8)
    codes[:, :step] = raw
    return _answer("run", rows, sizes, match(keys, ids, codes.view("<u8").reshape(-1, AROUND)))


def _answer(kind: str, rows: pa.Table, sizes: list[int], found: np.ndarray, shared: np.ndarray | None = None) -> pa.Table:
    """A row a block: what was found for its keys, and the occurrences that it will send of those that are shared."""
    own = [zstandard.compress(x.tobytes(), 1) for x in np.split(found, np.cumsum(sizes)[:-1])]
    return pa.table([rows.column("bucket"), pa.array([kind] * len(sizes)), rows.column("part"), pa.array(own, pa.binary()), pa.array(np.zeros(len(sizes), np.int64) if shared is None else shared)], schema=_BITS)


class Occurrences:
    """What a bucket sends of its shared anchors: each distinct occurrence once, or, of hot anchors, each distinct run."""

    def __init__(self, ids: np.ndarray, anchors: Anchors, answers: pa.Table, parts: int):
        self.rank = np.unique(ids, return_inverse=True)[1]
        seeds, _, local, back = _counted(anchors, self.rank)
        state = np.maximum(_read(answers, "seed", seeds, parts), local.astype(np.uint8))[back]
        self.anchors = np.flatnonzero(state)
        codes = anchors.around(self.anchors)
        own = self.rank[anchors.doc[self.anchors]]
        first, self.back = _distinct(codes, own)
        self.least = own[first]
        codes, places, hot = codes[first], anchors.places[self.anchors[first]], state[self.anchors[first]] == 2
        self.plain, self.hot = np.flatnonzero(~hot), np.flatnonzero(hot)
        keys, rows, ranks, self.runs = [anchors.seed[self.anchors[first[self.plain]]]], [codes[self.plain]], [self.least[self.plain]], []
        for o in range(SIDE + 1):
            at = self.hot[places[self.hot] >> o & 1 > 0]
            masked = np.zeros((len(at), AROUND), np.uint64)
            masked[:, SIDE - o : SIDE - o + LENGTH] = codes[at, SIDE - o : SIDE - o + LENGTH]
            keys.append(_fold(masked))
            rows.append(masked)
            ranks.append(self.least[at])
            self.runs.append(at)
        self.keys, self.codes, self.ranks = np.concatenate(keys), np.concatenate(rows), np.concatenate(ranks)

    def payload(self, ids: np.ndarray) -> list[np.ndarray]:
        raw = np.ascontiguousarray(self.codes.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, : CODE // 8].reshape(len(self.codes), AROUND * (CODE // 8))
        return [np.unique(ids)[self.ranks], np.ascontiguousarray(raw)]

    def hits(self, anchors: Anchors, found: np.ndarray) -> np.ndarray:
        """Numbers of the words where runs start that a smaller id has; found: the answers to `keys`."""
        bits = np.zeros(len(self.least), np.uint8)
        bits[self.plain] = found[: len(self.plain)]
        at = len(self.plain)
        for o, own in enumerate(self.runs):
            bits[own] |= found[at : at + len(own)] & (1 << o)
            at += len(own)
        every = np.zeros(len(anchors.at), np.uint8)
        every[self.anchors] = bits[self.back] | np.where(self.rank[anchors.doc[self.anchors]] > self.least[self.back], np.uint8(255), np.uint8(0))
        return anchors.run[every[anchors.of] >> anchors.offset.astype(np.uint8) & 1 > 0]


def _extend(parts: int, run_parts: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        words = Words()
        for bucket, ids, texts in zip(*(left.column(c).to_pylist() for c in ("bucket", "ids", "texts"))):
            own, _, texts = _unpack(ids, texts)
            found = Occurrences(own, Anchors(texts, words), right, parts)
            out += _send(bucket, found.keys, found.payload(own), run_parts)
        return pa.Table.from_pylist(out, schema=_SENT)

    return run


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.string()), ("kept", pa.string())])


def _remove(parts: int, run_parts: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        words = Words()
        for packed, texts in zip(*(left.column(c).to_pylist() for c in ("ids", "texts"))):
            ids, known, texts = _unpack(packed, texts)
            anchors = Anchors(texts, words)
            occurrences = Occurrences(ids, anchors, right, parts)
            places = occurrences.hits(anchors, _read(right, "run", occurrences.keys, run_parts))
            steps = np.zeros(int(anchors.lengths.sum()) + 1, np.int64)
            np.add.at(steps, places, 1)
            np.add.at(steps, places + LENGTH, -1)
            covered = np.cumsum(steps[:-1]) > 0
            for k, (i, ok, text) in enumerate(zip(ids.tolist(), known.tolist(), texts)):
                a = int(anchors.first[k])
                mine = covered[a : a + int(anchors.lengths[k])]
                removed = int(mine.sum())
                own = _WORD.findall(text)
                edges = np.flatnonzero(np.diff(np.r_[False, mine, False].astype(np.int8))) if removed else []
                for c, v in zip(out, (i if ok else None, len(own), removed, ",".join(f"{x}:{y}" for x, y in zip(edges[::2], edges[1::2])), " ".join(w for w, m in zip(own, mine.tolist()) if not m) if removed else " ".join(own))):
                    c.append(v)
        return pa.table([pa.array(c, f.type) for c, f in zip(out, _RESULT)], schema=_RESULT)

    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) → doc_id, n_words, n_removed, spans (removed word ranges start:end), kept (text)."""
    spark = docs.sparkSession
    packed = materialise(_pack(docs), "repeat-buckets")
    size = packed.agg(F.sum("size")).first()[0] or 0
    parts = max(PARTS * shuffle_width(spark), int(size * 0.4) // PART_BYTES + 1)  # 0.3 seeds of 8 bytes a word of 6
    seeds = map_arrow(packed, _seeds(parts), _SENT_DDL)
    shared = materialise(seeds.groupBy("part").applyInArrow(_shared(HOT_BUCKETS, HOT), _BITS_DDL), "repeat-seeds")
    occurrences = shared.agg(F.sum("shared")).first()[0] or 0
    run_parts = max(parts, occurrences // PART_OCCURRENCES + 1)
    runs = packed.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(_extend(parts, run_parts), _SENT_DDL)
    earlier = materialise(runs.groupBy("part").applyInArrow(_matched, _BITS_DDL), "repeat-runs")
    answers = shared.unionByName(earlier)
    return packed.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_remove(parts, run_parts), "doc_id long, n_words long, n_removed long, spans string, kept string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k, len(ws) AS n FROM d),
g AS (SELECT doc_id, k, n, word, CASE WHEN k <= n - 12 THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) END AS win FROM w),
f AS (SELECT win, min(doc_id) AS first FROM g WHERE win IS NOT NULL GROUP BY win),
m AS (SELECT g.doc_id, g.k, g.word, CASE WHEN f.first < g.doc_id THEN 1 ELSE 0 END AS hit FROM g LEFT JOIN f ON g.win = f.win),
c AS (SELECT doc_id, k, word, max(hit) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM m),
r AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS bigint) AS n_words, CAST(coalesce(r.n_removed, 0) AS bigint) AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
