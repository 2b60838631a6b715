"""Near-duplicate classes by order min-hash and banded alignment.

Method: a k-mer is SHINGLE consecutive words, labelled with how often it has occurred before in its text. For each of
BANDS x ROWS hash functions the two least labelled k-mers are sampled and kept in text order, so a sketch component
matches with a probability that falls with edits and with reordering. ROWS components make a band key; texts that
share a key are candidates. Candidates are verified by a banded bit-parallel alignment of their words: a link is
1 - distance / longer length >= SIMILARITY. Links are closed to classes by label propagation with shortcuts.

Words are compared by 40-bit hashes: two different words of one hash count as equal, once in 10^12 comparisons. Alignments
of long texts keep masks of the band only, so their memory grows with the text and not with its square.

Candidates: the members of a key are compared with its least member first, and the links found are closed to classes.
A key whose members are then of one class is done, so a group of near copies of any size costs one comparison a member.
In every other key all pairs of members of different classes are compared, those that passed as well as those that
failed: members are dealt to chunks and every two chunks meet in a block. A key of more than MANY members is split first
by an exact prefix filter if that leaves fewer pairs, which is counted: texts that are aligned share at least a word (the
n-th of its kind) among the fifth of the words of each that are rarest in such keys, so members may meet by those words
alone, and a key of unlike members, such as a header that very many texts begin with, costs a row for each of these words
and not a comparison for each pair. Two exact lower bounds of the distance,
from lengths and from word counts in buckets, spare the alignment of most pairs; a pair that the block's own links
have already put into one class is skipped. So two texts that share a key and are aligned are of one class, whatever
else the key holds. Not all aligned texts share a key: the README has the measured share, 0.5 to 0.6 at alignment 0.8.

Skew: equal texts are one node from the start (partial aggregation by digest); keys, pairs and labels are narrow rows
joined by equi-joins that AQE may split; a hot key is many blocks of bounded bytes; nothing but counts comes to the driver.

Defined results: a null text counts as empty; empty texts are equal; a text of fewer than SHINGLE words is one k-mer;
texts whose words agree are alike whatever their spacing; class_id is the least doc_id of a class (nulls only if all
are null); n_links counts the links of a row's text among the pairs that were aligned, enough to hold its class together
and not all that exist; repeated rows share their class; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_PATTERN, fresh, map_arrow, materialise, maybe_broadcast, slices, table

SHINGLE, SIMILARITY, BANDS, ROWS, SEED = 5, 0.8, 24, 1, 11
#: Members and packed bytes of a chunk on average, and the buckets of the two word-count bounds.
CHUNK, CHUNK_BYTES, COARSE, FINE = 1024, 4 << 20, 64, 1024
#: Members from which a key may be split by rare words, and how many times fewer pairs that must leave.
MANY, FEWER = 4 * CHUNK, 4
#: Cells of the table of word counts that orders words by rarity; any order gives the same links.
CELLS = 1 << 16
#: Words up to which an alignment keeps a bit mask of each word; beyond, masks of the band are made as they are needed.
MASKED = 4096
_WORD = re.compile(WORD_PATTERN)
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _C1
    x = (x ^ (x >> np.uint64(29))) * _C2
    return x ^ (x >> np.uint64(32))


class Words:
    """64-bit word hashes with a table of bounded size."""

    def __init__(self, most: int = 100_000):
        self.memo, self.most = {}, most

    def __call__(self, text: str) -> list[int]:
        memo = self.memo
        if len(memo) > self.most:
            memo.clear()
        get = memo.get
        return [get(w) or memo.setdefault(w, xxhash.xxh64_intdigest(w) or 1) for w in _WORD.findall(text)]


def _hash_functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    n = BANDS * ROWS
    return rng.integers(0, 1 << 63, n, np.uint64) << np.uint64(1) | np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def sketches(words: list[list[int]]) -> np.ndarray:
    """(texts, BANDS * ROWS) order-min-hash components; rows of texts without words are 0."""
    out = np.zeros((len(words), BANDS * ROWS), np.uint64)
    some = [k for k, w in enumerate(words) if w]
    if not some:
        return out
    own = [words[k] if len(words[k]) >= SHINGLE else words[k] + [0] * (SHINGLE - len(words[k])) for k in some]
    sizes = np.array([len(w) for w in own])
    flat = np.fromiter((x for w in own for x in w), np.uint64, int(sizes.sum()))
    count = sizes - SHINGLE + 1
    first = np.cumsum(count) - count
    text = np.repeat(np.arange(len(own)), count)
    at = np.arange(len(text)) - first[text] + (np.cumsum(sizes) - sizes)[text]
    with np.errstate(over="ignore"):
        kmer = np.zeros(len(at), np.uint64)
        for k in range(SHINGLE):
            kmer = kmer * _C1 + flat[at + k]
        kmer = _mix(kmer)
        key = _mix(kmer + text.astype(np.uint64) * _C2)  # equal k-mers of one text meet, in text order
        order = np.argsort(key, kind="stable")
        new = np.r_[True, key[order][1:] != key[order][:-1]]
        run = np.flatnonzero(new)
        nth = np.empty(len(key), np.uint64)
        nth[order] = np.arange(len(key)) - run[np.cumsum(new) - 1]
        again = np.flatnonzero(nth)
        kmer[again] = _mix(kmer[again] + nth[again] * _C2)
        place = np.arange(len(kmer), dtype=np.uint64)
        low, high = np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000)
        for j, (a, b) in enumerate(zip(*_hash_functions())):
            value = (kmer * a + b & high) | place
            one = np.minimum.reduceat(value, first)
            value[(one & low).astype(np.int64)] = _MAX
            two = np.minimum.reduceat(value, first)
            ahead = (one & low) < (two & low)
            x, y = np.where(ahead, one, two) >> np.uint64(32), np.where(ahead, two, one) >> np.uint64(32)
            out[some, j] = _mix((x << np.uint64(32) | y) + np.uint64(j))
    return out


def _bits(places: Sequence[int], low: int, high: int) -> int:
    """An integer with the bits of the places in [low, high), counted from low; its size is the band's at most."""
    n = len(places)
    if n == 1:
        return 1 << places[0] - low if low <= places[0] < high else 0
    if n > 4:
        places = places[bisect_left(places, low) : bisect_left(places, high)]
        if len(places) > 32:
            own = bytearray((high - low >> 3) + 1)
            for p in places:
                own[p - low >> 3] |= 1 << (p - low & 7)
            return int.from_bytes(own, "little")
    eq = 0
    for p in places:
        if low <= p < high:
            eq |= 1 << p - low
    return eq


def distance(a: list[int], b: list[int], most: int) -> int:
    """Word edit distance if at most `most`, else any larger number: bit-parallel columns inside a diagonal band."""
    lo = 0
    end = min(len(a), len(b))
    while lo < end and a[lo] == b[lo]:
        lo += 1
    i, j = len(a), len(b)
    while i > lo and j > lo and a[i - 1] == b[j - 1]:
        i, j = i - 1, j - 1
    a, b = a[lo:i], b[lo:j]
    m, n = len(a), len(b)
    if not m or not n or abs(m - n) > most:
        return max(m, n) if not m or not n else most + 1
    masks: dict[int, int] = {}  # of whole texts: their memory grows as the square, so only of short ones
    places: dict[int, list[int]] = {}
    for k, w in enumerate(a):
        if m <= MASKED:
            masks[w] = masks.get(w, 0) | 1 << k
        else:
            places.setdefault(w, []).append(k)
    width = min(m, 2 * most + 2)
    mask = (1 << width) - 1
    up, down, top, skipped = mask, 0, 0, 0  # vertical +1 and -1 steps of the rows in the band; value above them
    for j in range(1, n + 1):
        if j - most - 1 > skipped and skipped < m - 1:  # the band slides down a row
            top += (up & 1) - (down & 1)
            up, down, skipped = up >> 1, down >> 1, skipped + 1
            rows = min(width, m - skipped)
            mask = (1 << rows) - 1
            if rows == width:
                up |= 1 << (rows - 1)
        w = b[j - 1]
        eq = (masks.get(w, 0) >> skipped if masks else _bits(places.get(w, ()), skipped, skipped + width)) & mask
        x = (((eq & up) + up) ^ up) | eq
        right = down | ~(x | up) & mask
        left = up & x
        right, left = right << 1 | 1, left << 1
        x = eq | down
        up, down = (left | ~(x | right)) & mask, right & x & mask
        top += 1
    return top + up.bit_count() - down.bit_count()


def alike(a: list[int], b: list[int]) -> bool:
    longer = max(len(a), len(b))
    most = int(longer * (1 - SIMILARITY) + 1e-9)
    return distance(a, b, most) <= most


def _node() -> F.Column:
    return F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32))


def _sketch(docs: DataFrame) -> DataFrame:
    """(node, components) of each distinct text that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in (s for b in batches for s in slices(b)):
            seen = dict(zip(batch.column("node").to_pylist(), batch.column("text").to_pylist()))  # a text once a slice
            own = [(node, w) for node, t in seen.items() if (w := words(t or ""))]
            if own:
                parts = sketches([w for _, w in own]).astype("<u8")
                yield pa.RecordBatch.from_arrays([pa.array([node for node, _ in own], pa.binary()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["node", "parts"])

    return map_arrow(docs.select(_node().alias("node"), "text"), run, "node binary, parts binary").groupBy("node").agg(F.min("parts").alias("parts"))


def _keys(parts: DataFrame) -> DataFrame:
    """(key, node): a row for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_pylist()
            if not nodes:
                continue
            x = np.frombuffer(b"".join(batch.column("parts").to_pylist()), "<u8").reshape(len(nodes), BANDS, ROWS)
            key = np.zeros((len(nodes), BANDS), np.uint64)
            with np.errstate(over="ignore"):
                for r in range(ROWS):
                    key = _mix(key * _C1 + x[:, :, r] + np.arange(BANDS, dtype=np.uint64))
            at = np.repeat(np.arange(len(nodes)), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().astype(np.int64)), pa.array(nodes, pa.binary()).take(pa.array(at))], names=["key", "node"])

    return map_arrow(parts, run, "key long, node binary")


def _grouped(keys: DataFrame) -> DataFrame:
    """(key, node, lead) of the members of keys with two nodes or more, the lead itself left out."""
    leads = keys.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("other")).where("lead <> other").select("key", "lead")
    # written, the leads are an input of their own, so that the join can split a hot key
    return keys.join(materialise(leads, "omh-leads").hint("merge"), "key").where("node <> lead")


def _word_arrays(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, words) of the given nodes, words as packed hashes; a text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in (s for b in batches for s in slices(b)):
            seen = dict(zip(batch.column("node").to_pylist(), batch.column("text").to_pylist()))
            own = [(np.array(words(t or ""), np.uint64) >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes() for t in seen.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(own, pa.binary())], names=["node", "words"])

    wanted = docs.select(_node().alias("node"), "text").join(maybe_broadcast(nodes, 64), "node", "left_semi")
    return map_arrow(wanted, run, "node binary, words binary").groupBy("node").agg(F.min("words").alias("words"))


def _unpack(raw: bytes) -> list[int]:
    x = np.zeros((len(raw) // 5, 8), np.uint8)
    x[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return x.view("<u8").ravel().tolist()


def _verify(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(node, lead, ok) of candidate pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            lead, unpacked, ok = None, [], []
            for name, a, b in zip(batch.column("lead").to_pylist(), batch.column("words").to_pylist(), batch.column("lead_words").to_pylist()):
                if name != lead:
                    lead, unpacked = name, _unpack(b)
                ok.append(alike(_unpack(a), unpacked))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("lead"), pa.array(ok, pa.bool_())], names=["node", "lead", "ok"])

    both = pairs.join(words, "node").join(words.select(F.col("node").alias("lead"), F.col("words").alias("lead_words")), "lead")
    return map_arrow(both.select("node", "lead", "words", "lead_words"), run, "node binary, lead binary, ok boolean")


def _counts(words: list[np.ndarray], buckets: int) -> np.ndarray:
    """(texts, buckets) numbers of words by hash bucket, capped at 255: a cap never makes two texts look further apart."""
    return np.array([np.minimum(np.bincount((w % np.uint64(buckets)).astype(np.int64), minlength=buckets), 255) for w in words], np.int16)


def block_links(nodes: list[bytes], labels: list[bytes], sides: list[int], raw: list[bytes], cross: bool) -> list[tuple[bytes, bytes]]:
    """Links that join all alike members of different labels in a block; with `cross` only pairs of different sides."""
    order = sorted(range(len(nodes)), key=lambda k: (len(raw[k]), nodes[k]))
    number = {name: k for k, name in enumerate(dict.fromkeys(labels))}
    label, side = np.array([number[labels[k]] for k in order]), np.array([sides[k] for k in order])
    words = [np.array(_unpack(raw[k]), np.uint64) for k in order]
    size = np.array([len(w) for w in words])
    most = (size * (1 - SIMILARITY) + 1e-9).astype(np.int64)
    end = np.searchsorted(size, size / SIMILARITY + 1e-6, side="right")  # longer ones differ by more than they may
    coarse, fine, found = _counts(words, COARSE), {}, []

    def finely(k: int) -> np.ndarray:
        if k not in fine:
            fine[k] = _counts(words[k : k + 1], FINE)[0]
        return fine[k]

    for i in range(len(order)):
        other = label[i + 1 : end[i]] != label[i]
        if cross:
            other &= side[i + 1 : end[i]] != side[i]
        js = i + 1 + np.flatnonzero(other)
        if len(js):  # an edit mends at most two units of the difference of counts, and at most one of the lengths
            apart = np.abs(coarse[js] - coarse[i]).sum(1, dtype=np.int64)
            js = js[apart + size[js] - size[i] <= 2 * most[js]]
        own = words[i].tolist() if len(js) else None
        for j in js.tolist():
            if label[j] == label[i] or int(np.abs(finely(j) - finely(i)).sum(dtype=np.int64)) + size[j] - size[i] > 2 * most[j]:
                continue
            if alike(words[j].tolist(), own):
                found.append((nodes[order[j]], nodes[order[i]]))
                label[label == label[j]] = label[i]
    return found


def rare_words(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Digests of a text's words of a kind, each with its number among these, of the share that aligned texts can differ by
    and one more, rarest first. Two aligned texts have one in common: they share all but a share of the longer's words."""
    kinds, back = np.unique(words, return_inverse=True)
    order = np.argsort(back, kind="stable")
    nth = np.empty(len(words), np.uint64)
    nth[order] = np.arange(len(words)) - np.searchsorted(back[order], back[order])
    with np.errstate(over="ignore"):
        token = _mix(words * _C1 + nth * _C2)
    size = int(len(words) * (1 - SIMILARITY) + 1e-9) + 1
    return token[np.lexsort((token, counts[(words % np.uint64(len(counts))).astype(np.int64)]))[:size]]


def _word_counts(rows: DataFrame) -> np.ndarray:
    """How many words of rows(words) fall in each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in (s for b in batches for s in slices(b)):
            for raw in batch.column("words").to_pylist():
                total += np.bincount(np.array(_unpack(raw), np.int64) % CELLS, minlength=CELLS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["cell", "n"])

    counts = np.zeros(CELLS, np.int64)
    for cell, n in map_arrow(rows.select("words"), run, "cell int, n bigint").groupBy("cell").agg(F.sum("n")).collect():  # CELLS rows at most
        counts[cell] = n
    return counts


def _by_rare_words(rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """rows(key, node, label, words) → (whole, key, node, label): a row for each rare word, with a key of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, 1 << 18)):
            keys, raw = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64), batch.column("words").to_pylist()
            if not raw:
                continue
            with np.errstate(over="ignore"):
                own = [_mix(rare_words(np.array(_unpack(r), np.uint64), counts) ^ k * _C1) for r, k in zip(raw, keys)]
            at = pa.array(np.repeat(np.arange(len(raw)), [len(x) for x in own]))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(at), pa.array(np.concatenate(own).view(np.int64)), batch.column("node").take(at), batch.column("label").take(at)], names=["whole", "key", "node", "label"])

    return map_arrow(rows.select("key", "node", "label", "words"), run, "whole long, key long, node binary, label binary")


def _narrowed(rows: DataFrame, words: DataFrame) -> DataFrame:
    """rows(key, node, label, words) with each key of more than MANY members, if that leaves few pairs, replaced by those of
    its rare words that members of different labels share."""
    hot = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MANY), "omh-hot")
    if hot.isEmpty():
        return rows
    large = rows.join(maybe_broadcast(hot.select("key"), 32), "key", "left_semi")
    spread = materialise(_by_rare_words(large, _word_counts(large)), "omh-spread")
    met = materialise(spread.groupBy("whole", "key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b"), "omh-spread-keys")
    pairs = met.groupBy("whole").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs"))
    better = hot.join(pairs, hot["key"] == pairs["whole"], "left").where(F.coalesce("pairs", F.lit(0.0)) * FEWER < F.col("n").cast("double") * F.col("n")).select("key")
    better = maybe_broadcast(materialise(better, "omh-split"), 32)
    some = spread.join(better.withColumnRenamed("key", "whole"), "whole", "left_semi").join(met.select("whole", "key").hint("merge"), ["whole", "key"])
    return rows.join(better, "key", "left_anti").unionByName(some.join(words, "node").select("key", "node", "label", "words"))


def _blocks(rows: DataFrame) -> DataFrame:
    """rows(key, node, label, words) → (node, lead): links that join all alike members of a key."""
    per = rows.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum(F.octet_length("words")) / CHUNK_BYTES), F.lit(1)).cast("int").alias("chunks"))
    dealt = rows.join(materialise(per, "omh-chunks").hint("merge"), "key").withColumn("side", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("key", F.least("side", "with").alias("one"), F.greatest("side", "with").alias("two"), "side", "node", "label", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(block: tuple, members: list[tuple]) -> pa.RecordBatch:
            sides, nodes, labels, raw = map(list, zip(*members))
            pairs = block_links(nodes, labels, sides, raw, block[1] != block[2])
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], names=["node", "lead"])

        now, members = None, []
        for batch in (s for b in batches for s in slices(b)):
            for key, one, two, *member in zip(*(batch.column(c).to_pylist() for c in ("key", "one", "two", "side", "node", "label", "words"))):
                if (key, one, two) != now:
                    if len(members) > 1:
                        yield give(now, members)
                    now, members = (key, one, two), []
                members.append(member)
        if len(members) > 1:
            yield give(now, members)

    return map_arrow(dealt.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two"), run, "node binary, lead binary")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, lead), verified links between different texts, enough to join all alike texts that share a key; and
    (node, label), the classes that they close to, of the texts that have a link."""
    parts = materialise(_sketch(docs), "omh-sketch")
    members = materialise(_grouped(_keys(parts)), "omh-members")
    wanted = members.select("node").unionByName(members.select(F.col("lead").alias("node"))).distinct()
    words = materialise(_word_arrays(docs, materialise(wanted, "omh-wanted")), "omh-words")
    tried = materialise(_verify(members.select("node", "lead").distinct(), words), "omh-pairs")
    found = tried.where("ok").select("node", "lead")
    known = components(found, "node", "lead")
    label = maybe_broadcast(known, 128)
    bad = tried.where("not ok").select("node", "lead").join(label, "node", "left").withColumnRenamed("label", "own")
    bad = bad.join(label.select(F.col("node").alias("lead"), "label"), "lead", "left").where("coalesce(own, node) <> coalesce(label, lead)").select("node", "lead")
    open_ = materialise(members.join(materialise(bad, "omh-failed").hint("merge"), ["node", "lead"]).select("key").distinct(), "omh-open")
    rows = members.join(maybe_broadcast(open_, 64), "key", "left_semi")
    rows = rows.select("key", "node").unionByName(rows.select("key", F.col("lead").alias("node")).distinct())
    rows = rows.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")).join(words, "node")
    rows = materialise(_narrowed(materialise(rows, "omh-rows"), words), "omh-narrowed")
    more = materialise(_blocks(rows).distinct(), "omh-block-links")
    ends = more.join(label, "node", "left").select("lead", "node", F.coalesce("label", "node").alias("own")).join(label.select(F.col("node").alias("lead"), "label"), "lead", "left")
    ends = materialise(ends.select("node", "lead", "own", F.coalesce("label", "lead").alias("label")), "omh-ends")
    classes = components(ends, "own", "label").withColumnRenamed("label", "class")  # of classes, which are few
    single = ends.select("node", F.col("own").alias("label")).unionByName(ends.select(F.col("lead").alias("node"), "label")).where("node = label")
    every = known.unionByName(single).distinct()
    return found.unionByName(more).distinct(), every.join(maybe_broadcast(classes, 128).withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("class", "label").alias("label"))


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, label): the least node of each connected component, by label propagation with shortcuts."""
    both = edges.select(F.col(left).alias("u"), F.col(right).alias("v"))
    both = materialise(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = materialise(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")), "labels")
    while True:
        known = maybe_broadcast(labels, 128)
        seen = both.join(known.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        near = seen.join(known, F.col("node") == F.col("u")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = known.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = materialise(near.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) → doc_id, node (digest of the text), class_id, first (digest of the text that stays), n_links."""
    ids = materialise(docs.select("doc_id", _node().alias("node")), "near-ids")
    nodes = materialise(ids.groupBy("node").agg(F.min("doc_id").alias("rep")), "near-nodes")
    found, label = links(docs)
    found = materialise(found, "near-links")
    ends = found.select("node").unionByName(found.select(F.col("lead").alias("node")))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    named = nodes.join(label, "node", "left").join(degree, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    named = materialise(named, "near-labels")
    least = named.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node")).alias("least"))
    classes = named.join(materialise(least, "near-classes"), "label").select("node", F.col("least.rep").alias("class_id"), F.col("least.node").alias("first"), "n_links")
    return ids.join(classes, "node").select("doc_id", "node", "class_id", "first", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs, all columns, with the document of least id of each class."""
    lost = near_duplicates(docs).where("not (doc_id <=> class_id and node = first)").select("doc_id", "node").distinct()
    lost = maybe_broadcast(materialise(lost.select(F.col("doc_id").alias("__id"), F.col("node").alias("__lost")), "near-lost"), 96)
    node = fresh(docs, "__node")
    rows = docs.withColumn(node, _node())
    same = (rows[node] == lost["__lost"]) & rows["doc_id"].eqNullSafe(lost["__id"])
    return rows.join(lost, same, "left_anti").drop(node)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("first"))).alias("kept"), "n_links")
