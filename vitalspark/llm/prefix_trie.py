"""The trie of conversation prefixes, from the Cartesian tree over the LCP array of the sorted conversations.

Method: a turn is a digest of its role and text, a conversation the array of its digests. Different conversations are sorted
by range partitions, so a partition is a block of the sorted list. The longest common prefixes (LCP) of neighbours form an
array whose Cartesian tree, with nodes of equal LCP merged, is the compact trie: a node is an interval of the list between
the nearest smaller values on both sides. Each block finds its intervals by one scan with a stack and expands the depths
between a node and its parent. Intervals that touch a block's end go on in its neighbours: where such a node begins is the
nearest smaller value to the left among the minima of the blocks and the LCPs between them, two integers a block.
The pieces of these nodes, as many as blocks times depth, are added up by the node's first block and depth; all other nodes
are whole in their block. What is counted at the node's first piece alone (children, words) is put right by the LCP at the
block's start, so every quantity is a sum or a minimum of pieces: saved tokens are the words of the members' turns from the
node's depth on, less those of the different turns.

Skew: copies of a conversation are one entry from the first partial aggregation on; a first turn that very many share is an
interval over many blocks. Members that end at a node are hashed from sorted runs of their ids, made in range partitions.
Children of open nodes look up their parent in a table of blocks times depth rows. A single conversation is one row of 24
bytes a turn, sorted in one task (with spill); its texts never meet there. A block keeps the open path and the children
that wait for their parent's end.

Defined results: rows of a null conv_id belong to no conversation; a null role or text is empty; rows of one turn number are
ordered by their digest, equal ones are turns of their own; the base of c is c - c % 20 with the sign of c for negative ids;
very long texts and conversations are whole; an empty table has no nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import WORD_PATTERN, map_arrow, materialise, maybe_broadcast, slices, table

#: Every conversation whose id is not a multiple of FAMILY takes up to HEADS - 1 first turns from the last that is.
FAMILY, HEADS = 20, 4
#: Ids that are joined to one run before they are hashed, and rows of a batch of nodes.
RUN, BATCH = 4096, 4096
_NONE = hashlib.sha256(b"").hexdigest()
#: Of a node's piece: block, first entry, depth, touches the block's begin and end; members, least member, children, leaves,
#: saved tokens, words before its depth, digest of its ends; depth and touching of a parent that may be open, or its least member.
_PIECE = (
    "block int, first bigint, depth bigint, left boolean, right boolean, n bigint, conv bigint, children bigint, leaves bigint, saved bigint, before bigint, ends string, "
    "up_left boolean, up_right boolean, up_conv bigint, head array<binary>, head_words array<bigint>, tail array<binary>, span bigint"
)


def _count() -> Column:
    return F.regexp_count("text", F.lit(WORD_PATTERN)).cast("bigint")


def ordered(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) → conv_id, t: its turns (pos, digest d, words w) in order."""
    clean = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32))
    narrow = clean.select("conv_id", "turn", digest.alias("d"), _count().alias("w"))
    placed = narrow.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "d")))
    return placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "d", "w"))).alias("t"))


def shared_heads(convs: DataFrame) -> DataFrame:
    """conv_id, t → the same with the first turns of each family's base in place of a conversation's own."""
    own = convs.withColumns({"base": F.expr(f"conv_id - conv_id % {FAMILY}"), "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS})
    heads = convs.where(f"conv_id % {FAMILY} = 0").select(F.col("conv_id").alias("base"), F.slice("t", 1, HEADS - 1).alias("top"))
    h = F.col("h").cast("int")
    joined = own.join(heads, "base", "left").withColumn("top", F.coalesce("top", F.slice("t", 1, 0)))
    return joined.select("conv_id", F.concat(F.slice("top", F.lit(1), h), F.slice("t", h + 1, F.size("t"))).alias("t"))


def digest_of_ends(members: DataFrame) -> DataFrame:
    """members(key, id) → key, ends: SHA-256 of the ids of a key, ascending and joined by commas."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, []

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["key", "id", "run"])

        for batch in batches:
            for key, x in zip(batch.column("key").to_pylist(), batch.column("id").to_pylist()):
                if key != now or len(ids) == RUN:
                    if ids:
                        yield give()
                    now, ids = key, []
                ids.append(x)
        if ids:
            yield give()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, keys, found = None, None, [], []
        for batch in (s for b in batches for s in slices(b)):
            for key, run in zip(batch.column("key").to_pylist(), batch.column("run").to_pylist()):
                if key != now:
                    if state:
                        keys.append(now)
                        found.append(state.hexdigest())
                    now, state = key, hashlib.sha256(run.encode())
                else:
                    state.update(b"," + run.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], names=["key", "ends"])
            keys, found = [], []
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends"])

    dealt = members.select("key", F.col("id").cast("bigint").alias("id")).repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    made = map_arrow(dealt, runs, "key binary, id bigint, run string")
    return map_arrow(made.repartition("key").sortWithinPartitions("key", "id").select("key", "run"), hashed, "key binary, ends string")


def common_prefix(a: list[bytes], b: list[bytes]) -> int:
    k, end = 0, min(len(a), len(b))
    while k < end and a[k] == b[k]:
        k += 1
    return k


class _Open:
    """A node on the stack of a block's scan: an interval whose end is not reached."""

    __slots__ = ("depth", "first", "left", "n", "conv", "children", "leaves", "total", "words", "ends", "waiting")

    def __init__(self, depth: int, first: int, left: bool):
        self.depth, self.first, self.left = depth, first, left
        self.n, self.conv, self.children, self.leaves, self.total, self.words, self.ends, self.waiting = 0, None, 0, 0, 0, 0, None, []

    def take(self, child: _Open, upper: list[int]) -> None:
        """Add a closed child; `upper` are the words of the path to it by depth."""
        self.n, self.conv = self.n + child.n, child.conv if self.conv is None else min(self.conv, child.conv)
        self.children, self.leaves, self.total = self.children + 1, self.leaves + child.leaves, self.total + child.total
        self.words += child.words + upper[child.depth] - upper[self.depth]


def scan_block(entries: Iterator[tuple[list[bytes], list[int], int, int, str]], block: int) -> Iterator[list]:
    """Sorted different (digests, words, members, least member, digest of ends) → rows of _PIECE."""
    stack = [_Open(0, 0, True)]
    last: list[bytes] = []
    words = [0]  # of the last entry's path, in all by depth
    head = head_words = span = None

    def close(node: _Open, parent: _Open, right: bool) -> Iterator[list]:
        node.leaves = node.leaves or 1
        for row in node.waiting:  # children whose parent is now known, but for an end that is open
            row[12], row[13], row[14] = (False, True, None) if right else (False, False, node.conv)
            yield row
        low = parent.depth if parent is not node else -1
        for d in range(node.depth, low, -1):
            deepest = d == node.depth
            before = words[d - 1] if d else 0
            saved = node.total - node.n * before - (node.words + words[node.depth] - before)
            row = [block, node.first, d, node.left, right, node.n, node.conv, node.children if deepest else 1, node.leaves, saved, before, node.ends if deepest else None, False, False, node.conv]
            row += [None] * 4
            if d > low + 1 or node.left or right:  # pieces of open nodes find their parent later
                yield row
            elif parent.left:
                row[12], row[14] = True, None
                yield row
            else:
                parent.waiting.append(row)
        if parent is not node:
            parent.take(node, words)

    number = -1
    for number, (own, sizes, n, conv, ends) in enumerate(entries):
        lcp = common_prefix(last, own)
        if number:
            span = lcp if span is None else min(span, lcp)
        else:
            head, head_words = own, list(accumulate(sizes, initial=0))
        while stack[-1].depth > lcp:
            node = stack.pop()
            if stack[-1].depth < lcp:
                stack.append(_Open(lcp, node.first, node.left))
            yield from close(node, stack[-1], False)
        if len(own) > lcp:
            stack.append(_Open(len(own), number, not number))
        top = stack[-1]
        top.n, top.conv, top.ends = top.n + n, conv if top.conv is None else min(top.conv, conv), ends
        last, words = own, list(accumulate(sizes, initial=0))
        top.total += n * words[-1]
    if number < 0:
        return
    while stack:
        node = stack.pop()
        yield from close(node, stack[-1] if stack else node, True)
    yield [block, *[None] * 14, head, head_words, last, len(last) if span is None else span]


def _pieces(entries: DataFrame) -> DataFrame:
    """Rows of _PIECE of entries (d, w, n, conv, ends), sorted in range partitions, which are the blocks."""
    kinds = StructType.fromDDL(_PIECE)
    schema = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = (entry for b in batches for s in slices(b) for entry in zip(*(s.column(c).to_pylist() for c in ("d", "w", "n", "conv", "ends"))))
        rows = scan_block(read, TaskContext.get().partitionId())
        while some := list(islice(rows, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)

    return map_arrow(entries.repartitionByRange("d").sortWithinPartitions("d").select("d", "w", "n", "conv", "ends"), run, kinds)


class Blocks:
    """What is known of all blocks: a few integers each."""

    def __init__(self, rows: list[tuple[int, int, int, int, int]]):
        """Rows (block, LCP with the block before, words of the first entry up to it, least LCP inside, length of the last entry)."""
        rows = sorted(rows)
        self.number = {r[0]: k for k, r in enumerate(rows)}
        self.names = [r[0] for r in rows]
        self.glue, self.glued_words, self.span, self.end = (np.array([r[c] for r in rows], np.int64) for c in (1, 2, 3, 4))
        self.glue_next = np.r_[self.glue[1:], -1]
        self._at, self._minima = -1, None

    def start(self, block: int, depth: int) -> int:
        """The first block of a node that holds a block's first entry."""
        k = self.number[block]
        if depth <= 0:
            return self.names[0]
        if self._at != k:  # minima, from the block leftwards, of LCPs between blocks and inside them
            mixed = np.empty(2 * k + 1, np.int64)
            mixed[0::2], mixed[1::2] = self.glue[k::-1], self.span[:k][::-1]
            self._at, self._minima = k, -np.minimum.accumulate(mixed)
        steps = int(np.searchsorted(self._minima, -depth, side="right"))  # before the first one below depth
        return self.names[k - (steps + 1) // 2]

    def key(self, block: int, depth: int, left: bool) -> tuple[int, int, bool]:
        """(first block, depth, whether it goes on to the right there) of the node of an open piece."""
        if left:
            start = self.start(block, depth)
            return start, depth, start != block or depth <= self.span[self.number[block]]
        return block, depth, True

    def up(self, block: int, depth: int, right: bool) -> tuple[int, int, bool]:
        """The key of the parent of an open node, given by its own key."""
        return self.key(block, depth - 1, not right or depth - 1 <= self.span[self.number[block]])


def _known(pieces: DataFrame) -> Blocks:
    ends = pieces.where("head is not null").select("block", "head", "head_words", "span", F.size("tail").alias("end"), F.lag("tail").over(Window.orderBy("block")).alias("before"))  # a row a block

    def glued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            heads, sums = batch.column("head").to_pylist(), batch.column("head_words").to_pylist()
            lcp = [-1 if b is None else common_prefix(b, h) for b, h in zip(batch.column("before").to_pylist(), heads)]
            held = [s[k] if k >= 0 else 0 for s, k in zip(sums, lcp)]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(lcp, pa.int64()), pa.array(held, pa.int64()), batch.column("span"), batch.column("end").cast(pa.int64())], names=["block", "glue", "held", "span", "end"])

    return Blocks([tuple(r) for r in map_arrow(ends, glued, "block int, glue bigint, held bigint, span bigint, end bigint").collect()])  # five integers a block


_OUT = ["conv", "depth", "parent_conv", "n", "children", "leaves", "saved", "ends"]


def _merged(pieces: DataFrame, blocks: Blocks) -> DataFrame:
    """The nodes that touch a block's end, put together: key (at, depth, goes), their values, and the parent's key."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {name: batch.column(name).to_pylist() for name in ("block", "depth", "left", "right", "children", "leaves", "saved", "before")}
            keys, children, leaves, saved = [], [], [], []
            for block, depth, left, right, kids, ends, own, before in zip(*c.values()):
                k = blocks.number[block]
                keys.append(blocks.key(block, depth, left))
                glue = blocks.glue[k] if left else -1
                children.append(kids - (depth < glue))
                leaves.append(ends - (right and blocks.glue_next[k] == blocks.end[k]))
                saved.append(own + (blocks.glued_words[k] - before if depth <= glue else 0))
            at, _, goes = zip(*keys) if keys else ((), (), ())
            arrays = [pa.array(at, pa.int32()), batch.column("depth"), pa.array(goes, pa.bool_()), batch.column("n"), batch.column("conv"), *(pa.array([int(v) for v in x], pa.int64()) for x in (children, leaves, saved)), batch.column("ends")]
            yield pa.RecordBatch.from_arrays(arrays, names=["at", "depth", "goes", "n", "conv", "children", "leaves", "saved", "ends"])

    def risen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [blocks.up(*k) if k[1] else (None, None, None) for k in zip(*(batch.column(c).to_pylist() for c in ("at", "depth", "goes")))]
            up = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *up], names=[*batch.schema.names, "up_at", "up_depth", "up_goes"])

    values = "n bigint, conv bigint, children bigint, leaves bigint, saved bigint, ends string"
    parts = map_arrow(pieces.where("left or right").drop("head", "head_words", "tail"), named, f"at int, depth bigint, goes boolean, {values}")
    sums = parts.groupBy("at", "depth", "goes").agg(*[F.sum(c).alias(c) if c not in ("conv", "ends") else (F.min if c == "conv" else F.max)(c).alias(c) for c in ("n", "conv", "children", "leaves", "saved", "ends")])
    return map_arrow(sums, risen, f"at int, depth bigint, goes boolean, {values}, up_at int, up_depth bigint, up_goes boolean")


def _resolved(pieces: DataFrame, blocks: Blocks) -> DataFrame:
    """Whole nodes below an open parent, with the parent's key."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [blocks.key(b, d - 1, left) for b, d, left in zip(*(batch.column(c).to_pylist() for c in ("block", "depth", "up_left")))]
            up = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("depth", "n", "conv", "children", "leaves", "saved", "ends")), *up], names=["depth", "n", "conv", "children", "leaves", "saved", "ends", "up_at", "up_depth", "up_goes"])

    below = pieces.where("not left and not right and (up_left or up_right)").drop("head", "head_words", "tail")
    return map_arrow(below, named, "depth bigint, n bigint, conv bigint, children bigint, leaves bigint, saved bigint, ends string, up_at int, up_depth bigint, up_goes boolean")


def prefix_trie(turn_lists: DataFrame) -> DataFrame:
    """conv_id, t (turns with digest d and words w) → a row for each node of the trie."""
    made = turn_lists.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.transform("t", lambda x: x["d"]).alias("d"), F.transform("t", lambda x: x["w"]).alias("w"))
    key = F.unhex(F.substring(F.sha2(F.concat_ws("", F.transform("d", lambda x: F.hex(x))), 256), 1, 32))
    made = materialise(made.withColumn("key", key), "trie-lists")
    ends = digest_of_ends(made.select("key", F.col("conv_id").alias("id")))
    entries = made.groupBy("d", "key").agg(F.first("w").alias("w"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv"))
    entries = materialise(entries.join(ends, "key").select("d", "w", "n", "conv", "ends"), "trie-entries")
    pieces = materialise(_pieces(entries), "trie-pieces")
    blocks = _known(pieces)
    nodes = pieces.where("head is null")
    open_ = materialise(_merged(nodes, blocks), "trie-open")
    parents = maybe_broadcast(open_.select(F.col("at").alias("up_at"), F.col("depth").alias("up_depth"), F.col("goes").alias("up_goes"), F.col("conv").alias("parent_conv")), 64)
    up = ["up_at", "up_depth", "up_goes"]
    whole = nodes.where("not left and not right and not up_left and not up_right").withColumn("parent_conv", F.col("up_conv"))
    found = [whole, _resolved(nodes, blocks).join(parents, up), open_.join(parents, up, "left")]
    rows = found[0].select(_OUT).unionByName(found[1].select(_OUT)).unionByName(found[2].select(_OUT))
    return rows.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(_NONE)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(shared_heads(ordered(table(spark, sf_dir, "conversations"))))


OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT i, 0 AS k, i AS v FROM range(256) s(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc WHERE k < 8),
step AS (SELECT list(v ORDER BY i) AS l FROM crc WHERE k = 8),
t AS (
  SELECT conv_id, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
             lambda a, b: xor(a >> 8, l[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t), step),
r AS (
  SELECT c.conv_id, 0 AS side, pos, d, w FROM c JOIN t ON t.conv_id = base AND pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, d, w FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
p AS (
  SELECT conv_id, row_number() OVER o AS depth, string_agg(d, '') OVER o AS path, w FROM r
  WINDOW o AS (PARTITION BY conv_id ORDER BY side, pos)
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
whole AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY 1),
m AS (SELECT p.*, p.depth = whole.depth AS ends FROM p JOIN whole USING (conv_id)),
v AS (
  SELECT path, depth, min(conv_id) AS conv, count(*) AS n, any_value(w) AS w,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends
  FROM m GROUP BY 1, 2),
kids AS (SELECT substr(path, 1, 64 * (depth::INT - 1)) AS path, count(*) AS k FROM v WHERE depth > 0 GROUP BY 1),
full_v AS (SELECT v.*, coalesce(k, 0) AS k FROM v LEFT JOIN kids USING (path)),
up AS (
  SELECT substr(path, 1, 64 * a::INT) AS path, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * w) AS saved
  FROM (SELECT *, unnest(range(depth + 1)) AS a FROM full_v) GROUP BY 1)
SELECT v.conv AS conv_id, v.depth::BIGINT AS depth, above.conv AS parent_conv_id, v.n::BIGINT AS n_convs, v.k::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
       saved::BIGINT AS saved_tokens, v.ends AS ends_sha256
FROM full_v v JOIN up USING (path) LEFT JOIN v above ON v.depth > 0 AND above.path = substr(v.path, 1, 64 * (v.depth::INT - 1))
"""
