"""Conversation prefix trie against a plain dictionary of prefixes, and its blocks against each other."""

import hashlib
import math
import random
import re
import zlib

import pytest

from vitalspark.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """The contract, prefix by prefix."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0, digest), (role, text)))
    convs = {c: [t for _, t in sorted(ts, key=lambda x: x[0])] for c, ts in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    words = {p: len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0 for p in nodes}
    leaves, saved, kids = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members) - 1) * words[p]
    key = lambda r: tuple((v is not None, v) for v in r)
    return sorted(
        ((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(m) if built[c] == p).encode()).hexdigest()) for p, m in nodes.items()),
        key=key,
    )


def found(spark, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.selectExpr("*", "'x' AS d", "1 AS w", "2 AS pos", "3 AS first", "'y' AS ends")
    out = trie.prefix_trie(trie.shared_heads(trie.ordered(df))).select(*COLUMNS).collect()
    return sorted((tuple(r) for r in out), key=lambda r: tuple((v is not None, v) for v in r))


def made(seed, n, longest, letters="ab"):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(4 * n), n):
        for k in range(rng.randrange(1, longest)):
            rows.append((c, k, rng.choice(["user", None]), " ".join(rng.choice(letters) for _ in range(rng.randrange(3)))))
    return rows


@pytest.mark.parametrize("partitions", ["1", "7", "40"])
@pytest.mark.parametrize("seed,n,longest", [(1, 60, 5), (2, 90, 12), (3, 300, 3)])
def test_nodes_equal_those_of_a_dictionary(spark, partitions, seed, n, longest):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = made(seed, n, longest)
        assert found(spark, rows, extra=seed == 1) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_ties_nulls_repeats_long_and_turnless_conversations(spark):
    rows = [(1, None, None, None), (1, None, "user", "a b"), (1, 0, "user", "a b"), (1, 0, "user", "a b"), (None, 0, "user", "lost"), (20, 0, "u", "x " * 50_000), (20, 1, None, "y")]
    rows += [(c, 0, "u", "q") for c in range(40, 60)] + [(-5, 0, "user", "a"), (-20, 3, "user", "b"), (7, 0, "", "1:"), (8, 0, "1", ":")]
    rows += [(100, k, "u", f"t{k}") for k in range(300)] + [(101, k, "u", f"t{k}") for k in range(300)] + [(119, k, "u", f"t{k}") for k in range(150)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == [] == found(spark, [(None, 0, "user", "a")])


def test_a_hot_conversation_and_a_hot_first_turn(spark):
    rows = [(c, k, "u", f"same {k}") for c in range(0, 30_000, 20) for k in range(3)]
    rows += [(c, k, "u", f"same {min(k, 0)}" if k == 0 else f"{c} {k}") for c in range(30_000, 40_000, 20) for k in range(2)]
    assert found(spark, rows) == plain(rows)


def cut(entries, sizes):
    """Rows of blocks of the given sizes."""
    rows, at = [], 0
    for block, size in enumerate(sizes):
        rows += list(trie.scan_block(iter(entries[at : at + size]), block))
        at += size
    return rows


def test_start_of_a_node_is_the_nearest_smaller_value_to_the_left():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randrange(1, 8)
        rows = [(3 * k, rng.randrange(4) if k else -1, 0, rng.randrange(4), 9) for k in range(n)]
        blocks = trie.Blocks(rows)
        for k in range(n):
            for depth in range(1, 5):
                at = k
                while rows[at][1] >= depth:
                    at -= 1
                    if rows[at][3] < depth:
                        break
                assert blocks.start(3 * k, depth) == 3 * at


def test_a_block_has_its_whole_nodes_once_and_open_ones_along_its_ends():
    entries = [([b"a"], [1], 2, 5, "x"), ([b"a", b"b"], [1, 2], 1, 4, "y"), ([b"a", b"c"], [1, 3], 1, 9, "z"), ([b"d"], [4], 1, 1, "w")]
    rows = cut(entries, [4])
    nodes = sorted((r[1], r[2], r[3], r[4], r[5], r[6]) for r in rows if r[15] is None)
    assert nodes == [(0, 0, True, True, 5, 1), (0, 1, True, False, 4, 4), (1, 2, False, False, 1, 4), (2, 2, False, False, 1, 9), (3, 1, False, True, 1, 1)]
    assert [r[15:] for r in rows if r[15] is not None] == [[[b"a"], [0, 1], [b"d"], 0]]
    assert cut(entries, [0]) == []


def test_digests_of_ends_do_not_depend_on_how_ids_are_cut(spark, monkeypatch):
    monkeypatch.setattr(trie, "RUN", 3)
    rows = [(bytes([k % 3]), k) for k in range(1000)] + [(b"one", 7)]
    got = {bytes(r["key"]): r["ends"] for r in trie.digest_of_ends(spark.createDataFrame(rows, "key binary, id long").repartition(5)).collect()}
    for key in (b"\0", b"\1", b"\2", b"one"):
        assert got[key] == hashlib.sha256(",".join(str(i) for k, i in sorted(rows, key=lambda r: r[1]) if k == key).encode()).hexdigest()
