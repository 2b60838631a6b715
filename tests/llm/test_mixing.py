"""The mix against a direct computation in plain Python, its shards, and sums in levels."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vitalspark.llm import mixing

WORD = re.compile("[^\x20\x09-\x0d]+")
BLOCK, SHARD = 16, 8


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    rows = [(k, None if k % 9 == 0 else "abc"[min(2, rng.randrange(6))], " ".join(f"w{k}x{j}" for j in range(rng.choice((0, 1, 5, 40, 90)))), "clash", 1) for k in range(200)]
    rows += [(None, "d", "alone", "clash", 1), (7, "a", None, "clash", 1), (8, "zero", "", "clash", 1), (9, "zero", " \n", "clash", 1), (1000, "b", "long " * 5000, "clash", 1)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, row_id string, block int").repartition(3).persist()


def direct(mix, order):
    """Words that each row gives, from the plan's quotas and permutations alone; order: (row_id, source number, size) in stream order."""
    streams = defaultdict(list)
    for row, src, size in order:
        streams[src] += [row] * size
    taken = Counter()
    for s, (blocks, slots, cut) in enumerate(mix.quota.itertuples(index=False)):
        for j in range(slots):
            key = mixing._key(mixing.np.array([s]), mixing.np.array([j // blocks]), mix.seed)
            b = int(mixing.permute([j % blocks], [blocks], key)[0])
            taken.update(streams[s][b * BLOCK : b * BLOCK + (cut if j == slots - 1 else BLOCK)])
    return taken


def test_taken_words_equal_the_direct_mix(docs):
    rows = mixing.materialise(mixing.sized(docs), "test-sizes")
    mix = mixing.Mix(rows, block=BLOCK, shard=SHARD)
    got = mix.taken().collect()
    order = sorted(((r["src"], r["offset"], r["row_id"], r["size"]) for r in got if r["size"]))
    assert all(a[0] != b[0] or a[1] + a[3] == b[1] for a, b in zip(order, order[1:]))  # streams without gaps
    want = direct(mix, [(row, src, size) for src, _, row, size in order])
    assert {r["row_id"]: r["taken"] for r in got if r["taken"]} == dict(want)
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    targets = mixing.targets(sizes)
    by = Counter()
    for r in got:
        by[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"] and r["target"] == float(targets[r["source"]])
    assert all(abs(by[s] - t) <= 1 for s, t in targets.items())


def test_shards_hold_the_mix(docs):
    slots = mixing.sharded(docs, BLOCK, SHARD).collect()
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_documents(docs, BLOCK).where("doc_id < 200 and size > 0").collect()}
    by = defaultdict(list)
    words = Counter()
    for r in slots:
        by[r["shard"]].append(r["slot"])
        own = WORD.findall(r["text"])
        assert len(own) == r["n_words"] <= BLOCK
        words.update(int(w[1:].split("x")[0]) for w in own if w[0] == "w")
    last = max(by)
    assert all(sorted(own) == list(range(SHARD if k < last else len(own))) for k, own in by.items())
    assert words == {k: n for k, n in taken.items() if n}
    assert len({r["source"] for r in slots if r["shard"] < 4}) > 2
    assert mixing.sharded(docs.limit(0)).count() == 0


def test_bases_in_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEVEL", 3)
    rows = [(s, b, (b * 7 + s) % 5) for s in range(3) for b in range(0, 50, s + 1)]
    got = {(r["src"], r["bucket"]): r["base"] for r in mixing._bases(spark.createDataFrame(rows, "src int, bucket long, sum long"), 50).collect()}
    assert got == {(s, b): sum(n for t, c, n in rows if t == s and c < b) for s, b, _ in rows}


def test_very_long_text_and_repeated_rows(spark):
    rows = [(1, "a", "word " * 60_000), (1, "a", "word " * 60_000), (2, "b", "x")]
    got = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, source string, text string")).agg(F.sum("size"), F.max(F.col("taken") / F.col("size"))).first()
    assert got[0] == 120_001 and got[1] <= 2
