"""SimHash with Golay keys against all pairs of fingerprints."""

import random
import re

import numpy as np
import pytest
import xxhash

from vitalspark.llm import simhash

SCHEMA = "doc_id long, text string"


def plain_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """{print: least of its component}."""
    prints = sorted(set(prints))
    label = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for b in prints[i + 1 :]:
                if (a ^ b).bit_count() <= 2 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def plain(rows):
    prints = [plain_print(t) for _, t in rows]
    label = plain_components(prints)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[label[p]] = min(least.get(label[p], i), i)
    return sorted(((i, p, least.get(label[p])) for (i, _), p in zip(rows, prints)), key=str)


def found(spark, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.selectExpr("*", "1 AS print", "'x' AS label", "2 AS least", "3 AS component_id")
    return sorted(((r["doc_id"], r["print"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)


def test_the_code_is_perfect():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 2000)
    own = simhash.decode(x)
    low, high, _ = simhash._code()
    words = {int(d): None for d in own}
    errors = x ^ ((own << 11) | low[(own << 11) & 0xFFF] ^ high[own >> 1])  # systematic: index, then the remainder
    assert np.bitwise_count(errors).max() <= 3 and len(words) > 1000
    for weight in range(1, 4):  # a codeword with up to three errors decodes to itself
        word = x ^ errors
        for _ in range(20):
            flips = np.zeros_like(x)
            while (np.bitwise_count(flips) < weight).any():
                flips |= np.where(np.bitwise_count(flips) < weight, 1 << rng.integers(0, 23, len(x)), 0)
            assert (simhash.decode(word ^ flips) == own).all()


def test_segments_at_one_bit_have_each_the_others_codeword_and_one_or_six_keys():
    x = np.random.default_rng(2).integers(0, 1 << 23, 500)
    codes, first = simhash.near_codes(x, 23)
    assert set(first.sum(1)) <= {1, 6}
    for bit in range(23):
        assert (codes == simhash.decode(x ^ 1 << bit)[:, None]).any(1).all()


def test_all_fingerprints_at_two_bits_share_a_key():
    rng = random.Random(3)
    for _ in range(20):
        p = rng.getrandbits(64)
        near = [p] + [p ^ 1 << i for i in range(64)] + [p ^ 1 << i ^ 1 << j for i in range(64) for j in range(i)]
        key, whose = simhash.keys(np.array(near, np.uint64))
        own = {}
        for k, w in zip(key.tolist(), whose.tolist()):
            own.setdefault(w, set()).add(k)
        assert key.min() >= 0 and all(own[0] & own[w] for w in range(len(near)))
        assert len(key) == len(set(zip(key.tolist(), whose.tolist())))


def test_fingerprints_equal_the_plain_ones(monkeypatch):
    rng = random.Random(4)
    texts = ["", " \t\n", "A", "a B", "É é x \x0b y", "a b c", "A B C " * 4] + [" ".join("".join(rng.choice("abcDEF é") for _ in range(5)) for _ in range(rng.randrange(60))) for _ in range(60)]
    for piece in (1, 7, 1 << 20):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert [simhash.fingerprint(t) for t in texts] == [plain_print(t) for t in texts]


@pytest.mark.parametrize("block", [64, 3, 1])
def test_components_of_crowded_fingerprints_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(5)
    prints = []
    for _ in range(6):  # crowds that stray from a centre, most of them linked through others
        p = rng.getrandbits(64)
        for _ in range(60):
            prints.append(p)
            p = p ^ 1 << rng.randrange(20) ^ (1 << rng.randrange(64) if rng.random() < 0.3 else 0)
    prints += [rng.getrandbits(64) for _ in range(100)] + [0, 1, 3, 7 << 61]
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in simhash.links(spark.createDataFrame([(p,) for p in signed], "print long")).collect()]
    assert all((a ^ b).bit_count() <= 2 and a != b for a, b in links)
    own = {p: p for p in prints}

    def root(p):
        while own[p] != p:
            p = own[p]
        return p

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        own[b] = a
    assert {p: root(p) for p in prints} == plain_components(prints)


def test_rows_equal_the_plain_ones(spark):
    rng = random.Random(6)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(rng.randrange(1, 200))) for _ in range(12)]
    rows = [(None, "alpha"), (None, None), (3, None), (3, None), (4, ""), (5, " \n"), (6, "alpha"), (6, "ALPHA"), (7, "alpha beta"), (8, "x " * 40_000)]
    for k in range(120):
        words = rng.choice(base).split()
        if rng.random() < 0.7:
            words[rng.randrange(len(words))] = rng.choice(["zeta", "eta"])
        rows.append((100 + rng.randrange(100), " ".join(words)))
    assert found(spark, rows, extra=True) == plain(rows)
    assert found(spark, []) == []
    assert found(spark, [(None, "one")])[0][2] is None


def test_whole_documents_equal_the_plain_ones(spark):
    df = simhash.op12_simhash(spark, "/root/testdata/sf0.001")
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in df.collect()), key=str) == plain(rows)
    assert all(len(r["fingerprint"]) == 16 for r in df.collect())
