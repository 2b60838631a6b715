"""Operators of the training-data pipeline in Spark: nulls, empty and long texts, ties, repeats, empty tables, other columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vitalspark.llm import bpe, chat_format, exact_dedup, fingerprint, html_extract, mixing, near_dedup, pii, substring_dedup, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, run int, row_id long, old boolean"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abdeimnorst") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = say(60)
    near = say(200).split()
    edit = lambda: " ".join(w if rng.random() > 0.02 else rng.choice(vocabulary) for w in near)
    texts = ["", None, "one", "same text here", "same text here", "same  text here"] + ["copy of a text " + say(0)] * 12
    texts += [edit() for _ in range(12)] + [say(rng.randrange(5, 60)) + " " + passage + " " + say(rng.randrange(5, 60)) for _ in range(12)]
    texts += [say(30) for _ in range(10)] + [say(6000), "x" * 30_000, "mail a.b@c.de or +49 (30) 1234567, ip 10.0.0.1"]
    out = [(k, t, "en", None if k % 7 == 0 else f"s{k % 3}", None, "clash", k, k, True) for k, t in enumerate(texts)]
    out += [(5, "repeated id", "en", "s1", 11, "clash", 1, 1, False), (5, "repeated id", "en", "s1", 11, "clash", 1, 1, False), (None, "no id", "en", "s2", 5, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(docs, empty, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(groups)
    sizes = {hashlib.sha256(t.encode()).hexdigest(): (len(ids), max((i for i in ids if i is not None), default=None)) for t, ids in groups.items()}
    assert all((r["group_size"], r["keep_id"]) == sizes[r["text_sha256"]] for r in got)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["text"] or "" for r in kept.collect()) == sorted(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.keep_one(empty).count() == 0


def test_exact_with_a_null_condition(docs, rows):
    got = {r["row_id"]: r for r in exact_dedup.exact_dedup(docs, F.col("source") == "s1").collect()}
    want = {r["row_id"]: r for r in exact_dedup.exact_dedup(docs).collect()}
    assert len(got) == len(rows) and all((got[k]["keep_id"], got[k]["group_size"]) == (r["keep_id"], r["group_size"]) for k, r in want.items())


def test_exact_under_a_key_that_clashes(docs, rows):
    """Texts that share a key but not their bytes are told apart, as if two had one SHA-256."""
    weak = lambda text: F.unhex(F.lpad(F.hex(F.length(text) % 3), 4, "0"))
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in exact_dedup.exact_dedup(docs, key=weak).collect())
    want = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in exact_dedup.exact_dedup(docs).collect())
    assert got == want and len(got) == len(rows)


def test_snapshot_is_written_once_and_read_for_each_batch(spark, tmp_path):
    of = lambda texts, at: exact_dedup._groups(spark.createDataFrame([(k + at, k, t) for k, t in enumerate(texts)], "doc_id long, row_id long, text string").withColumn("digest", exact_dedup.sha256(F.col("text"))))
    path = str(tmp_path / "snapshot")
    exact_dedup.write_snapshot(of([f"old {k}" for k in range(500)], 0), path)
    for batch, n in ((["old 3", "old 3", "new", "old 400"], 2), (["x"], 0), ([], 0)):
        snap, both = exact_dedup.against_snapshot(of(batch, 1000), path)
        assert both.count() == n and snap.count() == 500
    hit = {r["n"] for r in exact_dedup.against_snapshot(of(["old 3", "old 3", "new", "old 400"], 1000), path)[1].collect()}
    assert hit == {3, 2}
    nothing = str(tmp_path / "nothing")
    exact_dedup.write_snapshot(of([], 0), nothing)
    assert exact_dedup.against_snapshot(of(["x"], 0), nothing)[1].count() == 0


def test_near_duplicates_of_all_pairs(spark):
    """Every pair of texts whose five-word shingles agree by 0.8 or more (Jaccard) is in one class; 1,000 documents, brute force."""
    import os

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    df = spark.read.parquet(path).select("doc_id", "text")
    shingles = {r["doc_id"]: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for r in df.collect() if len(w := WORD.findall(r["text"] or "")) >= 5}
    holders = defaultdict(set)
    for k, own in shingles.items():
        for s in own:
            holders[s].add(k)
    shared = defaultdict(int)
    for ids in holders.values():
        for a in ids:
            for b in ids:
                if a < b:
                    shared[a, b] += 1
    alike = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(shingles[a]) + len(shingles[b]) - n)]
    by = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()}
    assert len(alike) > 50 and [p for p in alike if by[p[0]] != by[p[1]]] == []


def test_near(docs, empty, rows):
    got = near_dedup.near_duplicates(docs).select("doc_id", "class_id").collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] not in (5, None)}
    assert len({by[k] for k in range(18, 30)}) == 1 and by[18] == 18  # near copies
    assert len({by[k] for k in range(30, 42)}) == 12  # a common passage is no near copy
    assert {by[k] for k in range(6, 18)} == {6} and by[0] == by[1] == 0 and by[3] == by[4] == 3
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id between 18 and 29").count() == 1 and kept.where("doc_id between 30 and 41").count() == 12
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.keep_one(empty).count() == 0


def test_near_in_a_hot_group(spark):
    """Near copies stay together among many texts that share most of their words with them and are not alike."""
    rng = random.Random(7)
    say = lambda n: ["".join(rng.choice("abdeimnorst") for _ in range(7)) for _ in range(n)]
    common = say(150)
    texts = [common + say(50) for _ in range(2000)]
    copies = [[w if rng.random() > 0.08 else say(1)[0] for w in texts[k]] for k in range(300)]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts + copies)], "doc_id long, text string")
    by = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).select("doc_id", "class_id").collect()}
    words = near_dedup.Words()
    own = [words(" ".join(t)) for t in texts[:300] + copies]
    sketch = near_dedup.sketches(own)
    meet = [k for k in range(300) if near_dedup.alike(own[k], own[300 + k]) and (sketch[k] == sketch[300 + k]).any()]
    assert len(meet) > 250 and [k for k in meet if by[k] != by[2000 + k]] == []


def test_block_links_join_what_all_pairs_join():
    rng = random.Random(8)
    base = [[rng.randrange(1, 60) for _ in range(40)] for _ in range(4)]
    texts = [[w if rng.random() > 0.1 else rng.randrange(1, 60) for w in base[k % 4] if rng.random() > 0.04] for k in range(80)]
    raw = [near_dedup.np.array(t, "<u8").view("u1").reshape(-1, 8)[:, :5].tobytes() for t in texts]
    nodes = [b"%03d" % k for k in range(80)]

    def classes(pairs):
        label = {n: n for n in nodes}
        for a, b in pairs:
            label = {n: min(label[a], label[b]) if v in (label[a], label[b]) else v for n, v in label.items()}
        return label

    every = [(nodes[i], nodes[j]) for i in range(80) for j in range(i) if near_dedup.alike(texts[i], texts[j])]
    sides = [k % 3 % 2 for k in range(80)]
    got = near_dedup.block_links(nodes, nodes, sides, raw, False)
    assert set(map(frozenset, got)) <= set(map(frozenset, every)) and classes(got) == classes(every) and 4 <= len(set(classes(every).values())) < 80
    crossing = [(a, b) for a, b in every if sides[int(a)] != sides[int(b)]]
    assert classes(near_dedup.block_links(nodes, nodes, sides, raw, True)) == classes(crossing)


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 102), (200, 201)], "a long, b long")
    got = {r["node"]: r["label"] for r in near_dedup.components(edges, "a", "b").collect()}
    assert all(got[k] == 1 for k in range(1, 41)) and got[102] == 100 and got[201] == 200 and len(got) == 45


@pytest.mark.parametrize("pack, hot", [(4 << 20, 1 << 30), (3000, 1 << 30), (3000, 0)])
def test_repeats(docs, empty, rows, monkeypatch, pack, hot):
    monkeypatch.setattr(substring_dedup, "PACK", pack)
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    first, want = {}, []
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    for i, text in ((-1 if r[0] is None else r[0], r[1]) for r in order):
        words = WORD.findall(text or "")
        for k in range(len(words) - 12):
            first.setdefault(tuple(words[k : k + 13]), i)
    for r in rows:
        i, words = -1 if r[0] is None else r[0], WORD.findall(r[1] or "")
        gone = {k + j for k in range(len(words) - 12) if first[tuple(words[k : k + 13])] < i for j in range(13)}
        want.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    got = [(-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(docs).collect()]
    assert sorted(got) == sorted(want)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_fingerprints(docs, empty, rows):
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = fingerprint.chunks([text.encode()])[0], fingerprint.chunks([edited.encode()])[0], fingerprint.chunks([after.encode()])[0]
        want.append((str(i), len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.encode(a), fingerprint.likeness(a, b), fingerprint.likeness(a, c)))
    got = [(str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["near_edited"], r["near_next"]) for r in fingerprint.compare_next(docs).collect()]
    assert sorted(got) == sorted(want)
    assert fingerprint.compare_next(empty).count() == 0 and fingerprint.fingerprints(docs).count() == len(rows)


def test_bpe(docs, empty, rows):
    got = bpe.tokenize(docs, bpe.default_vocabulary()).collect()
    assert sorted(r["decoded_sha256"] for r in got) == sorted(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows)
    assert bpe.encode_documents(empty, bpe.default_vocabulary()).count() == 0


def test_mixing(spark, docs, empty, rows):
    got = mixing.mix_documents(docs, block=16).collect()
    again = mixing.mix_documents(docs.repartition(5), block=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    by = defaultdict(lambda: [0, 0.0])
    for r in got:
        by[r["source_size"], r["target"]][0] += r["taken"]
    assert all(abs(taken - target) <= 1 for (_, target), (taken, _) in by.items())
    out = mixing.mixed(docs, block=16)
    assert out.columns == docs.columns
    assert sum(len(WORD.findall(r["text"])) for r in out.collect()) == sum(r["taken"] for r in got)
    assert mixing.mix_documents(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_unlike_texts_with_a_common_header_cost_rows_and_not_pairs(spark, monkeypatch):
    rng = random.Random(7)
    header = " ".join(f"h{k}" for k in range(60))
    own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(1500)]
    for k in range(0, 1500, 30):  # every thirtieth has an edited copy
        words = own[k].split()
        for _ in range(8):
            words[rng.randrange(80)] = f"e{rng.randrange(10**6)}"
        own[k + 1] = " ".join(words)
    df = spark.createDataFrame([(k, f"{header} {t}") for k, t in enumerate(own)], "doc_id long, text string")
    sizes, blocks = [], near_dedup._blocks
    monkeypatch.setattr(near_dedup, "_blocks", lambda rows: (sizes.append(rows.count()), blocks(rows))[1])
    want = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()}
    monkeypatch.setattr(near_dedup, "MANY", 32)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()}
    assert got == want == {k: k - 1 if k % 30 == 1 else k for k in range(1500)}
    assert sizes[0] > 3_000 and sizes[1] < sizes[0], sizes  # members of keys before, and what is left of them to be compared


def test_parts_by_occurrences_change_no_removal(spark, monkeypatch):
    rng = random.Random(12)
    passages = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(13, 40))) for _ in range(6)]
    rows = [(k, " ".join([*(f"u{rng.randrange(10**6)}" for _ in range(20)), rng.choice(passages), rng.choice(passages), "end"])) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, substring_dedup.remove_repeats(df).collect()))
    monkeypatch.setattr(substring_dedup, "PART_OCCURRENCES", 3)
    monkeypatch.setattr(substring_dedup, "HOT", 40)
    monkeypatch.setattr(substring_dedup, "PACK", 3000)
    assert sorted(map(tuple, substring_dedup.remove_repeats(df).collect())) == want and sum(r[2] for r in want) > 3000


def test_a_large_batch_against_a_snapshot_of_ten_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "PART_KEYS", 20_000)
    made = lambda low, high: spark.range(low, high).select(F.sha2(F.col("id").cast("string"), 256).alias("hex"), F.col("id")).select(F.unhex("hex").alias("digest"), F.struct(F.col("id").alias("doc_id"), F.col("id").alias("row_id")).alias("keep"), F.lit(1).cast("long").alias("n"))
    exact_dedup.write_snapshot(made(0, 10), f"{tmp_path}/snap")
    batch = made(5, 1_000_000)
    _, both = exact_dedup.against_snapshot(batch, f"{tmp_path}/snap")
    assert sorted((r["keep"]["doc_id"], r["n"]) for r in both.collect()) == [(k, 2) for k in range(5, 10)]
    filters = spark.read.parquet(f"{tmp_path}/snap/filters")
    kept = exact_dedup.screen(batch, filters.select("seg", "filter"), filters.first()["segments"]).count()
    assert 5 <= kept < 999_995 // 50  # about 1 in 256 of what no segment has


def test_pii(docs, empty, rows):
    got = {r["doc_id"]: r for r in pii.find_pii(docs).where("n_email + n_ip + n_phone > 0").collect()}
    (row,) = got.values()
    assert row["spans"] == "email:5:13,ip:38:46,phone:17:33"
    assert row["base_sha256"] == hashlib.sha256(row["spans"].encode()).hexdigest()
    assert pii.find_pii(empty).count() == 0


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(k, 1, int(18 <= k < 30), "clash") for k in range(60)] + [(None, 1, 1, ""), (3, 1, None, "")], "doc_id long, quality int, toxic int, text string")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model, spans=True).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r["predicted"] for r in got)
    none = labels.limit(0)
    assert toxicity.drop_toxic(docs, none).count() == docs.count() and toxicity.score(empty, toxicity.train(empty, none)).count() == 0


def test_toxicity_trains_on_long_texts_too(spark):
    rng = random.Random(3)
    plain = ["".join(rng.choice("aeinort") for _ in range(5)) for _ in range(200)]
    text = lambda k, n: " ".join("vilezz" if k % 2 and j % 50 == 7 else rng.choice(plain) for j in range(n))
    docs = spark.createDataFrame([(k, text(k, 6000), "clash") for k in range(60)] + [(99, text(1, 200_000), "clash")], "doc_id long, text string, held_out string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all(got[k] == k % 2 for k in range(60)) and got[99] == 1


@pytest.mark.parametrize("toxic", [1, 0])
def test_one_very_long_labelled_text_leaves_predictions_as_they_are(spark, toxic):
    rng = random.Random(4)
    plain = ["".join(rng.choice("aeinort") for _ in range(6)) for _ in range(200)]
    text = lambda k: " ".join("grubbox" if k % 3 == 0 and j % 20 == 7 else rng.choice(plain) for j in range(60))
    rows = [(k, text(k)) for k in range(240)]
    labels = [(k, int(k % 3 == 0)) for k in range(240)]
    own = next(k for k in range(toxic ^ 1, 240) if k % 3 == toxic ^ 1 and zlib.crc32(str(k).encode()) % 5)
    long = " ".join(rng.choice(plain) for _ in range(20_000)) + " "
    longer = [(k, long * (8_400_000 // len(long)) + t if k == own else t) for k, t in rows]
    made = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = []
    for own_rows in (rows, longer):
        docs = spark.createDataFrame(own_rows, "doc_id long, text string")
        model = toxicity.train(docs, made)
        got.append({r["doc_id"]: r["predicted"] for r in toxicity.score(docs.where(f"doc_id <> {own}"), model).collect()})
    assert got[0] == got[1] == {k: t for k, t in labels if k != own}


def test_pages(spark):
    pages = [(k, f"http://h.x/{k}", f"<nav>menu</nav><article class='a{k}'><p>text number {k} of it<p>and &lt;more&gt;</article><footer>f</footer>", "t", k) for k in range(5)]
    pages += [(9, None, None, "t", 1), (9, "not a url", "", "t", 1), (None, "http://h.x/z", "<p>loose", "t", 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string, n_chars int")
    got = {r["page_id"]: r for r in html_extract.extract(df).where("url is not null").collect()}
    assert got[3]["text"] == "text number 3 of it and <more>" and got[3]["n_chars"] == len(got[3]["text"]) and got[9]["text"] == "" and got[None]["text"] == "loose"
    assert html_extract.extract(df).count() == len(pages) and html_extract.extract(df.limit(0)).count() == 0


def test_preferences(spark):
    schema = "pair_id long, turn long, role string, text string, side string, pos int"
    a = [(1, 0, "user", "hi", "z", 0), (1, 1, "assistant", "good", "z", 0), (2, 0, None, None, "z", 0), (2, 1, "assistant", "same", "z", 0), (3, 0, "user", "only", "z", 0)]
    b = [(1, 0, "user", "hi", "z", 0), (1, 1, "assistant", "bad one", "z", 0), (2, 0, None, None, "z", 0), (2, 1, "assistant", "same", "z", 0)]
    got = {r["pair_id"]: r for r in chat_format.format_preferences(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()}
    one = got[1]
    assert one["prompt"] == "<|im_start|>user\nhi<|im_end|>\n" and one["n_prompt_turns"] == 1
    for text, mask, said in ((one["chosen"], one["chosen_mask"], "good"), (one["rejected"], one["rejected_mask"], "bad one")):
        lo, hi = map(int, mask.split(":"))
        assert text[lo:hi] == said + "<|im_end|>"
    assert got[2]["chosen"] == got[2]["rejected"] == "" and got[2]["n_prompt_turns"] == 2
    assert got[3]["n_prompt_turns"] == 0 and got[3]["chosen_mask"] == "" and got[3]["rejected"] == ""
    empty = spark.createDataFrame([], schema)
    assert chat_format.format_preferences(empty, empty).count() == 0


def test_pipeline(spark, docs, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(18, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids"] and out.agg(F.sum("n_tokens")).first()[0] > 0


def test_pipeline_on_an_empty_table(spark, empty, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    """Ties, nulls, repeated rows and clashing columns: without labels nothing is toxic, of equal texts the largest id stays, then the least of each class."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abdeimnorst") for _ in range(6))
    base = [word() for _ in range(120)]
    texts = {k: " ".join(word() for _ in range(rng.randrange(20, 60))) for k in range(30)}
    texts |= {k: texts[k - 30] for k in range(30, 40)}  # exact copies
    texts |= {k: " ".join(w if rng.random() > 0.02 else word() for w in base) for k in range(40, 50)}  # near copies
    texts |= {50: None, 51: "", 52: "same tie", 53: "same tie"}
    rows = [(k, t, "en", "s" + str(k % 2) if k % 5 else None, None, "clash", k) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __parts string, block int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {}
    for k in sorted(texts):  # the largest id of equal texts
        kept[texts[k] or ""] = k
    ids = sorted(kept.values())
    near = [k for k in ids if 40 <= k < 50]
    want = {k for k in ids if k not in near[1:]}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "__parts", "block"], name
    names = ("__row", "__n", "__node", "__d", "__own_doc_id", "__id", "__digest", "__lost", "ROW_ID", "__name")
    clash = spark.createDataFrame([(1, "a b", "s", *"k" * 10), (1, "a b", "s", *"k" * 10), (2, "a b", None, *[None] * 10)], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    for f in (exact_dedup.keep_one, near_dedup.keep_one, mixing.mixed):
        assert f(clash).columns == clash.columns and f(clash).count() > 0
    assert {r["doc_id"] for r in docs.collect()} == want and docs.count() == len(want)
    sizes = defaultdict(int)
    for k in want:
        sizes["s" + str(k % 2) if k % 5 else None] += len(WORD.findall(texts[k] or ""))
    goal = {s: float(t) for s, t in mixing.targets(sizes).items()}
    taken = defaultdict(int)
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path)).collect()
    for r in mixed:
        assert r["doc_id"] in want and r["n_chars"] == len(r["text"])
        taken[r["source"]] += len(WORD.findall(r["text"]))
    assert all(abs(taken[s] - t) <= 1 for s, t in goal.items())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    own = bpe._codec(bpe.default_vocabulary())
    assert sorted((r["doc_id"], bytes(r["ids"])) for r in out) == sorted((r["doc_id"], own.encode(r["text"])) for r in mixed)
