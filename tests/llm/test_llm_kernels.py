"""Kernels of the training-data operators against brute force, without Spark."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest

from vitalspark.llm import bpe, exact_dedup, fingerprint, html_extract, mixing, near_dedup, pii, substring_dedup, toxicity


def test_fuse_filter_has_no_false_negative_and_few_false_positives():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 50_000):
        keys = rng.integers(0, 1 << 63, n, np.uint64)
        f = exact_dedup.FuseFilter.load(exact_dedup.FuseFilter(np.r_[keys, keys]).dump())
        assert f.contains(keys).all()
        other = rng.integers(0, 1 << 63, 20_000, np.uint64)
        assert f.contains(other).mean() < 0.02


def test_chunks_depend_on_the_text_alone_and_resist_shifts():
    rng = random.Random(2)
    texts = ["", "a", "é" * 40] + ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(1, 4000))) for _ in range(40)]
    raw = [t.encode() for t in texts]
    together = fingerprint.chunks(raw)
    assert all((a == fingerprint.chunks([r])[0]).all() for a, r in zip(together, raw))
    for codes, r in zip(together, raw):
        assert int((codes & np.uint64(255)).sum()) == len(r)
        assert (fingerprint.decode(fingerprint.encode(codes)) == codes).all()
    long = "".join(rng.choice("abcdefgh ") for _ in range(8000)).encode()
    a, b = fingerprint.chunks([long, b"inserted" + long])
    assert fingerprint.likeness(a, b) > 0.9 and fingerprint.likeness(a, a) == 1 and fingerprint.likeness(a, a[:0]) == 0 and fingerprint.likeness(a[:0], a[:0]) == 1


def test_main_text():
    page = """<html><head><title>x<body class="has-sidebar"><div id="page-header"><a href=x>Home</a></div><div class="wrap"><div class="post-12"><h1>Ti&amp;tle</h1>
    <p>Some long  text&nbsp;here, with <a href=q>link</a>s and <b>bold</b>ness.<p>Second &am one<ul><li>one<li>two</ul><form>buy <input></form><div class="adBox">AD</div></div>
    <div class="sidebar">side side</div></div><div id=comments><p>long comment comment comment comment</div><script>var t="</p>";</script><footer>f</footer>"""
    assert html_extract.main_text(page, html_extract.best(html_extract.scores(page))) == "Ti&tle Some long text here, with links and boldness. Second &am one one two"
    assert html_extract.main_text("", None) == "" and html_extract.main_text("just <b>te</b>xt", None) == "just text"
    assert html_extract.main_text("<p>a<!-- b --><br>c<style>d</style>", None) == "a c"
    other = "<body><div class='post-3'><p>Body text of it</div><div class='x'><p>Another and much longer block of text that is not the post at all</div>"
    assert html_extract.main_text(other, "body>div.post-N") == "Body text of it"


def test_main_text_is_whole_around_the_winning_path():
    say = lambda word, n: (word + " ") * n
    sections = "".join(f"<section><p>{say(w, 100)}</section>" for w in ("one", "two", "six"))
    for tag in ("article", "div class=post", "main", "body"):
        page = f"<html><{tag}><h1>Title</h1><p>{say('lead', 40)}{sections}<p>closing</{tag.split()[0]}>"
        won = html_extract.best(html_extract.scores(page))
        assert won.endswith("section") and html_extract.main_text(page, won) == " ".join(f"Title {say('lead', 40)}{say('one', 100)}{say('two', 100)}{say('six', 100)}closing".split())
        direct = f"<{tag}>" + "".join(f"<p>paragraph {k}" for k in range(10)) + "<section>short</section>"
        assert html_extract.main_text(f"<html>{direct}", won).split() == [w for k in range(10) for w in ("paragraph", str(k))] + ["short"]
    page = "<body><article><section>text of it</section><div><a href=x>link one</a> <a href=y>link two</a></div></article><div>other</div>"
    assert html_extract.main_text(page, "body>article>section") == "text of it"


@pytest.mark.parametrize(
    "element", ["article class='post category-social'", "article class='tag-advertising'", "main id=search", "h2 id='form-validation'", "h3 class='notice'", "section id='related-work'", "section id='discussion'",
                "h2 id='side-effects'", "div class='tag-comments'", "div id='reply-to-critics'", "p class='two-side-story'"],
)
def test_names_of_topics_are_no_boilerplate(element):
    page = f"<body><div><p>before</div><{element}>text of it</{element.split()[0]}>"
    assert "text of it" in [t for _, t, _ in html_extract.Page(page).blocks]


@pytest.mark.parametrize("name", ["ad", "ad-slot-2", "adBox", "page-header", "site-footer", "comments", "comment-12", "related-posts", "social-share", "sidebar left", "cookie-consent", "search-form", "main-nav", "discussion-thread", "site-comments-area"])
def test_names_of_boilerplate(name):
    assert html_extract.Page(f"<body><div class='{name}'>gone</div><div id='{name.split()[0]}'>gone</div>").blocks == []


def test_targets_and_quotas():
    sizes = {"a": 100, "b": 10, "c": 50, None: 7}
    t = mixing.targets(sizes)
    assert sum(t.values()) == 1.5 * 167 and all(t[s] <= 2 * n for s, n in sizes.items())
    free = [s for s in sizes if t[s] < 2 * sizes[s]]
    weight = {"a": 3, "b": 1, "c": 2, None: 3}
    assert len({t[s] / weight[s] for s in free}) == 1
    for n in (1, 2, 7, 1000):
        p = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 99))
        assert sorted(p) == list(range(n)) and (mixing.permute(p, np.full(n, n), np.full(n, 99), True) == np.arange(n)).all()


@pytest.mark.parametrize("masked", [near_dedup.MASKED, 0])
def test_word_distance_equals_dynamic_programming(monkeypatch, masked):
    monkeypatch.setattr(near_dedup, "MASKED", masked)
    rng = random.Random(1)
    for k in range(3000):
        a = [rng.randrange(1, 5) for _ in range(rng.randrange(0, 25))]
        b = [x if rng.random() < 0.8 else rng.randrange(1, 5) for x in a if rng.random() < 0.9] if k % 2 else [rng.randrange(1, 5) for _ in range(rng.randrange(0, 25))]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        most = rng.randrange(0, 10)
        got = near_dedup.distance(a, b, most)
        assert got == row[-1] if row[-1] <= most else got > most


def test_word_distance_of_long_texts_is_bounded_in_memory(monkeypatch):
    rng = random.Random(2)
    a = [rng.choice((rng.randrange(40), rng.randrange(9000))) for _ in range(9000)]
    b = [w if rng.random() > 0.1 else -1 for w in a if rng.random() > 0.02]
    tracemalloc.start()
    far = near_dedup.distance(a, b, 1800)
    assert tracemalloc.get_traced_memory()[1] < 2e6
    tracemalloc.stop()
    monkeypatch.setattr(near_dedup, "MASKED", 1 << 30)
    assert far == near_dedup.distance(a, b, 1800) <= 1800


def test_sketches_depend_on_the_text_alone():
    words = near_dedup.Words()
    texts = [words(t) for t in ("a b c d e f g h", "a", "", "x y z " * 50, "a b c d e f g h")]
    s = near_dedup.sketches(texts)
    assert (s[0] == s[4]).all() and (s[2] == 0).all() and all((near_dedup.sketches([t])[0] == r).all() for t, r in zip(texts, s))


def test_pii_equals_plain_patterns():
    patterns = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= sum(c.isdigit() for c in m) <= 19 and pii.luhn("".join(c for c in m if c.isdigit()))), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= sum(c.isdigit() for c in m) <= 15),
    }
    rng = random.Random(3)
    for k in range(6000):
        letters = ("ab1234+.-@ ()_%é0", "0123456789 -", "12.")[k % 3]
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 60)))
        want = [(kind, m.start(), m.end()) for kind, (p, ok) in patterns.items() for m in re.finditer(p, t) if ok(m[0])]
        assert pii.spans(t, None, {})[0] == want
    assert pii.spans("1" * 200_000 + " " + "a" * 200_000, None, {})[0] == []


def test_em_trusts_labelers_that_agree():
    counts = {(1, 1, 1, 1, 0, 0): 80, (-1, -1, 0, -1, 0, 0): 60, (1, -1, 0, 1, 0, 0): 5, (-1, 1, 0, -1, 0, 0): 4}
    right, post = pii.expectation_maximisation(counts)
    assert post[1, 1, 1, 1, 0, 0] > 0.95 and post[-1, -1, 0, -1, 0, 0] < 0.05 and right[0] > 0.9


def test_classifier_depends_on_shares_and_not_on_the_number_of_candidates():
    cells = {("email", 1, 1, 1, 1, 0, 0): 8, ("email", -1, -1, 0, -1, 0, 0): 6, ("ip", 1, -1, 0, 1, 2, 1): 3}
    post = dict(zip(cells, (0.97, 0.04, 0.6)))
    few, many = (pii.fit_classifier({c: n * k for c, n in cells.items()}, post) for k in (1, 100_000))
    assert np.allclose(few, many, atol=1e-6)


def chain(e, trans):
    n = len(e)
    f, b = np.zeros((n, 2)), np.zeros((n, 2))
    own = np.stack([np.zeros(n), e], 1)
    f[0] = own[0]
    for t in range(1, n):
        for y in (0, 1):
            f[t, y] = own[t, y] + np.logaddexp(f[t - 1, 0] + trans[0, y], f[t - 1, 1] + trans[1, y])
    for t in range(n - 2, -1, -1):
        for y in (0, 1):
            b[t, y] = np.logaddexp(trans[y, 0] + own[t + 1, 0] + b[t + 1, 0], trans[y, 1] + own[t + 1, 1] + b[t + 1, 1])
    p = np.exp(f + b - (f + b).max(1, keepdims=True))
    return p[:, 1] / p.sum(1)


def test_marginals_equal_the_plain_recursion():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 0, 700, 1, 256, 257, 40, 512, 900])
    e, trans = rng.normal(0, 3, lengths.sum()), rng.normal(0, 1.5, (2, 2))
    m, at = toxicity.marginals(e, lengths, trans), 0
    for n in lengths:
        if n:
            assert np.allclose(m[at : at + n], chain(e[at : at + n], trans), atol=1e-9)
        at += n


def test_toxic_words_are_learnt(spark):
    rng = random.Random(5)
    plain = ["".join(rng.choice("aeinort") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    make = lambda bad: " ".join(rng.choice(plain) if not bad or rng.random() > 0.1 else rng.choice(["vilezz", "grubbox"]) + rng.choice(["", "en", "er"]) for _ in range(40))
    rows = [(k, make(k % 4 == 0), int(k % 4 == 0)) for k in range(400)]
    df = spark.createDataFrame(rows[:300], "key long, text string, toxic int")
    model = toxicity.fit(df)
    p = model.score(model.documents([r[1] for r in rows[300:]])[0])
    assert ((p >= 0.5) == np.array([r[2] == 1 for r in rows[300:]])).mean() > 0.95
    again = toxicity.fit(df.repartition(7))
    assert np.array_equal(again.weights, model.weights) and np.allclose(again.document, model.document)
    aggregates, words, m = model.documents(["some vilezzen here", ""])
    assert toxicity._spans("some vilezzen here", m) == "5:13" and model.score(aggregates)[1] < 0.5
    assert toxicity.fit(df.where("toxic = 0")).score(np.zeros((2, 2))).tolist() == [0.0, 0.0]
    assert toxicity.fit(df.limit(0)).score(np.zeros((1, 2))).tolist() == [0.0]


def test_aligned_texts_share_a_rare_word_in_any_order_of_words():
    rng = np.random.default_rng(9)
    met = 0
    for _ in range(600):
        n = int(rng.integers(1, 80))
        a = rng.integers(0, 30 if rng.random() < 0.5 else 10**9, n).tolist()
        b = list(a)
        for _ in range(int(rng.integers(0, n // 4 + 2))):
            k = int(rng.integers(0, len(b) + 1))
            b[k : k + int(rng.integers(0, 2))] = [int(rng.integers(0, 40))] * int(rng.integers(0, 2))
        if b and near_dedup.alike(a, b):
            met += 1
            counts = rng.integers(0, 5, 64)
            one, two = (set(near_dedup.rare_words(np.array(x, np.uint64), counts).tolist()) for x in (a, b))
            assert one & two and len(one) == int(len(a) * 0.2 + 1e-9) + 1
    assert met > 200


def test_parting_by_a_word_is_the_same_for_any_number_of_classes():
    rng = np.random.default_rng(6)
    few, word = rng.integers(0, 50, 3000), rng.integers(1, 4, 3000).astype(np.uint64) << np.uint64(36)
    want = substring_dedup._part(few, word)
    got = substring_dedup._part(few + (1 << 30), word)
    assert len(set(zip(want.tolist(), got.tolist()))) == len(set(want.tolist())) == len(set(got.tolist())) == len(set(zip(few.tolist(), word.tolist())))


def test_long_words_keep_their_ends_and_are_told_apart():
    a, b = "Vilezz" + "a" * 1000 + "en", "Vilezz" + "a" * 1001 + "en"
    assert toxicity.short(a) != toxicity.short(b) and len(toxicity.short(a)) == toxicity.LONG_WORD == len(toxicity.short("q" * 64))
    assert toxicity.short(toxicity.short(a)) == toxicity.short(a) and toxicity.word_features(a)[1:] == toxicity.word_features(b)[1:]


def test_runs_share_their_anchor():
    words = near_dedup.Words()
    a, b = "q w e r t y u i o p a s d f g h j k l", "z x c v b n m " + "w e r t y u i o p a s d f" + " m n b v"
    own = [substring_dedup.Anchors([t], words) for t in (a, b)]
    n = substring_dedup.LENGTH
    runs = [{tuple(x.flat[k : k + n].tolist()): (x.seed[c], o) for k, c, o in zip(x.run.tolist(), x.of.tolist(), x.offset.tolist())} for x in own]
    (both,) = runs[0].keys() & runs[1].keys()
    assert runs[0][both] == runs[1][both]
    assert len(substring_dedup.Anchors(["too short"], words).run) == 0 and len(substring_dedup.Anchors([], words).run) == 0


def test_extension_equals_comparing_all_pairs():
    rng = np.random.default_rng(4)
    side, n, around = substring_dedup.SIDE, substring_dedup.LENGTH, substring_dedup.AROUND
    for _ in range(60):
        rows = int(rng.integers(1, 40))
        codes = rng.integers(1, 3, (rows, around)).astype(np.uint64)
        key = rng.integers(0, 3, rows).astype(np.uint64)
        codes[:, side:n] = (key[:, None] + 1) * 7 if rng.random() < 0.7 else rng.integers(1, 3, (rows, n - side))  # else anchors of one hash differ
        codes[rng.random(rows) < 0.2, : rng.integers(1, side + 1)] = 0
        ids = rng.integers(0, 12, rows)
        want = np.zeros(rows, np.uint8)
        for i in range(rows):
            for o in range(side + 1):
                own = codes[i, side - o : side - o + n]
                hit = any(key[j] == key[i] and ids[j] < ids[i] and (codes[j, side - o : side - o + n] == own).all() for j in range(rows))
                want[i] |= int(hit and (own != 0).all()) << o
        assert (substring_dedup.match(key, ids, codes) == want).all()


@pytest.mark.parametrize("text", ["", "a b"])
def test_hash_of_kept_words(text):
    assert hashlib.sha256(" ".join(re.findall("[^\x20\x09-\x0d]+", text)).encode()).hexdigest() == hashlib.sha256(text.encode()).hexdigest()
