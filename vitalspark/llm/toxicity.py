"""Toxic spans and document scores by a linear-chain conditional random field.

Method: token labels come from the document labels of a training sample: in a toxic document a token is toxic if
one of its features (word, prefixes, suffixes) is significantly commoner in toxic than in clean documents after
a correction for the number of features tried. A two-label CRF (hashed features of the word and its neighbours,
transition weights) is trained on these tokens. Over a whole text, forward-backward gives each token's marginal
exactly; marginals aggregate to a document score by a logistic model over (log-odds of the largest marginal, log
of the summed marginals), and runs of tokens of at least one half are the offending spans.

Sample: of each class at most TRAIN_DOCS labelled documents, those of smallest hash of doc_id, each whole whatever its
length. Their texts stay on the executors: features are counted there by document, the CRF is trained on windows around at
most TOXIC_PLACES toxic, CLEAN_PLACES clean look-alike and PLACES random tokens of each, and the document score on two
numbers of each whole text. So a long labelled text weighs as one document and crowds out none. Everything else (scores,
spans) covers every whole text. Only the model, of fixed size, is sent out.

Defined results: a null text counts as empty; a text without a word scores like one whose largest marginal is 0;
a word of more than LONG_WORD characters has the features of its ends and of its digest; a null doc_id has the crc32 of the
empty string and no label; several labels of an id count as toxic if any is;
repeated rows score alike; without a toxic or without a clean training row the score is the training rate (0 if
there is none); an empty table gives an empty result. Labels, language, source and id never enter a score.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, map_arrow, materialise, shuffle_width, slices, table, texts

#: Training documents a class at most, and the characters of a word that its features are made of.
TRAIN_DOCS, LONG_WORD = 3000, 64
#: Words on either side of a place that the CRF is trained on, and places a document: random ones, tokens that are marked
#: toxic in a toxic document, and such tokens in a clean one.
REACH, PLACES, TOXIC_PLACES, CLEAN_PLACES = 12, 2, 20, 4
#: A feature marks toxic tokens if it is this much commoner in toxic documents, and in at least this many of them.
RATIO, LEAST_DOCS = 10, 3
#: Size of the hashed weight table, penalty, learning rate and passes.
DIMENSION, RIDGE, RATE, EPOCHS = 1 << 18, 1e-5, 0.5, 6
#: Tokens of a segment of the blocked forward-backward recursion; words kept in a worker's table.
SEGMENT, TABLE_SIZE = 256, 200_000
#: Features that a task counts before it hands their counts on.
COUNTED = 300_000
HELD_OUT = 5
_WORD = re.compile(r"\w+")


def short(word: str) -> str:
    """The word in lower case; a long one by its ends and digest, so that what is kept of a word is bounded."""
    word = word.lower()
    return word if len(word) <= LONG_WORD else word[:16] + hashlib.md5(word.encode()).hexdigest() + word[-16:]  # LONG_WORD again


def word_features(word: str) -> list[str]:
    word = short(word)
    n = len(word)
    return ["w" + word, *("p" + word[:k] for k in (3, 4, 5, 6) if n > k), *("s" + word[-k:] for k in (3, 4, 5) if n > k)]


def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode()) % DIMENSION


def _hashed(word: str) -> tuple[list[int], int, int]:
    """Own features, and the feature of the word as the one before and after another."""
    low = short(word)
    return [_hash(f) for f in word_features(word)], _hash("<" + low), _hash(">" + low)


def document_features(words: list[str]) -> set[str]:
    return {f for w in set(words) for f in word_features(w)}


def is_significant(clean: int, toxic: int, n_clean: int, n_toxic: int, tried: int) -> bool:
    """Whether a feature's documents are toxic too often to be chance, at a level corrected for the features tried."""
    if toxic < LEAST_DOCS or toxic / n_toxic < RATIO * (clean + 0.5) / (n_clean + 1):
        return False
    rate = n_toxic / (n_toxic + n_clean)
    g = 2 * (toxic * math.log(toxic / ((toxic + clean) * rate)) + (clean * math.log(clean / ((toxic + clean) * (1 - rate))) if clean else 0))
    return g > 2 * math.log(max(tried, 1)) + 2


def marginals(emission: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(toxic) of each token of concatenated chains; trans[y, y'] are log-weights, emission the toxic label's.

    The odds r of the forward messages follow r' = e (r A11 + A01) / (r A10 + A00), a fractional-linear map; so a long
    chain is cut into segments whose maps are composed, and all segments run side by side. The backward pass mirrors it.
    """
    if not len(emission):
        return np.zeros(0)
    f, b, e = messages(emission, lengths, trans)
    odds = f * b / e  # the token's own weight is in both
    return odds / (1 + odds)


def messages(emission: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odds of the forward and of the backward messages, both with the token's own factor, and that factor."""
    e, a = np.exp(np.clip(emission, -30, 30)), np.exp(trans)
    # the backward pass is a forward one over the reversed tokens with the transposed transitions
    return _odds(e, lengths, a), _odds(e[::-1], lengths[::-1], a.T)[::-1], e


def _odds(e: np.ndarray, lengths: np.ndarray, a: np.ndarray) -> np.ndarray:
    lengths = lengths[lengths > 0]
    per = -(-lengths // SEGMENT)
    chain = np.repeat(np.arange(len(lengths)), per)
    first = np.cumsum(per) - per
    part = np.arange(len(chain)) - first[chain]
    start = (np.cumsum(lengths) - lengths)[chain] + part * SEGMENT
    size = np.minimum(SEGMENT, lengths[chain] - part * SEGMENT)
    begin = np.full(len(chain), np.nan)  # odds before a segment; nan at a chain's start
    if (per > 1).any():
        maps = np.tile(np.eye(2), (len(chain), 1, 1))
        step = np.array([[a[1, 1], a[0, 1]], [a[1, 0], a[0, 0]]])
        whole = np.flatnonzero(part < (per - 1)[chain])  # segments that another one follows, all of full size
        for t in range(SEGMENT):
            m = np.einsum("ij,njk->nik", step, maps[whole])
            if not t:  # a chain's first token has no transition before it
                m = np.where((part[whole] == 0)[:, None, None], maps[whole], m)
            m[:, 0] *= e[start[whole] + t][:, None]
            maps[whole] = m / m.max(axis=(1, 2), keepdims=True)
        for k in range(1, int(per.max())):
            at = np.flatnonzero(part == k)
            m, r = maps[at - 1], np.where(np.isnan(begin[at - 1]), 1.0, begin[at - 1])
            begin[at] = (m[:, 0, 0] * r + m[:, 0, 1]) / (m[:, 1, 0] * r + m[:, 1, 1])
    out = np.empty(len(e))
    order = np.argsort(-size, kind="stable")
    start, size, r = start[order], size[order], begin[order]
    live = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right")
    for t, n in enumerate(live.tolist()):
        own, x = start[:n] + t, r[:n]
        if t:
            x = e[own] * (x * a[1, 1] + a[0, 1]) / (x * a[1, 0] + a[0, 0])
        else:
            x = np.where(np.isnan(x), e[own], e[own] * (x * a[1, 1] + a[0, 1]) / (x * a[1, 0] + a[0, 0]))
        r[:n] = out[own] = np.clip(x, 1e-30, 1e30)
    return out


class Model:
    """CRF weights and the logistic model of the document score."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, document: np.ndarray, rate: float | None = None):
        self.weights, self.trans, self.document, self.rate = weights.astype(np.float32), trans, document, rate
        self._clear()

    def fresh(self) -> Model:
        """The same model with empty tables: a task's tables end with the task."""
        return Model(self.weights, self.trans, self.document, self.rate)

    def __getstate__(self):
        return self.weights, self.trans, self.document, self.rate

    def __setstate__(self, state):
        self.weights, self.trans, self.document, self.rate = state
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.own, self.left, self.right = array("d"), array("d"), array("d")
        self.columns: tuple | None = None

    def _number(self, word: str) -> int:
        own, left, right = _hashed(word)
        w = self.weights
        self.own.append(float(w[own].sum() + w[_hash("bias")]))
        self.left.append(float(w[left]))
        self.right.append(float(w[right]))
        self.columns = None
        self.ids[word] = k = len(self.own) - 1
        return k

    def tokens(self, words: list[list[str]]) -> np.ndarray:
        """Marginals of the concatenated tokens of texts."""
        if len(self.own) > TABLE_SIZE:
            self._clear()
        get, number = self.ids.get, self._number
        ids = np.array([k if (k := get(w)) is not None else number(w) for own in words for w in own], np.int64)
        lengths = np.array([len(own) for own in words], np.int64)
        if not len(ids):
            return np.zeros(0)
        if self.columns is None:
            self.columns = tuple(np.array(x, float) for x in (self.own, self.left, self.right))
        own, left, right = self.columns
        e = own[ids]
        inner = np.ones(len(ids), bool)
        inner[(np.cumsum(lengths) - lengths)[lengths > 0]] = False  # the first token of each text
        at = np.flatnonzero(inner)
        e[at] += left[ids[at - 1]]
        e[at - 1] += right[ids[at]]
        return marginals(e, lengths, self.trans)

    def documents(self, own: list[str]) -> tuple[np.ndarray, list[list[str]], np.ndarray]:
        """Aggregates of each text (largest and summed marginal), its words, and all marginals."""
        words = [_WORD.findall(t) for t in own]
        m = self.tokens(words)
        lengths = np.array([len(w) for w in words])
        top, total = np.zeros(len(own)), np.zeros(len(own))
        some = np.flatnonzero(lengths)
        if len(some):
            at = (np.cumsum(lengths) - lengths)[some]
            top[some], total[some] = np.maximum.reduceat(m, at), np.add.reduceat(m, at)
        return np.stack([top, total], 1), words, m

    def score(self, aggregates: np.ndarray) -> np.ndarray:
        if self.rate is not None:
            return np.full(len(aggregates), self.rate)
        return 1 / (1 + np.exp(-_design(aggregates) @ self.document))


def _design(aggregates: np.ndarray) -> np.ndarray:
    top = np.clip(aggregates[:, 0], 1e-4, 1 - 1e-4)
    return np.stack([np.ones(len(top)), np.log(top / (1 - top)), np.log(aggregates[:, 1] + 1e-3)], 1)


def windows(words: list[str], label: int, bad: Callable[[str], bool]) -> list[tuple[list[str], np.ndarray]]:
    """Pieces of a labelled document that the CRF is trained on, with their tokens' labels; the random places are those
    of the text alone."""
    if not words:
        return []
    found = np.array([bad(w) for w in words])
    marks = found if label else np.zeros(len(words), bool)
    rng = np.random.default_rng([7, len(words), zlib.crc32(" ".join(words[:1000]).encode())])
    centres = np.flatnonzero(found)[: TOXIC_PLACES if label else CLEAN_PLACES].tolist() + rng.integers(0, len(words), PLACES).tolist()
    return [([short(w) for w in words[max(0, c - REACH) : c + REACH + 1]], marks[max(0, c - REACH) : c + REACH + 1]) for c in sorted(set(centres))]


def marker(strong: set[str]) -> Callable[[str], bool]:
    """Whether a word has a significant feature, with a table of bounded size."""
    table_: dict[str, bool] = {}

    def bad(word: str) -> bool:
        if len(table_) > TABLE_SIZE:
            table_.clear()
        return table_[word] if word in table_ else table_.setdefault(word, not strong.isdisjoint(word_features(word)))

    return bad


def train_crf(pieces: list[tuple[list[str], np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions from labelled windows, by stochastic gradient steps on exact marginals."""
    rng = np.random.default_rng(7)
    weights, trans = np.zeros(DIMENSION), np.zeros((2, 2))
    square, square_t = np.full(DIMENSION, 1e-2), np.full((2, 2), 1e-1)
    hashed: dict[str, tuple] = {}
    bias = _hash("bias")
    for _ in range(EPOCHS):
        order = rng.permutation(len(pieces))
        for k in range(0, len(order), 512):
            batch = [pieces[i] for i in order[k : k + 512]]
            rows, cols = [], []
            at = 0
            for own, _ in batch:
                for w in own:
                    if w not in hashed:
                        hashed[w] = _hashed(w)
                for j, w in enumerate(own):
                    mine = [bias, *hashed[w][0]]
                    if j:
                        mine.append(hashed[own[j - 1]][1])
                    if j + 1 < len(own):
                        mine.append(hashed[own[j + 1]][2])
                    cols += mine
                    rows += [at] * len(mine)
                    at += 1
            rows, cols = np.array(rows), np.array(cols)
            e = np.bincount(rows, weights[cols], at)
            y = np.concatenate([m for _, m in batch]).astype(float)
            lengths = np.array([len(own) for own, _ in batch])
            fwd, bwd, own_factor = messages(e, lengths, trans)
            m = fwd * bwd / own_factor
            m = m / (1 + m)
            slope = np.bincount(cols, (m - y)[rows], DIMENSION) / len(batch) + RIDGE * weights
            square += slope * slope
            weights -= RATE * slope / np.sqrt(square)
            inner = np.ones(at, bool)
            inner[np.cumsum(lengths) - lengths] = False
            b = np.flatnonzero(inner)
            joint = np.exp(trans)[None] * np.stack([np.ones(len(b)), fwd[b - 1]], 1)[:, :, None] * np.stack([np.ones(len(b)), bwd[b]], 1)[:, None, :]
            pair = joint / joint.sum((1, 2), keepdims=True)
            true = np.stack([np.stack([(1 - y[b - 1]) * (1 - y[b]), (1 - y[b - 1]) * y[b]], 1), np.stack([y[b - 1] * (1 - y[b]), y[b - 1] * y[b]], 1)], 1)
            slope_t = (pair - true).sum(0) / len(batch) + 1e-3 * trans
            square_t += slope_t * slope_t
            trans = trans - 0.1 * slope_t / np.sqrt(square_t)
    return weights, trans


def document_model(aggregates: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression of document labels by Newton steps."""
    x, w = _design(aggregates), np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (weight * (toxic - p)) - 0.1 * w)
        w += np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return w


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % HELD_OUT == 0


def _significant(sample: DataFrame, n_clean: int, n_toxic: int) -> set[str]:
    """The significant features of sample(text, toxic); documents are counted by feature on the executors."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            seen: tuple[Counter, Counter] = (Counter(), Counter())

            def counts() -> dict:
                names = list(seen[0].keys() | seen[1].keys())
                return {"feature": names, "clean": [seen[0][f] for f in names], "bad": [seen[1][f] for f in names]}

            for text, label in zip(texts(batch), batch.column("toxic").to_pylist()):
                seen[label].update(document_features(_WORD.findall(text)))
                if len(seen[0]) + len(seen[1]) > COUNTED:
                    yield counts()
                    seen[0].clear()
                    seen[1].clear()
            yield counts()

        return work

    counted = arrow_map(sample.select("text", "toxic"), "feature string, clean bigint, bad bigint", make)
    counted = materialise(counted.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad")).where(F.col("bad") >= LEAST_DOCS), "toxic-features")
    tried = counted.count()
    likely = counted.where(F.col("bad") / n_toxic >= RATIO * (F.col("clean") + 0.5) / (n_clean + 1) * (1 - 1e-9))
    return {r["feature"] for r in likely.collect() if is_significant(r["clean"], r["bad"], n_clean, n_toxic, tried)}  # of a bounded number of documents


def _windows(sample: DataFrame, strong: set[str]) -> list[tuple[list[str], np.ndarray]]:
    """All pieces of sample(id, text, toxic), in an order that does not depend on partitions."""

    def make():
        bad = marker(strong)

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            rows = [(key, label, k, *piece) for key, text, label in zip(batch.column("key").to_pylist(), texts(batch), batch.column("toxic").to_pylist()) for k, piece in enumerate(windows(_WORD.findall(text), label, bad))]
            key, label, place, words, marks = zip(*rows) if rows else [()] * 5
            yield {"key": list(key), "toxic": list(label), "place": list(place), "words": list(words), "marks": [m.tolist() for m in marks]}

        return work

    found = arrow_map(sample.select("key", "text", "toxic"), "key bigint, toxic int, place int, words array<string>, marks array<boolean>", make)
    rows = sorted(found.collect(), key=lambda r: (r["toxic"], r["key"], r["place"]))  # a bounded number of windows of bounded words
    return [(r["words"], np.array(r["marks"], bool)) for r in rows]


def _aggregates(sample: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Aggregates and labels of the whole texts of sample(key, text, toxic)."""

    def make():
        crf = model.fresh()

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            found = crf.documents(texts(batch))[0]
            yield {"key": batch.column("key"), "toxic": batch.column("toxic"), "top": found[:, 0], "total": found[:, 1]}

        return work

    rows = sorted(arrow_map(sample.select("key", "text", "toxic"), "key bigint, toxic int, top double, total double", make).collect(), key=tuple)
    return np.array([(r["top"], r["total"]) for r in rows]).reshape(-1, 2), np.array([r["toxic"] for r in rows], int)


def fit(sample: DataFrame, weights: dict[int, float] | None = None) -> Model:
    """A model from sample(key, text, toxic); weights: what a document of each class counts."""
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Model(np.zeros(DIMENSION), np.zeros((2, 2)), np.zeros(3), float(*n) if n else 0.0)
    model = Model(*train_crf(_windows(sample, _significant(sample, n[0], n[1]))), np.zeros(3))
    aggregates, toxic = _aggregates(sample, model)
    model.document = document_model(aggregates, toxic, np.array([(weights or {0: 1.0, 1: 1.0})[t] for t in toxic.tolist()]))
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.where("toxic in (0, 1)").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS) for k in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # 2 x TRAIN_DOCS rows at most
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = materialise(rows.select(F.xxhash64("doc_id").alias("key"), "text", "toxic").repartition(shuffle_width(docs.sparkSession)), "toxic-sample")
    taken = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    return fit(sample, {t: sizes[t] / n for t, n in taken.items()})  # classes count as in all labels


def score(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) → doc_id, held_out, score, predicted, and with spans 'start:end,...' of toxic tokens."""
    kind = dict(docs.dtypes)["doc_id"]

    def make():
        crf = model.fresh()

        def work(batch) -> Iterator[dict]:
            own = texts(batch)
            aggregates, words, m = crf.documents(own)
            p = crf.score(aggregates)
            out = {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": p, "predicted": (p >= 0.5).astype(int)}
            if spans:
                at, marks = 0, []
                for text, ws, (top, _) in zip(own, words, aggregates):
                    marks.append(_spans(text, m[at : at + len(ws)]) if top >= 0.5 else "")
                    at += len(ws)
                out["spans"] = marks
            yield out

        return work

    schema = f"doc_id {kind}, held_out boolean, score double, predicted int" + ", spans string" * spans
    return arrow_map(docs.select("doc_id", "text", held_out().alias("held_out")), schema, make)


def _spans(text: str, m: np.ndarray) -> str:
    """Runs of neighbouring tokens with a marginal of one half or more, as start:end in code points."""
    out: list[list[int]] = []
    last = -2
    for k, word in enumerate(_WORD.finditer(text)):
        if m[k] >= 0.5:
            if last == k - 1:
                out[-1][1] = word.end()
            else:
                out.append([word.start(), word.end()])
            last = k
    return ",".join(f"{a}:{b}" for a, b in out)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, without the documents that the model predicts to be toxic; a map over the rows."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = model.fresh()
        for batch in (s for b in batches for s in slices(b)):
            p = crf.score(crf.documents(texts(batch))[0])
            yield batch.filter(pa.array(p < 0.5))

    return map_arrow(docs, run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")), spans=True)
