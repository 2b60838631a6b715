"""Personal-data spans by weak supervision.

Method: candidates of a kind are the base matches (the exact patterns below), base matches that fail their check, and
what looser patterns find: addresses and numbers that are spelt out, spaced, bracketed, defanged or written without a
prefix. Four labelers (pattern with its check, gazetteer, context, shape) vote +1, 0 or -1 on every candidate.
Spark counts the vote patterns over all documents; expectation-maximisation over these counts estimates
each labeler's reliability and the posterior of every pattern; a logistic classifier is trained on the posteriors
over aggregated feature patterns, again counts of all documents. Base spans always stay; of the further candidates
the classifier adds those with at least THRESHOLD, the likelier first, that overlap no span taken before.

Both counts are tables of a fixed number of cells (kinds x votes x length and border classes), so what reaches
the driver does not grow with the data; candidates themselves never leave the executors in training.

Defined results: a null text counts as empty; offsets are code points, end exclusive; an empty text has the
digest of the empty string and no span; repeated rows are scored alike; an empty table gives an empty result
(and no model, none being needed); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table, texts

#: Kinds in order, and the base patterns (possessive where that cannot change a match).
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _NUMBER = re.compile(r"[0-9]"), re.compile(r"[0-9]+")
_SIGN = re.compile(r"[(\[{]\s?at\s?[)\]}]", re.I)
#: Further candidates: mail addresses spelt out or spaced, defanged or spelt network addresses, card numbers in other groups,
#: telephone numbers without the plus sign. Bounded repeats, so that each is found in linear time.
_AT, _DOT = r"\s?(?:\(\s?at\s?\)|\[\s?at\s?\]|\{\s?at\s?\}|<at>)\s?", r"\s?(?:\(\s?dot\s?\)|\[\s?dot\s?\]|\{\s?dot\s?\}|\[\.\]|<dot>|\x20dot\x20|\.)\s?"
_NAME, _LABEL = r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}", r"[A-Za-z0-9-]{1,63}"
_SPELT = re.compile(rf"{_NAME}{_AT}{_LABEL}(?:{_DOT}{_LABEL}){{1,5}}", re.I)
_SAID = re.compile(rf"{_NAME}(?:\x20dot\x20[A-Za-z0-9]{{1,63}}){{0,3}}\x20at\x20{_LABEL}(?:\x20dot\x20{_LABEL}){{1,4}}", re.I)
_SPACED = re.compile(rf"{_NAME}\x20?@\x20?{_LABEL}(?:\x20?\.\x20?{_LABEL}){{1,5}}")
_OCTETS = re.compile(r"(?<![\w.])[0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\x20dot\x20)\s?[0-9]{1,3}){3}(?![\w])", re.I)
_GROUPS = re.compile(r"(?<![\w.,/-])[0-9]{4}(?:[./_][0-9]{4}){3}(?![\w.,/-]?[0-9])")
_LOCAL_PHONE = re.compile(r"(?<![\w+.-])(?:\([0-9]{2,5}\)|[0-9]{2,5})[\x20/.-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,4}(?![\w.-])")
_PREFIXED = re.compile(r"(?<![\w+.-])00[1-9][0-9]{0,2}[\x20/.-]?(?:\(?[0-9]{1,5}\)?[\x20/.-]?){2,5}(?<=[0-9])(?![\w])")
#: Gazetteers and context words by kind.
_TLDS = frozenset("com org net edu gov io de fr es uk eu info biz co us ca au ch at it nl".split())
_DIAL = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "62", "64", "65", "66", "81", "82", "86", "90", "91", "351", "352", "353", "358", "420")
_CARD_HEADS = {
    "4": (13, 16, 19), "51": (16,), "52": (16,), "53": (16,), "54": (16,), "55": (16,), "2221": (16,), "223": (16,), "23": (16,), "24": (16,), "25": (16,), "26": (16,), "270": (16,), "271": (16,), "2720": (16,),
    "34": (15,), "37": (15,), "36": (14,), "38": (14,), "6011": (16,), "65": (16,), "35": (16,), "62": (16, 17, 18, 19),
}
_CUES = {
    "email": re.compile(r"e-?mail|mailto|contact|write to|courriel|correo|kontakt", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|adresse|dirección|login|gateway", re.I),
    "card": re.compile(r"card|visa|mastercard|amex|karte|carte|tarjeta|payment", re.I),
    "phone": re.compile(r"tel|phone|call|fax|mobile|handy|portable|móvil|whatsapp|sms", re.I),
}
_AGAINST = re.compile(r"version|release|isbn|order|invoice|section|chapter|sha|hash|serial|model|part no", re.I)
#: A candidate is added from this probability; the ridge penalty, EM rounds and the least and largest reliability.
THRESHOLD, RIDGE, ROUNDS, LEAST, MOST = 0.5, 1.0, 50, 0.55, 0.99
#: How often votes are 1 by chance, of labelers where that follows from their rule and is not one less their reliability: a
#: check digit fits one number in ten, and so many 16-digit numbers begin like an issuer's of that length.
CHANCE = {"card": {0: 0.1, 1: sum(10.0 ** -len(head) for head, sizes in _CARD_HEADS.items() if 16 in sizes)}}
#: Reliability that EM begins with for pattern, gazetteer, context and shape, and its weight against a kind's votes: the
#: same share at every size, so that a labeler which hardly varies in a corpus is not taken for the truth.
BELIEF, WEIGHT = (0.85, 0.75, 0.9, 0.75), 0.25


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the base pattern in linear time: a local part runs back from its @ to the last match at most."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def candidates(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, pattern vote): 1 base match, -1 base match that fails its check, 0 further candidate."""
    out = []
    if "@" in text:
        out += [("email", a, b, 1) for a, b in _emails(text)]
        out += [("email", m.start(), m.end(), 0) for m in _SPACED.finditer(text) if " " in m[0]]
    if "at)" in text or "at]" in text or "at}" in text or "at>" in text or _SIGN.search(text):
        out += [("email", m.start(), m.end(), 0) for m in _SPELT.finditer(text)]
    if " dot " in text:
        out += [("email", m.start(), m.end(), 0) for m in _SAID.finditer(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        ok = all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))
        out.append(("ip", m.start(), m.end(), 1 if ok else -1))
    if "[.]" in text or "(.)" in text or "dot" in text:
        out += [("ip", m.start(), m.end(), 0) for m in _OCTETS.finditer(text) if all(int(x) <= 255 for x in _NUMBER.findall(m[0]))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19:
                right = luhn(digits)
                out.append(("card", m.start(), m.end(), -1 if not right else 1 if len(digits) >= 16 else 0))
    out += [("card", m.start(), m.end(), 0) for m in _GROUPS.finditer(text) if luhn("".join(_NUMBER.findall(m[0])))]
    if "+" in text:
        for m in _PHONE.finditer(text):
            digits = sum(c.isdigit() for c in m[0])
            out.append(("phone", m.start(), m.end(), 1 if 8 <= digits <= 15 else -1))
    out += [("phone", m.start(), m.end(), 0) for m in _LOCAL_PHONE.finditer(text)]
    if "00" in text:
        out += [("phone", m.start(), m.end(), 0) for m in _PREFIXED.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    base = [(a, b) for _, a, b, vote in out if vote == 1]
    return _without(out, base) if base and len(base) < len(out) else out


def _without(found: list[tuple[str, int, int, int]], base: list[tuple[int, int]]) -> list[tuple[str, int, int, int]]:
    """The candidates without the further ones that overlap base matches: they are the same data again."""
    base.sort()
    starts, reach = [a for a, _ in base], list(accumulate((b for _, b in base), max))  # the furthest end so far
    return [c for c in found if c[3] == 1 or not ((k := bisect_left(starts, c[2])) and reach[k - 1] > c[1])]


def votes(text: str, kind: str, start: int, end: int, pattern: int) -> tuple[int, int, int, int, int, int]:
    """The votes of pattern, gazetteer, context and shape, and the length and border classes of a candidate."""
    span = text[start:end]
    digits = "".join(c for c in span if c in "0123456789")
    if kind == "email":
        known = 1 if re.split(r"[.\])}>\s]", span.lower())[-1] in _TLDS else -1
    elif kind == "ip":
        parts = [p.lstrip("0") for p in _NUMBER.findall(span)]
        known = 1 if len(parts[0]) <= 3 and 1 <= int(parts[0] or 0) <= 223 else -1  # the first part of a host's address
    elif kind == "card":
        known = 1 if any(len(digits) in _CARD_HEADS.get(digits[:k], ()) for k in (1, 2, 3, 4)) else -1
    else:
        known = (1 if digits.removeprefix("00").startswith(_DIAL) else -1) if span.startswith(("+", "00")) else 0
    before = text[max(0, start - 40) : start]
    cue = 1 if _CUES[kind].search(before) else -1 if _AGAINST.search(before) else 0
    glued = (start > 0 and text[start - 1].isalnum()) + 2 * (end < len(text) and text[end].isalnum())
    if kind == "card":
        shape = -1 if glued else 0  # the length is the issuer's affair
    elif kind == "phone":
        shape = -1 if glued else 1 if 9 <= len(digits) <= 13 else 0
    elif kind == "ip":
        shape = -1 if glued or any(len(p) > 3 or int(p or 0) > 255 for p in parts) else 1
    else:
        shape = -1 if glued else 1
    return pattern, known, cue, shape, min(5, (end - start) // 6), glued


def expectation_maximisation(counts: dict[tuple, int], chance: dict[int, float] | None = None) -> tuple[np.ndarray, dict[tuple, float]]:
    """Reliabilities of the labelers and the posterior of each vote pattern, from pattern counts (one kind's).

    A labeler is as reliable for what is no personal data as for what is, but for those in `chance`: their votes for what is
    none are known beforehand, so that a vote which is common by chance carries little.
    """
    patterns = np.array([p[:4] for p in counts])
    n = np.array(list(counts.values()), float)
    right, prior, own = np.array(BELIEF), 0.5, np.array([k in (chance or {}) for k in range(4)])
    given = np.array([(chance or {}).get(k, 0.5) for k in range(4)])
    yes, no = (patterns == 1).astype(float), (patterns == -1).astype(float)
    for _ in range(ROUNDS):
        wrong = np.where(own, given, 1 - right)  # votes for what is none
        logit = math.log(prior / (1 - prior)) + yes @ np.log(right / wrong) + no @ np.log((1 - right) / (1 - wrong))
        post = 1 / (1 + np.exp(-logit))
        prior = float(np.clip((n @ post + 1) / (n.sum() + 2), 0.02, 0.98))
        real, none = post[:, None] * n[:, None], np.where(own, 0, (1 - post)[:, None] * n[:, None])
        agree, voted = (yes * real + no * none).sum(0), ((yes + no) * (real + none)).sum(0)
        weight = WEIGHT * max(1.0, n.sum())
        right = np.clip((agree + np.array(BELIEF) * weight) / (voted + weight), LEAST, MOST)
    return right, dict(zip(counts, post.tolist(), strict=True))


def _features(kind: str, cell: tuple) -> np.ndarray:
    x = np.zeros(4 + 4 * 3 + 6 + 4)
    x[KINDS.index(kind)] = 1
    for k in range(4):
        x[4 + 3 * k + cell[k] + 1] = 1
    x[16 + cell[4]] = 1
    x[22 + cell[5]] = 1
    return x


def fit_classifier(cells: dict[tuple, int], post: dict[tuple, float]) -> np.ndarray:
    """Ridge logistic regression on soft labels by Newton steps; cells: (kind, *votes, length, border) → count."""
    x = np.array([_features(c[0], c[1:]) for c in cells])
    y = np.array([post[c[0], *c[1:]] for c in cells])
    n = np.array(list(cells.values()), float)
    n *= 1e5 / n.sum()  # the penalty weighs the same whatever the number of candidates
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (n * (y - p)) - RIDGE * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame) -> tuple[np.ndarray | None, dict[str, np.ndarray]]:
    """Classifier weights and the labelers' reliabilities by kind, from the votes of all documents."""

    def make():
        def work(batch) -> Iterator[dict]:
            seen: Counter = Counter()
            for text in texts(batch):
                for kind, start, end, pattern in candidates(text):
                    seen[kind, *votes(text, kind, start, end, pattern)] += 1
            names = ("kind", "pattern", "known", "cue", "shape", "long", "glued")
            yield {k: [c[i] for c in seen] for i, k in enumerate(names)} | {"n": list(seen.values())}

        return work

    schema = "kind string, pattern int, known int, cue int, shape int, long int, glued int, n long"
    cells = arrow_map(docs.select("text"), schema, make).groupBy("kind", "pattern", "known", "cue", "shape", "long", "glued").agg(F.sum("n").alias("n"))
    counts = {tuple(r[:7]): r["n"] for r in cells.collect()}  # at most 4 x 81 x 24 cells
    if not counts:
        return None, {}
    post: dict[tuple, float] = {}
    right = {}
    for kind in KINDS:
        own = {c[1:]: n for c, n in sorted(counts.items()) if c[0] == kind}
        if own:
            right[kind], found = expectation_maximisation(own, CHANCE.get(kind))
            post |= {(kind, *c): p for c, p in found.items()}
    return fit_classifier(dict(sorted(counts.items())), post), right


def spans(text: str, weights: np.ndarray | None, memo: dict) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans, each by kind, then start."""
    found = candidates(text)
    base = [(k, a, b) for k, a, b, vote in found if vote == 1]
    more: list[tuple[float, int, int, str]] = []  # (-probability, start, end, kind)
    for kind, start, end, vote in found if weights is not None else ():
        if vote < 1:
            cell = votes(text, kind, start, end, vote)
            if (kind, cell) not in memo:
                memo[kind, cell] = 1 / (1 + math.exp(-float(_features(kind, cell) @ weights)))
            if memo[kind, cell] >= THRESHOLD:
                more.append((-memo[kind, cell], start, end, kind))
    if not more:
        order = lambda s: (KINDS.index(s[0]), s[1])
        base.sort(key=order)
        return base, base
    added = [(kind, start, end) for _, start, end, kind in _apart(sorted(more))]
    order = lambda s: (KINDS.index(s[0]), s[1])
    return sorted(base, key=order), sorted(base + added, key=order)


def _apart(more: list[tuple[float, int, int, str]]) -> list[tuple[float, int, int, str]]:
    """Of spans in order of preference those that overlap none taken before."""
    out, own = [], []  # own: spans taken, which are apart from each other, in order
    for span in more:
        _, start, end, _ = span
        k = bisect_left(own, (start, end))
        if not (k and own[k - 1][1] > start or k < len(own) and own[k][0] < end):
            own.insert(k, (start, end))
            out.append(span)
    return out


def find_pii(docs: DataFrame, weights: np.ndarray | None = None, fit: bool = True) -> DataFrame:
    """docs(doc_id, text, ...) → doc_id, counts of base spans by kind, base_sha256, spans, n_spans (added ones too)."""
    if weights is None and fit:
        weights, _ = train(docs)
    kind = dict(docs.dtypes)["doc_id"]

    def make():
        memo: dict = {}

        def work(batch) -> Iterator[dict]:
            rows = [spans(t, weights, memo) for t in texts(batch)]
            joined = lambda found: ",".join(f"{k}:{a}:{b}" for k, a, b in found)
            counts = {f"n_{k}": [sum(s[0] == k for s in base) for base, _ in rows] for k in KINDS}
            yield {"doc_id": batch.column("doc_id"), **counts, "base_sha256": [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows], "spans": [joined(every) for _, every in rows], "n_spans": [len(every) for _, every in rows]}

        return work

    return arrow_map(docs.select("doc_id", "text"), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long", make)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
