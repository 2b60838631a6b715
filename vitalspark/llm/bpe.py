"""Byte-level BPE encoding by a bounded-lookahead transducer, and decoding by an incremental state machine.

Method: the merge list alone fixes how far right of a token's end the input can still change that token (the
sufficient lookahead, see `sufficient_lookahead`). A text is fed in pieces of PIECE characters to a transducer with two
levels of state. The first finds the borders of added tokens and pre-tokens: what could still change with further input
(a few characters, or the last unfinished pre-token) is held back. The second gets the bytes of a pre-token and emits
those tokens that end at least the lookahead before the end of what it holds; a pre-token's end makes all of it stable,
and no merge crosses a token border of the full result, so what is left is encoded on its own. What is held is
encoded as the one sequence of tokens of which any two neighbours stay apart, which is what merging by rank gives. A
pre-token that ends within WINDOWS lookaheads is looked up in a table of bounded size first. Neither level holds more than a piece and
WINDOWS lookaheads, whatever the length of a text, a pre-token or a run of white space. Decoding feeds the bytes of
the emitted tokens to a UTF-8 state machine that holds at most three pending bytes and writes U+FFFD for what no valid
sequence can begin. Digests are updated as ids and text come out.

Defined results: a null text counts as empty, and an empty text has no token; the strings of added tokens
become their ids; equal texts give equal ids; truncation and padding of the file are not used; a file with another
pre-tokenizer, normalizer or kind of added tokens than the ones built here is refused, as is a merge list in which a
token is made by a later rule than one that uses it (its lookahead may have no bound); an empty table gives an empty
result; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, table, texts

#: Pre-tokens kept in a worker's table and bytes of the longest one; when full, it is emptied.
TABLE_SIZE, LONGEST_KEPT = 200_000, 64
#: Characters fed at a time, and lookaheads that the byte level takes in before it emits.
PIECE, WINDOWS = 1 << 16, 8
#: The pre-token pattern of the byte-level vocabulary, and its classes of characters.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CLASSES = (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+")
#: Characters beyond a border on which it may depend: the longest contraction, and the one after white space.
BORDER = 3


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[int, int]], made: list[int], size: dict[int, int]) -> int:
    """Bytes after a token's end beyond which the input cannot change the token any more.

    Merging (u, v) by rule r fails only if something right of v takes v, or a part on v's right edge, first: a
    rule (s, x) of lower rank than a rule that puts s into its parent. Whether that x forms depends in turn on
    what stands right of x. need(r) = |v| + the largest need of such rules. All rules that make a token count; each
    must rank below the rules that use it, so one pass in order of rank computes all. The result also covers the
    first byte outside.
    """
    makers: dict[int, list[tuple[int, int]]] = {}  # token → (rank, right part) of the rules that make it
    for rank, ((_, v), t) in enumerate(zip(merges, made, strict=True)):
        makers.setdefault(t, []).append((rank, v))
    ranks: dict[int, list[int]] = {}  # left part → ranks of its rules, and the largest need so far
    needs: dict[int, list[int]] = {}
    best = 0
    for rank, (u, v) in enumerate(merges):
        if any(own[-1][0] >= rank for s in (u, v) if (own := makers.get(s))):
            raise ValueError(f"merge {rank} uses a token that a later merge makes")
        more, todo, seen = 0, [(v, rank)], {v: rank}
        while todo:
            s, bound = todo.pop()
            k = bisect_left(ranks.get(s, ()), bound)
            if k:
                more = max(more, needs[s][k - 1])
            for own, right in makers.get(s, ()):
                if seen.get(right, -1) < own:
                    seen[right] = own
                    todo.append((right, own))
        need = size[v] + more
        ranks.setdefault(u, []).append(rank)
        own = needs.setdefault(u, [])
        own.append(max(need, own[-1] if own else 0))
        best = max(best, need)
    return best + 1


class Codec:
    """Encoder and decoder of one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        _check(spec)
        model, to_byte = spec["model"], _byte_chars()
        vocab: dict[str, int] = model["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items() if t not in self.added} | {i: t.encode() for t, i in self.added.items()}
        self.single = [vocab.get(c) for c, b in sorted(to_byte.items(), key=lambda x: x[1])]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merges = [(vocab[a], vocab[b]) for a, b in pairs]
        made = [vocab[a + b] for a, b in pairs]
        self.rule = {m: (rank, t) for rank, (m, t) in reversed(list(enumerate(zip(merges, made, strict=True))))}
        self.size = {i: len(b) for i, b in self.bytes_of.items()}
        self.lookahead = sufficient_lookahead(merges, made, self.size)
        self.window = WINDOWS * max(self.lookahead, max(self.size.values()))
        self._derive(merges, made)
        self.split = regex.compile(PATTERN)
        self.classes = [regex.compile(c) for c in CLASSES]
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.longest = max(map(len, self.added), default=0)
        self.memo: dict[str, bytes] = {}

    def _derive(self, merges: list[tuple[int, int]], made: list[int]) -> None:
        """How each token is made, and the table of those that their own bytes encode to; others never come out."""
        self.rank, self.parts = dict.fromkeys(self.bytes_of, -1), {}
        self.near: dict[int, bool] = {}  # whether two tokens stay apart
        several = {t for t, n in Counter(made).items() if n > 1}
        whole = {self.bytes_of[i]: i for i in self.single if i is not None}
        for rank, (pair, t) in enumerate(zip(merges, made, strict=True)):
            if t in several:  # the rule that its own bytes end with
                several.discard(t)
                steps: list = []
                if self._merge(self.bytes_of[t], steps) != [t]:
                    self.rank.pop(t)
                    continue
                rank, pair = steps[-1]
            elif t in self.parts or t not in self.rank:
                continue
            self.rank[t], self.parts[t] = rank, pair
        for t, (u, v) in sorted(self.parts.items(), key=lambda x: self.rank[x[0]]):
            if whole.get(self.bytes_of[u]) == u and whole.get(self.bytes_of[v]) == v and self._fits(u, v, self.rank[t]):
                whole[self.bytes_of[t]] = t
        self.trie: dict[int, int] = {}  # node and next byte → node
        self.ends = [-1]  # the token that ends at a node
        for raw, t in whole.items():
            node = 0
            for byte in raw:
                then = self.trie.setdefault(node << 8 | byte, len(self.ends))
                if then == len(self.ends):
                    self.ends.append(-1)
                node = then
            self.ends[node] = t

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def _merge(self, raw: bytes, steps: list | None = None) -> list[int]:
        """By definition: apply the merge of lowest rank, leftmost first, until none applies; `steps` gets those applied."""
        single, rule = self.single, self.rule
        ids = [single[b] for b in raw]
        found = [rule.get(p) for p in zip(ids, ids[1:])]
        while True:
            best = None
            for k, f in enumerate(found):
                if f is not None and (best is None or f < best):
                    best, at = f, k
            if best is None:
                return ids
            if steps is not None:
                steps.append((best[0], (ids[at], ids[at + 1])))
            ids[at : at + 2] = [best[1]]
            del found[at]
            if at:
                found[at - 1] = rule.get((ids[at - 1], ids[at]))
            if at < len(found):
                found[at] = rule.get((ids[at], ids[at + 1]))

    def _fits(self, a: int, b: int, limit: float = math.inf) -> bool:
        """Whether tokens a and b stay apart when they stand next to each other.

        Time runs backwards: the part at the border that was made last is undone, the right one of two of a rank, as the
        left one merges first. A rule for the two parts then at the border that ranks before the undone one would have
        taken them.
        """
        rule, rank, split = self.rule, self.rank, self.parts
        while True:
            found = rule.get((a, b))
            if found is not None and found[0] < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], split[a][1]
            elif rank[b] < 0:
                return True
            else:
                limit, b = rank[b] + 1, split[b][0]

    def _segment(self, raw: bytes) -> list[int]:
        """As _merge: the one sequence of tokens of which all neighbours stay apart, tried from the longest tokens on."""
        step, ends, near, n = self.trie.get, self.ends, self.near, len(raw)
        ids: list[int] = []
        tried: list[tuple[int, list]] = []  # where each token starts, and the shorter ones that may stand there
        dead: set[int] = set()  # places from which nothing follows; the tokens up to a place are unique
        at = 0
        while at < n:
            node, end, options = 0, at, []
            while end < n and (node := step(node << 8 | raw[end])) is not None:
                end += 1
                if (token := ends[node]) >= 0:
                    options.append((token, end))
            while True:
                if not options:
                    dead.add(at)
                    ids.pop()
                    at, options = tried.pop()
                    continue
                token, end = options.pop()
                if end in dead:
                    continue
                if ids:
                    pair = ids[-1] << 32 | token
                    if (ok := near.get(pair)) is None:
                        if len(near) >= TABLE_SIZE:
                            near.clear()
                        ok = near[pair] = self._fits(ids[-1], token)
                    if not ok:
                        continue
                break
            ids.append(token)
            tried.append((at, options))
            at = end
        return ids

    def stream(self, pieces: Iterable[bytes]) -> Iterator[bytes]:
        """Packed ids of one pre-token that arrives in pieces, each as soon as it is stable."""
        state = Bytes(self)
        for piece in pieces:
            yield from state.feed(piece)
        yield state.end()

    def _word(self, word: str) -> bytes:
        """A whole pre-token: its end is known, so a short one is stable at once and may be kept in the table."""
        raw = word.encode()
        if len(raw) > self.window:
            return b"".join(self.stream([raw]))
        out = self._pack(self._segment(raw))
        if len(raw) <= LONGEST_KEPT:
            if len(self.memo) >= TABLE_SIZE:
                self.memo.clear()
            self.memo[word] = out
        return out

    def words(self, found: list[str]) -> bytes:
        memo, word = self.memo.get, self._word
        return b"".join([memo(w) or word(w) for w in found])

    def pieces(self, text: str, piece: int = 0) -> Iterator[bytes]:
        """Packed ids of a text in the order and at the pace in which the transducer emits them."""
        piece = piece or PIECE
        state = Text(self, piece)
        for k in range(0, len(text), piece):
            yield from state.feed(text[k : k + piece], k + piece >= len(text))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(self.pieces(text))

    def decode(self, ids: Iterable[bytes]) -> Iterator[str]:
        """Text of packed ids that come in pieces; the state between pieces is the decoder's pending bytes."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        bytes_of = self.bytes_of.__getitem__
        for part in ids:
            yield state.decode(b"".join(map(bytes_of, np.frombuffer(part, "<u4").tolist())))
        yield state.decode(b"", True)


def _check(spec: dict) -> None:
    """Refuse settings that this codec does not follow (truncation and padding are unused by contract)."""
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"].get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
        raise ValueError("not a byte-level BPE file without normalizer and prefix space")
    model = spec["model"]
    if model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix")):
        raise ValueError("the model's dropout, fallback, prefix or suffix is not supported")
    if any(x.get(k) for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that strip or match whole words are not supported")


class Bytes:
    """The byte level of the transducer: the part of one pre-token that is not yet stable."""

    def __init__(self, codec: Codec):
        self.codec, self.held = codec, b""

    def feed(self, raw: bytes) -> Iterator[bytes]:
        codec, at = self.codec, 0
        while at < len(raw):
            take = codec.window - len(self.held)
            self.held += raw[at : at + take]
            at += take
            if len(self.held) == codec.window:
                ids, end = [], 0
                for i in codec._segment(self.held):
                    if end + codec.size[i] > codec.window - codec.lookahead:
                        break
                    end += codec.size[i]
                    ids.append(i)
                self.held = self.held[end:]
                yield codec._pack(ids)

    def end(self) -> bytes:
        raw, self.held = self.held, b""
        return self.codec._pack(self.codec._segment(raw)) if raw else b""


class Text:
    """The character level of the transducer: text whose borders are open, and the class of an unfinished pre-token."""

    def __init__(self, codec: Codec, piece: int):
        self.codec, self.piece, self.held = codec, piece, ""
        self.keep = codec.longest + BORDER  # the last characters, on which a border before them may depend
        self.inside: regex.Pattern | None = None  # the class of a pre-token that `state` has begun to take in
        self.state = Bytes(codec)

    def feed(self, piece: str, last: bool) -> Iterator[bytes]:
        codec, at = self.codec, 0
        text, self.held = self.held + piece if self.held else piece, ""
        if codec.special:
            for m in codec.special.finditer(text):
                yield from self._plain(text[at : m.start()], True)
                yield codec._pack([codec.added[m[0]]])
                at = m.end()
        yield from self._plain(text[at:] if at else text, last)

    def _plain(self, text: str, border: bool) -> Iterator[bytes]:
        """Text without added tokens; without a border at its end, what depends on more text is held back."""
        codec = self.codec
        if self.inside:
            m = self.inside.match(text)
            end = m.end() if m else 0
            if not border and end > len(text) - self.keep:  # it may go on
                stop = max(0, len(text) - self.keep)
                self.held = text[stop:]
                yield from self.state.feed(text[:stop].encode())
                return
            if self.inside is codec.classes[-1] and end < len(text):
                end -= 1  # the last white space before other characters does not belong to the run
            yield from self.state.feed(text[:end].encode())
            yield self.state.end()
            self.inside, text = None, text[end:]
        found = codec.split.findall(text)
        if border:
            if found:
                yield codec.words(found)
            return
        over, first = 0, ""
        while found and over <= self.keep:
            first = found.pop()
            over += len(first)
        if found:
            yield codec.words(found)
        self.held = text[len(text) - over :]
        if over > self.piece and len(first) > over - self.piece + self.keep:  # a pre-token that is longer than a piece
            self.inside = next(c for c in codec.classes if (m := c.match(first, first[0] == " ")) and m.end() == len(first))
            stop = len(first) - self.keep - 1
            yield from self.state.feed(self.held[:stop].encode())
            self.held = self.held[stop:]


def _codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


_CODECS: dict[str, Codec] = {}


def round_trip(codec: Codec, text: str, piece: int = 0) -> tuple[int, str, str]:
    """Number of tokens, digest of the ids, and digest of the text decoded from them, all taken as tokens come out."""
    sent, back = hashlib.sha256(), hashlib.sha256()
    n = 0

    def tokens() -> Iterator[bytes]:
        nonlocal n
        for part in codec.pieces(text, piece):
            n += len(part) // 4
            sent.update(part)
            yield part

    for part in codec.decode(tokens()):
        back.update(part.encode())
    return n, sent.hexdigest(), back.hexdigest()


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text, ...) → doc_id, n_tokens, ids (little-endian unsigned 32-bit integers)."""
    kind = dict(docs.dtypes)["doc_id"]

    def make():
        codec = _codec(path)

        def work(batch):
            ids = [codec.encode(t) for t in texts(batch)]
            yield {"doc_id": batch.column("doc_id"), "n_tokens": [len(x) // 4 for x in ids], "ids": ids}

        return work

    return arrow_map(docs.select("doc_id", "text"), f"doc_id {kind}, n_tokens long, ids binary", make)


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text, ...) → doc_id, n_tokens, ids_sha256, decoded_sha256 of the round trip."""
    kind = dict(docs.dtypes)["doc_id"]

    def make():
        codec = _codec(path)

        def work(batch):
            n, ids, back = zip(*(round_trip(codec, t) for t in texts(batch)))
            yield {"doc_id": batch.column("doc_id"), "n_tokens": list(n), "ids_sha256": list(ids), "decoded_sha256": list(back)}

        return work

    return arrow_map(docs.select("doc_id", "text"), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents"), default_vocabulary())
