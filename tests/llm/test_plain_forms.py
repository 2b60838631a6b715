"""Fingerprints and preference pairs against plain, item-by-item forms of their definitions."""

import random

import pytest

from vitalspark.llm import chat_format, fingerprint
from vitalspark.llm.chat_format import END, START

M64 = (1 << 64) - 1


def plain_chunks(raw):
    """The chunk codes of a text, byte by byte."""
    gear, byte = fingerprint._GEAR.tolist(), fingerprint._BYTE.tolist()

    def hashed(p):  # of the last 16 bytes before place p
        return sum(gear[raw[p - 1 - i]] << i for i in range(min(16, p))) & 0xFFFFFFFF

    out, start, n = [], 0, len(raw)
    while start < n:
        end = n
        if n - start > fingerprint.LEAST:
            for p in range(start + fingerprint.LEAST, n):
                h, size = hashed(p), p - start
                strict, loose = h >> 32 - fingerprint.STRICT == 0, h >> 32 - fingerprint.LOOSE == 0
                if strict and size <= fingerprint.TARGET or loose and size >= fingerprint.TARGET or size == fingerprint.MOST:
                    end = p
                    break
        value, power = 0, 1
        for b in raw[start:end]:
            value, power = value + byte[b] * power & M64, power * fingerprint._STEP & M64
        value ^= end - start
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            value = (value ^ value >> 33) * factor & M64
        value ^= value >> 33
        out.append(value & ~0xFF & M64 | end - start)
        start = end
    return sorted(out)


def test_chunks_equal_a_chunker_that_goes_byte_by_byte():
    rng = random.Random(1)
    raw = [bytes(rng.choice(letters) for _ in range(rng.randrange(0, 900))) for letters in (b"ab", b"abcdefgh ", bytes(range(256))) for _ in range(40)]
    raw += [b"", b"x" * 16, b"x" * 17, b"x" * 1000]
    for own, got in zip(raw, fingerprint.chunks(raw)):
        assert got.tolist() == plain_chunks(own)


def plain_pair(turns):
    """The formatted pair of one conversation of (turn, role, text)."""
    own = sorted(((t is not None, t or 0, r or "user", x or "") for t, r, x in turns))
    chosen = [(r, x) for _, _, r, x in own]
    last = max((k for k, (r, _) in enumerate(chosen) if r == "assistant"), default=None)
    rejected = list(chosen)
    if last is not None:
        earlier = [x for r, x in chosen[:last] if r == "assistant"]
        rejected[last : last + 1] = [("assistant", earlier[-1])] if earlier else []
    common = 0
    while common < min(len(chosen), len(rejected)) and chosen[common] == rejected[common]:
        common += 1
    text = lambda rows: "".join(f"{START}{r}\n{x}{END}\n" for r, x in rows)

    def mask(rows):
        out, at = [], 0
        for r, x in rows:
            at += len(text([(r, x)]))
            if r == "assistant":
                out.append(f"{at - len(x) - len(END) - 1}:{at - 1}")
        return ",".join(out)

    return common, text(chosen[:common]), text(chosen[common:]), mask(chosen[common:]), text(rejected[common:]), mask(rejected[common:])


def test_reply_pairs_equal_plain_python(spark):
    rng = random.Random(2)
    roles, words = ["user", "assistant", "assistant", None, "system"], ["a", "bé", "", None, "long " * 40, "😀 x"]
    rows = [(c, rng.choice([None, 0, 1, 1, 2, 3, 4]), rng.choice(roles), rng.choice(words), "clash", 1) for c in range(60) for _ in range(rng.randrange(1, 8))]
    rows += [(None, k, "assistant", "null id", "clash", 1) for k in range(3)] + [(99, 1, "assistant", "same", "clash", 1)] * 3  # repeated rows and tied turns
    rows += [(100, 0, "user", "w " * 200_000, "clash", 1), (100, 1, "assistant", "y " * 200_000, "clash", 1)]  # very long turns
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, side string, pos int").repartition(5)
    got = {r["pair_id"]: tuple(r)[1:] for r in chat_format.format_sides(chat_format.reply_pairs(df)).collect()}
    by = {}
    for c, turn, role, text, *_ in rows:
        by.setdefault(c, []).append((turn, role, text))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        assert got[c] == plain_pair(turns), c
    assert chat_format.format_sides(chat_format.reply_pairs(df.limit(0))).count() == 0


@pytest.mark.parametrize("text", ["", "a", "é" * 50])
def test_a_text_is_like_itself(text):
    (own,) = fingerprint.chunks([text.encode()])
    assert fingerprint.likeness(own, own) == 1.0
