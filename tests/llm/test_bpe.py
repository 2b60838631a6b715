"""The BPE transducer against the tokenizers library and against whole merging."""

import hashlib
import json
import random
import tracemalloc

import numpy as np
import pytest

from vitalspark.llm import bpe


def codec():
    return bpe._codec(bpe.default_vocabulary())


def ids_of(text, piece):
    return np.frombuffer(b"".join(codec().pieces(text, piece)), "<u4").tolist()


def test_equals_the_library_in_pieces_of_any_size():
    from tokenizers import Tokenizer

    ref, rng = Tokenizer.from_file(bpe.default_vocabulary()), random.Random(3)
    texts = ["", " ", "a" * 5000, "ab" * 4000, "<|endoftext|>hi <|endoftext|>", "don't I'll", "\r\n\t x", "é" * 900, "😀" * 400, " " * 3000 + "a", "-" * 6000]
    texts += ["   <|endoftext|>  x", "''''s 's", " " * 500 + "\n" + "b", "\n" * 400 + " b", "1" * 900 + " 2", "x " * 9000]
    texts += ["".join(rng.choice("abcdehtinr") for _ in range(4500)) for _ in range(4)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0x1F300, 0x1F700)])) for _ in range(50)) for _ in range(200)]
    parts = ["a", "b", "'s", "'", " ", "  ", "\n", "1", "2", "<|endoftext|>", "<|endof", "!", "é"]
    texts += ["".join(rng.choice(parts) * rng.choice([1, 1, 1, 2, 40, 90]) for _ in range(30)) for _ in range(400)]
    for t in texts:
        want = ref.encode(t, add_special_tokens=False).ids
        for piece in (0, 1, 16, 50):
            if piece != 1 or len(t) < 2000:
                assert ids_of(t, piece) == want
        raw = np.array(want, "<u4").tobytes()
        assert bpe.round_trip(codec(), t, 16) == (len(want), hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        assert "".join(codec().decode(raw[k : k + 4] for k in range(0, len(raw), 4))) == t


def test_memory_does_not_grow_with_the_text():
    def peak(n):
        text = ("word " * 50 + "x" * 700 + " " * 300) * n
        tracemalloc.start()
        bpe.round_trip(codec(), text)
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top

    peak(1)
    small = peak(40)
    assert peak(400) < 1.3 * small + 1e6
    tracemalloc.start()  # one long pre-token
    sum(len(p) for p in codec().pieces("thereinthetionating" * 10_000))
    assert tracemalloc.get_traced_memory()[1] < 3e6
    tracemalloc.stop()


def own_codec(tmp_path, merges, letters):
    """A codec of a merge list over a few letters."""
    vocab = {c: k for k, c in enumerate(letters)}
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    path = tmp_path / f"{random.getrandbits(64)}.json"
    path.write_text(json.dumps({"model": {"type": "BPE", "vocab": vocab, "merges": [f"{a} {b}" for a, b in merges]}, "added_tokens": [], "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}}))
    return bpe.Codec(str(path))


def test_random_merge_lists_with_tokens_that_several_rules_make(tmp_path):
    rng, shared, refused = random.Random(5), 0, 0
    for _ in range(2000):
        tokens, merges = list("ab"), []
        for _ in range(rng.randrange(2, 8)):
            pair = rng.choice(tokens), rng.choice(tokens)
            if pair not in merges and len(pair[0] + pair[1]) < 9:
                merges.append(pair)
                tokens.append(pair[0] + pair[1])
        made = ["".join(m) for m in merges]
        shared += len(set(made)) < len(made)
        try:
            own = own_codec(tmp_path, merges, "ab")
        except ValueError:
            assert any(made[j] in merges[i] for j in range(len(made)) for i in range(j + 1))
            refused += 1
            continue
        own.window = own.lookahead + max(own.size.values())  # the tightest that always gives a token
        for _ in range(12):
            raw = bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 80)))
            whole = own._merge(raw)
            assert own._segment(raw) == whole
            n = rng.randrange(1, 9)
            got = np.frombuffer(b"".join(own.stream(raw[k : k + n] for k in range(0, len(raw), n))), "<u4").tolist()
            assert got == whole
    assert shared - refused > 50


def test_segments_equal_merging_by_rank():
    rng = random.Random(6)
    for k in range(3000):
        raw = bytes(rng.choice((b"therinagods", b" -=*", b"ab", bytes(range(256)))[k % 4]) for _ in range(rng.randrange(1, 60)))
        assert codec()._segment(raw) == codec()._merge(raw)


def test_lookahead_of_a_small_merge_list():
    # a+b, then b+c of lower priority: whether "ab" forms is known with its own last byte; b+c must wait for none
    assert bpe.sufficient_lookahead([(0, 1), (1, 2)], [3, 4], {0: 1, 1: 1, 2: 1, 3: 2, 4: 2}) == 2
    # b+c first: "ab" needs one byte more
    assert bpe.sufficient_lookahead([(1, 2), (0, 1)], [3, 4], {0: 1, 1: 1, 2: 1, 3: 2, 4: 2}) == 3


def test_other_settings_are_refused(tmp_path):
    spec = {"model": {"type": "BPE", "vocab": {"a": 0}, "merges": []}, "added_tokens": [], "pre_tokenizer": {"type": "Whitespace"}}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Codec(str(path))
