import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from obsengine.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def best_fit_decreasing(counts):
    rooms, n = [], 0
    for length in range(len(counts) - 1, 0, -1):
        for _ in range(counts[length]):
            fits = [r for r in rooms if r >= length]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - length)
            else:
                n += 1
                rooms.append(len(counts) - 1 - length)
    return n


HISTOGRAMS = {
    "spread": lambda r: r.integers(1, 65, 3000),
    "middle": lambda r: r.integers(20, 45, 2000),
    "thirds": lambda r: r.integers(20, 23, 900),
    "one": lambda r: np.array([64]),
    "full": lambda r: np.full(500, 64),
    "tiny": lambda r: np.full(500, 1),
    "none": lambda r: np.array([], int),
}


@pytest.mark.parametrize("name", HISTOGRAMS)
def test_configurations_hold_every_piece_once(name):
    counts = np.bincount(HISTOGRAMS[name](np.random.default_rng(2)), minlength=65)
    found = packing.configurations(counts)
    held = np.zeros(65, int)
    for pattern, times in found:
        assert times > 0 and sum(x * k for x, k in pattern) <= 64
        for x, k in pattern:
            held[x] += k * times
    assert (held == counts).all()
    assert sum(n for _, n in found) <= 1.003 * best_fit_decreasing(counts) + 1


def test_packed(spark):
    rng = np.random.default_rng(3)
    words = ["the", " of", "Éa", "\n", "  ", "<|endoftext|>", "x1", "ß!!"]
    texts = ["", None, "a", "b" * 90_000, " " * 40_000 + "c", "same text", "same text"]
    texts += ["".join(rng.choice(words, rng.integers(1, 900))) for _ in range(120)]
    rows = [(i if i != 4 else None, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(5)
    got = packing.packed(docs, PATH, capacity=128).collect()
    plain = Tokenizer.from_file(PATH)
    want = []
    for i, t, _ in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 128 or 128, len(ids), 128), len(ids)] if len(ids) > 128 else [0, len(ids)]
        want += [(i, n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r[:5]) for r in got), key=repr) == sorted(want, key=repr)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 128
    assert len(held) <= 1.02 * sum(r.length for r in got) / 128 + 1
    assert packing.packed(docs.limit(0), PATH).count() == 0
