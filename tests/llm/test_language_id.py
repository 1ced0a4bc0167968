import random
import tracemalloc
import zlib

import numpy as np

from obsengine.llm import language_id as li


def one_by_one(text):
    """A text's vector from the definition: trigrams in Python, bound and bundled one at a time."""
    first, second, third = li.letter_vectors()
    codes = [int(li.letter_codes()[ord(c)]) for c in f" {text.lower()} "]
    codes = [c for i, c in enumerate(codes) if c or not i or codes[i - 1]]
    total = np.zeros(li.DIMENSIONS)
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        if b:
            total += first[a] * second[b] * third[c]
    return total


TEXTS = ["", "a", "  12 !!", "Straße und  Öl", "日本語 текст mixed", "x" * 50, "a-b c", "".join(map(chr, range(0x400, 0x500)))]


def test_bundles_match_the_definition():
    found, many = li.bundles(TEXTS, list(range(len(TEXTS))), len(TEXTS))
    assert (found == np.array([one_by_one(t) for t in TEXTS])).all()
    assert (many > 0).tolist() == [any(c.isalpha() for c in t) for t in TEXTS]
    wide = ["".join(map(chr, range(0x100, 0x250)))]
    assert (li.bundles(wide, [0], 1)[0][0] == one_by_one(wide[0])).all()


def test_parts_and_blocks_change_nothing(monkeypatch):
    texts = [*TEXTS, "".join(random.Random(3).choices("abcdefghijklmnop ", k=3000))]
    whole = li.bundles(texts, list(range(len(texts))), len(texts))
    monkeypatch.setattr(li, "PART", 100)
    monkeypatch.setattr(li, "BLOCK", 7)
    parts = li.bundles(texts, list(range(len(texts))), len(texts))
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_a_long_text_of_many_trigrams_takes_bounded_memory():
    text = "".join(map(chr, np.random.default_rng(5).integers(0x4E00, 0x9FA0, 2_700_000).tolist()))  # 8 MB
    li.bundles(["a"], [0], 1)
    tracemalloc.start()
    _, many = li.bundles([text], [0], 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert many[0] == len(text) and peak < 1 << 29


def test_a_slice_of_many_trigrams_takes_little_memory():
    rng = random.Random(6)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1000)) for _ in range(64)]
    li.bundles(["a"], [0], 1)
    tracemalloc.start()
    li.bundles(texts, list(range(64)), 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32e6


def corpus(n):
    rng = random.Random(8)
    parts = {"x": ["tha", "ing", "er", "on"], "y": ["sch", "ung", "en", "ver"], "z": ["ção", "que", "os", "ar"]}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(parts))
        words = ["".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 60))]
        rows.append((i, " ".join(words), lang if i % 7 else None, "k"))
    return rows


def test_identify_on_held_out_texts(spark):
    rows = corpus(600)
    odd = [(1000, None, "x", "k"), (1001, "", None, "k"), (1002, "12 34 !?", "y", "k"), (None, "thaing eron", None, "k"), (5, rows[5][1], None, "k")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, lang_pred string")
    got = li.identify(docs).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: t for i, _, t, _ in rows}
    held = [r for r in got if r.held_out and truth.get(r.doc_id)]
    assert len(held) > 100 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in by.items() if i is not None)
    assert {by[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert by[None].lang_pred == "x"
    again = {(r.doc_id, r.lang_pred, r.score) for r in li.identify(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.lang_pred, r.score) for r in got}
    kept = li.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == len(got) - 3


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert li.identify(empty).count() == 0
    got = li.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first()
    assert (got.lang_pred, got.score) == ("und", 0.0)
