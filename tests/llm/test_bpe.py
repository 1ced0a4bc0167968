import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from obsengine.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
PARTS = ["a", "the", "in", "er", " ", "  ", "\n", "'", "'s", "'ll", "1", "23", ",", "!!", "é", "語", "<|endoftext|>", "<|", "　"]
LONG = {
    "letters": "ab" * 60_000,
    "white space": " " * 70_000 + "x",
    "tabs": "\t" * 70_000,
    "kinds": "1" * 50_000 + "a" * 50_000 + "," * 50_000 + "'s",
    "special inside": " " * 20_000 + "<|endoftext|>" + " " * 20_000,
    "wide": "é" * 50_000 + "　" * 40_000 + "語" * 40_000,
    "quotes": ("'" * 3 + "ll") * 12_000,
    "noise": "".join(random.Random(1).choices("etaoinshrdlu", k=60_000)),
}


def ids(text):
    return np.frombuffer(bpe.encode(text, bpe.merges(PATH)), "<u4").tolist()


@pytest.mark.parametrize("name", LONG)
def test_long_texts_in_slices(name):
    assert ids(LONG[name]) == PLAIN.encode(LONG[name], add_special_tokens=False).ids


def test_short_texts_and_their_decoding():
    rng = random.Random(4)
    for text in ["", None, *("".join(rng.choices(PARTS, k=rng.randint(1, 200))) for _ in range(200))]:
        want = PLAIN.encode(text or "", add_special_tokens=False).ids
        assert ids(text) == want
        assert "".join(bpe.decode_slices(bpe.encode(text, bpe.merges(PATH)), bpe.merges(PATH))) == (text or "")


def test_any_slicing_gives_the_same_ids():
    rng, codec = random.Random(5), bpe.merges(PATH)
    text = "".join(rng.choices(PARTS, k=30_000)) + "q" * 40_000
    for _ in range(3):
        cuts = sorted([0, len(text), *rng.sample(range(len(text)), 40)])
        found = b"".join(bpe.encode_slices((text[a:b] for a, b in zip(cuts, cuts[1:])), codec))
        assert np.frombuffer(found, "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_a_word_holds_a_bounded_window_and_what_it_emits_stays():
    codec, rng = bpe.merges(PATH), random.Random(6)
    for _ in range(20):
        word = "".join(rng.choices("thineraosd", k=4 * codec.lookahead + 300)).encode()
        whole = codec.merge_long(word)
        run = bpe.OpenWord(codec)
        early = np.frombuffer(run.feed(word), "<u4").tolist()
        assert early and early == whole[: len(early)] and len(run.data) < 8 * codec.lookahead + 512


def test_ill_formed_bytes_decode_as_the_library_does():
    rng, codec = random.Random(7), bpe.merges(PATH)
    for _ in range(200):
        some = [rng.randint(0, 50256) for _ in range(40)]
        packed = np.array(some, "<u4").tobytes()
        assert "".join(bpe.decode_slices(packed, codec)) == PLAIN.decode(some, skip_special_tokens=False)


def test_tables(spark):
    rows = [(1, "it's <|endoftext|> é", 0), (2, None, 1), (None, "", 2), (1, "x" * 500_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(map(tuple, bpe.round_trip_digests(docs, PATH).collect()), key=repr)
    want = []
    for i, t, _ in rows:
        found = np.array(PLAIN.encode(t or "", add_special_tokens=False).ids, "<u4")
        want.append((i, len(found), hashlib.sha256(found.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    back = bpe.decode_table(bpe.encode_table(docs, PATH), PATH)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted([(i, t or "") for i, t, _ in rows], key=repr)
    assert bpe.round_trip_digests(docs.limit(0), PATH).count() == 0
