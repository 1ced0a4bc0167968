import hashlib
import zlib

import numpy as np
import pytest

from obsengine.llm import telephony as t


def adpcm_one(block):
    """One IMA ADPCM block, sample by sample, as the format's description has it."""
    value = int.from_bytes(block[:2], "little", signed=True)
    index = min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(t.STEPS[index])
            change = step >> 3
            if code & 4:
                change += step
            if code & 2:
                change += step >> 1
            if code & 1:
                change += step >> 2
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(t.MOVES[code & 7])))
            out.append(value)
    return out


def test_adpcm_matches_a_sample_by_sample_decoder():
    blocks = np.random.default_rng(1).integers(0, 256, (40, t.BLOCK), dtype=np.uint8)
    assert t.decode_adpcm(blocks).tolist() == [adpcm_one(bytes(b)) for b in blocks]


def test_tables_have_the_known_values():
    mulaw, alaw = t.TABLES[t.MULAW].astype(int), t.TABLES[t.ALAW].astype(int)
    assert (mulaw[0x00], mulaw[0x80], mulaw[0xFF], mulaw[0x7F]) == (-32124, 32124, 0, 0)
    assert (alaw[0xD5], alaw[0x55], alaw[0xAA], alaw[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(alaw)) == 256 and sorted(set(-alaw)) == sorted(set(alaw))


@pytest.mark.parametrize("kind", [t.PCM, t.ALAW, t.MULAW, t.ADPCM])
def test_wav_round_trip(kind):
    payload = bytes(range(256))
    assert t.load(t.store(payload, kind, 8000)) == (kind, 8000, payload)
    assert t.load(t.store(b"", kind))[2] == b""
    with pytest.raises(ValueError):
        t.load(b"nothing")


def test_resampling_keeps_samples_and_lines():
    x = np.arange(-1000, 1000, 10).astype(np.int16)
    y = t.resample(x, 8000, 16000)
    assert len(y) == 2 * len(x) and (y[::2] == x).all() and (abs(y[3:-3:2] - (x[1:-2] + 5)) <= 1).all()
    assert t.resample(x[:0], 8000, 16000).tolist() == []
    assert len(t.resample(x, 8000, 11025)) == len(x) * 441 // 320


def test_features_do_not_depend_on_neighbours():
    payloads = [t.padded(s)[1] for s in ("", "abc" * 100, "é" * 900, None)]
    assert t.features(payloads) == [f for p in payloads for f in t.features([p])]


def test_payload_digests(spark):
    rows = [(1, "héllo", "x"), (2, None, "y"), (3, "", None), (3, "", None), (None, "a" * 3_000_000, "z"), (5, "b" * 64, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = sorted(map(tuple, t.payload_digests(docs).collect()), key=repr)
    want = []
    for i, text, _ in rows:
        n, p = t.padded(text)
        m = t.store(p)
        want.append((i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), t.features([p])[0]))
    assert got == sorted(want, key=repr)
    assert all(len(x) % 64 == 0 and len(x) for _, x in map(t.padded, (None, "", "a" * 64)))
    assert t.payload_digests(docs.limit(0)).count() == 0


def test_resampled_column(spark):
    media = t.stored(spark.createDataFrame([(1, b"\xff" * 64), (2, None)], "id int, p binary"), "p")
    got = dict(t.resampled(media, "id").collect())
    assert t.load(bytes(got[1])) == (t.PCM, 16000, bytes(256)) and t.load(bytes(got[2]))[2] == b""
