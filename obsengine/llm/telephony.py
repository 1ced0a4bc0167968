"""Telephony audio as media columns: mu-law, A-law and IMA ADPCM in WAV bytes, decoded to PCM.

`store` puts 8-bit samples into WAV bytes without loss; `decode` reads them back, expands mu-law and
A-law by lookup tables and decodes ADPCM with numpy across all blocks of a slice of rows (each block
starts from its own header, so step k is taken for every block at once); `resampled` stores 16-bit PCM
at another rate. All arithmetic is on integers, so equal inputs give equal outputs on any machine.

Defined cases: null audio is empty audio; `payload_digests` appends zero bytes up to a positive multiple of
the block size, so that an empty or null text is one block of zeros; block headers whose step index is out of
range are clamped to the last step; a stored value that isn't a WAV of these kinds is an error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsengine.llm.common import map_rows, staging_path

PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17  # WAVE format tags
RATE = 8000
BLOCK = 64  # bytes of an ADPCM block: a 4-byte header that holds the first sample, then two samples a byte
HEADER = 44
SLICE_ROWS = 64

#: IMA ADPCM's step sizes and the step index's change by a code's magnitude. Fixed values.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
     118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
     1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
     6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
     32767], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mulaw_table() -> np.ndarray:
    """G.711 mu-law: inverted bits; sign, three bits of exponent, four of mantissa, with a bias of 132."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law: every other bit inverted; the lowest two exponents share one step."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, ((code & 15) << 4) + 8
    size = np.where(exponent > 0, (mantissa + 256) << np.maximum(exponent - 1, 0), mantissa)
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(n, bytes of a block) uint8 to (n, samples of a block) int16; the loop is over the samples of one block."""
    n, width = blocks.shape
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    out[0] = value
    for k in range(2 * (width - 4)):
        code = (blocks[:, 4 + k // 2] >> (4 * (k % 2))).astype(np.int32)
        size, step = code & 7, STEPS[index]
        change = (step >> 3) + (step & -(size & 1)) // 4 + (step & -((size >> 1) & 1)) // 2 + (step & -(size >> 2))
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + MOVES[size], 0, len(STEPS) - 1)
        out[k + 1] = value
    return np.ascontiguousarray(out.T)


def store(payload: bytes, kind: int = MULAW, rate: int = RATE) -> bytes:
    """WAV bytes that hold the payload as it is: 8-bit samples, ADPCM blocks, or 16-bit PCM."""
    align, bits = {PCM: (2, 16), ADPCM: (BLOCK, 4)}.get(kind, (1, 8))
    per_second = rate * BLOCK // (1 + 2 * (BLOCK - 4)) if kind == ADPCM else rate * align
    head = struct.pack("<4sI4s4sIHHIIHH", b"RIFF", HEADER - 8 + len(payload), b"WAVE", b"fmt ", 16, kind, 1, rate, per_second, align, bits)
    return head + struct.pack("<4sI", b"data", len(payload)) + payload


def load(media: bytes) -> tuple[int, int, bytes]:
    """Kind, rate and payload of WAV bytes, whatever other chunks there are."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV")
    kind = rate = None
    at = 12
    while at + 8 <= len(media):
        name, length = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data" and kind in (PCM, *TABLES, ADPCM):
            return kind, rate, media[at + 8 : at + 8 + length]
        at += 8 + length + length % 2
    raise ValueError(f"no data of a known kind: {kind}")


def expand(kind: int, payload: bytes) -> np.ndarray:
    """16-bit samples of a payload."""
    if kind == PCM:
        return np.frombuffer(payload, "<i2")
    raw = np.frombuffer(payload, np.uint8)
    return decode_adpcm(raw.reshape(-1, BLOCK)).ravel() if kind == ADPCM else TABLES[kind][raw]


def resample(samples: np.ndarray, rate: int, to_rate: int) -> np.ndarray:
    """Cubic interpolation at the new rate's instants, in 14-bit fixed point; the ends repeat."""
    up, down = to_rate // np.gcd(rate, to_rate), rate // np.gcd(rate, to_rate)
    if not len(samples) or up == down:
        return samples.astype(np.int16)
    at = np.arange(len(samples) * up // down, dtype=np.int64) * down
    x = np.arange(up) / up
    taps = np.stack([-x * (x - 1) * (x - 2) / 6, (x + 1) * (x - 1) * (x - 2) / 2, -(x + 1) * x * (x - 2) / 2, (x + 1) * x * (x - 1) / 6])
    taps = np.rint(taps * (1 << 14)).astype(np.int32)
    padded = np.pad(samples.astype(np.int32), (1, 2), "edge")
    base, phase = at // up, at % up
    total = sum(taps[k][phase] * padded[base + k] for k in range(4))
    return np.clip((total + (1 << 13)) >> 14, -32768, 32767).astype(np.int16)


def stored(rows: DataFrame, payload_column: str, kind: int = MULAW) -> DataFrame:
    """rows (id, payload) as (id, media)."""
    name = rows.columns[0]

    def run(part: dict[str, list]) -> dict[str, list]:
        return {name: part[name], "media": [store(p or b"", kind) for p in part[payload_column]]}

    return map_rows(rows, run, f"{name} {rows.schema[name].dataType.simpleString()}, media binary", SLICE_ROWS)


def resampled(media: DataFrame, id_column: str, media_column: str = "media", to_rate: int = 16000) -> DataFrame:
    """(id, pcm): WAV bytes of 16-bit PCM at to_rate. Null media give an empty WAV."""
    rows = media.select(id_column, F.col(media_column).alias("media"))

    def run(part: dict[str, list]) -> dict[str, list]:
        out = []
        for m in part["media"]:
            kind, rate, payload = load(m) if m else (PCM, to_rate, b"")
            out.append(store(resample(expand(kind, payload), rate, to_rate).tobytes(), PCM, to_rate))
        return {id_column: part[id_column], "pcm": out}

    return map_rows(rows, run, f"{id_column} {rows.schema[id_column].dataType.simpleString()}, pcm binary", SLICE_ROWS)


def _levels(samples: np.ndarray, starts: np.ndarray) -> list[str]:
    """Peak, energy and sign changes of each part of the samples that begins at one of starts."""
    wide = samples.astype(np.int64)
    turned = np.concatenate([[0], (samples[1:] < 0) != (samples[:-1] < 0)]).astype(np.int64)
    turned[starts] = 0
    peak, energy = np.maximum.reduceat(abs(wide), starts), np.add.reduceat(wide * wide, starts)
    return [f"{p}/{e}/{t}" for p, e, t in zip(peak, energy, np.add.reduceat(turned, starts), strict=True)]


def features(payloads: list[bytes], rate: int = RATE, to_rate: int = 16000) -> list[str]:
    """For each non-empty payload of whole blocks: its levels by each codec, and its length and crc as resampled PCM."""
    sizes = np.array([len(p) for p in payloads])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    mulaw = TABLES[MULAW][raw]
    adpcm = decode_adpcm(raw.reshape(-1, BLOCK)).ravel()
    columns = [_levels(mulaw, starts), _levels(TABLES[ALAW][raw], starts), _levels(adpcm, starts // BLOCK * (2 * BLOCK - 7))]
    pcm = [resample(mulaw[s : s + n], rate, to_rate) for s, n in zip(starts, sizes, strict=True)]
    return [
        f"mulaw={m};alaw={a};adpcm={d};pcm={len(p)}/{zlib.crc32(p.tobytes())}" for m, a, d, p in zip(*columns, pcm, strict=True)
    ]


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + bytes(-len(data) % BLOCK if data else BLOCK)


def payload_digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Texts' bytes through the whole chain: stored as a written table of mu-law WAVs, read back, decoded, digested."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))

    def put(part: dict[str, list]) -> dict[str, list]:
        sized = [padded(t) for t in part["text"]]
        return {"doc_id": part["doc_id"], "n_bytes": [n for n, _ in sized], "media": [store(p) for _, p in sized]}

    def get(part: dict[str, list]) -> dict[str, list]:
        payloads = [load(m)[2] for m in part["media"]]
        return {
            "doc_id": part["doc_id"],
            "n_bytes": part["n_bytes"],
            "payload_bytes": [len(p) for p in payloads],
            "payload_sha256": [hashlib.sha256(p).hexdigest() for p in payloads],
            "tail_crc32": [zlib.crc32(p[-BLOCK:]) for p in payloads],
            "media_bytes": [len(m) for m in part["media"]],
            "media_sha256": [hashlib.sha256(m).hexdigest() for m in part["media"]],
            "feature": features(payloads),
        }

    path = staging_path(spark, "media")
    schema = "doc_id long, n_bytes long, media binary"
    map_rows(rows, put, schema, SLICE_ROWS).write.option("compression", "zstd").parquet(path)
    return map_rows(
        spark.read.schema(schema).parquet(path),
        get,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,"
        " media_sha256 string, feature string",
        SLICE_ROWS,
    )
