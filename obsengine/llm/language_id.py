"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) those of its letters, each
permuted (rotated) by its place; a text's vector bundles (adds) those of its trigrams; a language's prototype
bundles its training texts. A text has the language whose prototype is closest by cosine, and its score is that
language's share of a softmax over the cosines.

Text vectors of a slice of rows are products of matrices, trigram counts times trigram vectors, over the
trigrams that the slice has, a block of them at a time. All entries are whole numbers, so results don't depend on how rows are dealt out.

Defined cases: text that is null or has no letter is `und` with score 0, as is every text if nothing was
learned; null languages are not learned from; equal cosines go to the first language in order; repeated rows
count each; an empty table gives an empty result; languages are at most LANGUAGES (their prototypes are
broadcast), else an error.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsengine.llm.common import crc_mod, filter_rows, give_back, map_rows, require_small

DIMENSIONS, SEED = 1024, 20240607
BUCKETS = 512  # letters up to U+017F have their own, the others share the rest; 0 is whatever is no letter
OWN = 0x180
SHARPNESS = 20.0
PART, BLOCK = 1 << 20, 1 << 10  # letters and different trigrams at a time: a block's vectors take 4 MB, and some are made at once
LANGUAGES = 1000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    points = np.arange(0x110000)
    codes = np.where(points < OWN, points, OWN + (points * 2654435761 >> 7) % (BUCKETS - OWN)).astype(np.int16)
    codes[[not chr(p).isalpha() for p in range(0x110000)]] = 0
    return codes


@lru_cache(maxsize=1)
def letter_vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters' vectors at the first, second and third place of a trigram."""
    at_last = np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), (BUCKETS, DIMENSIONS))
    return np.roll(at_last, 2, axis=1), np.roll(at_last, 1, axis=1), at_last


def bundles(texts: list[str], groups: list[int], n_groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(n_groups, DIMENSIONS) bundles of the trigrams of each group's texts, and how many trigrams each has.

    A trigram is three letters in a row or two at a word's start or end. Letters are taken in parts, and trigrams' vectors
    made in blocks, so that memory does not grow with the number of different trigrams.
    """
    lowered = [f" {t.lower()} " for t in texts]
    codes = letter_codes()[np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), "<u4")]
    sizes = [len(t) for t in lowered]
    text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    kept = (codes > 0) | np.concatenate([[True], (codes[:-1] > 0) | (text[1:] != text[:-1])])
    codes, text = codes[kept], text[kept]
    group_of = np.array(groups, np.int64)
    used = np.flatnonzero(np.bincount(codes, minlength=BUCKETS))
    small = np.zeros(BUCKETS, np.int64)
    small[used] = np.arange(len(used))
    out, many = np.zeros((n_groups, DIMENSIONS)), np.zeros(n_groups, np.int64)
    for first in range(0, max(0, len(codes) - 2), PART):
        c, owner = small[codes[first : first + PART + 2]], text[first : first + PART + 2]
        real = (codes[first + 1 : first + len(c) - 1] > 0) & (owner[:-2] == owner[2:])
        keys = ((c[:-2] * len(used) + c[1:-1]) * len(used) + c[2:])[real]
        _bundle(keys, group_of[owner[1:-1][real]], used, out, many)
    return out, many


def _bundle(keys: np.ndarray, group: np.ndarray, used: np.ndarray, out: np.ndarray, many: np.ndarray) -> None:
    """Adds the trigrams `keys` of the groups to their bundles, a block of different trigrams at a time."""
    n = max(1, len(used))
    if len(used) <= 96:  # few enough for a table by key, which is faster than sorting
        there = np.flatnonzero(np.bincount(keys, minlength=1))
        place = np.zeros(n**3 + 1, np.int32)
        place[there] = np.arange(len(there))
        at = place[keys]
    else:
        there, at = np.unique(keys, return_inverse=True)
    first, second, third = letter_vectors()
    for begin in range(0, len(there), BLOCK):
        block = there[begin : begin + BLOCK]
        mine = (at >= begin) & (at < begin + BLOCK) if len(there) > BLOCK else slice(None)
        counts = np.bincount(group[mine] * len(block) + at[mine] - begin, minlength=len(out) * len(block)).reshape(len(out), -1)
        vectors = first[used[block // (n * n)]] * second[used[block // n % n]] * third[used[block % n]]
        out += counts.astype(np.float32) @ vectors
        many += counts.sum(1)


def learn(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes by language: sums over each task's texts, then over tasks."""
    rows = docs.select(F.col(text_column).alias("text"), F.col(lang_column).alias("lang")).dropna()

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                langs = part.column(1).to_pylist()
                names = sorted(set(langs))
                sums, _ = bundles(part.column(0).to_pylist(), [names.index(x) for x in langs], len(names))
                for name, total in zip(names, sums):
                    totals[name] = totals.get(name, 0) + total.astype(np.int64)
        for name, total in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * DIMENSIONS), pa.array(range(DIMENSIONS), pa.int32()), pa.array(total)], ["lang", "at", "value"]
            )
        give_back()

    sums = rows.mapInArrow(run, "lang string, at int, value long").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    by_lang = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("values"))
    found = by_lang.limit(LANGUAGES + 1).collect()
    require_small(len(found), LANGUAGES, "languages")
    return {r.lang: np.array([v.value for v in r["values"]], np.float64) for r in sorted(found, key=lambda r: r.lang)}


def units_of(prototypes: dict[str, np.ndarray]) -> np.ndarray:
    return np.array([v / max(1e-12, np.linalg.norm(v)) for v in prototypes.values()])


def compare(texts: list[str | None], names: list[str], prototypes: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Each text's language and score; prototypes are rows of length one."""
    if not names:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    found, many = bundles([t or "" for t in texts], list(range(len(texts))), len(texts))
    size = np.sqrt((found * found).sum(1, keepdims=True))
    cosines = np.round(found @ prototypes.T / np.maximum(size, 1e-12), 9)
    odds = np.exp(SHARPNESS * (cosines - cosines.max(1, keepdims=True)))
    best, known = cosines.argmax(1), many > 0
    score = np.where(known, np.round(odds[np.arange(len(texts)), best] / odds.sum(1), 6), 0.0)
    return [names[b] if k else UNKNOWN for b, k in zip(best, known)], score


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """The columns `keep`, lang_pred and score. A narrow map."""
    names, units = list(prototypes), units_of(prototypes)
    rows = docs.select(*keep, F.col(text_column).alias("_text"))

    def run(part: dict[str, list]) -> dict[str, list]:
        langs, scores = compare(part["_text"], names, units)
        return {k: part[k] for k in keep} | {"lang_pred": langs, "score": scores}

    kept = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return map_rows(rows, run, f"{kept}, lang_pred string, score double", 64)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the documents that aren't held out."""
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", (crc_mod("doc_id", 3) == 1).alias("held_out"))
    return predict(held, learn(held.filter("NOT held_out")), ("doc_id", "held_out"))


def accepted(docs: DataFrame) -> DataFrame:
    """docs, all columns, without those of no language."""
    known = learn(docs.filter(crc_mod("doc_id", 3) != 1))
    names, units = list(known), units_of(known)
    return filter_rows(docs, "text", lambda texts: [x != UNKNOWN for x in compare(texts, names, units)[0]])
