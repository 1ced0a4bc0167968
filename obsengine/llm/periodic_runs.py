"""Runs of repeated words by Lyndon arrays, in the way of Ellert and Fischer: linear time over any ordered alphabet.

A run is a longest stretch of words with a smallest period q, at least twice as long as q. Every run has a Lyndon word
of its period's length as its root, under one of the two orders of the alphabet: there the next smaller suffix of
some word i of the run starts q words later. So the next smaller suffix of each word names a candidate period, and the run is
as far as the text goes on matching itself at that distance, to both sides.

Both come from one pass over the text for each order, with a stack of suffixes that have no smaller one yet. Two suffixes are
compared word by word only beyond what is already known to match: the pass keeps the match that reaches farthest, and inside
of it a pair of suffixes has the same extension as the pair that it is a copy of, which was compared before. So almost every
comparison that succeeds moves the farthest end on; the tests count no more than 1.5 for each word on periodic, Fibonacci,
Thue-Morse, ruler and random texts. There are no suffix arrays, no trees, and no hashes of words to stand for them: words are
numbered by a dictionary, by first appearance, and that is their order. To the left, a run's first root is less than a
period from the run's start, so it is extended by less than a period.

Spark deals out documents; one document is worked on in one task, with memory linear in its words.

Defined cases: a null or empty text has no words, no runs, and an empty collapsed text; repeated rows are worked on each; ties
for the longest run go to the smallest start, then the smallest period; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsengine.llm.common import crc32, map_rows

LEAST_LENGTH = 12
Run = tuple[int, int, int]


def extensions(letters: list[int], least: int = LEAST_LENGTH, count: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(i, j, k): j starts the next smaller suffix of i, they match for k letters, and i may be the first root of a run of `least` letters.

    A letter is a number from 0 on; the end of the text is smaller than all. count[0] grows by the letters compared in extensions.
    """
    n, s = len(letters), [*letters, -1]
    smaller = [-1] * n  # of each letter: the stack below it, its previous smaller suffix
    later, matched = [0] * n, [0] * n  # next smaller suffixes that share a letter at least, and how many
    before = [0] * n  # letters that a suffix shares with its previous smaller one
    out = []
    near, far, end, compared = 0, 0, 0, 0  # s[near:] and s[far:end] are the match that reaches farthest
    for j in range(1, n):
        c, i = s[j], j - 1
        while (a := s[i]) >= c:
            if a == c:
                k, known = 1, False
                if j < end:
                    shift = far - near
                    u, v = (i - shift if i >= far else i), j - shift
                    if later[u] == v:
                        k, known = matched[u], True
                    elif smaller[v] == u:
                        k, known = before[v], True
                    if known and k >= end - j:
                        k, known = end - j, False
                if not known:
                    x, y = i + k, j + k
                    while s[x] == s[y]:  # ends with the text: only s[n] is -1, and x < y
                        x += 1
                        y += 1
                    compared += y - j - k
                    k = y - j
                    if y > end:
                        near, far, end = i, j, y
                if s[i + k] < s[j + k]:
                    before[j] = k
                    break
                later[i], matched[i] = j, k
                period = j - i
                if k > max(0, least - 2 * period) and not (i >= period and later[i - period] == i and matched[i - period] >= period):
                    out.append((i, j, k))
            i = smaller[i]
        smaller[j] = i
    if count is not None:
        count[0] += compared
    return out


def runs(letters: list[int], least: int = LEAST_LENGTH) -> list[Run]:
    """(start, length, period) of every run of at least `least` letters, by start, then period."""
    found: set[Run] = set()
    top = max(letters, default=0)
    for order in (letters, [top - x for x in letters]):
        for i, j, k in extensions(order, least):
            period = j - i
            need = max(2 * period, least) - period - k
            if need > 0 and (need > i or letters[i - need] != letters[j - need]):
                continue
            back, most = 0, min(period - 1, i)
            while back < most and letters[i - back - 1] == letters[j - back - 1]:
                back += 1
            if back >= need:
                found.add((i - back, back + period + k, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[Run]) -> bytes:
    """The words that no run holds after its first period, joined by spaces."""
    kept, at = [], 0
    for a, b in sorted((start + period, start + length) for start, length, period in found):
        if a > at:
            kept += words[at:a]
        at = max(at, b)
    return b" ".join(kept + words[at:])


def numbered(words: list[bytes]) -> list[int]:
    number = {w: n for n, w in enumerate(dict.fromkeys(words))}
    return [number[w] for w in words]


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rewritten: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): every run of each text as (start, length, period), and the text without their repeats.

    Words are runs of anything but space and \\t to \\r. rewritten: from an id and the words of its text to those to look at.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))

    def run(part: dict[str, list]) -> dict[str, list]:
        out = {"doc_id": part["doc_id"], "n_words": [], "runs": [], "collapsed": []}
        for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
            words = (text or "").encode().split()
            if rewritten:
                words = rewritten(doc_id, words)
            found = runs(numbered(words))
            out["n_words"].append(len(words))
            out["runs"].append([{"start": a, "length": b, "period": c} for a, b, c in found])
            out["collapsed"].append(collapsed(words, found).decode())
        return out

    return map_rows(rows, run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string", 64)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document by crc32 of its id repeats a stretch of its words from some word on. Not those without an id."""
    if doc_id is None or not words:
        return words
    g, kind = divmod(crc32(str(doc_id).encode()), 10)
    if kind:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def digests(found: DataFrame) -> DataFrame:
    """The result of periodic_runs with its longest run in columns, and its runs and collapsed text as digests."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    first = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return found.withColumn("first", first).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("first.start")).alias("start"), F.col("first.length").alias("length"),
        (-F.col("first.period")).alias("period"), F.expr("1000 * first.length div -first.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
