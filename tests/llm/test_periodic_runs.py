import hashlib
import random
import zlib

import pytest

from obsengine.llm import periodic_runs as pr

RNG = random.Random(12)


def plain(s, least):
    """Every run, by trying all periods."""
    n, out = len(s), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            if j - i + q >= max(2 * q, least) and not any(s[i : j + q - d] == s[i + d : j + q] for d in range(1, q)):
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def with_repeat(s):
    a = RNG.randrange(len(s))
    p = 1 + (len(s) - a) // RNG.randint(3, 10)
    return s[:a] + [s[a + i % p] for i in range(len(s) - a)]


@pytest.mark.parametrize("least", [2, 5, 12])
def test_all_runs_of_random_texts(least):
    for _ in range(400):
        s = [RNG.randrange(RNG.choice([1, 2, 2, 3, 9])) for _ in range(RNG.randint(1, 60))]
        s = with_repeat(s) if RNG.random() < 0.6 else s
        assert pr.runs(s, least) == plain(s, least), s


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def texts(n):
    yield [0] * n
    yield [0, 1] * (n // 2)
    yield fibonacci(n)
    yield fibonacci(n)[::-1]
    yield [i.bit_count() & 1 for i in range(n)]
    yield [(i & -i).bit_length() for i in range(1, n)]
    yield [(i & -i).bit_length() & 1 for i in range(1, n)]
    yield ([0] * 50 + [1]) * (n // 51)
    up = [x for k in range(1, int((2 * n) ** 0.5)) for x in [0] * k + [1]]
    yield up
    yield up + up[::-1]
    yield [RNG.randrange(2) for _ in range(n)]
    yield with_repeat([RNG.randrange(2) for _ in range(n)])
    yield with_repeat([RNG.randrange(999) for _ in range(n)])


def test_comparisons_are_linear():
    for s in texts(20_000):
        top = max(s)
        for order in (s, [top - x for x in s]):
            count = [0]
            pr.extensions(order, 2, count)
            assert count[0] <= 1.5 * len(s)


def test_runs_of_known_texts():
    for s in texts(120):
        assert pr.runs(s, 2) == plain(s, 2)
    assert pr.runs([0] * 12) == [(0, 12, 1)] and pr.runs([0] * 11) == [] == pr.runs([])


def rows():
    some = lambda n: " ".join(RNG.choices(["a", "b", "é", "x y", "the"], k=n))
    out = [(i, some(RNG.randint(0, 90)) + "\n\t " * (i % 2)) for i in range(60)]
    out += [(None, "a b " * 20), (None, None), (60, None), (61, ""), (62, " \n"), (63, "a " * 30), (63, "a " * 30), (63, "b c " * 9)]
    return out + [(64, "w " * 40 + "x"), (65, " ".join(map(str, range(300)))), (66, "p q r " * 60_000)]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain(words, 12) if n < 1000 else [(0, n, 3)]
    gone = {i for a, b, q in found for i in range(a + q, a + b)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda data: hashlib.sha256(data).hexdigest()
    shown = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *shown, sha("".join(f"{a},{b},{q}\n" for a, b, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)), n)


def test_query_against_brute_force(spark):
    given = rows()
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in given) >= 3
    docs = spark.createDataFrame([(*r, "x", 1) for r in given], "doc_id long, text string, runs string, start int")
    out = pr.digests(pr.periodic_runs(docs, rewritten=pr.planted))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted((expected(*r) for r in given), key=repr)
    kinds = dict(out.dtypes)
    assert all(kinds[c] == "bigint" for c in ("n_runs", "start", "length", "period", "exponent_milli"))
    assert pr.digests(pr.periodic_runs(docs.limit(0))).count() == 0


def test_texts_without_their_repeats(spark):
    docs = spark.createDataFrame([(1, "go on " + "again and " * 9 + "stop"), (2, "no repeats")], "doc_id long, text string")
    got = {r.doc_id: (r.collapsed, [tuple(x) for x in r.runs]) for r in pr.periodic_runs(docs).collect()}
    assert got == {1: ("go on again and stop", [(2, 18, 2)]), 2: ("no repeats", [])}
