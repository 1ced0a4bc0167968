import random

import duckdb
import pytest

from obsengine.llm import quality_rules as qr

RNG = random.Random(4)


def plain(text):
    """The contract's measures, one by one."""
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.encode().split()]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in again for k in range(3)}
    return (
        len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
        len(lines), sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text),
    )


def some(n):
    return " ".join(RNG.choices(["a", "The", "é1", "x#y", "ÄÖ", "|", "word\u00a0joined", "\u2003"], k=n))


ROWS = [(1, None), (2, ""), (3, " \n\t\v\f\r"), (4, "one two"), (5, some(60)), (6, "a b c\n" * 30), (7, some(200) + "\n" + some(9)), (7, "x" * 70), (7, "x" * 70)]
ROWS += [(None, "SHOUTING WORDS ALL OVER " * 20), (8, "\n".join(f"line {i % 3} of {i}" for i in range(60))), (9, "a" * 300_000), (10, "y z " * 100_000 + "end")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, failures string, n_words int")


@pytest.fixture(scope="module")
def entries(spark):
    return qr.ledger(frame(spark, ROWS)).cache()


def test_measures(spark, entries):
    got = sorted((tuple(r)[:9] for r in entries.collect()), key=repr)
    small = [r for r in ROWS if len(r[1] or "") < 100_000]
    want = sorted(((i, *plain(t)) for i, t in small), key=repr)
    assert [r for r in got if r[0] not in (9, 10)] == want
    by = {r.doc_id: r for r in entries.collect()}
    assert by[9].n_words == 1 and by[9].word_chars == 300_000 and by[10].n_words == 200_001 and by[10].n_repeat_words == 200_000
    assert qr.ledger(frame(spark, ROWS).limit(0)).count() == 0


def test_policies_and_bits(entries):
    for r in qr.apply_policy(entries, "v2").collect():
        fails = {
            "few_words": r.n_words < 50, "repeated_words": 100 * r.n_repeat_words > 50 * r.n_words,
            "word_length": not 2 * r.n_words <= r.word_chars <= 15 * r.n_words, "symbols": 10 * r.n_symbols > r.n_words,
            "duplicate_lines": 100 * r.n_dup_lines > 50 * r.n_lines, "shouting": r.n_upper > r.n_lower,
        }
        assert {name for name in qr.RULES if r.failures & qr.mask((name,))} == {k for k, v in fails.items() if v}
        assert r.base_failed == (fails["few_words"] or fails["repeated_words"]) and r.kept == (not any(fails.values()))
    assert qr.mask(("few_words", "symbols")) == 9
    kept = {v: qr.apply_policy(entries, v).filter("kept").count() for v in qr.POLICIES}
    assert kept["v1"] >= kept["v2"]


def test_ablations_are_policies_without_a_rule(entries):
    policy = qr.POLICIES["v2"]
    rows = [{x for x in policy if r.failures & qr.mask((x,))} for r in entries.collect()]
    got = {r.rule: tuple(r)[1:] for r in qr.ablations(entries, "v2").collect()}
    assert got == {x: (sum(x in r for r in rows), sum(r == {x} for r in rows), sum(not r for r in rows), sum(not r - {x} for r in rows)) for x in policy}
    assert qr.ablations(entries.limit(0), "v2").count() == 0


def test_sql_agrees(spark, entries):
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", [r for r in ROWS if len(r[1] or "") < 100_000])
    names = ["doc_id", *qr.MEASURES, "failures", "base_failed", "kept"]
    want = sorted(db.execute(f"SELECT {', '.join(names)} FROM ({qr.ORACLE_SQL})").fetchall(), key=repr)
    small = qr.apply_policy(entries, "v2").filter("coalesce(doc_id, 0) NOT IN (9, 10)").select(*names)
    assert sorted(map(tuple, small.collect()), key=repr) == want
    ablated = sorted(db.execute(f"SELECT rule, n_failed, n_only, n_kept, n_kept_without FROM ({qr.ABLATIONS_SQL})").fetchall())
    got = qr.ablations(entries.filter("coalesce(doc_id, 0) NOT IN (9, 10)"), "v2").select("rule", "n_failed", "n_only", "n_kept", "n_kept_without")
    assert sorted(map(tuple, got.collect())) == ablated
