import random
import re

import duckdb
import pytest

from obsengine.llm import license_scan as ls

RNG = random.Random(13)
NOISE = ["the", "of", "Under", "license", "work", "version", "2", "0", "é", "rights", "x-y", "cc", "by", "und", "lorem", "This"]


def plain(text):
    """The contract's base columns, and every block against every template."""
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    starts = [(i, label) for label, phrase in ls.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in starts]
    base, labels, score = {label for _, label in starts}, {label for _, label in starts}, 0.0
    for label, template in ls.TEMPLATES:
        own = re.findall(r"[a-z0-9]+", template.lower())
        width = ls.width_of(len(own))
        for i in range(0, len(words), width // 2):
            part = len(set(own) & set(words[i : i + width])) / len(set(own))
            if part >= ls.THRESHOLD - 1e-9:
                labels.add(label)
                score = max(score, part)
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)


def noise(n):
    return " ".join(RNG.choices(NOISE, k=n))


def near(text):
    words = text.split()
    for _ in range(RNG.randint(0, 2 + len(words) // 8)):
        i = RNG.randrange(len(words))
        words[i : i + RNG.randint(0, 1)] = RNG.choices(NOISE, k=RNG.randint(0, 1))
    return " ".join(words or ["x"])


def rows():
    out = [(i, noise(RNG.randint(0, 60)) + "\n" + near(RNG.choice(ls.TEMPLATES)[1]).replace(" ", RNG.choice([" ", "\n", "--"])) + ".\n" + noise(RNG.randint(0, 60))) for i in range(150)]
    out += [(200, None), (None, None), (201, ""), (202, "\n \t--"), (None, "Licensed under CC BY-NC 4.0."), (203, "cc by nc cc by nc CC-BY-NC"), (204, "cc by by nc; ccby nc")]
    out += [(205, "Released under the MIT License.\nAll rights reserved."), (205, "Released under the MIT License.\nAll rights reserved."), (205, "nothing here")]
    return out + [(206, noise(50_000) + " under the mit license " + noise(9)), (207, "é" * 300_000), (208, "MIT LICENSE, the under released")]


ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 0) for r in ROWS], "doc_id long, text string, label string, row int").repartition(3).cache()


def test_against_all_blocks_and_templates(docs):
    got = sorted(map(tuple, ls.labelled(docs).collect()), key=repr)
    want = sorted(((i, *plain(t)) for i, t in ROWS), key=repr)
    assert got == want
    labels = [r[6] for r in want]
    assert sum(map(bool, labels)) > 60 and "" in labels and len({x for r in labels for x in r.split(",")}) >= 9


def test_defined_cases(spark, docs):
    assert ls.labelled(docs.limit(0)).count() == 0
    got = {r.doc_id: r for r in ls.labelled(docs).filter("doc_id IN (203, 204, 208)").collect()}
    assert (got[203].n_base, got[203].first_word, got[203].last_word, got[203].score) == (3, 0, 6, 1.0)
    assert got[204].base_labels == "" and got[208].labels == "mit" and got[208].base_labels == ""


def test_spans_of_matches(spark):
    docs = spark.createDataFrame([(1, "word " * 100 + ls.TEMPLATES[8][1] + " end" * 40)], "doc_id long, text string")
    texts, found = ls.licenses(docs)
    rows = found.filter("containment = 1").collect()
    assert {r.label for r in rows} == {"gpl"} and texts.count() == 1
    assert any(r.first_word <= 100 and r.first_word + r.width >= 100 + len(ls.words_of(ls.TEMPLATES[8][1])) for r in rows)


def test_the_order_of_words_changes_no_result(docs, monkeypatch):
    want = sorted(map(tuple, ls.labelled(docs).collect()), key=repr)
    monkeypatch.setattr(ls, "frequencies", lambda docs, vocabulary, text: docs.sparkSession.createDataFrame([(w.decode(), len(w) * 7 % 5) for w in vocabulary], "word string, n long"))
    assert sorted(map(tuple, ls.labelled(docs).collect()), key=repr) == want


def test_sql_agrees():
    db = duckdb.connect()
    small = [r for r in ROWS if len(r[1] or "") < 10_000]
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", small)
    got = db.execute(f"SELECT doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score FROM ({ls.ORACLE_SQL})").fetchall()
    assert sorted(got, key=repr) == sorted(((i, *plain(t)) for i, t in small), key=repr)
