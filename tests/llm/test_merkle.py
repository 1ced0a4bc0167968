import hashlib
import zlib

import duckdb
import pytest

from obsengine.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree long, digest string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    doc_id, text, lang, source, n_chars = row
    text = text if text is None or not lower else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """All levels, from the contract's words."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 8]) for i in range(0, len(last), 8)])
    return levels


def plain(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    trees = {g: tree([leaf(r) for r in own[g]]) for g in langs}
    top = tree([trees[g][-1][0] for g in langs])
    out = []
    for at, g in enumerate(langs):
        for i, r in enumerate(own[g]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            x, siblings = leaf(r, bad), []
            for levels, k in ((trees[g], i), (top, at)):
                for level in levels[:-1]:
                    run = list(level[k // 8 * 8 : k // 8 * 8 + 8])
                    siblings += [s for n, s in enumerate(run) if n != k % 8]
                    run[k % 8] = x
                    x, k = h(*run), k // 8
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], h(*siblings), x, x == top[-1][0]))
    return sorted(out, key=repr)


def documents(n):
    rows = [(i, f"Text {i} of É words" * (i % 5), ["en", "fr", "é", None][i * i % 4 if i % 9 else 3], f"src{i % 3}", i) for i in range(n)]
    rows += [(None, "NO ID", "en", None, None), (None, None, None, None, None), (7, "other TEXT of 7", "en", "s", 1), (7, "", "fr", "s", 0)]
    return rows + [(5000, "LONE", "lone", "s", 4), (5001, "REPEATED", "en", "s", 1), (5001, "REPEATED", "en", "s", 1), (3, "X" * 300_000, "de", "s", 2)]


def got(spark, rows):
    return sorted(map(tuple, merkle.tampered_manifest(spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA)).collect()), key=repr)


@pytest.mark.parametrize("n", [0, 3, 700])
def test_against_plain_python(spark, n):
    rows = documents(n)
    want = plain(rows)
    assert got(spark, rows) == want
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_one_group_of_any_size(spark, n):
    rows = [(i, f"Row {i}", "en", None, None) for i in range(n)]
    assert got(spark, rows) == plain(rows)


def test_many_groups(spark):
    rows = [(i, f"Row {i}", f"lang{i % 70}", None, None) for i in range(90)]
    assert got(spark, rows) == plain(rows)


def test_empty_table(spark):
    out = merkle.tampered_manifest(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns == [f.split()[0] for f in merkle.MANIFEST.split(", ")]


def test_ranks_don_t_depend_on_tasks(spark, monkeypatch):
    rows = documents(300)
    monkeypatch.setattr(merkle, "TASK_ROWS", 20)
    assert got(spark, rows) == plain(rows)


def test_sql_agrees(spark):
    rows = [r for r in documents(150) if len(r[1] or "") < 1000]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert sorted(db.execute(merkle.ORACLE_SQL).fetchall(), key=repr) == plain(rows)
