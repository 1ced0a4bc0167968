"""Profiles of labelled clips and hybrid search, against plain Python."""

import math
import random
import re
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsengine.functions.text import STOP_WORDS
from obsengine.operators import profiles, retrieval
from obsengine.plans import text_queries

RNG = random.Random(26)
BOXES = "clip string, frame long, row_id long, track long, name string, box struct<x1:double,y1:double,x2:double,y2:double>"


def scene():
    rows = []
    for i in range(1500):
        clip, name = RNG.choice(["a", "a", "b"]), RNG.choice(["person", "helmet", "vest", "ebox", "hook"])
        x, y = RNG.uniform(0, 700), RNG.uniform(0, 150)
        w, h = (RNG.uniform(20, 400), RNG.uniform(20, 200)) if name == "person" else (20, 20)
        rows.append((clip, RNG.randint(0, 30), i, RNG.randint(0, 1), name, (x, y, x + w, y + h)))
    rows += [("c", 1, 2000, 0, "helmet", (0.0, 0.0, 9.0, 9.0)), ("d", 1, 2001, 0, "person", (0.0, 0.0, 9.0, 9.0))]
    return rows + [("a", 1, 3000, 0, "person", (100.0, 0.0, 200.0, 100.0)), ("a", 1, 3001, 0, "helmet", (190.0, -18.0, 210.0, 2.0))]


ROWS = scene()


def wears(box, items, low, high, slack):
    x1, y1, x2, y2 = box
    return any(x1 <= (a + c) / 2 <= x2 and y1 + (y2 - y1) * low - slack <= (b + d) / 2 <= y1 + (y2 - y1) * high for a, b, c, d in items)


@pytest.fixture(scope="module")
def boxes(spark):
    return spark.createDataFrame(ROWS, BOXES).repartition(5).cache()


@pytest.mark.parametrize("cell", [1.0, 128.0, 10_000.0])
def test_wearing(boxes, cell):
    got = profiles.wearing(boxes.filter("name = 'person'"), boxes.filter("name = 'helmet'"), ["clip", "frame"], "row_id", 0.0, 0.45, 8.0, cell)
    want = [(c, f, i) for c, f, i, _, n, b in ROWS if n == "person" and wears(b, [r[5] for r in ROWS if r[4] == "helmet" and r[:2] == (c, f)], 0.0, 0.45, 8.0)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and ("a", 1, 3000) in want and len(want) > 20


def test_profiles(boxes, monkeypatch):
    monkeypatch.setattr(profiles, "STATIC_ROWS", 30)
    got = {r.clip: r for r in profiles.profiled(boxes, "clip", 10).collect()}
    drifts = {r.clip: r for r in profiles.drift(boxes, "clip", least=30).collect()}
    assert set(got) == {"a", "b", "c", "d"} and set(drifts) <= {"a", "b"}
    for clip, r in got.items():
        own = [x for x in ROWS if x[0] == clip]
        frames = sorted({x[1] for x in own})
        kept = set(frames[:: max(1, len(frames) // 10)])
        people = [x for x in own if x[4] == "person" and x[1] in kept and x[5][3] - x[5][1] >= 40]
        of = lambda name, p: [x[5] for x in own if x[4] == name and x[1] == p[1]]  # noqa: B023, E731
        worn = {n: sum(wears(p[5], of(n, p), *band) for p in people) for n, band in profiles.WEAR.items()}
        assert (r.sampled, r.n, r.helmet, r.vest) == (len(kept), len(people), worn["helmet"], worn["vest"])
        assert r.no_helmet == pytest.approx(1 - (worn["helmet"] / len(people) if people else 0))
        tall = sorted(x[5][3] - x[5][1] for x in own if x[4] == "person")
        crowd = sorted(Counter(x[1] for x in own if x[4] == "person").values())
        at = lambda s, p: s[int(len(s) * p)] if s else None
        assert [r.person_p10, r.person_p50, r.person_p90, r.crowd_p90, r.crowd_max] == [at(tall, 0.1), at(tall, 0.5), at(tall, 0.9), at(crowd, 0.9), crowd[-1] if crowd else None]
        assert (r.boxes, r.frames, r.width) == (len(own), len(frames), max(x[5][2] for x in own) + 1) and r.minutes == pytest.approx(len(frames) / 1500)
    for clip in ("a", "b"):
        things = {}
        for x in ROWS:
            if x[0] == clip and x[4] in profiles.STATIC:
                things.setdefault((x[4], x[3]), []).append(x[5])
        spread = {k: max(statistics.pstdev(b[0] for b in v), statistics.pstdev(b[1] for b in v)) for k, v in things.items() if len(v) >= 30}
        assert (clip in drifts) == bool(spread)
        if spread:
            worst = max(spread, key=spread.get)
            assert (drifts[clip].name, drifts[clip].track) == worst and drifts[clip].drift == pytest.approx(spread[worst]) and drifts[clip].camera == "moving"
    assert profiles.profiled(boxes.limit(0), "clip").count() == 0


WORDS = ["helmet", "vest", "edge", "the", "of", "crane", "zone", "net", "plant", "fall"]


def cosine(a, b):
    return round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9)


def terms(text):
    return [w for w in re.findall("[a-z0-9]+", text.lower()) if w not in STOP_WORDS]


def search(query, vector, docs, k):
    """The whole search for one query, from its definition."""
    q = Counter(terms(query))
    lexical = []
    for d, text, _ in docs:
        own = terms(text)
        shared = sum(min(n, own.count(w)) for w, n in q.items())
        if shared:
            lexical.append((-round(shared / (1 + math.log1p(len(own))), 9), d))
    lexical = sorted(lexical)[: 2 * k]
    if vector is None:
        found = [(d, -s) for s, d in lexical]
    else:
        dense = sorted((-cosine(vector, v), d) for d, _, v in docs if v is not None and cosine(vector, v) > 0)[: 2 * k]
        ranks: dict[int, list] = {}
        for number, hits in enumerate((lexical, dense)):
            for place, (_, d) in enumerate(hits, 1):
                ranks.setdefault(d, []).append((number, place))
        score = {d: sum(1 / (60 + p) for _, p in r) for d, r in ranks.items()}
        found = sorted(score.items(), key=lambda x: (-x[1], ranks[x[0]][0]))[:k]
    by = {d: (text, v) for d, text, v in docs}
    grams = lambda t: set(zip(terms(t), terms(t)[1:]))

    def alike(a, b):
        (ta, va), (tb, vb) = by[a], by[b]
        if va is not None and vb is not None:
            return float(np.dot(va, vb) / np.linalg.norm(va) / np.linalg.norm(vb))
        ga, gb = grams(ta), grams(tb)
        return len(ga & gb) / len(ga | gb) if ga and gb else 0.0

    best = max((s for _, s in found), default=1.0)
    picked = []
    while len(picked) < min(k, len(found)):
        rest = [(d, s) for d, s in found if d not in picked]
        worth = [0.6 * s / best - 0.4 * max(0.0, *(alike(d, p) for p in picked)) if picked else s / best for d, s in rest]
        picked.append(rest[int(np.argmax(np.round(worth, 12)))][0])
    return picked


def test_search_with_and_without_vectors(spark):
    rng = np.random.default_rng(3)
    docs = [(d, " ".join(RNG.choices(WORDS, k=RNG.randint(0, 25))), rng.normal(size=5).tolist() if d % 3 else None) for d in range(60)]
    docs += [(100, None, None), (101, "", rng.normal(size=5).tolist())]
    asked = [(q, " ".join(RNG.choices(WORDS, k=6)), rng.normal(size=5).tolist() if q % 2 else None) for q in range(12)] + [(50, "nothing here", None), (51, None, rng.normal(size=5).tolist())]
    both = spark.createDataFrame(docs, "doc_id long, text string, embedding array<double>").repartition(4)
    df, vectors = both.select("doc_id", "text"), both.select("doc_id", "embedding").filter("embedding IS NOT NULL")
    queries = spark.createDataFrame(asked, "q long, text string, embedding array<double>")
    got: dict[int, list] = {}
    for r in retrieval.searched(queries, "q", df, vectors, "doc_id", 4).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.doc_id)
    assert got == {q: w for q, text, v in asked if (w := search(text or "", v, [(d, t or "", x) for d, t, x in docs], 4))}
    assert 50 not in got and len(got[51]) == 4
    assert retrieval.searched(queries.limit(0), "q", df, vectors, "doc_id", 4).count() == 0
    assert retrieval.searched(queries, "q", df.limit(0), vectors, "doc_id", 4).count() == 0


def test_too_many_query_vectors_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_VECTORS", 2)
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(3)], "q long, embedding array<double>")
    with pytest.raises(ValueError):
        retrieval.dense_top(rows, "q", rows.withColumnRenamed("q", "d"), "d", 2)


def test_lexical_top_moves_no_terms_and_takes_any_number_of_queries(spark, monkeypatch):
    """Rows of one id are one document, null ids none; queries beyond a matrix are joined, with the same result; the query shuffles hits only."""
    docs = spark.createDataFrame(
        [(1, "red fox red fox"), (2, "blue fox"), (2, "red"), (3, "red red red the"), (None, "red fox"), (4, None), (5, "nothing"), (6, "Blue, fox; RED")], "doc_id long, text string"
    )
    asked = spark.createDataFrame([(1, "red fox red"), (2, "blue"), (3, "the"), (4, None), (5, "missing")], "item_id int, text string")
    whole = retrieval.lexical(asked, "item_id", docs.filter("doc_id IS NOT NULL"), "doc_id").withColumn("score", F.round("score", 9))
    want = sorted(map(tuple, retrieval.top(whole, "item_id", "doc_id", 2).collect()))
    few = lambda: sorted(map(tuple, retrieval.lexical_top(asked, "item_id", docs, "doc_id", 2).select("item_id", "doc_id", "score", "rank").collect()))
    assert few() == want and len(want) == 4
    monkeypatch.setattr(retrieval, "QUERY_CELLS", 3)
    assert few() == want
    monkeypatch.undo()
    plan = text_queries.lexical_topk(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
