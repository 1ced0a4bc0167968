"""Operators against brute force on small inputs, with nulls, ties and empty tables."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from obsengine.functions import geometry as g
from obsengine.functions import text as t
from obsengine.operators import joins, metrics, retrieval, selection, sequence


def plain_longest(times, gap):
    best, chain = None, []
    for x in sorted(times):
        chain = [*chain, x] if chain and x - chain[-1] <= gap else [x]
        if best is None or chain[-1] - chain[0] > best[1] - best[0]:
            best = (chain[0], chain[-1])
    return best


def test_longest_run_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, rng.randint(0, 400)) for k in range(80) for _ in range(rng.randint(1, 60))] + [(500, None)]
    df = spark.createDataFrame(rows, "k int, t long")
    for block in (None, 7, 10_000):
        got = {r.k: (r.first, r.last) for r in sequence.longest_run(df.filter("t IS NOT NULL"), ["k"], "t", 6, block).collect()}
        assert got == {k: plain_longest([x for j, x in rows if j == k], 6) for k in range(80)}
    times = spark.createDataFrame([(1, 0.0), (1, 3.0), (1, 6.0), (2, 0.0), (2, 3.1)], "k int, t double")
    assert [tuple(r) for r in sequence.longest_run(times, ["k"], "t", 3.0).orderBy("k").collect()] == [(1, 0.0, 6.0, 6.0), (2, 0.0, 0.0, 0.0)]
    assert sequence.longest_run(df.limit(0), ["k"], "t", 6).count() == 0


def test_folds_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rng = random.Random(2)
        rows = [(k, i, rng.randint(0, 300), float(rng.randint(0, 20))) for k in range(12) for i in range(40)]
        df = spark.createDataFrame(rows, "k int, i int, t long, v double")
        kept, segments = [], []
        for k in range(12):
            last = None
            for _, i, x, _ in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
                if last is None or x - last >= 25:
                    kept.append((k, i, x))
                    last = x
            state = None
            for _, _, x, v in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[3])):
                if state is None or abs(v - state[0]) > 6:
                    if state and state[2] - state[1] >= 10:
                        segments.append((k, *state[1:]))
                    state = [v, x, x, 0]
                state[2], state[3] = x, state[3] + 1
            if state[2] - state[1] >= 10:
                segments.append((k, *state[1:]))
        assert sorted(map(tuple, sequence.greedy_spacing(df, ["k"], "t", "i", 25).collect())) == sorted(kept)
        assert sorted(map(tuple, sequence.anchored_segments(df, ["k"], "t", "v", 6, 10).collect())) == sorted(segments)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sequence.greedy_spacing(df.limit(0), ["k"], "t", "i", 25).count() == 0


def test_band_and_nearest_joins(spark):
    rng = random.Random(3)
    left = [(rng.randint(0, 4), i, rng.randint(0, 500)) for i in range(200)] + [(9, 999, 5), (None, 1000, 5)]
    right = [(rng.randint(0, 4), i, rng.randint(0, 500)) for i in range(200)]
    l, r = spark.createDataFrame(left, "k int, a int, t long"), spark.createDataFrame(right, "k int, b int, u long")
    pairs = sorted((x.a, x.b) for x in joins.band(l, r, ["k"], "t", "u", 9).collect())
    assert pairs == sorted((a, b) for k, a, x in left for j, b, y in right if k == j and abs(x - y) <= 9)
    got = {x.a: x.b for x in joins.nearest(l, r, ["k"], "t", "u", "b", 9).collect()}
    for k, a, x in left:
        near = [(abs(x - y), -y, -b) for j, b, y in right if k == j and abs(x - y) <= 9]
        assert got[a] == (-min(near)[2] if near else None)
    assert len(got) == len(left)


def test_active_intervals(spark):
    rng = random.Random(4)
    moments = [(rng.randint(0, 3), i, rng.randint(0, 300)) for i in range(100)]
    spells = [(rng.randint(0, 3), i, s, s + rng.randint(0, 90)) for i in range(60) for s in [rng.randint(0, 300)]]
    m, s = spark.createDataFrame(moments, "k int, a int, t long"), spark.createDataFrame(spells, "k int, b int, s long, e long")
    got = sorted((x.a, x.b) for x in joins.active_at(m, s, ["k"], "t", "s", F.col("e") + 2, 25).collect())
    assert got == sorted((a, b) for k, a, x in moments for j, b, p, q in spells if k == j and p <= x <= q + 2)


def test_greedy_match(spark):
    rng = random.Random(5)
    box = lambda: (lambda x, y: {"x1": x, "y1": y, "x2": x + 10.0, "y2": y + 10.0})(rng.randint(0, 20) * 1.0, rng.randint(0, 20) * 1.0)
    dets = [(i, d, rng.choice([0.1, 0.5, 0.9]), box()) for i in range(20) for d in range(6)]
    truths = [(i, x, box()) for i in range(20) for x in range(5)]
    want = []
    for i in range(20):
        free = {x: b for j, x, b in truths if j == i}
        for _, d, _, b in sorted((r for r in dets if r[0] == i), key=lambda r: (-r[2], r[1])):
            best = max(((metrics.overlap(b, q), x) for x, q in free.items()), default=(0, None))
            if best[0] >= 0.3:
                del free[best[1]]
                want.append((i, d, best[1]))
    kinds = "box struct<x1:double,y1:double,x2:double,y2:double>"
    d = spark.createDataFrame(dets, f"image int, det_id int, confidence double, {kinds}")
    g_ = spark.createDataFrame(truths, f"image int, truth_id int, {kinds}")
    assert sorted(map(tuple, metrics.greedy_match(d, g_, "image", 0.3).collect())) == sorted(want)


def test_mmr_against_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(q, d, float(s), rng.normal(size=4).tolist(), 0) for q in range(4) for d, s in enumerate(sorted(rng.random(8))[::-1])]
    df = spark.createDataFrame([(q, d, s, v, d + 1) for q, d, s, v, _ in rows], "q int, d int, score double, embedding array<double>, rank int")
    got = {(r.q, r["rank"]): r.d for r in retrieval.diverse(df, "q", "d", 5).collect()}
    for q in range(4):
        own = [r for r in rows if r[0] == q]
        cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
        picked = []
        while len(picked) < 5:
            worth = {r[1]: 0.6 * r[2] / own[0][2] - 0.4 * max([cos(r[3], own[p][3]) for p in picked], default=0) for r in own if r[1] not in picked}
            picked.append(max(worth, key=worth.get))
        assert [got[q, k] for k in range(1, 6)] == picked


def test_nearest_matches_rows_with_nulls(spark):
    left = spark.createDataFrame([("k", 10, None), ("k", 20, "note"), (None, 10, None)], "k string, t int, note string")
    right = spark.createDataFrame([("k", 11, 7)], "k string, u int, b int")
    got = {(x.k, x.t): x.b for x in joins.nearest(left, right, ["k"], "t", "u", "b", 3).collect()}
    assert got == {("k", 10): 7, ("k", 20): None, (None, 10): None}


def test_grouped_split(spark):
    rows = [(f"g{i:02d}",) for i in range(40) for _ in range(10)]
    got = selection.grouped_split(spark.createDataFrame(rows, "g string"), "g", {"train": 0.7, "val": 0.15, "test": 0.15}, 42017).collect()
    count = {s: sum(r.split == s for r in got) for s in ("train", "val", "test")}
    assert len(got) == 40 and count["val"] >= 4 and count["test"] >= 4 and count["train"] >= 26


def test_geometry_values(spark):
    square, line = ((100.0, 100.0), (500.0, 100.0), (500.0, 500.0), (100.0, 500.0)), ((0.0, 0.0), (10.0, 0.0))
    bow = ((0.0, 0.0), (10.0, 10.0), (10.0, 0.0), (0.0, 10.0))
    cam = g.Camera(1700.0, 28.0, 3.4, 960.0, 540.0)
    r = spark.range(1).select(
        g.signed_distance(g.point(300, 300), g.path(*square)).alias("inside"), g.signed_distance(g.point(600, 300), g.path(*square)).alias("out"),
        g.area(g.path(*square)).alias("area"), g.self_intersects(g.path(*bow)).alias("bow"), g.self_intersects(g.path(*square)).alias("square"),
        g.to_polyline(g.point(4, 2), g.path(*line)).alias("on"), g.to_polyline(g.point(13, 4), g.path(*line)).alias("off"), g.to_polyline(g.point(0, 3), g.path((0.0, 0.0))).alias("single"),
        cam.pixel(F.lit(1.5), F.lit(7.0)).alias("p"), cam.ground(F.lit(960.0), F.lit(540 - 1700 * math.tan(math.radians(28)) - 5)).alias("sky"),
    ).first()
    assert (r.inside, r.out, r.area, r.bow, r.square, r.on, r.off, r.single) == (200, -100, 160000, True, False, 2, 5, 3)
    back = spark.range(1).select(cam.ground(F.lit(r.p.x), F.lit(r.p.y)).alias("s")).first().s
    assert abs(back.x - 1.5) < 1e-9 and abs(back.z - 7) < 1e-9 and r.sky is None
    bands = [(0.2, 1.4, "near"), (1.6, 2.9, "caution"), (3.1, 5.0, "clear"), (0.9, 2.2, "indeterminate"), (1.6, 3.5, "indeterminate"), (None, None, "indeterminate")]
    df = spark.createDataFrame(bands, "lo double, hi double, want string").withColumn("got", g.distance_band(F.col("lo"), F.col("hi"), 1.5, 3.0))
    assert df.filter("got != want").count() == 0


def test_text_functions(spark):
    rows = [("a b c d", "b c d e"), ("ok", "x"), (None, None), ("one two three", "")]
    df = spark.createDataFrame(rows, "a string, b string").select(
        t.overlap(t.tokens(F.col("a")), t.tokens(F.col("b"))).alias("o"), t.ngrams(t.tokens(F.col("a")), 2).alias("n"),
        t.jaccard(t.tokens(F.col("a")), t.tokens(F.col("b"))).alias("j"), t.html_escaped(F.concat(F.lit("<&'\">"), "a")).alias("h"),
    )
    got = df.collect()
    assert [r.o for r in got] == [0.5, 1.0, 1.0, 0.0] and [r.n for r in got] == [["a b", "b c", "c d"], [], [], ["one two", "two three"]]
    assert [round(r.j, 3) for r in got] == [0.6, 0, 0, 0] and got[0].h == "&lt;&amp;&#x27;&quot;&gt;a b c d"


def test_quantiles_and_averages(spark):
    from obsengine.operators.aggregates import linear_quantiles

    rng = random.Random(7)
    rows = [(k, i, float(rng.randint(0, 30))) for k in range(6) for i in range(rng.choice([1, 2, 40, 400]))] + [(0, -1, None)]
    df = spark.createDataFrame(rows, "k int, i int, v double")
    got = {r.k: (r.a, r.b) for r in linear_quantiles(df, ["k"], "v", {"a": 0.5, "b": 0.9}).collect()}
    known = {k: [v for j, _, v in rows if j == k and v is not None] for k in range(6)}
    assert all(np.allclose(got[k], np.quantile(known[k], [0.5, 0.9])) for k in range(6)) and len(got) == 6
    averages = {r.k: (r.n, r.average) for r in sequence.last_average(df.filter("v IS NOT NULL"), ["k"], ["i"], "v", 0.35).collect()}
    for k, values in known.items():
        e = values[0]
        for v in values[1:]:
            e = 0.65 * e + 0.35 * v
        assert averages[k][0] == len(values) and abs(averages[k][1] - e) < 1e-9


def test_even_thinning_against_all_places(spark):
    """Every place of every number of rows, found without a list of places for each row."""
    for n in (1, 2, 20, 150):
        sizes = [1, 2, n - 1, n, n + 1, 2 * n - 1, 2 * n, 3 * n + 1, 1001]
        rows = [(k, i) for k, size in enumerate(sizes) for i in range(size)]
        thinned = sequence.evenly_thinned(spark.createDataFrame(rows, "k int, i int"), ["k"], ["i"], n)
        want = {(k, i) for k, size in enumerate(sizes) for i in range(size) if size <= n or i in {round(j * (size - 1) / max(1, n - 1)) for j in range(n)}}
        assert {tuple(r) for r in thinned.collect()} == want
        assert "transform" not in thinned._jdf.queryExecution().optimizedPlan().toString()
