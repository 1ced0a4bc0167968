import random
import tracemalloc
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa

from obsengine.llm import toxicity as tx


def test_raw_scores_match_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    weights, factors = rng.normal(size=9), rng.normal(size=(9, 3))
    sets = [[], [0, 3, 5], [2], [], [1, 2, 3, 8], []]
    got, _ = tx.raw_scores(0.3, weights, factors, np.array(sum(sets, []), int), np.array([len(s) for s in sets]))
    want = [0.3 + sum(weights[i] for i in s) + sum(factors[i] @ factors[j] for i, j in combinations(s, 2)) for s in sets]
    assert np.allclose(got, want)


def test_pairs_that_weights_alone_cannot_tell():
    rng = random.Random(2)
    filler = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    texts, labels = [], []
    for _ in range(4000):  # either alone is harmless, both together are toxic
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(rng.sample(filler, 12) + ["insult"] * a + ["group"] * b))
        labels.append(float(a and b))
    model = tx.fit([tx.terms_of(t) for t in texts], np.array(labels))
    assert abs(model[3]).max() > 0.3
    got = tx.score(["insult", "group", "insult group", "wa nothing", "Group, INSULT!"], model) >= 0.5
    assert got.tolist() == [False, False, True, False, True]


def tables(spark):
    rng = random.Random(3)
    filler = ["".join(rng.choices("aeioulnrst", k=6)) for _ in range(500)]
    docs, labels = [], []
    for i in range(1500):
        toxic = int(rng.random() < 0.15)
        docs.append((i, " ".join(rng.choices(filler, k=40) + (["vile", "scum"] if toxic else [])), "k"))
        if i % 3:
            labels.append((i, toxic if i % 50 else None, "l"))
    docs += [(2000, None, "k"), (2001, "", "k"), (None, "vile scum", "k"), (7, "scum vile " * 50_000, "k")]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int, text string")


def test_classify_and_filter(spark):
    docs, labels = tables(spark)
    got = tx.classify(docs, labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id != 7]
    assert len(got) == 1504 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.99
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.doc_id: r.predicted for r in got if r.doc_id in (None, 2000, 2001)} == {None: 1, 2000: 0, 2001: 0}
    kept = tx.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in got)
    shuffled = tx.classify(docs.repartition(9), labels.repartition(3))
    assert sorted(map(tuple, shuffled.collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_nothing_to_learn_from(spark):
    docs, labels = tables(spark)
    got = tx.classify(docs, labels.limit(0)).agg({"score": "max"}).first()[0]
    assert got == 0
    assert tx.classify(docs.limit(0), labels).count() == 0


def test_a_fit_takes_memory_for_its_rows_and_not_for_sorting_them():
    rng = np.random.default_rng(6)
    documents = [np.unique(rng.integers(0, 1 << 18, 1000, np.int32)) for _ in range(4000)]
    labels = rng.integers(0, 2, len(documents)).astype(float)
    tracemalloc.start()
    tx.fit(documents, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 110e6  # rows are 16 MB, sums 48


def test_telling_terms_by_one_pass_over_all_terms():
    rng = np.random.default_rng(7)
    documents = [np.unique(rng.integers(0, 400, 30, np.int32)) for _ in range(2000)]
    labels = np.array([float(d[0] < 3 or rng.random() < 0.1) for d in documents])
    terms, at, times = np.unique(np.concatenate(documents), return_inverse=True, return_counts=True)
    toxic, share = np.bincount(at, np.repeat(labels, [len(d) for d in documents])), labels.mean()
    evidence = abs(toxic - share * times) / np.sqrt(share * (1 - share) * times + 0.5)
    assert 0 < (evidence > tx.EVIDENCE).sum() < len(terms)
    assert tx.telling_terms(documents, labels).tolist() == terms[evidence > tx.EVIDENCE].tolist()


def test_workers_keep_no_words_after_a_task(spark):
    docs, labels = tables(spark)
    assert tx.accepted(docs, labels).count()

    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([tx.buckets.cache_info().currsize] * b.num_rows)], ["n"])

    assert {r.n for r in spark.range(0, 8, 1, 8).mapInArrow(held, "n long").collect()} == {0}
