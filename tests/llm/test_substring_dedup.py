import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from obsengine.llm import substring_dedup as sd

RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choices("abcdeilmnorstu", k=RNG.randint(2, 7))) for _ in range(4000)]


def some(n):
    return RNG.choices(VOCABULARY, k=n)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, content string, start int")


def test_anchors_are_the_minima_of_every_gap():
    h = np.random.default_rng(1).integers(0, 50, 400).astype(np.uint64)
    want = {i + k for i in range(len(h) - sd.GAP + 1) for k in range(sd.GAP) if h[i + k] == h[i : i + sd.GAP].min()}
    assert sd.anchors(h).tolist() == sorted(want)
    assert sd.anchors(h[:5]).tolist() == np.flatnonzero(h[:5] == h[:5].min()).tolist() and len(sd.anchors(h[:0])) == 0


def test_any_51_words_that_two_texts_share_hold_a_common_window():
    for _ in range(60):
        passage = some(51)
        found = [set(sd.windows(sd.shingle_hashes([w.encode() for w in some(RNG.randint(0, 40)) + passage + some(RNG.randint(0, 40))]))[1].tolist()) for _ in range(2)]
        assert found[0] & found[1]


def test_bands_find_similar_lines():
    caught = total = 0
    for _ in range(150):
        a = some(100)
        b = a.copy()
        for _ in range(2):
            b[RNG.randrange(100)] = "changed" + RNG.choice(VOCABULARY)
        x, y = (sd.shingle_hashes([w.encode() for w in t]) for t in (a, b))
        if len(np.intersect1d(x, y)) / len(np.union1d(x, y)) >= 0.8:
            p, q = (sd.bands_of(t, np.array([0]))[0] for t in (x, y))
            total += 1
            caught += bool((p == q).any())
    assert total > 100 and caught / total > 0.98


def test_passages_repeats_and_clean_documents(spark):
    passages = [some(n) for n in (51, 60, 98, 300)]
    rows, planted = [], {}
    for i in range(200):
        words = some(RNG.randint(60, 300))
        if i % 4 == 0:
            p = passages[(i // 4) % 4]
            at = RNG.randint(0, len(words))
            planted[i] = (at, len(p))
            words[at:at] = p
        lines = RNG.choice([" ", "\n", "  \t"])
        rows.append((i, " ".join(words[:40]) + lines + " ".join(words[40:])))
    rows += [(900, None), (901, ""), (902, "short text"), (None, rows[0][1]), (7, rows[7][1]), (903, "w " * 100_000)]
    got = sd.repeated_spans(frame(spark, rows).repartition(6)).collect()
    keepers = set(list(planted)[:4])
    assert {r.doc_id for r in got} == set(planted) - keepers
    for r in got:
        at, n = planted[r.doc_id]
        assert at <= r.start_word and r.start_word + r.n_words <= at + n and r.n_words >= 32 and r.kept_doc_id in keepers
    clean = sd.without_repeats(frame(spark, rows))
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == ["doc_id", "text", "content", "start"] and clean.count() == len(rows)
    spans = {}
    for r in got:
        spans.setdefault(r.doc_id, []).append((r.start_word, r.n_words))
    for i, t in rows:
        if i is not None and t:
            gone = {k for a, n in spans.get(i, []) for k in range(a, a + n)}
            assert texts[i].split() == [w for k, w in enumerate(t.split()) if k not in gone]


def test_similar_lines_and_their_clusters(spark):
    base = some(120)
    rows = []
    for i in range(30):
        line = base.copy()
        if i:
            line[RNG.randrange(120)] = f"other{i}"
        rows.append((100 + i, " ".join(some(20)) + "\n" + " ".join(line)))
    rows += [(i, " ".join(some(120))) for i in range(30)]
    got = sd.repeated_spans(frame(spark, rows)).collect()
    assert {r.doc_id for r in got} == set(range(101, 130)) and {r.kept_doc_id for r in got} == {100}
    assert all(r.n_words == 120 and r.start_word == 20 for r in got)


def test_no_link_between_lines_of_a_bucket_is_lost(spark):
    """Against all pairs: families of lines of which many share a bucket with lines that they are not similar to."""
    lines = []
    for _ in range(6):
        base = some(100)
        for _ in range(90):
            line = base.copy()
            for at in RNG.sample(range(100), RNG.choice((1, 1, 2, 2, 5, 9))):
                line[at] = f"new{RNG.randrange(10**6)}"
            lines.append(" ".join(line))
    table = sd.paragraph_table(frame(spark, list(enumerate(lines)))).filter("bands IS NOT NULL")
    nodes = table.drop("doc_id", "version", "start", "words").dropDuplicates(["node"])
    members = sd.bucket_members(nodes)
    pairs = sd.first_pairs(members, nodes)
    told = sd.answers(table.select(*sd.DOCUMENT, "start", "words", "node"), frame(spark, list(enumerate(lines)))).dropDuplicates(["node"])
    shingles = {r.node: r.shingles for r in told.collect()}
    rows = nodes.select("node", "bands").collect()
    assert members.filter(f"size > {sd.FEW}").count() > 0
    root = {r.node: r.node for r in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(rows):
        for b in rows[:i]:
            if set(a.bands) & set(b.bands) and sd.jaccard(shingles[a.node], shingles[b.node]) >= sd.SIMILARITY:
                low, high = sorted((top(a.node), top(b.node)))
                root[high] = low
    want = {n: top(n) for n in root}
    got = {r.node: r.root for r in sd.clustered(members, pairs, told.select("node", "shingles"), nodes).collect()}
    assert {n: got.get(n, n) for n in want} == want and len(set(want.values())) < len(want)


def test_copies_and_nothing(spark):
    text = " ".join(some(400))
    got = sd.repeated_spans(frame(spark, [(i, text) for i in range(50)])).collect()
    assert {r.doc_id for r in got} == set(range(1, 50)) and {r.kept_doc_id for r in got} == {0}
    assert all(r.n_words >= 350 for r in got)
    assert sd.repeated_spans(frame(spark, [(1, "a")]).limit(0)).count() == 0
    assert sd.without_repeats(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_cut():
    assert sd.cut(" a b\tc\nd  e ", [(1, 2), (4, 1)]) == " a\nd "
    assert sd.cut("é ü é", [(0, 1)]) == " ü é" and sd.cut(None, [(0, 1)]) is None and sd.cut("a", None) == "a"


def test_near_copies_of_short_lines_and_of_wrapped_passages(spark):
    line, passage = some(36), some(70)
    near_line, near = line[:-1] + ["changed"], passage.copy()
    near[35] = "changed"  # what is left to either side is too short for a whole common window
    wrap = lambda words, n: "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))
    rows = [(1, " ".join(some(15)) + "\n" + " ".join(line)), (2, " ".join(some(15)) + "\n" + " ".join(near_line) + "\n" + " ".join(some(9)))]
    rows += [(3, wrap(some(50), 10) + "\n\n" + wrap(passage, 12)), (4, wrap(some(30), 10) + "\n \n" + wrap(near, 17) + "\n\n" + wrap(some(40), 8))]
    got = sorted((r.doc_id, r.start_word, r.n_words, r.kept_doc_id) for r in sd.repeated_spans(frame(spark, rows)).collect())
    assert got == [(2, 15, 36, 1), (4, 30, 70, 3)]


def test_joined_lines_end_at_the_same_places_whatever_surrounds_and_breaks_them():
    passage = some(400)
    found = []
    for n in (7, 19):
        words = [w.encode() for w in some(33 + n) + passage + some(21)]
        parts = [p for run in sd.short_runs([n] * (len(words) // n) + [len(words) % n]) for p in sd.joined_parts(sd.shingle_hashes(words), *run)]
        found.append({sd.content_of(words[a:b]) for a, b in parts})
        assert sum(b - a for a, b in parts) == len(words) and all(b - a > sd.JOIN for a, b in parts[1:-1])
    assert len(found[0] & found[1]) >= 2
    assert sd.short_runs([3, 4, 0, 5, 60, 7, 8]) == [(0, 7), (72, 87)]
    assert sd.joined_parts(np.zeros(500, np.uint64), 0, 504) == [(0, 30), (30, 504)]


def test_similar_paragraphs_that_overlap_in_the_kept_document_stay(spark):
    text = " ".join(some(5)) + "\n" + " ".join(some(45))
    got = sd.repeated_spans(frame(spark, [(1, text), (2, text)])).collect()
    assert [tuple(r)[:4] for r in got] == [(2, 0, 50, 1)]


def test_removed_passages_end_where_they_were_planted(spark):
    passages = [some(n) for n in (51, 75, 140)]
    rows, want = [], []
    for i in range(45):
        p, words = passages[i % 3], some(RNG.randint(45, 90))
        at = (0, len(words), RNG.randint(1, 44))[i // 3 % 3]
        rows.append((i, " ".join(words[:at] + [f"left{i}"] * (at > 0) + p + [f"right{i}"] + words[at:])))
        if i > 2:
            want.append((i, at + (at > 0), len(p), i % 3))
    rows += [(7, "another text")]
    got = sorted((r.doc_id, r.start_word, r.n_words, r.kept_doc_id) for r in sd.repeated_spans(frame(spark, rows)).collect())
    assert got == want


def test_a_span_does_not_grow_into_the_kept_occurrence(spark):
    text = " ".join(some(3) * 60)
    got = sd.repeated_spans(frame(spark, [(1, text), (2, text)])).collect()
    spans = {r.doc_id: (r.start_word, r.n_words) for r in got}
    assert spans[2] == (0, 180) and spans.get(1, (180, 0))[0] >= sd.SPAN + sd.SHINGLE - 1


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    passage, other = " ".join(some(80)), " ".join(some(120))
    rows = [(1, passage), (2, passage), (2, other), (2, other), (3, other + " " + passage)]
    got = sorted((r.doc_id, r.start_word, r.n_words, r.kept_doc_id) for r in sd.repeated_spans(frame(spark, rows)).collect())
    assert got == [(2, 0, 80, 1), (3, 0, 200, 1)]
    texts = sorted((r.doc_id, r.text) for r in sd.without_repeats(frame(spark, rows)).collect())
    assert texts == [(1, passage), (2, ""), (2, other), (2, other), (3, "")]


def test_sketches_differ_in_no_more_bits_than_sets():
    for n in (1, 5, 40, 900):
        x = RNG.sample(range(1 << 40), n)
        y = x[: RNG.randint(0, n)] + RNG.sample(range(1 << 40), 3)
        h = [np.array(z + z[:2], np.uint64) for z in (x, y)]
        sizes, sketches = sd.sizes_and_sketches(np.concatenate(h), np.array([len(z) for z in h]))
        one, two = sketches.view(np.uint64).tolist()
        assert sizes.tolist() == [len(set(x)), len(set(y))]
        assert sum((a ^ b).bit_count() for a, b in zip(one, two)) <= len(set(x) ^ set(y))


def test_recall_over_all_pairs_of_lines_of_3_to_500_words(spark):
    """Against every pair of documents of one line: those with a Jaccard similarity of 0.8 or more, whether or not they share a bucket."""
    lines = []
    for _ in range(60):
        base = some(RNG.choice((3, 8, 20, 25, 40, 60, 120, 500)))
        lines.append(base)
        for _ in range(4):
            near = base.copy()
            for at in RNG.sample(range(len(base)), max(1, len(base) // 50)):
                near[at] = f"new{RNG.randrange(10**6)}"
            lines.append(near)
    sets = [set(zip(*(x[i:] for i in range(5)))) for x in lines]
    near = {(i, j) for j in range(len(lines)) for i in range(j) if sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    got = {r.doc_id for r in sd.repeated_spans(frame(spark, [(i, " ".join(x)) for i, x in enumerate(lines)])).filter("start_word = 0").collect()}
    want = {j for _, j in near}
    assert len(want) > 60 and len(got & want) >= 0.98 * len(want)
    shared = {j for j in got if any(len(sets[i] & sets[j]) for i in range(len(lines)) if i < j)}
    assert got == shared  # a line with nothing in common with another stays


def thue_morse(one, two, length):
    return "".join((one, two)[i.bit_count() & 1] for i in range(length))


def test_words_that_meet_under_a_polynomial_hash_stay(spark):
    """Thue-Morse words and their opposites agree under every polynomial modulo 2 ** 64; the documents have no word in common."""
    pairs = [("a", "b"), ("c", "d"), ("e", "f"), ("g", "h"), ("i", "k"), ("l", "m")]
    texts = [" ".join(thue_morse(*p[::side], n) for p in pairs for n in (1024, 2048, 1024, 4096)) for side in (1, -1)]
    assert not set(texts[0].split()) & set(texts[1].split())
    hashes = [sd.word_hashes(t.encode())[0] for t in texts]
    assert not np.isin(*hashes).any()
    assert sd.repeated_spans(frame(spark, list(enumerate(texts)))).count() == 0


def test_word_hashes_don_t_depend_on_place_or_piece(monkeypatch):
    words = [w.encode() for w in some(300)] + [b"x" * 9000]
    want = sd.word_hashes(b" ".join(words))[0]
    monkeypatch.setattr(sd, "PIECE", 50)
    got, at = sd.word_hashes(b"\n \t" + b" \n ".join(words) + b"  ")
    assert (got == want).all() and len(set(got.tolist())) == len(set(words)) and at[0] == 3


def test_lines_of_one_name_that_differ_get_another(spark):
    lines = spark.createDataFrame([(1, 7, 100), (2, 7, 200), (3, 8, 300), (4, 7, 100)], "doc_id long, node long, check long")
    clashes = lines.dropDuplicates(["node", "check"]).groupBy("node").count().filter("count > 1").select("node")
    got = sorted(map(tuple, sd.renamed(lines, clashes).select("doc_id", "node").collect()))
    assert got == [(1, 100), (2, 200), (3, 8), (4, 100)]
    assert sorted(sd.renamed(lines, clashes.limit(0)).collect())[0].node == 7


def test_sets_beyond_the_room_of_a_slice(monkeypatch):
    h = np.random.default_rng(4).integers(0, 50, 100).astype(np.uint64)
    sizes = np.array([10] * 10)
    want = sd.sizes_and_sketches(h, sizes)
    monkeypatch.setattr(sd, "OWN_BITS", 62)  # room for four
    got = sd.sizes_and_sketches(h, sizes)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_lines_of_five_words_and_more_and_short_passages(spark):
    line, passage = some(6), some(24)
    rows = [(1, " ".join(some(30)) + "\n" + " ".join(line)), (2, " ".join(some(9)) + "\n\n" + " ".join(line) + "\n\nof four words here"), (3, "of four words here")]
    got = sorted((r.doc_id, r.start_word, r.n_words, r.kept_doc_id) for r in sd.repeated_spans(frame(spark, rows)).collect())
    assert got == [(2, 9, 6, 1)]
    both = [" ".join(some(40) + passage + some(40)) for _ in range(2)]
    found = [(r.doc_id, r.n_words) for r in sd.repeated_spans(frame(spark, list(enumerate(both)))).collect()]
    assert found in ([], [(1, 24)])  # found where it holds an anchor's window, and then whole


def test_repeated_rows_are_answered_once_and_the_lines_tables_are_gone_when_passages_grow(spark, monkeypatch, tmp_path):
    passage = some(80)
    rows = [(i, " ".join(some(40) + passage + some(40))) for i in range(3)]
    docs = frame(spark, rows + rows[:2] * 3)
    table = sd.paragraph_table(docs)
    asked = table.select(*sd.DOCUMENT, "start", "words", "node").distinct()
    assert sd.answers(asked, docs).count() == asked.count()
    left, real = [], sd.extended
    monkeypatch.setattr("obsengine.llm.common.shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(sd, "extended", lambda *a: left.extend(p.rsplit("-", 1)[0] for p in os.listdir(tmp_path / "obsengine")) or real(*a))
    got = sorted((r.doc_id, r.n_words, r.kept_doc_id) for r in sd.repeated_spans(docs).collect())
    assert got == [(1, 80, 0), (2, 80, 0)]
    assert "answers" in left and not {"line-nodes", "line-members", "line-shingles", "line-clusters"} & set(left)


def test_pairs_that_several_bands_of_small_buckets_share_are_looked_at_once(spark, monkeypatch):
    base = some(120)
    lines = [" ".join(base[:-1] + [f"other{i}"]) for i in range(3)]
    rows, real = {}, sd.staged
    nodes = sd.paragraph_table(frame(spark, list(enumerate(lines)))).filter("bands IS NOT NULL").drop("doc_id", "version", "start", "words")
    members = sd.bucket_members(nodes)

    def counted(df, name):
        table = real(df, name)
        rows[name] = table.count()
        return table

    monkeypatch.setattr(sd, "staged", counted)
    ids = sorted(r.node for r in nodes.collect())
    got = sorted(map(tuple, sd.first_pairs(members, nodes).collect()))
    assert got == [(u, v) for u in ids for v in ids if u < v]
    assert members.filter("size = 3").count() > 3 and rows["line-small"] == 0 and rows["line-ends"] == 3


def test_spans_meet_what_they_repeat_in_one_join(spark):
    passage = some(60)
    docs = frame(spark, [(i, " ".join(some(40) + passage + some(40))) for i in range(3)])
    versions = {r.doc_id: r.version for r in sd.documents(docs, "doc_id", "text").collect()}
    spans = spark.createDataFrame(
        [(i, versions[i], 50, 30, 0, versions[0], 50, True) for i in (1, 2)], f"doc_id long, version int, start int, words int, {sd.KEPT}, edge boolean"
    )
    asked = sd.asked_spans(spans)
    assert sorted((r.doc_id, r.kept_doc_id) for r in asked.filter("kept_doc_id IS NOT NULL").collect()) == [(1, 0), (2, 0)]
    assert [tuple(r) for r in asked.filter("kept_doc_id IS NULL").collect()] == [(0, versions[0], 50, 30, None, True, None, None, None)]
    grown = sd.extended(sd.answers(asked, docs))
    assert sorted((r.doc_id, r.start, r.end, r.kept_doc_id) for r in grown.collect()) == [(1, 40, 100, 0), (2, 40, 100, 0)]
    assert grown._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables")
def test_recall_over_the_lines_of_a_table_by_length(spark):
    """Against all lines with shingles: exact repeats of an earlier document's, and near ones by an inverted index over all shingles."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, places, sets, index, near = {}, [], {}, defaultdict(list), {}
    for doc, text in sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()):
        at = 0
        for words in (x.split() for x in text.encode().lower().split(b"\n")):
            if len(words) >= 5:
                line = tuple(words)
                if line not in seen:
                    seen[line] = doc
                    sets[line] = set(zip(*(words[i:] for i in range(5))))
                    common = Counter(other for g in sets[line] for other in index[g])
                    near[line] = any(5 * k >= 4 * (len(sets[line]) + len(sets[o]) - k) and seen[o] < doc for o, k in common.items())
                    for g in sets[line]:
                        index[g].append(line)
                if seen[line] < doc or near[line]:
                    places.append((doc, at, len(words)))
            at += len(words)
    gone = defaultdict(set)
    for r in sd.repeated_spans(docs).collect():
        gone[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
    totals, caught = Counter(), Counter()
    for doc, at, n in places:
        size = "short" if n < 20 else "middle" if n < 50 else "long"
        totals[size] += 1
        caught[size] += gone[doc] >= set(range(at, at + n))
    assert totals and all(caught[k] >= 0.9 * totals[k] for k in totals), (caught, totals)
