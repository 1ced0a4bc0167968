"""Retrieval over clauses or documents: lexical and dense scores, top k, fusion, diversity, grounding."""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsengine.functions import text as t
from obsengine.functions import vectors as v
from obsengine.operators import joins
from obsengine.session import written

QUERY_VECTORS, QUERY_CELLS = 10_000, 50_000_000
#: Ids of documents that are sent to every task.
HITS = 1_000_000


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, n): terms without stop words."""
    return df.select(key, F.explode(t.without(t.tokens(F.col(text)))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))


def lexical(queries: DataFrame, query_key: str, docs: DataFrame, doc_key: str, text: str = "text") -> DataFrame:
    """(query, doc, score): shared term counts over 1 + ln(1 + terms of the document); only pairs that share a term."""
    d = term_counts(docs, doc_key, text)
    q = term_counts(queries, query_key, text).withColumnRenamed("n", "_q")
    sizes = d.groupBy(doc_key).agg(F.sum("n").alias("_size"))
    shared = q.join(d, "term").groupBy(query_key, doc_key).agg(F.sum(F.least("n", "_q")).alias("_shared"))
    return shared.join(sizes, doc_key).select(query_key, doc_key, (F.col("_shared") / (1 + F.log1p("_size"))).alias("score"))


def top(scored: DataFrame, query_key: str, doc_key: str, k: int) -> DataFrame:
    """The k best of each query with their rank: by score, then id."""
    w = Window.partitionBy(query_key).orderBy(F.desc("score"), doc_key)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def dense(queries: DataFrame, query_key: str, docs: DataFrame, doc_key: str, vector: str = "embedding") -> DataFrame:
    """(query, doc, score): cosines above 0 of a stated set of query vectors, no more than QUERY_VECTORS, with every row."""
    asked = queries.select(query_key, F.col(vector).alias("_q"))
    if asked.limit(QUERY_VECTORS + 1).count() > QUERY_VECTORS:
        raise ValueError(f"more than {QUERY_VECTORS} query vectors: ask in blocks")
    pairs = docs.select(doc_key, F.col(vector).alias("_d")).crossJoin(F.broadcast(asked))
    return pairs.select(query_key, doc_key, v.cosine(F.col("_q"), F.col("_d")).alias("score")).filter("score > 0")


def hybrid(lexical_hits: DataFrame, dense_hits: DataFrame, query_key: str, doc_key: str, k: int) -> DataFrame:
    """The k best of each query by reciprocal ranks; equal ones by list, lexical first, then rank."""
    pair = F.struct(query_key, doc_key).alias("_pair")
    lists = {n: df.select(pair, "rank") for n, df in (("lexical", lexical_hits), ("dense", dense_hits))}
    scored = joins.fused(lists, "_pair").select("_pair.*", F.col("rrf").alias("score"), "first_list", "first_rank")
    w = Window.partitionBy(query_key).orderBy(F.desc("score"), "first_list", "first_rank")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each line: by score, then id."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _top_in_tasks(docs: DataFrame, doc_key: str, names: list, query_key: str, kind: str, k: int, score: Callable[[pd.Series], np.ndarray], column: str) -> DataFrame:
    """(query, doc, score, rank): the k best scores above 0 of each query. A task keeps the k best of what it has read, and sends on no others.

    score: from some values of the column to their scores, a line a query. doc_key is a long.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores, ids = np.full((len(names), 0), -np.inf), np.zeros((len(names), 0), np.int64)
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256]
                new = score(part[column])
                scores, ids = _best(np.hstack([scores, new]), np.hstack([ids, np.broadcast_to(part[doc_key].to_numpy(np.int64), new.shape)]), k)
        q, at = np.nonzero(scores > 0)
        yield pd.DataFrame({query_key: [names[i] for i in q], doc_key: ids[q, at], "score": scores[q, at]})

    rows = docs.select(F.col(doc_key).cast("long").alias(doc_key), column).filter(F.col(column).isNotNull() & F.col(doc_key).isNotNull())
    found = rows.mapInPandas(run, f"{query_key} {kind}, {doc_key} long, score double")
    return top(found, query_key, doc_key, k)


def _no_hits(docs: DataFrame, query_key: str, kind: str, doc_key: str) -> DataFrame:
    return docs.sparkSession.createDataFrame([], f"{query_key} {kind}, {doc_key} long, score double, rank int")


def dense_top(queries: DataFrame, query_key: str, docs: DataFrame, doc_key: str, k: int, vector: str = "embedding") -> DataFrame:
    """(query, doc, score, rank): the k best cosines above 0, to nine places, of each of a stated set of query vectors, no more than QUERY_VECTORS.

    Queries are one matrix in every task. doc_key is a long. Rows and queries without a vector have no cosine.
    """
    asked = queries.select(F.col(query_key).alias("_q"), F.transform(vector, lambda x: x.cast("double")).alias("_v")).filter("_v IS NOT NULL").limit(QUERY_VECTORS + 1).collect()
    if len(asked) > QUERY_VECTORS:
        raise ValueError(f"more than {QUERY_VECTORS} query vectors: ask in blocks")
    kind = dict(queries.dtypes)[query_key]
    if not asked:
        return _no_hits(docs, query_key, kind, doc_key)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    names, matrix = [r["_q"] for r in asked], unit(np.array([r["_v"] for r in asked], float))

    def score(vectors: pd.Series) -> np.ndarray:
        return np.round(matrix @ unit(np.array(vectors.tolist(), float)).T, 9)

    return _top_in_tasks(docs, doc_key, names, query_key, kind, k, score, vector)


#: Of bytes of lower-cased text, what is no letter a-z or digit becomes a space.
_LETTERS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def lexical_top(queries: DataFrame, query_key: str, docs: DataFrame, doc_key: str, k: int, text: str = "text", digits: int = 9) -> DataFrame:
    """(query, doc, score, rank): the k best of `lexical`, rounded to `digits`, of each of a stated set of queries, which share QUERY_CELLS cells.

    That min(n, m) of a term's counts is shared is a sum over the first, second and further time that it occurs: queries are one matrix of such
    occurrences in every task, and a document's shared counts the sum of the lines of those that it has. Documents are read once, and
    nothing of them is shuffled but hits. doc_key is a long. Rows that share an id are one document, of all their texts. Texts that are null,
    and queries without terms, have no hits. More queries than one matrix holds are asked by `lexical`, which shuffles all terms of the documents.
    """
    if not docs.groupBy(doc_key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        docs = docs.groupBy(doc_key).agg(F.concat_ws(" ", F.collect_list(text)).alias(text))
    kind = dict(queries.dtypes)[query_key]
    asked = term_counts(queries, query_key, text).limit(QUERY_CELLS + 1).collect()
    most: dict[str, int] = {}
    for r in asked:
        most[r["term"]] = max(r["n"], most.get(r["term"], 0))
    names = sorted({r[query_key] for r in asked if r[query_key] is not None})
    if len(names) * sum(most.values()) > QUERY_CELLS or len(asked) > QUERY_CELLS:
        found = lexical(queries.filter(F.col(query_key).isNotNull()), query_key, docs.filter(F.col(doc_key).isNotNull()), doc_key, text)
        return top(found.withColumns({"score": F.round("score", digits), doc_key: F.col(doc_key).cast("long")}).filter("score > 0"), query_key, doc_key, k)
    if not names:
        return _no_hits(docs, query_key, kind, doc_key)
    start = dict(zip(most, np.cumsum([0, *most.values()])[:-1].tolist()))
    line = {q: i for i, q in enumerate(names)}
    cells = np.zeros((sum(most.values()), len(names)), np.float32)
    for r in asked:
        if r[query_key] is not None:
            cells[start[r["term"]] : start[r["term"]] + r["n"], line[r[query_key]]] = 1
    known = {w.encode(): (start[w], n) for w, n in most.items()}
    stop = {w.encode() for w in t.STOP_WORDS}

    def score(texts: pd.Series) -> np.ndarray:
        out = np.zeros((len(names), len(texts)))
        for i, value in enumerate(texts):
            words = value.lower().encode().translate(_LETTERS).split()
            held = Counter(filter(known.__contains__, words))
            at = [a + j for w, n in held.items() for a, m in (known[w],) for j in range(min(n, m))]
            size = sum(w not in stop for w in words)
            if at:
                out[:, i] = np.round(cells[at].sum(0, dtype=np.float64) / (1 + math.log1p(size)), digits)
        return out

    return _top_in_tasks(docs, doc_key, names, query_key, kind, k, score, text)


def diverse(candidates: DataFrame, query_key: str, doc_key: str, k: int, weight: float = 0.6, vector: str = "embedding", text: str | None = None) -> DataFrame:
    """Maximal marginal relevance over each query's candidates (query, doc, score, rank, vector), which `top` has bounded.

    Relevance is the score over the best one; the first pick goes by it alone, later ones also by how unlike the
    picked they are; earlier candidates win ties. Two are alike by the cosine of their vectors or, where one has none, by the
    Jaccard similarity of their texts' term bigrams (`text`; none without it); what points away is as unlike as can be, not more.
    """
    types = dict(candidates.dtypes)
    grams = t.ngrams(t.without(t.tokens(F.col(text))), 2) if text else F.array().cast("array<string>")
    rows = candidates.select(query_key, doc_key, "score", "rank", F.col(vector).alias("_v"), grams.alias("_g"))

    def likeness(frame: pd.DataFrame) -> np.ndarray:
        known = np.array([v is not None for v in frame["_v"]])
        alike = np.zeros((len(frame), len(frame)))
        if known.any():
            vectors = np.array(frame["_v"][known].tolist(), float)
            unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            alike[np.ix_(known, known)] = np.round(unit @ unit.T, 12)
        sets = [set(g) for g in frame["_g"]]
        for i, j in itertools.combinations(range(len(frame)), 2):
            if not (known[i] and known[j]) and sets[i] and sets[j]:
                alike[i, j] = alike[j, i] = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
        return np.maximum(alike, 0)

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank", kind="stable").reset_index(drop=True)
        alike = likeness(frame)
        relevance = frame["score"].to_numpy() / (frame["score"].max() or 1.0)
        picked: list[int] = []
        while len(picked) < min(k, len(frame)):
            rest = [i for i in range(len(frame)) if i not in picked]
            worth = [weight * relevance[i] - (1 - weight) * alike[i, picked].max() if picked else relevance[i] for i in rest]
            picked.append(rest[int(np.argmax(np.round(worth, 12)))])
        out = frame.loc[picked, [query_key, doc_key, "score"]]
        return out.assign(rank=range(1, len(picked) + 1))

    schema = f"{query_key} {types[query_key]}, {doc_key} {types[doc_key]}, score double, rank int"
    return rows.groupBy(query_key).applyInPandas(pick, schema)


def searched(queries: DataFrame, query_key: str, docs: DataFrame, vectors: DataFrame, doc_key: str, k: int, text: str = "text", vector: str = "embedding", digits: int = 9) -> DataFrame:
    """(query, doc, score, rank): whole hybrid search, for many queries at once, over docs (doc, text) and vectors (doc, vector).

    Queries with a vector fuse the 2 k best by terms with the 2 k best by cosine, and put the k best of those in order of marginal relevance;
    queries without one pick k of the 2 k best by terms so. Documents may lack vectors. Lexical scores are rounded to `digits`.
    Texts and vectors are read where they lie; only hits are joined with theirs.
    """
    both = 2 * k
    by_terms = lexical_top(queries, query_key, docs, doc_key, both, text, digits)
    known = vectors.join(docs.select(doc_key), doc_key, "left_semi")
    by_cosine = dense_top(queries, query_key, known, doc_key, both, vector)
    seen = queries.filter(F.col(vector).isNotNull()).select(query_key)
    fused = hybrid(by_terms.join(seen, query_key, "left_semi"), by_cosine, query_key, doc_key, k).select(query_key, doc_key, "score", "rank")
    plain = by_terms.join(seen, query_key, "left_anti").select(query_key, doc_key, "score", "rank")
    found = written(fused.unionByName(plain), "hits")
    wanted = found.select(doc_key).distinct()
    if wanted.count() <= HITS:  # then the texts of hits are looked up without moving the others
        wanted = F.broadcast(wanted)
    texts = docs.select(doc_key, text).join(wanted, doc_key, "left_semi")
    candidates = found.join(texts, doc_key).join(vectors.select(doc_key, vector), doc_key, "left")
    return diverse(candidates, query_key, doc_key, k, vector=vector, text=text)


#: Words that speak of a rule's matter. Fixed values.
HINTS = {
    "R1": ("helmet", "head", "ppe", "protection", "impact", "hardhat"),
    "R2": ("vest", "visibility", "conspicuous", "traffic", "plant", "hiviz", "fluorescent"),
    "R3": ("restricted", "zone", "barrier", "access", "authorised", "permit"),
    "R4": ("machinery", "plant", "separation", "danger", "movement", "excavator", "crane"),
    "R5": ("edge", "fall", "height", "guardrail", "net", "harness", "scaffold"),
}


def hint_shares(text: Column) -> dict[str, Column]:
    """For each rule the share of its hints that are among the text's terms."""
    return {rule: hint_share(text, hints) for rule, hints in HINTS.items()}


def hint_share(text: Column, hints: Sequence[str]) -> Column:
    """Share of the hints that are among the text's tokens."""
    return F.size(F.array_intersect(t.tokens(text), F.array(*map(F.lit, hints)))) / F.lit(float(len(hints)))


def grounded(sentence: Column, evidence: Column, least: int = 2) -> Column:
    """Whether a sentence shares at least `least` distinct terms with the evidence."""
    return F.size(F.array_intersect(t.without(t.tokens(sentence)), t.without(t.tokens(evidence)))) >= least
