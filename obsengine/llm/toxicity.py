"""Toxicity by a factorization machine over hashed terms.

A document is the set of its terms: runs of letters, lower-cased, and longer ones' first STEM letters, which stand
for a word's other forms; hashed to BUCKETS. The machine adds a weight
for each term and, for each pair of terms, the product of their factors, so that it can learn a pair, say an
insult with a mention of a group, that says more than its two terms, which additive weights can't.

It is fitted by minibatch AdaGrad on a bounded sample of the labelled rows (about `sample` of them, dealt by a
hash of the id), in one task, copies of a text counting once. Terms enter if their documents' labels are further
from the sample's share than chance makes likely (EVIDENCE standard deviations). Only the model, of no more than
TERMS_KEPT terms, travels to the tasks that score. Every document is scored, over its whole text.

Defined cases: null and empty texts have no terms and get the score of the bias; null labels are not learned
from; with no labelled rows every score is 0; a document with several label rows counts once for each; repeated
rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsengine.llm.common import crc_mod, filter_rows, give_back, map_rows, require_small, staged

TERMS = re.compile(r"[^\W\d_]+")
STEM = 4
BUCKETS = 1 << 22
SAMPLE = 20_000
BROADCAST = 200_000  # drawn labels, of 12 bytes each
FACTORS, EPOCHS, BATCH, RATE = 4, 30, 128, 0.1
PENALTY, EVIDENCE, TERMS_KEPT = 1e-4, 3.5, 1 << 15
THRESHOLD = 0.5
SEED = 7

Model = tuple[float, np.ndarray, np.ndarray, np.ndarray]  # bias; terms, ascending; their weights; their factors


@lru_cache(maxsize=1 << 16)
def buckets(word: str) -> tuple[int, ...]:
    found = [word] if len(word) < STEM + 2 else [word, f"{word[:STEM]}-"]
    return tuple(xxhash.xxh64_intdigest(t, SEED) % BUCKETS for t in found)


def forget() -> None:
    """Drops the words that a task has met; its worker goes on to other tasks and stages."""
    buckets.cache_clear()


def terms_of(text: str | None) -> np.ndarray:
    """The text's set of terms, ascending."""
    found = set(chain.from_iterable(map(buckets, set(TERMS.findall((text or "").lower())))))
    return np.sort(np.fromiter(found, np.int32, len(found)))


def _sums(values: np.ndarray, starts: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Sums of the parts of values that begin at starts; parts that aren't filled sum to zero."""
    out = np.zeros((len(starts), *values.shape[1:]))
    if filled.any():
        out[filled] = np.add.reduceat(values, starts[filled], axis=0)
    return out


def raw_scores(bias: float, weights: np.ndarray, factors: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The machine's output for documents whose terms' places are laid end to end in `at`; and the sums of their factors."""
    starts, filled = np.cumsum(sizes) - sizes, sizes > 0
    v = factors[at]
    total = _sums(v, starts, filled)
    pairs = 0.5 * (total**2 - _sums(v * v, starts, filled)).sum(1)
    return bias + _sums(weights[at], starts, filled) + pairs, total


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def telling_terms(documents: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The terms, ascending, whose documents' labels differ from the share of all by more than chance."""
    times, toxic = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS)  # 48 MB, however many documents and terms they have
    for document, label in zip(documents, labels):
        times[document] += 1
        toxic[document] += label
    terms = np.flatnonzero(times).astype(np.int32)
    times, toxic = times[terms], toxic[terms]
    share = labels.mean() if len(labels) else 0.0
    evidence = abs(toxic - share * times) / np.sqrt(share * (1 - share) * times + 0.5)
    return np.sort(terms[np.argsort(-evidence, kind="stable")[: min(TERMS_KEPT, int((evidence > EVIDENCE).sum()))]])


def fit(documents: list[np.ndarray], labels: np.ndarray) -> Model:
    """Trains on sets of terms, equal ones with equal labels once, whatever their order."""
    return fit_distinct({(d.tobytes(), float(y)) for d, y in zip(documents, labels)})


def fit_distinct(rows: set[tuple[bytes, float]]) -> Model:
    """The same for sets of terms as bytes with their labels, which are not copied."""
    distinct = sorted(rows)
    documents, labels = [np.frombuffer(d, np.int32) for d, _ in distinct], np.array([y for _, y in distinct])
    terms = telling_terms(documents, labels)
    rng = np.random.default_rng(SEED)
    weights, factors = np.zeros(len(terms)), rng.normal(0, 0.02, (len(terms), FACTORS))
    places = [np.searchsorted(terms, np.intersect1d(d, terms)) for d in documents]
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    bias = float(np.log(share / (1 - share)))
    seen_w, seen_v, seen_b = np.full(len(terms), 1e-6), np.full(factors.shape, 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(places))
        for b in range(0, len(order), BATCH):
            batch = order[b : b + BATCH]
            at, sizes = np.concatenate([places[i] for i in batch]), np.array([len(places[i]) for i in batch])
            score, total = raw_scores(bias, weights, factors, at, sizes)
            error = (sigmoid(score) - labels[batch]) / len(batch)
            by_term = np.repeat(error, sizes)
            used = np.unique(at)
            near = np.searchsorted(used, at)
            slope = by_term[:, None] * (np.repeat(total, sizes, axis=0) - factors[at])
            g_w = np.bincount(near, by_term, len(used)).astype(float)
            g_v = np.stack([np.bincount(near, slope[:, k], len(used)) for k in range(FACTORS)], 1) + PENALTY * factors[used]
            seen_w[used] += g_w**2
            seen_v[used] += g_v**2
            seen_b += error.sum() ** 2
            pace = RATE / np.sqrt(seen_w[used])
            moved = weights[used] - pace * g_w
            weights[used] = np.sign(moved) * np.maximum(0, abs(moved) - pace * PENALTY)
            factors[used] -= RATE / 4 / np.sqrt(seen_v[used]) * g_v
            bias -= RATE / np.sqrt(seen_b) * error.sum()
    kept = (weights != 0) | (abs(factors).max(1, initial=0) > 0.05)
    return bias, terms[kept], weights[kept], factors[kept]


def learn(docs: DataFrame, labels: DataFrame, label_column: str = "toxic", folds: int = 5, held: int = 0, sample: int = SAMPLE) -> Model:
    """The model of a sample of the labelled rows whose fold isn't the held-out one."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_column).cast("int").alias("label"))
        .dropna()
        .filter(crc_mod("doc_id", folds) != held)
    )
    share = min(1.0, sample / max(1, known.count()))
    drawn = known.filter((F.xxhash64("doc_id") / 2.0**64 + 0.5) < share)  # about `sample` rows: small enough to broadcast
    drawn = staged(drawn.distinct(), "toxicity-labels")
    require_small(drawn.count(), BROADCAST, "drawn labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")

    def featurize(part: dict[str, list]) -> dict[str, list]:
        return {"label": part["label"], "terms": [terms_of(t).tobytes() for t in part["text"]]}

    rows = map_rows(texts.select("label", "text"), featurize, "label int, terms binary", done=forget)
    staged_rows = staged(rows.distinct(), "toxicity-sample")  # repeated rows are one
    kept = min(1.0, 2 * sample / max(1, staged_rows.count()))  # under 1 only where ids have many different texts
    staged_rows = staged_rows.filter((F.xxhash64("label", "terms") / 2.0**64 + 0.5) < kept)

    def train(batches):
        held_rows = {(terms, float(label)) for b in batches for label, terms in zip(*(c.to_pylist() for c in b.columns))}
        if held_rows:
            bias, terms, weights, factors = fit_distinct(held_rows)  # the same model however rows were dealt out
            held_rows.clear()
            names = ["bias", "terms", "weights", "factors"]
            columns = [pa.array([x]) for x in (bias, terms.tolist(), weights.tolist(), factors.ravel().tolist())]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, kinds)], names)
        give_back()

    kinds = [pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
    schema = "bias double, terms array<long>, weights array<double>, factors array<double>"
    found = staged_rows.repartition(1).mapInArrow(train, schema).collect()
    if not found:
        return -30.0, np.empty(0, np.int64), np.empty(0), np.empty((0, FACTORS))
    r = found[0]
    return r.bias, np.array(r.terms, np.int64), np.array(r.weights), np.array(r.factors).reshape(-1, FACTORS)


def score(texts: list[str | None], model: Model) -> np.ndarray:
    bias, terms, weights, factors = model
    sets = [terms_of(t) for t in texts]
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate([*sets, np.empty(0, np.int32)]).astype(np.int64)
    at = np.minimum(np.searchsorted(terms, flat), max(0, len(terms) - 1))
    known = terms[at] == flat if len(terms) else np.zeros(len(flat), bool)
    counts = np.bincount(np.repeat(np.arange(len(sets)), sizes)[known], minlength=len(sets))
    raw, _ = raw_scores(bias, weights, factors, at[known], counts)
    return np.round(sigmoid(raw), 6)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    model = learn(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 5) == 0).alias("held_out"), "text")

    def run(part: dict[str, list]) -> dict[str, list]:
        found = score(part["text"], model)
        return {"doc_id": part["doc_id"], "held_out": part["held_out"], "score": found, "predicted": (found >= THRESHOLD).astype(int)}

    return map_rows(rows, run, "doc_id long, held_out boolean, score double, predicted int", done=forget)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, without the toxic ones."""
    model = learn(docs, labels)
    return filter_rows(docs, "text", lambda texts: (score(texts, model) < THRESHOLD).tolist(), 512, forget)
