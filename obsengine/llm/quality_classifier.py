"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated isotonically.

Each text is reduced to a few statistics, once, in a staged table; all else works on that. Standardized
statistics x become z(x) = sqrt(2 / D) cos(x W + b) with Gaussian W, whose inner products approximate a Gaussian
kernel; every task sums z z' and z y over its labelled rows, the sums are added up, and the driver solves the one
D x D system. A further fold's raw scores, counted in bins, fit the isotonic (pool adjacent violators) map from raw
score to the share of good documents.

Of the folds of crc32(doc_id) mod 4, 2 is held out, 3 calibrates and 0 and 1 fit. All labelled rows are used.

Defined cases: null and empty texts have statistics of zero and are scored like any other; null labels are not
learned from; with no rows to fit every score is 0.5 (with none to calibrate, the raw score clipped to 0 to 1); a
document with several label rows counts once for each; repeated rows are scored each; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsengine.llm.common import crc_mod, map_rows, staged
from obsengine.llm.quality_rules import measure

STATISTICS = (
    "log_words", "word_chars", "symbols", "dup_lines", "repeated", "upper", "letters", "digits", "unique", "log_line",
    "stops", "commas", "shouts", "bars",
)
FEATURES, BANDWIDTH, RIDGE, SEED = 192, 3.0, 1e-4, 11
SUMS, SUMMERS = "part long, total binary", 64
BIN = 1000
THRESHOLD = 0.7
DIGITS = b"0123456789"


def statistics(text: str | None) -> list[float]:
    text = text or ""
    n, chars, symbols, dup, repeated, lines, upper, lower = measure(text)
    if not n:
        return [0.0] * len(STATISTICS)
    data = text.encode()
    high = len(data) - len(text)  # bytes beyond one a character: letters with marks, mostly
    return [
        math.log1p(n),
        chars / n,
        symbols / n,
        dup / max(1, lines),
        repeated / n,
        upper / (upper + lower + 1),
        (upper + lower + high) / max(1, chars),
        (len(data) - len(data.translate(None, DIGITS))) / max(1, chars),
        len(set(data.split())) / n,
        math.log1p(n / max(1, lines)),
        text.count(".") / n,
        text.count(",") / n,
        text.count("!") / n,
        text.count("|") / n,
    ]


def fourier(x: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    w = rng.normal(0, 1 / BANDWIDTH, (len(STATISTICS), FEATURES))
    b = rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.sqrt(2 / FEATURES) * np.cos(np.clip((x - mean) / deviation, -6, 6) @ w + b)
    return np.concatenate([z, np.ones((len(x), 1))], axis=1)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(rows, lambda p: {"doc_id": p["doc_id"], "x": [statistics(t) for t in p["text"]]}, "doc_id long, x array<double>")


def normal_equations(labelled: DataFrame, mean: np.ndarray, deviation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over (x, label) rows: z z' and z y."""
    width = FEATURES + 1

    def run(batches):
        total = np.zeros((width, width + 1))
        for batch in batches:
            if batch.num_rows:
                z = fourier(np.array(batch.column(0).to_pylist()), mean, deviation)
                total += z.T @ np.column_stack([z, batch.column(1).to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()])], ["part", "total"])

    def add(batches):
        total = np.zeros((width, width + 1))
        for batch in batches:
            for data in batch.column(1).to_pylist():
                total += np.frombuffer(data).reshape(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tobytes()])], ["part", "total"])

    sums = labelled.select("x", "label").mapInArrow(run, SUMS)
    sums = sums.repartition(SUMMERS, "part").mapInArrow(add, SUMS)  # a tree: no task adds more than its share of the tasks' sums
    total = np.frombuffer(sums.repartition(1).mapInArrow(add, SUMS).first()["total"]).reshape(width, width + 1)
    return total[:, :-1], total[:, -1]


def isotonic(scores: np.ndarray, weights: np.ndarray, goods: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins ascending by score: knots of the map, at each block's mean score."""
    blocks: list[list[float]] = []
    for s, n, g in zip(scores, weights, goods):
        blocks.append([s * n, n, g])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    found = np.array(blocks).reshape(-1, 3)
    return found[:, 0] / found[:, 1], found[:, 2] / found[:, 1]


def learn(known: DataFrame, labels: DataFrame, label_column: str = "quality") -> Callable[[np.ndarray], np.ndarray]:
    """From rows of statistics to scores, learned from the labelled rows of `known` that aren't held out."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_column).cast("double").alias("label")).dropna()
    rows = known.join(named, "doc_id").withColumn("fold", crc_mod("doc_id", 4)).filter("fold != 2")
    labelled = staged(rows.select("x", "label", "fold"), "quality-labelled")
    fitting = labelled.filter("fold < 2")
    at = range(len(STATISTICS))
    s = fitting.agg(
        F.array(*(F.avg(F.col("x")[i]) for i in at)).alias("mean"), F.array(*(F.stddev_pop(F.col("x")[i]) for i in at)).alias("dev"), F.count("*").alias("n")
    ).first()
    if not s.n:
        return lambda x: np.full(len(x), 0.5)
    mean, deviation = np.array(s.mean), np.maximum(s.dev, 1e-9)
    gram, target = normal_equations(fitting, mean, deviation)
    penalty = RIDGE * s.n * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-9
    w = np.linalg.solve(gram + penalty, target)

    def raw(x: np.ndarray) -> np.ndarray:
        return np.clip(np.round((fourier(x, mean, deviation) * w).sum(1), 6), -1, 2)

    def bins(part: dict[str, list]) -> dict[str, list]:
        return {"bin": np.rint(BIN * raw(np.array(part["x"]).reshape(-1, len(STATISTICS)))).astype(int), "label": part["label"]}

    counted = map_rows(labelled.filter("fold = 3").select("x", "label"), bins, "bin int, label double", 4096)
    found = sorted(counted.groupBy("bin").agg(F.count("*"), F.sum("label")).collect())  # no more than 3 * BIN + 1
    if not found:
        return lambda x: np.clip(raw(x), 0, 1)
    at_score, share = isotonic(*np.array(found, float).T * np.array([[1 / BIN], [1], [1]]))
    return lambda x: np.round(np.interp(raw(x), at_score, share), 6)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    known = staged(measured(docs), "quality-statistics")
    scorer = learn(known, labels)
    rows = known.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "x")

    def run(part: dict[str, list]) -> dict[str, list]:
        found = scorer(np.array(part["x"]).reshape(-1, len(STATISTICS)))
        return {"doc_id": part["doc_id"], "held_out": part["held_out"], "score": found, "predicted": (found >= THRESHOLD).astype(int)}

    return map_rows(rows, run, "doc_id long, held_out boolean, score double, predicted int", 4096)
