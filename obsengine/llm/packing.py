"""Best-fit packing of token sequences: a configuration LP over the histogram of lengths.

A configuration says how many pieces of each length share a sequence. The linear program (cover every length's
count with as few sequences as possible) is solved by multiplicative weights: each length has a price that
falls as it gets covered, a knapsack dynamic program over the capacity finds the configurations of (almost) the
highest price, and these are used a step further. What is used is then rounded down to whole sequences, and what is left of the histogram
goes best fit, longest first.

Only the histogram, at most `capacity` counts, comes to the driver, and only the list of configurations (no more
than ROUNDS for each length, and what best fit adds, whatever the number of documents) goes to the tasks. Texts are tokenized once, in place; pieces are never grouped: a piece's
rank among those of its length is its rank in its task, plus the counts of the tasks before, and from
its rank follow its sequence and place.

Defined cases: a null or empty text is the end token alone; repeated rows are packed each; null ids stay null;
an empty table gives an empty packing.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsengine.llm import bpe
from obsengine.llm.common import give_back, map_rows, require_small, staged

ROUNDS, STEP, SLACK, RATE = 600, 0.1, 0.001, 0.05
CONFIGURATIONS = 1_000_000
LONG_TEXT = 1 << 15
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def knapsack(prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to the capacity: the highest total price of lengths that fit, and the last of them (0: none)."""
    room = len(prices) - 1
    best, last = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for c in range(1, room + 1):
        total = best[c - 1 :: -1] + prices[1 : c + 1] if c > 1 else best[:1] + prices[1:2]
        k = int(total.argmax())
        if total[k] > best[c - 1]:
            best[c], last[c] = total[k], k + 1
        else:
            best[c] = best[c - 1]
    return best, last


def unwind(best: np.ndarray, last: np.ndarray, room: int, left: np.ndarray | None = None) -> dict[int, int]:
    """The lengths that make best[room], with how many of each; with `left`, no more of any than are left."""
    found: dict[int, int] = {}
    while room > 0:
        length = int(last[room])
        if not length:
            room -= 1
        elif left is not None and found.get(length, 0) >= left[length]:
            room -= 1
        else:
            found[length] = found.get(length, 0) + 1
            room -= length
    return found


def configuration_lp(counts: np.ndarray) -> dict[tuple[tuple[int, int], ...], float]:
    """Configurations, as (length, number) pairs, and how often to use each, in fractions; no length is covered twice.

    Prices start at the lengths themselves (a full sequence is worth the capacity), less a little for each
    piece, so that of equally full ones those of few pieces come first.
    """
    capacity = len(counts) - 1
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return {}
    worth = np.where(counts > 0, np.arange(capacity + 1) - 0.02, 0)
    covered = np.zeros(capacity + 1)
    used: dict[tuple[tuple[int, int], ...], float] = {}
    for _ in range(ROUNDS):
        prices = worth * np.exp(RATE * np.clip(covered[lengths].mean() - covered, -100, 100))
        best, last = knapsack(prices)
        value = prices[lengths] + best[capacity - lengths]
        for length in lengths[value >= (1 - SLACK) * value.max()].tolist():
            fill = unwind(best, last, capacity - length)
            fill[length] = fill.get(length, 0) + 1
            step = STEP * min(counts[x] / k for x, k in fill.items())
            for x, k in fill.items():
                covered[x] += k * step / counts[x]
            key = tuple(sorted(fill.items(), reverse=True))
            used[key] = used.get(key, 0.0) + step
    share = np.average(covered[lengths], weights=(counts * np.arange(capacity + 1))[lengths])
    return {key: amount / share for key, amount in used.items()}


def best_fit(left: np.ndarray) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit, longest first, of a whole histogram: sequences alike are one entry, however many there are."""
    capacity = len(left) - 1
    open_: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]  # by room: contents and how many
    for length in np.flatnonzero(left)[::-1].tolist():
        need = int(left[length])
        for room in range(length, capacity):
            while need and open_[room]:
                inside, many = open_[room].popitem()
                fit = room // length
                take = min(many, need // fit)
                if take:
                    key = inside + (length,) * fit
                    open_[room - fit * length][key] = open_[room - fit * length].get(key, 0) + take
                    need -= take * fit
                if take < many:
                    if need and need < fit:
                        key = inside + (length,) * need
                        open_[room - need * length][key] = open_[room - need * length].get(key, 0) + 1
                        need, take = 0, take + 1
                    if take < many:
                        open_[room][inside] = many - take
                        if need == 0:
                            break
            if not need:
                break
        fit = capacity // length
        for take, each in ((need // fit, fit), (int(need % fit > 0), need % fit)):
            if take:
                key = (length,) * each
                room = capacity - each * length
                open_[room][key] = open_[room].get(key, 0) + take
    return [(tuple((x, inside.count(x)) for x in sorted(set(inside), reverse=True)), n) for o in open_ for inside, n in o.items()]


def configurations(counts: np.ndarray) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Whole sequences that hold exactly counts[length] pieces of each length: (configuration, how many)."""
    left, out = counts.copy(), []
    for pattern, amount in configuration_lp(counts).items():
        if (times := min([int(amount), *(int(left[x]) // k for x, k in pattern)])) > 0:
            out.append((pattern, times))
            for x, k in pattern:
                left[x] -= k * times
    return out + best_fit(left)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary file's ranks as a tiktoken encoding: the same ids, several times faster."""
    codec = bpe.merges(path)
    special = set(codec.special.values())
    ranks = {data: i for i, data in enumerate(codec.bytes_of) if i not in special}
    return tiktoken.Encoding("packing", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens=codec.special)


def token_ids(text: str | None, path: str) -> np.ndarray:
    """Long texts go through the streaming encoder, which needs no more than its window."""
    if text and len(text) > LONG_TEXT:
        return np.frombuffer(bpe.encode(text, bpe.merges(path)), "<u4")
    return tokenizer(path).encode_to_numpy(text or "", allowed_special="all").astype("<u4")


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """The PIECES of every document; nth: the piece's rank among those of its length in the task `part`, as stored."""
    rows = docs.select("doc_id", "text")

    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                docs_of, texts = (c.slice(at, 256).to_pylist() for c in batch.columns)
                out = []
                for doc, text in zip(docs_of, texts, strict=True):
                    ids = np.append(token_ids(text, path), np.array([end_id], "<u4"))
                    bounds = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                    for n, (a, b) in enumerate(zip(bounds, bounds[1:])):
                        out.append((doc, n, a, b - a, zlib.crc32(ids[a:b].tobytes()), part, int(seen[b - a])))
                        seen[b - a] += 1
                columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names)
        give_back()

    names = [f.split()[0] for f in PIECES.split(", ")]
    kinds = [pa.int32() if f.endswith(" int") else pa.int64() for f in PIECES.split(", ")]
    return rows.mapInArrow(run, PIECES)


def places(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Slots by length: from which rank on, the first sequence, slots in each, and the place of the first slot."""
    found = configurations(counts)
    require_small(len(found), CONFIGURATIONS, "configurations")
    taken, sequence, rows = np.zeros(len(counts), np.int64), 0, []
    for pattern, times in found:
        offset = 0
        for length, k in pattern:
            rows.append((length, int(taken[length]), sequence, k, offset))
            taken[length] += k * times
            offset += length * k
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    names = ("length", "from_rank", "sequence", "slots", "offset")
    return {n: table[:, i] for i, n in enumerate(names)} | {"starts": np.searchsorted(table[:, 0], np.arange(len(counts) + 1))}


def packed(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    cut = staged(pieces(rows, path, capacity, end_id), "pieces")
    by_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most `capacity` rows
        counts[length] = n
    slots = places(counts)
    ranked = cut.join(before, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank")
    )

    def run(part: dict[str, list]) -> dict[str, list]:
        length, rank = np.array(part["length"], np.int64), np.array(part["rank"], np.int64)
        at = np.empty(len(length), np.int64)
        for x in np.unique(length):
            a, b = slots["starts"][x], slots["starts"][x + 1]
            mine = length == x
            at[mine] = a + np.searchsorted(slots["from_rank"][a:b], rank[mine], "right") - 1
        copy, slot = np.divmod(rank - slots["from_rank"][at], slots["slots"][at])
        keep = {n: part[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
        return keep | {"sequence_id": slots["sequence"][at] + copy, "offset": slots["offset"][at] + slot * length}

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return map_rows(ranked, run, schema, 1 << 16)
