"""Substring dedup: paragraphs, MinHash banding, exact Jaccard, components of what repeats.

Paragraphs are of two kinds. *Lines* of at least SHINGLE words are compared as sets of five-word shingles, and so
is what short lines make together: a run of lines of under LONG_WORDS words, up to a blank or longer line, whole and cut at
content-defined ends (the smallest shingle hash of JOIN to each side), wherever its lines are broken.
BANDS bands of ROWS minhashes (recall at a similarity of 0.8: 1 - (1 - 0.8 ** 4) ** 10, over 0.99) name candidates,
whose exact Jaccard similarity then has to reach SIMILARITY. *Windows* find passages inside other text: a
window is SPAN shingles from an anchor, and anchors are the smallest shingle hashes of every GAP in a row, so that
they fall on the same places of a passage wherever it stands. Any passage of GAP + SPAN + 3 = 51 words that two
documents share holds one whole window of both, whatever surrounds it. Windows have one band, their whole content: at
their size a single changed word already takes the similarity below 0.8. Windows that continue each other in both documents are
one passage. All passages have their words compared with the kept occurrence's (128 bits) and are extended as far as those
to both sides agree too (under GAP words, as more would hold another window; 64 bits of each word's bytes).

Equal paragraphs are one class from the start. In a band's bucket each class is first compared with the bucket's
smallest and largest, which joins most of a hot bucket in linear time. Of the classes of a bucket that are still in
several clusters, those of different clusters are compared that share one of their rarest shingles: sets of n and of no more
than n shingles that have a similarity of 0.8 share one of the (n - ceil(4n / 5) + 1) and (m - ceil(8m / 9) + 1) rarest
(prefix filter), and their sketches of 256 bits differ in no more bits than the sets in shingles, so that no link of a bucket is lost. Classes similar by any chain of links are one cluster (connected
components). Of each cluster that occurs in several documents the
occurrence with the smallest (doc_id, version, place) stays and the others are removed; removals that touch are one span.

Words are runs of anything but space and \\t to \\r, A-Z lower-cased. Defined cases: null and empty texts have no
paragraphs; rows with a null id are left alone; rows that share an id and a text count as one document, so repeating a row
removes nothing; rows that share an id only are documents of their own, told apart by `version`, 31 bits of the text's hash;
within ties the smallest place stays; an empty table gives an empty result. Lines of under SHINGLE words have no shingles and go
only inside of a longer passage. Equal lines are those with the same 128 bits of their words' bytes: half of them are a line's name,
the other half is compared, and lines of one name that differ there are named by it instead.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsengine.llm.common import dropped, map_rows, slices, staged
from obsengine.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
GAP, SPAN = 32, 16
BANDS, ROWS = 10, 4
LONG_WORDS, JOIN = 50, 30
M = np.uint64(0x9E3779B97F4A7C15)
POWERS = np.array([pow(int(M), SPAN - 1 - k, 1 << 64) for k in range(SPAN)], np.uint64)
PIECE = 1 << 19
SPACE = re.compile(rb"[\t-\r ]")
IN_WORD = np.array([not SPACE.match(bytes([b])) for b in range(256)])
BYTE_HASHES = np.array([xxhash.xxh64_intdigest(bytes([b]), 5) for b in range(256)], np.uint64) * IN_WORD
FEW, OWN_BITS = 32, 44
SKETCH = ("s0", "s1", "s2", "s3")
PARAGRAPHS = "doc_id long, version int, start int, words int, node long, check long, n int, s0 long, s1 long, s2 long, s3 long, bands array<long>"
KEPT = "kept_doc_id long, kept_version int, kept_start int"
ANSWERS = f"doc_id long, version int, start int, words int, node long, {KEPT}, shingles binary, content binary, before binary, after binary"
DOCUMENT = ("doc_id", "version")
KEPT_PLACE = tuple(f.split()[0] for f in KEPT.split(", "))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


@lru_cache(2)
def _factors(n: int) -> np.ndarray:
    """What a byte's hash is multiplied by at the places 0 to n - 1 of a word: mixed, not powers, under which some long words would meet."""
    return _mix(_mix(np.arange(1, n + 1, dtype=np.uint64) * M)) | np.uint64(1)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of data, and where they start.

    A word's hash is a sum of its bytes' hashes, each times its place's factor. Texts are cut at white space into pieces of
    about PIECE bytes.
    """
    hashes, starts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(data):
        gap = SPACE.search(data, at + PIECE)
        letters = np.frombuffer(data[at : gap.start() if gap else len(data)], np.uint8)
        inside = IN_WORD[letters]
        first = np.flatnonzero(inside[1:] > inside[:-1]) + 1
        if inside[0]:
            first = np.concatenate([[0], first])
        if len(first):
            place = np.arange(first[0], len(letters)) - np.repeat(first, np.concatenate([first[1:], [len(letters)]]) - first)
            factors = _factors(1 << max(12, int(place.max()).bit_length()))
            hashes.append(_mix(np.add.reduceat(BYTE_HASHES[letters[first[0] :]] * factors[place], first - first[0])))
            starts.append(first + at)
        at += len(letters)
    return np.concatenate(hashes), np.concatenate(starts)


def shingles_of(w: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of words, of which w has the hashes."""
    n = max(0, len(w) - SHINGLE + 1)
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        total = total * M + w[k : k + n]
    return _mix(total)


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    return shingles_of(word_hashes(b" ".join(words))[0])


def _sliding(take, x: np.ndarray, width: int) -> np.ndarray:
    """take (minimum or maximum) over every `width` in a row, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = take(x[:-step], x[step:])
        done += step
    return x


def anchors(h: np.ndarray) -> np.ndarray:
    """Places that are the minimum of some GAP shingles in a row."""
    if len(h) < GAP:
        return np.flatnonzero(h == h.min()) if len(h) else np.empty(0, np.int64)
    least = _sliding(np.minimum, h, GAP)
    padded = np.concatenate([np.zeros(GAP - 1, np.uint64), least, np.zeros(GAP - 1, np.uint64)])
    return np.flatnonzero(_sliding(np.maximum, padded, GAP) == h)


def windows(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows and their contents' hashes."""
    at = anchors(h)
    at = at[at + SPAN <= len(h)]
    return at, _mix((h[at[:, None] + np.arange(SPAN)] * POWERS).sum(1, dtype=np.uint64))


def bands_of(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(paragraphs, BANDS) keys of the paragraphs' shingles, which begin at starts and end where the next begins."""
    rng = np.random.default_rng(17)
    keys = []
    for band in range(BANDS):
        key = np.full(len(starts), band, np.uint64)
        for _ in range(ROWS):
            a, b = (np.uint64(x) for x in rng.integers(0, 1 << 63, 2, dtype=np.uint64))
            key = key * M + np.minimum.reduceat((h ^ b) * (a | np.uint64(1)), starts)
        keys.append(_mix(key))
    return np.stack(keys, 1).view(np.int64)


def short_runs(sizes: list[int]) -> list[tuple[int, int]]:
    """(first word, end) of two or more lines of under LONG_WORDS words in a row, none of them blank. sizes: words of each line."""
    out, first, at, lines = [], 0, 0, 0
    for n in [*sizes, 0]:
        if 0 < n < LONG_WORDS:
            lines += 1
        else:
            if lines > 1:
                out.append((first, at))
            first, lines = at + n, 0
        at += n
    return out


def joined_parts(h: np.ndarray, first: int, end: int) -> list[tuple[int, int]]:
    """(first word, end) of the parts of a run of words, between its places that are the minimum of JOIN shingles to each side."""
    mine = h[first : max(first, end - SHINGLE + 1)]
    ends = np.empty(0, np.int64)
    if len(mine) > 2 * JOIN:
        ends = np.flatnonzero(_sliding(np.minimum, mine, 2 * JOIN + 1) == mine[JOIN:-JOIN]) + JOIN
        ends = ends[ends - np.concatenate([[-JOIN - 1], ends[:-1]]) > JOIN] + first
    cuts = [first, *ends.tolist(), end]
    return list(zip(cuts, cuts[1:]))


def content_of(words: list[bytes]) -> bytes:
    return xxhash.xxh128_digest(b" ".join(words), 3)


def names_of(words: list[bytes]) -> bytes:
    """64 bits of the bytes of each word."""
    return b"".join(map(xxhash.xxh3_64_digest, words))


def shingle_set(h: np.ndarray) -> bytes:
    return np.unique(h).astype("<u8").tobytes()


def sizes_and_sketches(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sets, whose shingles stand one after the other: the numbers of different shingles and (sets, 4) words of sketches.

    A sketch has 256 bits, each telling whether an odd number of the set's shingles falls on it. Shingles are told apart
    by OWN_BITS bits of their hashes here, under which there is room for 2 ** (64 - OWN_BITS) sets at a time.
    """
    room = 1 << 64 - OWN_BITS
    if len(sizes) > room:
        at = int(sizes[:room].sum())
        parts = sizes_and_sketches(h[:at], sizes[:room]), sizes_and_sketches(h[at:], sizes[room:])
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    owner = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    keys = np.sort(owner << np.uint64(OWN_BITS) | h & np.uint64((1 << OWN_BITS) - 1))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    h, owner = keys, (keys >> np.uint64(OWN_BITS)).astype(np.int64)
    odd = np.bincount(owner * 256 + (h & np.uint64(255)).astype(np.int64), minlength=256 * len(sizes)) & 1
    return np.bincount(owner, minlength=len(sizes)), np.packbits(odd.astype(np.uint8).reshape(-1, 256), axis=1).view("<i8")


def paragraphs(texts: list[str | None]) -> list[tuple[np.ndarray, ...]]:
    """Columns of the texts' paragraphs: the text's place in the list, first word, words, node; for lines check, n, sketch and bands too."""
    places, starts, nodes, lines, names, parts = [], [], [], [], [], []
    for i, text in enumerate(texts):
        data = (text or "").encode().lower()
        w, at = word_hashes(data)
        if len(w) < SHINGLE:
            continue
        h = shingles_of(w)
        plain = b" ".join(data.split())
        word_at = np.cumsum(IN_WORD[np.frombuffer(data, np.uint8)])[at] - 1 + np.arange(len(at))  # where words are in plain
        word_at = np.append(word_at, len(plain) + 1)
        breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == ord("\n"))
        ends = np.append(np.searchsorted(at, breaks), len(w))
        counts = (ends - np.concatenate([[0], ends[:-1]])).tolist()
        at, contents = windows(h)
        places.append(np.full(len(at), i))
        starts.append(at)
        nodes.append(contents)
        spans = {(end - n, end) for n, end in zip(counts, ends.tolist())}
        spans.update(part for run in short_runs(counts) for part in [run, *joined_parts(h, *run)])
        for first, end in sorted(spans):
            if end - first >= SHINGLE:
                lines.append((i, first, end - first))
                names.append(xxhash.xxh128_digest(plain[word_at[first] : word_at[end] - 1], 3))
                parts.append(h[first : end - SHINGLE + 1])
    n = sum(map(len, starts))
    i, first, size = (np.array(x, np.int64) for x in zip(*lines)) if lines else [np.empty(0, np.int64)] * 3
    node, check = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2).T
    lengths, h = np.array([len(p) for p in parts], np.int64), np.concatenate(parts) if parts else np.empty(0, np.uint64)
    keys = bands_of(h, np.cumsum(lengths) - lengths) if parts else np.empty((0, BANDS), np.int64)
    sets, sketches = sizes_and_sketches(h, lengths) if parts else (np.empty(0, np.int64), np.empty((0, len(SKETCH)), np.int64))
    used = np.where(sets > 3, BANDS, 1)  # sets of up to three are similar to equal sets only, which share every band
    keys = keys[np.arange(BANDS) < used[:, None]]
    offsets = np.concatenate([np.zeros(n + 1, np.int64), np.cumsum(used)]).astype(np.int32)
    of_window = np.arange(n + len(lines)) < n

    def lines_only(values: np.ndarray) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(n, np.int64), values]), mask=of_window)

    return [
        np.concatenate([*places, i]).astype(np.int64),
        np.concatenate([*starts, first]).astype(np.int32),
        np.concatenate([np.full(n, SPAN + SHINGLE - 1), size]).astype(np.int32),
        np.concatenate([*(x.view(np.int64) for x in nodes), node]),
        lines_only(check),
        lines_only(sets),
        *(lines_only(sketches[:, k]) for k in range(len(SKETCH))),
        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys), mask=pa.array(of_window)),
    ]


def version_of(text: Column) -> Column:
    """What tells apart texts that share an id."""
    return F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def documents(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, version, text) of the rows with an id."""
    text = F.col(text_column)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), version_of(text).alias("version"), text.alias("text")).filter("doc_id IS NOT NULL")


def paragraph_table(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """PARAGRAPHS of all texts, as a written table."""
    names = [f.split()[0] for f in PARAGRAPHS.split(", ")]

    def run(part: dict[str, list]) -> dict[str, list]:
        place, *others = paragraphs(part["text"])
        ids, versions = np.array(part["doc_id"], np.int64), np.array(part["version"], np.int32)
        return dict(zip(names, (ids[place], versions[place], *others)))

    return staged(map_rows(documents(docs, id_column, text_column), run, PARAGRAPHS, 128), "paragraphs")


def renamed(lines: DataFrame, clashes: DataFrame) -> DataFrame:
    """lines, those of the nodes in clashes named by their check. Hardly any are: the join is with an empty table as a rule."""
    found = lines.join(clashes.select("node", F.lit(True).alias("_clash")), "node", "left")
    return found.withColumn("node", F.expr("if(_clash, check, node)")).drop("_clash", "check")


def bucket_members(nodes: DataFrame) -> DataFrame:
    """(key, node, low, high, size): the nodes of buckets that hold several, with the bucket's smallest and largest, as a written table."""
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    edges = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("size")).filter("low < high")
    edges = staged(edges, "line-buckets")
    members = staged(keyed.join(edges, "key"), "line-members")
    dropped(edges)
    return members


def may_be_similar(u: str = "_u", v: str = "_v") -> str:
    """SQL: neither the sizes nor the sketches of two sets rule out the similarity."""
    unlike = " + ".join(f"bit_count({x}{u} ^ {x}{v})" for x in SKETCH)
    return f"5 * least(n{u}, n{v}) >= 4 * greatest(n{u}, n{v}) AND 9 * ({unlike}) <= n{u} + n{v}"


def _of(side: str, nodes: DataFrame, *more: str) -> DataFrame:
    """Columns of nodes, named for one side of a pair."""
    return nodes.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("n", *SKETCH)), *more)


def first_pairs(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v), as a written table: the pairs of a bucket that may be similar; of a large bucket those with its ends.

    The ends make all pairs of a bucket of up to three, as most are, and bands share these pairs, so that they are looked at once.
    """
    middling = (F.col("size") > 3) & (F.col("size") <= FEW)
    small = staged(members.filter(middling).select("key", "node").join(nodes.drop("bands"), "node"), "line-small")
    met = _of("u", small, "key").join(_of("v", small, "key"), "key").filter("u < v").filter(may_be_similar()).select("u", "v")
    ends = staged(bucket_ends(members.filter(~middling)), "line-ends")
    far = ends.join(_of("u", nodes), "u").join(_of("v", nodes), "v").filter(may_be_similar()).select("u", "v")
    pairs = staged(met.union(far).distinct(), "line-pairs")
    dropped(small, ends)
    return pairs


def bucket_ends(members: DataFrame) -> DataFrame:
    """(u, v): every node with the smallest and the largest of its buckets, so that pairs grow with the nodes."""
    ends = members.select("node", F.explode(F.array("low", "high")).alias("end"))
    return ends.select(F.least("node", "end").alias("u"), F.greatest("node", "end").alias("v")).filter("u < v").distinct()


def still_apart(keyed: DataFrame, roots: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v): the pairs of a bucket that are in different clusters and share one of their first shingles, as a written table.

    keyed: (key, node, low, high). A bucket's largest cluster meets its other nodes only.
    """
    found = staged(keyed.join(roots, "node", "left").select(keyed["*"], F.coalesce("root", "node").alias("root")), "line-roots")
    sizes = found.groupBy("key", "root").agg(F.count("*").alias("often"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("often", "root"))["root"].alias("largest"), F.count("*").alias("roots")).filter("roots > 1")
    mixed = staged(mixed.select("key", "largest"), "line-mixed")
    apart = staged(found.join(mixed, "key").selectExpr("key", "node", "low", "high", "root", "root = largest AS large"), "line-apart")
    keys = staged(apart.groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("keys")), "line-keys")  # BANDS at most
    tokens = staged(first_shingles(apart, sets, nodes).join(keys, "node"), "line-tokens")
    more = ("key", "token", "root", "large", "at", "firsts", "keys")
    wide, narrow = _of("u", tokens, *more), _of("v", tokens.filter("at < n - (8 * n + 8) div 9 + 1"), *more)
    for c in more[2:]:
        wide, narrow = wide.withColumnRenamed(c, f"{c}_u"), narrow.withColumnRenamed(c, f"{c}_v")
    met = wide.join(narrow.filter("NOT large_v"), ["key", "token"]).union(wide.filter("NOT large_u").join(narrow.filter("large_v"), ["key", "token"]))
    enough = "9 * least(n_u - at_u, n_v - at_v) >= 4 * (n_u + n_v)"  # what the first common shingle leaves, itself included
    once = "token = array_intersect(firsts_u, firsts_v)[0] AND key = array_intersect(keys_u, keys_v)[0]"  # under the first that both have
    pairs = met.filter(f"root_u != root_v AND n_v <= n_u AND {enough} AND {may_be_similar()} AND {once}")
    pairs = staged(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "line-pairs")
    dropped(found, mixed, apart, keys, tokens)
    return pairs


def first_shingles(apart: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """apart with n, sketch, and a row (at, token, firsts) for each of a node's first shingles, as many as a prefix needs."""
    for end in ("low", "high"):
        apart = apart.join(sets.select(F.col("node").alias(end), F.col("shingles").alias(f"{end}_shingles")), end)
    rows = apart.join(nodes.select("node", "n", *SKETCH), "node").join(sets, "node")
    names = ["key", "node", "root", "large", "n", *SKETCH]

    def run(batches):
        for batch in batches:
            sides = [[np.frombuffer(x, "<u8") for x in batch.column(len(names) + i).to_pylist()] for i in range(3)]
            firsts = []
            for own, low, high in zip(*sides):
                common = np.isin(own, low) | np.isin(own, high)
                firsts.append(np.concatenate([own[~common], own[common]])[: len(own) - (4 * len(own) + 4) // 5 + 1])
            sizes = np.array([len(x) for x in firsts], np.int64)
            part = pa.RecordBatch.from_arrays(batch.columns[: len(names)], names).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            lists = pa.array(firsts, pa.list_(pa.uint64())).cast(pa.list_(pa.int64()), safe=False).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            at = np.concatenate([np.arange(n) for n in sizes]) if len(sizes) else sizes
            token = np.concatenate(firsts).view(np.int64) if len(sizes) else sizes
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(at, pa.int32()), pa.array(token, pa.int64()), lists], [*names, "at", "token", "firsts"])

    schema = "key long, node long, root long, large boolean, n int, s0 long, s1 long, s2 long, s3 long, at int, token long, firsts array<long>"
    return rows.select(*names, "shingles", "low_shingles", "high_shingles").mapInArrow(run, schema)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of lines, named by their contents' hashes, that have a Jaccard similarity of SIMILARITY."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    both = both.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")

    def verify(batches):
        for batch in batches:
            u, v, a, b = (c.to_pylist() for c in batch.columns)
            kept = [i for i in range(len(u)) if jaccard(a[i], b[i]) >= SIMILARITY]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in kept], pa.int64()) for x in (u, v)], ["u", "v"])

    return both.select("u", "v", "a", "b").mapInArrow(verify, "u long, v long")


def asked_lines(lines: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, version, start, words, node, edge, kept place): one occurrence of each node of the pairs and of large buckets."""
    wanted = members.filter(F.col("size") > FEW).select("node").union(pairs.select("u")).union(pairs.select("v")).distinct()
    found = lines.join(wanted, "node", "left_semi").dropDuplicates(["node"])
    return found.select(*DOCUMENT, "start", "words", "node", F.lit(False).alias("edge"), *nowhere())


def nowhere() -> list[Column]:
    """The kept place of what is no removal."""
    return [F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in KEPT.split(", ")]


def answers(asked: DataFrame, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """ANSWERS to (doc_id, version, start, words, node, edge, kept place), as a written table, from one join with the texts.

    Lines, which have a node, get their shingles. Spans, which have none, get 128 bits of their words' hash and, if they
    are at an edge, the names of the GAP - 1 words before, nearest first, and after. Without a column edge none is. A removal's
    answer has its kept place, as it was asked. What is asked of one document is no more than twice
    the paragraphs it has. It is answered once, however often the document's row is repeated.
    """
    edge = (F.col("edge") if "edge" in asked.columns else F.lit(False)).alias("edge")
    kept = KEPT_PLACE if "kept_doc_id" in asked.columns else nowhere()
    by_doc = asked.groupBy(*DOCUMENT).agg(F.collect_set(F.struct("start", "words", "node", edge, *kept)).alias("asked"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 64):
                yield pa.RecordBatch.from_arrays(*answered(part))

    texts = documents(docs, id_column, text_column).join(by_doc, list(DOCUMENT)).dropDuplicates(list(DOCUMENT))  # on the join's own partitions and order
    return staged(texts.select(*DOCUMENT, "text", "asked").mapInArrow(run, ANSWERS), "answers")


def answered(part: pa.RecordBatch) -> tuple[list[pa.Array], list[str]]:
    """ANSWERS to a slice of (doc_id, version, text, asked), as columns and their names. What was asked is sent back as it came."""
    doc_id, version, texts, asked = part.columns
    sizes = np.diff(asked.offsets)
    questions = asked.flatten()
    first, words, node, edge, *kept = questions.flatten()
    starts, ends = (x.to_numpy().tolist() for x in (first, pc.add(first, words)))
    of_line, edges = node.is_valid().to_pylist(), edge.to_pylist()
    shingles, contents, before, after = ([None] * len(questions) for _ in range(4))
    at = 0
    for text, n in zip(texts.to_pylist(), sizes.tolist()):
        mine = range(at, at + n)
        at += n
        data = (text or "").encode().lower()
        h = shingles_of(word_hashes(data)[0]) if any(of_line[k] for k in mine) else None
        words_of = [] if all(of_line[k] for k in mine) else data.split()
        for k in mine:
            start, end = starts[k], ends[k]
            if of_line[k]:
                shingles[k] = shingle_set(h[start : end - SHINGLE + 1])
                continue
            contents[k], before[k], after[k] = content_of(words_of[start:end]), b"", b""
            if edges[k]:
                before[k], after[k] = names_of(words_of[max(0, start - GAP + 1) : start][::-1]), names_of(words_of[end : end + GAP - 1])
    owner = pa.array(np.repeat(np.arange(len(sizes)), sizes))
    told = [pa.array(x, pa.binary()) for x in (shingles, contents, before, after)]
    return [doc_id.take(owner), version.take(owner), first, words, node, *kept, *told], [f.split()[0] for f in ANSWERS.split(", ")]


def clustered(members: DataFrame, pairs: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root): the components of all links between lines that share a band.

    pairs: first_pairs(); sets: (node, shingles) of the pairs and of large buckets.
    """
    stars = components(verified(pairs, sets), "lines-by-pairs")
    rest = still_apart(members.filter(F.col("size") > FEW).drop("size"), stars, sets, nodes)
    return components(stars.select(F.col("node").alias("u"), F.col("root").alias("v")).union(verified(rest, sets)), "lines")


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common)


def _repeats(occurrences: DataFrame, cluster: str) -> DataFrame:
    """The occurrences of clusters in several documents, as a written table.

    Clusters are written before a join, and so is its result: Spark splits a hot cluster only in a join of two plain
    shuffles that is a stage of its own.
    """
    least = [f(c).alias(f"{n}_{c}") for c in DOCUMENT for n, f in (("low", F.min), ("high", F.max))]
    several = occurrences.groupBy(cluster).agg(*least).filter("low_doc_id < high_doc_id OR low_version < high_version").select(cluster)
    several = staged(several, "clusters")
    found = staged(occurrences.join(several, cluster), "repeats")
    dropped(several)
    return found


def _removals(occurrences: DataFrame, cluster: str) -> DataFrame:
    """The occurrences of clusters in several documents, without each cluster's first and what overlaps it in its document, as a written table."""
    found = _repeats(occurrences, cluster)
    place = F.struct(*DOCUMENT, "start", (-F.col("words")).alias("less"))
    kept = staged(found.groupBy(cluster).agg(F.min(place).alias("kept")), "kept")
    others = "doc_id != kept.doc_id OR version != kept.version OR start >= kept.start - kept.less OR start + words <= kept.start"
    out = found.join(kept, cluster).filter(others).select(
        *DOCUMENT, "start", (F.col("start") + F.col("words")).alias("end"), *(F.col(f"kept.{c}").alias(f"kept_{c}") for c in (*DOCUMENT, "start"))
    )
    out = staged(out, "removals")
    dropped(found, kept)
    return out


def aligned(removals: DataFrame) -> DataFrame:
    """(document, start, words, kept document, kept_start): windows that overlap, and do so in the kept document too, as one span."""
    shifted = removals.withColumn("shift", F.col("start") - F.col("kept_start"))
    keys = (*DOCUMENT, "kept_doc_id", "kept_version", "shift")
    spans = numbered_spans(shifted.repartition(*DOCUMENT), *keys).groupBy(*keys, "span")  # dealt once, for at_ends() too
    spans = spans.agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("words"))
    return spans.select(*DOCUMENT, "start", "words", "kept_doc_id", "kept_version", (F.col("start") - F.col("shift")).alias("kept_start"))


def at_ends(spans: DataFrame) -> DataFrame:
    """spans with `edge`: whether one could outgrow what it makes together with those that it overlaps or touches."""
    placed = numbered_spans(spans.withColumn("end", F.col("start") + F.col("words")), *DOCUMENT)
    block = Window.partitionBy(*DOCUMENT, "span")
    edge = (F.col("start") - F.min("start").over(block) < GAP) | (F.max("end").over(block) - F.col("end") < GAP)
    return placed.withColumn("edge", edge).select(*spans.columns, "edge")


def asked_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, version, start, words, node, edge, kept place) of the spans and, once each and without a kept place, of what they repeat."""
    place, no_node = [*DOCUMENT, "start", "words"], F.lit(None).cast("long").alias("node")
    kept = spans.groupBy(*KEPT_PLACE, "words").agg(F.max("edge").alias("edge")).toDF(*place, "edge")
    return spans.select(*place, no_node, "edge", *KEPT_PLACE).union(kept.select(*place, no_node, "edge", *nowhere()))


def extended(around: DataFrame) -> DataFrame:
    """Removals (document, start, end, kept_doc_id): the spans with the words to both sides that the kept occurrence has too.

    around: answers to asked_spans(), those with a kept place being the spans. In the kept document itself a span does not
    grow into the kept occurrence. Spans whose own words are not the kept ones (windows are joined by 64 bits) are none.
    """
    sides = ("content", "before", "after")
    spans = around.filter("kept_doc_id IS NOT NULL").select(*DOCUMENT, "start", "words", *KEPT_PLACE, *sides)
    kept = around.filter("kept_doc_id IS NULL").select(*DOCUMENT, "start", "words", *sides)
    kept = kept.toDF(*KEPT_PLACE, "words", *(f"kept_{c}" for c in sides))
    both = spans.join(kept, [*KEPT_PLACE, "words"]).filter("content = kept_content")
    names = [*DOCUMENT, "start", "words", "kept_doc_id", "kept_version", "kept_start"]

    def run(batches):
        for batch in batches:
            one, two, far_one, far_two = (batch.column(len(names) + i).to_pylist() for i in range(4))
            grown = [pa.array(_common(x, y), pa.int32()) for x, y in ((one, far_one), (two, far_two))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *grown], [*names, "before", "after"])

    fields = ", ".join(f"{n} {'long' if n.endswith('id') else 'int'}" for n in [*names, "before", "after"])
    found = both.select(*names, "before", "after", "kept_before", "kept_after").mapInArrow(run, fields)
    room = "if(doc_id = kept_doc_id AND version = kept_version, greatest(0, start - kept_start - words - after), before)"
    return found.selectExpr(*DOCUMENT, f"start - least(before, {room}) AS start", "start + words + after AS end", "kept_doc_id")


def _common(one: list[bytes], two: list[bytes]) -> np.ndarray:
    """How many of the first words, by their names, are the same, for each pair."""
    x, y = (np.frombuffer(b"".join(h.ljust(8 * GAP, fill) for h in side), "<u8").reshape(-1, GAP) for side, fill in ((one, b"\0"), (two, b"\1")))
    return np.logical_and.accumulate(x == y, axis=1).sum(1, dtype=np.int32)


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, start_word, n_words, kept_doc_id, version): what to remove of each document; the smallest document that keeps it."""
    table = paragraph_table(docs, id_column, text_column)
    found = _removals(table.filter("bands IS NULL").drop("bands"), "node")
    spans = staged(at_ends(aligned(found)), "window-spans")
    lines = table.filter("bands IS NOT NULL")
    named = staged(lines.select("node", "check", "n", *SKETCH, "bands").dropDuplicates(["node", "check"]), "line-nodes")  # copies of a line are one
    clashes = staged(named.groupBy("node").count().filter("count > 1").select("node"), "line-clashes")
    nodes, written = renamed(named, clashes), staged(lines.select(*DOCUMENT, "start", "words", "node", "check"), "lines")
    lines = renamed(written, clashes)
    dropped(found, table)
    members = bucket_members(nodes)
    pairs = first_pairs(members, nodes)
    told = answers(asked_lines(lines, members, pairs).union(asked_spans(spans)), docs, id_column, text_column)
    dropped(spans)
    around = told.filter("node IS NULL")
    sets = staged(told.filter("node IS NOT NULL").select("node", "shingles"), "line-shingles")
    roots = clustered(members, pairs, sets, nodes)
    dropped(members, pairs, sets, named)
    occurrences = lines.join(roots, "node", "left").select(*DOCUMENT, "start", "words", F.coalesce("root", "node").alias("cluster"))
    occurrences = staged(occurrences, "line-clusters")
    dropped(written, clashes)
    whole = _removals(occurrences, "cluster")
    dropped(occurrences)
    removed = staged(extended(around).union(whole.select(*DOCUMENT, "start", "end", "kept_doc_id")), "removed")  # the widest join, when little else is left
    dropped(whole, told)
    return merged(removed)


def numbered_spans(removed: DataFrame, *keys: str) -> DataFrame:
    """removed with `span`: the number, among those of its keys, of what overlaps or touches. A window holds one document's removals."""
    by_key = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(by_key.rowsBetween(Window.unboundedPreceding, -1))
    marked = removed.withColumn("fresh", F.when(F.col("start") <= reach, 0).otherwise(1))
    return marked.withColumn("span", F.sum("fresh").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))


def merged(removed: DataFrame) -> DataFrame:
    """Removals (document, start, end, kept_doc_id) that overlap or touch, as one span."""
    return numbered_spans(removed, *DOCUMENT).groupBy(*DOCUMENT, "span").agg(
        F.min("start").alias("start_word"), (F.max("end") - F.min("start")).alias("n_words"), F.min("kept_doc_id").alias("kept_doc_id")
    ).select("doc_id", "start_word", "n_words", "kept_doc_id", "version")


def cut(text: str | None, spans: list[tuple[int, int]] | None) -> str | None:
    """text without the words of spans (first, number), and without the white space before each of those words."""
    if not text or not spans:
        return text
    data = text.encode()
    kept, at, word = [], 0, 0
    gone = np.zeros(len(data.split()), bool)
    for first, n in spans:
        gone[first : first + n] = True
    for piece in data.split():
        start = data.index(piece, at)
        if not gone[word]:
            kept.append(data[at : start + len(piece)])
        at, word = start + len(piece), word + 1
    return (b"".join(kept) + data[at:]).decode()


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs, all columns, their texts without the repeated spans."""
    names, at, key = docs.columns, docs.columns.index(text_column), docs.columns.index(id_column)
    spans = repeated_spans(docs, id_column, text_column)
    by_doc = spans.groupBy(F.col("doc_id").alias("_id"), F.col("version").alias("_version")).agg(F.collect_list(F.struct("start_word", "n_words")).alias("_spans"))
    numbered = docs.toDF(*(f"c{i}" for i in range(len(names))))
    same = (numbered[f"c{key}"].cast("long") == F.col("_id")) & (version_of(numbered[f"c{at}"]) == F.col("_version"))
    joined = numbered.join(by_doc, same, "left").drop("_id", "_version")
    target = numbered.schema

    def run(batches):
        for batch in batches:
            spans_of = batch.column(batch.num_columns - 1).to_pylist()
            texts = [cut(t, s and [(x["start_word"], x["n_words"]) for x in s]) for t, s in zip(batch.column(at).to_pylist(), spans_of)]
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return joined.mapInArrow(run, target).toDF(*names)
