"""A Merkle manifest of a dataset, made and verified in Pregel-style RDD supersteps.

Rows are leaves: a digest of their fields. The leaves of each group (here: each language), in order of id, hang
under parents of eight; what remains of every group hangs under one root the same way. Going up, every node messages its
digest to its parent in each superstep, and a parent that has all its children hashes them and messages its own.
Going back, every parent sends each child what the child needs to get to the root alone: the digests of its
siblings, and the path that the parent itself was sent. At the leaves, a row as it is claimed to be is folded along its
path and compared with the root.

A vertex knows its group, its index, and how many nodes its level has, so it knows how many children to wait for.
Its key is (group, index), and no parent has more than eight children, so a group with most of the rows spreads
like any other. An index is a rank: that of a row in its task of a table dealt out by ranges, plus the rows of the tasks
before, so no group is ever sorted in one place. Every level is a written table: a lost executor costs a part of one
superstep. There are as many supersteps as a tree of the largest group has levels, and levels shrink by eight.

Defined cases: null fields are `-`; rows with a null id come first, and a null group is a group, the first; rows that share
an id are ordered by their digests; repeated rows are leaves each; a group of one row has that leaf as its subroot; a leaf
without any siblings has the proof of an empty text; an empty table gives an empty manifest; columns that are not named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsengine.llm.common import dropped, map_rows, staged

FAN = 8
#: Rows of a task of a superstep, and the most tasks of one, so that the driver can keep track of them.
TASK_ROWS, MOST_TASKS = 50_000, 20_000
VERTEX = "tree long, node long, size long, digest string, children array<string>, ids array<long>, claims array<string>"
MANIFEST = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
#: A path: for each level up to the root, the place among the children of its parent, and its siblings.
Path = list[tuple[int, list[str]]]
PATH = "array<struct<place: int, siblings: array<string>>>"


def joined_digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(fields: list[bytes | None]) -> str:
    """Each field as its byte count, a colon and its bytes, or `-`."""
    return hashlib.sha256(b"".join(b"-" if f is None else b"%d:%b" % (len(f), f) for f in fields)).hexdigest()


def proof(path: Path) -> str:
    return joined_digest([s for _, siblings in path for s in siblings])


def folded(digest: str, path: Path) -> str:
    """The root that a leaf has along a path."""
    for place, siblings in path:
        digest = joined_digest([*siblings[:place], digest, *siblings[place:]])
    return digest


def tasks(rows: int) -> int:
    return min(MOST_TASKS, 1 + rows // TASK_ROWS)


def digests(docs: DataFrame, id_column: str, tree_column: str, fields: list[str], suspect: Column, claim: Callable[[list], list]) -> DataFrame:
    """(tree_key, id, digest, claim): the digest of each row and of what it is claimed to be, which differ only in suspect rows.

    A narrow map. tree_key orders as the group does, bytewise, null first.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(tree_column).cast("string")), F.lit(""))
    named = [F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(fields)]
    rows = docs.select(key.alias("tree_key"), F.col(id_column).cast("long").alias("id"), F.coalesce(suspect, F.lit(False)).alias("suspect"), *named)

    def run(part: dict[str, list]) -> dict[str, list]:
        columns = [[None if v is None else v.encode() for v in part[f"f{i}"]] for i in range(len(fields))]
        values = [list(v) for v in zip(*columns, strict=True)]
        found = [leaf_digest(v) for v in values]
        claims = [leaf_digest(claim(v)) if s else d for v, d, s in zip(values, found, part["suspect"], strict=True)]
        return {"tree_key": part["tree_key"], "id": part["id"], "digest": found, "claim": claims}

    return map_rows(rows, run, "tree_key string, id long, digest string, claim string")


def indexed(rows: DataFrame, group: str, order: list[str], count: int, name: str) -> DataFrame:
    """rows (a written table) with node, the rank by `order` in the group from 0, and size, the group's rows.

    Ranges are dealt out by group, order and place in the table, so equal rows and hot groups split.
    """
    keys = [group, *order, "_at"]
    dealt = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(tasks(count), *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    placed = staged(dealt.drop("_at").select("*", at.alias("_at"), F.spark_partition_id().alias("_part")), name)
    by_part = placed.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = by_part.select(group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("size"))
    out = placed.join(starts, [group, "_part"]).withColumn("node", F.col("_at") + F.col("_shift"))
    out = staged(out.drop("_at", "_part", "_shift"), name)
    dropped(placed)
    return out


def climbed(leaves: DataFrame, count: int, largest: int, name: str) -> list[DataFrame]:
    """The levels of every tree, leaves first, up to where the largest tree has one node. One superstep for each."""
    levels = [leaves]
    while largest > 1:
        last, lowest, largest = levels[-1], len(levels) == 1, -(-largest // FAN)
        columns = ["tree", "node", "size", "digest", *(["id", "claim"] if lowest else [])]
        count = -(-count // FAN)
        sent = last.filter("size > 1").select(*columns).rdd.map(
            lambda v: ((v.tree, v.node // FAN), (v.node % FAN, v.digest, v.size, *v[4:]))
        )

        def complete(box: tuple[tuple[int, int], Iterator[tuple]], lowest: bool = lowest) -> tuple:
            (tree, index), got = box[0], sorted(box[1], key=lambda m: m[0])
            size = got[0][2]
            if [m[0] for m in got] != list(range(min(FAN, size - FAN * index))):
                raise ValueError(f"node {index} of tree {tree} was sent {len(got)} children of a level of {size}")
            children = [m[1] for m in got]
            ids, claims = ([m[3] for m in got], [m[4] for m in got]) if lowest else ([], [])
            return tree, index, -(-size // FAN), joined_digest(children), children, ids, claims

        made = leaves.sparkSession.createDataFrame(sent.groupByKey(tasks(count)).map(complete), VERTEX, verifySchema=False)
        levels.append(staged(made, f"{name}-{len(levels)}"))
    return levels


def _paths(met: tuple) -> Iterator[tuple[int, Path]]:
    """For each child of a vertex that has been sent its path: the child's place and path."""
    children, path = met
    for place in range(len(children)):
        yield place, [(place, children[:place] + children[place + 1 :]), *path]


def descended(levels: list[DataFrame], starts: DataFrame, count: int) -> RDD:
    """Reverse supersteps: (root of its tree, path, digest, id, claim, tree, node) for every leaf.

    starts: (tree, level, root, path) of the last node of each tree, as the trees above have sent it.
    """
    begun = lambda k: starts.filter(F.col("level") == k).rdd.map(lambda s: ((s.tree, 0), ([s.root, s.subroot], [tuple(x) for x in s.path])))
    lone = levels[0].filter("size = 1").select("tree", "digest", "id", "claim").rdd.map(lambda v: ((v.tree, 0), (v.digest, v.id, v.claim)))
    found = lone.join(begun(0), tasks(0)).map(lambda m: (*m[1][1], *m[1][0], *m[0]))
    sent = None
    for k in range(len(levels) - 1, 0, -1):
        sent = begun(k) if sent is None else sent.union(begun(k))
        vertices = levels[k].rdd.map(lambda v: ((v.tree, v.node), (v.children, v.ids, v.claims)))
        met = vertices.join(sent, tasks(count // FAN**k))
        if k > 1:
            sent = met.flatMap(lambda m: (((m[0][0], m[0][1] * FAN + n), (m[1][1][0], path)) for n, path in _paths((m[1][0][0], m[1][1][1]))))
        else:
            found = found.union(met.flatMap(_leaves))
    return found


def _leaves(met: tuple) -> Iterator[tuple]:
    (tree, node), ((children, ids, claims), (roots, path)) = met
    for n, own in _paths((children, path)):
        yield roots, own, children[n], ids[n], claims[n], tree, node * FAN + n


def manifest(docs: DataFrame, fields: list[str], id_column: str = "doc_id", tree_column: str = "lang", suspect: Column | None = None, claim: Callable[[list], list] = list) -> DataFrame:
    """MANIFEST, a written table: each row's leaf, its group's subroot, the root, the digest of its siblings, and whether what it is claimed to be leads to the root.

    claim: from the fields of a suspect row, as bytes, to what they are claimed to be.
    """
    spark = docs.sparkSession
    rows = staged(digests(docs, id_column, tree_column, fields, F.lit(False) if suspect is None else suspect, claim), "merkle-digests")
    count = rows.count()
    if not count:
        return spark.createDataFrame([], MANIFEST)
    ordered = indexed(rows, "tree_key", ["id", "digest"], count, "merkle-leaves")
    keys = staged(ordered.filter("node = 0").select(F.lit(0).alias("all"), "tree_key"), "merkle-trees")
    n_trees = keys.count()
    numbers = indexed(keys, "all", ["tree_key"], n_trees, "merkle-trees")
    numbered = ordered.join(numbers.select("tree_key", F.col("node").alias("tree")), "tree_key")
    leaves = staged(numbered.select("tree", "node", "size", "digest", "id", "claim"), "merkle-leaves")
    dropped(rows, ordered, keys, numbers)

    largest = leaves.agg(F.max("size")).first()[0]
    levels = climbed(leaves, count, largest, "merkle-level")
    roots = [level.filter("size = 1").select("tree", "digest", F.lit(k).alias("level")) for k, level in enumerate(levels)]
    subroots = roots[0]
    for more in roots[1:]:
        subroots = subroots.union(more)
    above = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("node"), F.lit(n_trees).cast("long").alias("size"), "digest", F.col("level").cast("long").alias("id"), F.lit(None).cast("string").alias("claim"))
    tops = climbed(staged(above, "merkle-subroots"), n_trees, n_trees, "merkle-top")

    last = tops[-1].select("tree", F.lit(len(tops) - 1).alias("level"), F.col("digest").alias("root"), F.lit("").alias("subroot"), F.expr(f"CAST(array() AS {PATH})").alias("path"))
    begun = descended(tops, last, n_trees).map(lambda s: (s[6], s[3], s[0][0], s[2], s[1]))
    starts = staged(spark.createDataFrame(begun, f"tree long, level long, root string, subroot string, path {PATH}", verifySchema=False), "merkle-starts")
    found = descended(levels, starts, count).map(_row)
    out = staged(spark.createDataFrame(found, MANIFEST, verifySchema=False), "merkle-manifest")
    dropped(*levels, *tops, starts)
    return out


def _row(found: tuple) -> tuple:
    (root, subroot), path, leaf, doc_id, claim, _, _ = found
    reached = folded(claim, path)
    return doc_id, leaf, subroot, root, proof(path), reached, reached == root


#: Of documents, as the query takes them.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def lower_cased_text(values: list[bytes | None]) -> list[bytes | None]:
    """FIELDS with A-Z of the text in lower case."""
    return [*values[:4], None if values[4] is None else values[4].lower()]


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents, where every third one by crc32 of its id is claimed in lower case. A null id is never suspect."""
    suspect = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(docs, FIELDS, suspect=suspect, claim=lower_cased_text)


#: crc32 by its bits. Levels in one recursion for the groups and one for the subroots; each claimed leaf climbs along them.
ORACLE_SQL = """
WITH RECURSIVE d AS (
  SELECT *, row_number() OVER () AS r, doc_id IS NOT NULL AND xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 3 = 0 AS bad FROM documents),
f AS (SELECT r, doc_id, lang, bad, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END
  || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
  || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS head, text FROM d),
h AS (SELECT r, doc_id, lang, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
  CASE WHEN bad THEN sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END) END AS claim FROM f),
g AS (SELECT dense_rank() OVER (ORDER BY lang NULLS FIRST) AS t, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, r, doc_id, leaf, coalesce(claim, leaf) AS claim FROM h),
nodes AS (SELECT t, 0 AS k, i, n, leaf AS x FROM g
  UNION ALL SELECT t, k + 1, i // 8, (n + 7) // 8, sha256(string_agg(x, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY t, k, i // 8, n),
subs AS (SELECT t, k AS depth, x FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS k, t - 1 AS i, count(*) OVER () AS n, x FROM subs
  UNION ALL SELECT k + 1, i // 8, (n + 7) // 8, sha256(string_agg(x, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY k, i // 8, n),
every AS (SELECT t, k, i, n, x FROM nodes WHERE n > 1 UNION ALL SELECT s.t, s.depth + o.k, o.i, o.n, o.x FROM tops o, subs s WHERE o.n > 1),
climb AS (SELECT g.r, g.t, 0 AS k, CASE WHEN s.depth = 0 THEN g.t - 1 ELSE g.i END AS i, g.claim AS y, '' AS p FROM g JOIN subs s USING (t)
  UNION ALL SELECT c.r, c.t, c.k + 1, CASE WHEN any_value(s.depth) = c.k + 1 THEN c.t - 1 ELSE c.i // 8 END,
    sha256(string_agg(CASE WHEN e.i = c.i THEN c.y ELSE e.x END, '' ORDER BY e.i)), c.p || coalesce(string_agg(e.x, '' ORDER BY e.i) FILTER (e.i != c.i), '')
  FROM climb c JOIN every e ON e.t = c.t AND e.k = c.k AND e.i // 8 = c.i // 8 JOIN subs s ON s.t = c.t GROUP BY c.r, c.t, c.k, c.i, c.y, c.p),
reached AS (SELECT r, arg_max(y, k) AS y, arg_max(p, k) AS p FROM climb GROUP BY r)
SELECT g.doc_id, g.leaf, s.x AS subroot, o.x AS root, sha256(q.p) AS proof_sha256, q.y AS folded_root, q.y = o.x AS verified
FROM g JOIN subs s USING (t) JOIN reached q USING (r) JOIN tops o ON o.n = 1"""
