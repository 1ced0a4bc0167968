"""Quality rules as a bitmask ledger: measure once, store failure bits, decide later.

`ledger` reads every text once and stores, for each document, its measurements and one failure bit
per rule. Policies are versioned sets of rules; applying one, or asking what it would do without
some rule, only combines stored bits (`apply_policy`, `ablations`) and never reads text again.

Defined cases: a null text has no words and fails `few_words`; an empty text likewise; repeated rows
each get a row; null ids stay null; an empty table gives an empty ledger; of the input only the two
named columns are read, so further columns and their names don't matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsengine.llm.common import map_rows

SYMBOLS = "#*$%&|<>"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
LOWER = bytes(range(ord("a"), ord("z") + 1))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower")

#: Rule name to SQL over the measurements, true where the rule fails. A rule's bit is its place here; append only.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "shouting": "n_upper > n_lower",
}
BASE = ("few_words", "repeated_words")
#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "v1": ("few_words", "repeated_words", "symbols"),
    "v2": ("few_words", "repeated_words", "word_length", "symbols", "duplicate_lines", "shouting"),
}


def mask(rules: tuple[str, ...]) -> int:
    places = list(RULES)
    return sum(1 << places.index(r) for r in rules)


def repeated_words(words: list[bytes]) -> int:
    """Words inside a three-word window that occurs twice or more, its first occurrence included."""
    if len(words) < 4:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.array([codes.setdefault(w, len(codes)) for w in words], np.int64)
    pairs = ids[:-1] * len(codes) + ids[1:]
    if len(codes) > 1 << 20:  # keeps the third factor inside 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, at, times = np.unique(pairs[:-1] * len(codes) + ids[2:], return_inverse=True, return_counts=True)
    again = times[at] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(again) + k] |= again
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of one text; words are runs of anything but space and \\t to \\r."""
    text = text or ""
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.split(None, 1)]
    blanks = sum(map(text.count, " \t\n\v\f\r"))
    return (
        len(words),
        len(text) - blanks,
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(data) - len(data.translate(None, UPPER)),
        len(data) - len(data.translate(None, LOWER)),
    )


def ledger(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, the MEASURES, failures): bit k of failures is set where rule k of RULES fails."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))

    def run(part: dict[str, list]) -> dict[str, list]:
        found = [measure(t) for t in part["text"]]
        return {"doc_id": part["doc_id"]} | {m: [f[i] for f in found] for i, m in enumerate(MEASURES)}

    measured = map_rows(rows, run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = sum((F.expr(sql).cast("long") * F.lit(1 << i) for i, sql in enumerate(RULES.values())), F.lit(0).cast("long"))
    return measured.withColumn("failures", bits)


def rejected(rules: tuple[str, ...]) -> Column:
    return F.col("failures").bitwiseAND(F.lit(mask(rules)).cast("long")) != 0


def apply_policy(entries: DataFrame, version: str) -> DataFrame:
    """entries with base_failed and the policy's verdict, kept."""
    return entries.withColumns({"base_failed": rejected(BASE), "kept": ~rejected(BASE) & ~rejected(POLICIES[version])})


def ablations(entries: DataFrame, version: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects, and kept without it.

    The ledger is first counted by its failure bits, of which there are at most 2 ** len(RULES) values.
    """
    counts = entries.groupBy("failures").agg(F.count("*").alias("n"))
    policy = mask(POLICIES[version])
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).cast("long").alias("bit")) for r in POLICIES[version]))
    failed = F.col("failures").bitwiseAND(F.lit(policy).cast("long"))
    others = failed.bitwiseAND(F.bitwise_not("bit"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return (
        counts.select("failures", "n", F.inline(rules))
        .groupBy("rule")
        .agg(
            total(failed.bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
            total(failed == F.col("bit")).alias("n_only"),
            total(failed == 0).alias("n_kept"),
            total(others == 0).alias("n_kept_without"),
        )
    )


_POLICY = ", ".join(f"('{r}', {mask((r,))})" for r in POLICIES["v2"])

ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents),
w AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM d),
t AS (SELECT rid, pos, w, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM w WINDOW p AS (PARTITION BY rid ORDER BY pos)),
r AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, w, w2, w3) AS n FROM t WHERE w3 IS NOT NULL),
c AS (SELECT rid, count(DISTINCT pos + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY rid),
m AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower
  FROM d LEFT JOIN c USING (rid)),
b AS (SELECT *, ({" + ".join(f"({sql})::BIGINT * {1 << i}" for i, sql in enumerate(RULES.values()))}) AS failures FROM m)
SELECT *, (failures & {mask(BASE)}) <> 0 AS base_failed,
       (failures & {mask(BASE) | mask(POLICIES["v2"])}) = 0 AS kept
FROM b"""
ABLATIONS_SQL = f"""
SELECT rule, count(*) FILTER (WHERE (failures & bit) <> 0)::BIGINT AS n_failed,
       count(*) FILTER (WHERE (failures & {mask(POLICIES["v2"])}) = bit)::BIGINT AS n_only,
       count(*) FILTER (WHERE (failures & {mask(POLICIES["v2"])}) = 0)::BIGINT AS n_kept,
       count(*) FILTER (WHERE (failures & {mask(POLICIES["v2"])} & ~bit) = 0)::BIGINT AS n_kept_without
FROM ({ORACLE_SQL}) AS judged CROSS JOIN (VALUES {_POLICY}) AS r(rule, bit) GROUP BY rule"""
