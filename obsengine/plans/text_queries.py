"""Queries on text: retrieval, grounding, gates, routing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from obsengine.functions import text as t
from obsengine.functions import vectors as v
from obsengine.operators import retrieval
from obsengine.plans.common import table

HINTS = ("the", "license", "of", "this", "work", "der")
ROUTES = {"R1": ("helmet", "the"), "R2": ("vest", "que"), "R4": ("near", "ung")}


def lexical_topk(spark, sf_dir):
    return retrieval.lexical_top(table(spark, sf_dir, "benchmark"), "item_id", table(spark, sf_dir, "documents"), "doc_id", 5)


def label_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e, e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))


def topk_dense(spark, sf_dir):
    e, asked = label_vectors(spark, sf_dir)
    scored = retrieval.dense(asked, "label", e, "vec_id").withColumn("score", F.round("score", 6))
    return retrieval.top(scored, "label", "vec_id", 5)


def mmr_rerank(spark, sf_dir):
    e, asked = label_vectors(spark, sf_dir)
    hits = retrieval.top(retrieval.dense(asked, "label", e, "vec_id").withColumn("score", F.round("score", 9)), "label", "vec_id", 10)
    return retrieval.diverse(hits.join(e.select("vec_id", "embedding"), "vec_id"), "label", "vec_id", 5).drop("score")


def hybrid_search(spark, sf_dir):
    """Benchmark passages looked up in documents by terms and vectors; every fourth has no vector, nor have documents beyond the embeddings."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    mine = vectors.select(F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 4 != 3, F.col("embedding")).alias("embedding"))
    asked = table(spark, sf_dir, "benchmark").select("item_id", "text").join(mine, "item_id", "left")
    found = retrieval.searched(asked, "item_id", table(spark, sf_dir, "documents"), vectors, "doc_id", 5)
    return found.withColumn("score", F.round("score", 9))


def hint_score(spark, sf_dir):
    shares = retrieval.hint_shares(F.col("text"))
    given = F.round(retrieval.hint_share(F.col("text"), HINTS), 6).alias("score")
    return table(spark, sf_dir, "documents").select("doc_id", given, *(F.round(c, 6).alias(rule) for rule, c in shares.items()))


def turns(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(w))


def grounding_overlap(spark, sf_dir):
    share = t.overlap(t.tokens(F.col("text")), t.tokens(F.col("before")))
    return turns(spark, sf_dir).select("conv_id", "turn", F.round(share, 6).alias("overlap"), (share < 0.08).alias("flagged"))


def sentence_grounded(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", retrieval.grounded(F.col("text"), F.col("before")).alias("grounded"))


def bigram_jaccard(spark, sf_dir):
    pair = t.jaccard(t.ngrams(t.tokens(F.col("text")), 2), t.ngrams(t.tokens(F.col("before")), 2))
    return turns(spark, sf_dir).select("conv_id", "turn", F.round(pair, 6).alias("similarity"))


def text_gate_failures(spark, sf_dir):
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.size(t.tokens(text))
    gates = {
        "length": ~words.between(8, 2000),
        "citation": text.rlike(r"(?i)licen[cs]e"),
        "authority": text.rlike("GNU|MIT|Apache"),
        "numbers": text.rlike("[0-9]{3}"),
    }
    named = table(spark, sf_dir, "documents").select("doc_id", "lang", t.failures(gates).alias("failed"))
    return named.select("lang", F.explode_outer("failed").alias("failure")).groupBy("lang", "failure").agg(F.count("*").alias("n"))


def question_router(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    legal = t.mentions(F.col("text"), ("illegal", "lawsuit", "nd the", "liable"))
    route = F.when(F.trim("text") == "", "empty").when(legal, "refused").otherwise(F.coalesce(t.routed(F.col("text"), ROUTES), F.lit("counts")))
    return c.select("conv_id", "turn", route.alias("route"))


def token_counts(spark, sf_dir):
    words = t.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(words).alias("n_tokens"), F.size(t.without(words)).alias("n_terms"), F.size(t.ngrams(words, 3)).alias("n_trigrams")
    )


def html_escape_report(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(t.html_escaped(F.col("html")), 256).alias("escaped_sha256"), t.safe_id(F.col("url")).alias("safe_id"))


def json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.count_distinct(k).alias("k_distinct"))


def vector_profile(spark, sf_dir):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", v.argmax(e).cast("int").alias("argmax"), F.round(F.array_max(v.softmax(e, 0.5)), 6).alias("peak"))


QUERIES = {
    f.__name__: f
    for f in (
        lexical_topk, topk_dense, mmr_rerank, hybrid_search, hint_score, grounding_overlap, sentence_grounded, bigram_jaccard, text_gate_failures,
        question_router, token_counts, html_escape_report, json_props, vector_profile,
    )
}

STOP = "'a', 'an', 'and', 'are', 'as', 'be', 'by', 'for', 'from', 'in', 'is', 'it', 'near', 'of', 'or', 'so', 'that', 'the', 'to', 'where', 'with'"
TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
TERMS = f"list_filter({TOKENS}, lambda w: w NOT IN ({STOP}))"
TURNS = "c AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)"
GRAMS = "list_distinct(list_transform(range(1, greatest(len({0}) - {1} + 2, 1)), lambda i: array_to_string({0}[i:i + {1} - 1], ' ')))"
#: Picks by marginal relevance from c (q, d, score, rank) and likeness a (q, x, y, s): k of them, the first by relevance alone.
PICKS = """c AS MATERIALIZED (SELECT *, score / max(score) OVER (PARTITION BY q) AS rel FROM cand),
p AS (SELECT q, 1 AS n, [d] AS picked, d, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rel DESC, rank) AS first FROM c) WHERE first = 1
  UNION ALL SELECT q, n + 1, list_append(picked, d), d, score FROM (
    SELECT p.q, p.n, p.picked, c.d, c.score, row_number() OVER (PARTITION BY p.q ORDER BY round(0.6 * c.rel - 0.4 * (SELECT coalesce(max(greatest(a.s, 0)), 0) FROM a WHERE a.q = c.q AND a.x = c.d AND list_contains(p.picked, a.y)), 12) DESC, c.rank) AS first
    FROM p JOIN c ON c.q = p.q AND NOT list_contains(p.picked, c.d) WHERE p.n < 5) WHERE first = 1)"""
SHARED = """d AS (SELECT doc_id, unnest({terms}) AS term FROM documents), dc AS (SELECT doc_id, term, count(*) AS n FROM d GROUP BY ALL),
q AS (SELECT item_id, unnest({terms}) AS term FROM benchmark), qc AS (SELECT item_id, term, count(*) AS n FROM q GROUP BY ALL),
z AS (SELECT doc_id, sum(n) AS size FROM dc GROUP BY doc_id),
s AS (SELECT item_id, doc_id, sum(least(qc.n, dc.n)) AS shared FROM qc JOIN dc USING (term) GROUP BY ALL)"""
ORACLE_SQL = {
    "mmr_rerank": f"""WITH RECURSIVE q AS (SELECT label, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY label),
s AS (SELECT q.label, d.vec_id, d.embedding, round(list_cosine_similarity(q.e::DOUBLE[], d.embedding::DOUBLE[]), 9) AS score FROM q, embeddings AS d),
cand AS MATERIALIZED (SELECT label AS q, vec_id AS d, score, embedding, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 10),
a AS MATERIALIZED (SELECT x.q, x.d AS x, y.d AS y, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 12) AS s FROM cand x JOIN cand y USING (q)), {PICKS}
SELECT q AS label, d AS vec_id, n AS rank FROM p""",
    "hybrid_search": f"""WITH RECURSIVE {SHARED.format(terms=TERMS.format("text"))},
lex AS (SELECT item_id, doc_id, round(shared / (1 + ln(1 + size)), 9) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(shared / (1 + ln(1 + size)), 9) DESC, doc_id) AS rank
  FROM s JOIN z USING (doc_id) QUALIFY rank <= 10),
seen AS (SELECT item_id, embedding FROM benchmark JOIN embeddings ON item_id = vec_id WHERE vec_id % 4 <> 3),
vd AS (SELECT doc_id, embedding FROM documents JOIN embeddings ON doc_id = vec_id),
cos AS (SELECT item_id, doc_id, round(list_cosine_similarity(seen.embedding::DOUBLE[], vd.embedding::DOUBLE[]), 9) AS score FROM seen, vd),
den AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM cos WHERE score > 0 QUALIFY rank <= 10),
lists AS (SELECT item_id, doc_id, 1 / (60 + rank) AS r, 'lexical' AS list, rank FROM lex WHERE item_id IN (SELECT item_id FROM seen) UNION ALL SELECT item_id, doc_id, 1 / (60 + rank), 'dense', rank FROM den),
fused AS (SELECT item_id, doc_id, sum(r) AS score, min((if(list = 'lexical', 0, 1), rank)) AS first FROM lists GROUP BY ALL),
cand AS MATERIALIZED (SELECT item_id AS q, doc_id AS d, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 12) DESC, first) AS rank FROM fused QUALIFY rank <= 5
  UNION ALL SELECT item_id, doc_id, score, rank FROM lex WHERE item_id NOT IN (SELECT item_id FROM seen)),
w AS MATERIALIZED (SELECT q, d, embedding, {GRAMS.format("k", 2)} AS g FROM (SELECT q, d, {TERMS.format("text")} AS k, (SELECT e.embedding FROM embeddings e WHERE e.vec_id = d) AS embedding FROM cand JOIN documents ON doc_id = d)),
a AS MATERIALIZED (SELECT x.q, x.d AS x, y.d AS y, CASE WHEN x.embedding IS NOT NULL AND y.embedding IS NOT NULL THEN round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 12)
  WHEN len(x.g) > 0 AND len(y.g) > 0 THEN len(list_intersect(x.g, y.g)) / len(list_distinct(x.g || y.g)) ELSE 0 END AS s FROM w x JOIN w y ON x.q = y.q AND x.d <> y.d), {PICKS}
SELECT q AS item_id, d AS doc_id, round(score, 9) AS score, n AS rank FROM p""",
    "lexical_topk": f"""
WITH d AS (SELECT doc_id, unnest({TERMS.format("text")}) AS term FROM documents), dc AS (SELECT doc_id, term, count(*) AS n FROM d GROUP BY ALL),
q AS (SELECT item_id, unnest({TERMS.format("text")}) AS term FROM benchmark), qc AS (SELECT item_id, term, count(*) AS n FROM q GROUP BY ALL),
z AS (SELECT doc_id, sum(n) AS size FROM dc GROUP BY doc_id),
s AS (SELECT item_id, doc_id, sum(least(qc.n, dc.n)) AS shared FROM qc JOIN dc USING (term) GROUP BY ALL)
SELECT item_id, doc_id, round(shared / (1 + ln(1 + size)), 9) AS score,
       row_number() OVER (PARTITION BY item_id ORDER BY round(shared / (1 + ln(1 + size)), 9) DESC, doc_id) AS rank
FROM s JOIN z USING (doc_id) QUALIFY rank <= 5""",
    "topk_dense": """
WITH q AS (SELECT label, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY label),
s AS (SELECT q.label, d.vec_id, round(list_cosine_similarity(q.e::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score FROM q, embeddings AS d)
SELECT label, vec_id, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 5""",
    "hint_score": f"""SELECT doc_id, round(len(list_intersect({TOKENS.format("text")}, {list(HINTS)})) / {float(len(HINTS))}, 6) AS score,
  {", ".join(f"round(len(list_intersect({TOKENS.format('text')}, {list(h)})) / {float(len(h))}, 6) AS {rule}" for rule, h in retrieval.HINTS.items())} FROM documents""",
    "grounding_overlap": f"""WITH {TURNS}, k AS (SELECT conv_id, turn, {TOKENS.format("text")} AS a, {TOKENS.format("prev")} AS b FROM c),
g AS (SELECT conv_id, turn, a, {GRAMS.format("a", 3)} AS x, {GRAMS.format("b", 3)} AS y FROM k),
o AS (SELECT conv_id, turn, CASE WHEN len(a) < 3 THEN 1.0 ELSE len(list_intersect(x, y)) / len(x) END AS o FROM g)
SELECT conv_id, turn, round(o, 6) AS overlap, o < 0.08 AS flagged FROM o""",
    "sentence_grounded": f"""WITH {TURNS} SELECT conv_id, turn,
len(list_intersect({TERMS.format("text")}, {TERMS.format("prev")})) >= 2 AS grounded FROM c""",
    "bigram_jaccard": f"""WITH {TURNS}, k AS (SELECT conv_id, turn, {TOKENS.format("text")} AS a, {TOKENS.format("prev")} AS b FROM c),
g AS (SELECT conv_id, turn, {GRAMS.format("a", 2)} AS x, {GRAMS.format("b", 2)} AS y FROM k)
SELECT conv_id, turn, round(coalesce(len(list_intersect(x, y)) / nullif(len(list_distinct(x || y)), 0), 0), 6) AS similarity FROM g""",
    "text_gate_failures": f"""
WITH d AS (SELECT lang, coalesce(text, '') AS text, len({TOKENS.format("text")}) AS n FROM documents),
f AS (SELECT lang, list_filter([CASE WHEN n NOT BETWEEN 8 AND 2000 THEN 'length' END, CASE WHEN regexp_matches(text, '(?i)licen[cs]e') THEN 'citation' END,
  CASE WHEN regexp_matches(text, 'GNU|MIT|Apache') THEN 'authority' END, CASE WHEN regexp_matches(text, '[0-9]{{3}}') THEN 'numbers' END], lambda x: x IS NOT NULL) AS fs FROM d)
SELECT lang, failure, count(*) AS n FROM (SELECT lang, unnest(CASE WHEN len(fs) = 0 THEN [NULL] ELSE fs END) AS failure FROM f) GROUP BY ALL""",
    "question_router": """SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'empty'
WHEN contains(lower(text), 'illegal') OR contains(lower(text), 'lawsuit') OR contains(lower(text), 'nd the') OR contains(lower(text), 'liable') THEN 'refused'
WHEN contains(lower(text), 'helmet') OR contains(lower(text), 'the') THEN 'R1' WHEN contains(lower(text), 'vest') OR contains(lower(text), 'que') THEN 'R2'
WHEN contains(lower(text), 'near') OR contains(lower(text), 'ung') THEN 'R4' ELSE 'counts' END AS route FROM conversations""",
    "token_counts": f"""WITH k AS (SELECT doc_id, {TOKENS.format("text")} AS a, {TERMS.format("text")} AS b FROM documents)
SELECT doc_id, len(a) AS n_tokens, len(b) AS n_terms, len({GRAMS.format("a", 3)}) AS n_trigrams FROM k""",
    "html_escape_report": """SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped_sha256,
replace(replace(url, '/', '-'), ' ', '_') AS safe_id FROM pages""",
    "json_props": """SELECT event_type, sum((props::JSON->>'$.k')::INTEGER)::BIGINT AS k_sum, count(DISTINCT (props::JSON->>'$.k')::INTEGER) AS k_distinct FROM events GROUP BY event_type""",
    "vector_profile": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT vec_id, list_position(v, list_max(v)) - 1 AS argmax, round(1 / list_sum(list_transform(v, lambda x: exp((x - list_max(v)) / 0.5))), 6) AS peak FROM e""",
}
