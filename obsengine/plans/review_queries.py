"""Queries on predicates, review, patched states and answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from obsengine.functions import predicates as p
from obsengine.operators import answers, retrieval, review
from obsengine.plans.common import HOUR, events, table
from obsengine.plans.join_queries import BOXES, boxes


def box_predicates(spark, sf_dir):
    b = boxes(table(spark, sf_dir, "lineitem"))
    box = F.col("box")
    return b.groupBy(F.col("line")).agg(
        F.count_if(p.assessable(box)).alias("assessable"), F.count_if(p.pose_candidate(box, 1200.0, 900.0)).alias("pose"),
        F.count_if(p.contact_visible(box, 800.0)).alias("contact"), F.count("*").alias("n"),
    )


def normalized_boxes(spark, sf_dir):
    n = p.normalized(F.col("box"), F.lit(1000), F.lit(700))
    return boxes(table(spark, sf_dir, "lineitem")).select("image", "line", n["w"].alias("w"), n["h"].alias("h"))


def letterbox_sizes(spark, sf_dir):
    s = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50 * 16 + 320).alias("w0"), (F.col("p_size") * 16 + 320).alias("h0")).distinct()
    return s.select("w0", "h0", p.letterboxed(F.col("w0"), F.col("h0"), 1920, 1080).alias("r")).select("w0", "h0", "r.*")


def override_by_verdict(spark, sf_dir):
    e = events(spark, sf_dir)
    rows = e.filter("event_type IN ('view', 'click')").select("event_id", "user_id", "us", F.when(F.col("value") > 50, "yes").otherwise("no").alias("state"))
    verdict = F.when(F.col("value") > 70, "yes").when(F.col("value") < 30, "no").otherwise("unknown")
    verdicts = e.filter("event_type = 'purchase'").select("user_id", F.col("us").alias("at"), F.col("event_id").alias("verdict_id"), verdict.alias("verdict"))
    return review.patched(rows, verdicts, ["user_id"], "us", "at", 12 * HOUR, "state").select("event_id", "state", "overridden")


def single_vote(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return review.single_vote(d, ["lang", "source"], "toxic")


def review_plan(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (F.col("value") * 4).alias("height"))
    order = [F.col("event_type") != "error", F.desc("height"), F.col("event_id")]
    return review.review_plan(e, ["user_id"], "height", order).select("event_id", "route")


def hybrid_topk(spark, sf_dir):
    """By language: long documents fused with those of the newest ids, then the ten best."""
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars")
    rank = lambda *o: d.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*o))).filter("rank <= 20")
    found = retrieval.hybrid(rank(F.desc("n_chars"), "doc_id"), rank(F.desc("doc_id")), "lang", "doc_id", 10)
    return found.select("lang", "doc_id", F.round("score", 9).alias("score"), "rank")


def regulation_router(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", answers.routed(F.col("text")).alias("route"))


QUERIES = {
    f.__name__: f
    for f in (box_predicates, normalized_boxes, letterbox_sizes, override_by_verdict, single_vote, review_plan, hybrid_topk, regulation_router)
}


ORACLE_SQL = {
    "box_predicates": f"""WITH {BOXES} SELECT line, count(*) FILTER (y2 - y1 >= 40 AND (y2 - y1) / greatest(x2 - x1, 1e-6) >= 1.6) AS assessable,
count(*) FILTER (y2 - y1 >= 40 AND x2 > x1 AND (y2 - y1) / nullif(x2 - x1, 0) >= 1.4 AND x1 > 3 AND y1 > 3 AND x2 < 1197 AND y2 < 897) AS pose,
count(*) FILTER (y2 <= 797) AS contact, count(*) AS n FROM b GROUP BY line""",
    "normalized_boxes": f"""WITH {BOXES} SELECT image, line, round((least(x2, 1000) - least(x1, 1000)) / 1000, 6) AS w,
round((least(y2, 700) - least(y1, 700)) / 700, 6) AS h FROM b""",
    "letterbox_sizes": """WITH s AS (SELECT DISTINCT p_partkey % 50 * 16 + 320 AS w0, p_size * 16 + 320 AS h0 FROM part),
k AS (SELECT *, least(1920::DOUBLE / w0, 1080::DOUBLE / h0) AS k FROM s), r AS (SELECT w0, h0, round_even(w0 * k, 0)::INTEGER AS w, round_even(h0 * k, 0)::INTEGER AS h FROM k)
SELECT w0, h0, floor((1920 - w) / 2.0)::INTEGER AS x, floor((1080 - h) / 2.0)::INTEGER AS y, w, h FROM r""",
    "override_by_verdict": f"""
WITH e AS (SELECT *, epoch_us(ts) AS us FROM events), r AS (SELECT event_id, user_id, us, CASE WHEN value > 50 THEN 'yes' ELSE 'no' END AS state FROM e WHERE event_type IN ('view', 'click')),
v AS (SELECT user_id, us, event_id AS vid, CASE WHEN value > 70 THEN 'yes' WHEN value < 30 THEN 'no' END AS verdict FROM e WHERE event_type = 'purchase'),
p AS (SELECT r.event_id, arg_max(verdict, (v.us, vid)) AS verdict FROM r JOIN v ON r.user_id = v.user_id AND abs(r.us - v.us) <= {12 * HOUR} AND verdict IS NOT NULL GROUP BY 1)
SELECT event_id, coalesce(verdict, state) AS state, coalesce(verdict <> state, false) AS overridden FROM r LEFT JOIN p USING (event_id)""",
    "single_vote": """SELECT lang, source, CASE WHEN count(DISTINCT toxic) = 1 THEN min(toxic) ELSE -100 END AS label FROM documents JOIN labels USING (doc_id) GROUP BY ALL""",
    "review_plan": """WITH e AS (SELECT event_id, user_id, event_type, value * 4 AS height FROM events),
r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type <> 'error', height DESC, event_id) AS k FROM e WHERE height >= 160)
SELECT event_id, CASE WHEN k <= 12 THEN 'review' WHEN k IS NOT NULL THEN 'over_budget' ELSE 'too_small' END AS route FROM e LEFT JOIN r USING (event_id)""",
    "hybrid_topk": """
WITH a AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents QUALIFY r <= 20),
b AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS r FROM documents QUALIFY r <= 20),
u AS (SELECT *, 0 AS l FROM a UNION ALL SELECT *, 1 FROM b),
f AS (SELECT lang, doc_id, sum(1.0 / (60 + r)) AS score, min(l) AS l, arg_min(r, l) AS r FROM u GROUP BY ALL)
SELECT lang, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, l, r) AS rank FROM f QUALIFY rank <= 10""",
    "regulation_router": """SELECT conv_id, turn, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty_question'
WHEN regexp_matches(lower(text), 'is this legal|is this illegal|legally compliant|compliance decision|are they liable|who is liable|legal liability|certify compliance') THEN 'legal_verdict_request'
WHEN regexp_matches(lower(text), 'regulation|clause|bocw|law|requirement|require|rule say|rules say|what does the rule') THEN 'regulation'
WHEN regexp_matches(lower(text), 'r1|helmet|head|hardhat') THEN 'R1' WHEN regexp_matches(lower(text), 'r2|vest|hi-vis|visibility|hiviz') THEN 'R2'
WHEN regexp_matches(lower(text), 'r3|restricted|zone') THEN 'R3' WHEN regexp_matches(lower(text), 'r4|machine|machinery|plant|excavator|near') THEN 'R4'
WHEN regexp_matches(lower(text), 'r5|edge|fall|height') THEN 'R5' ELSE 'counts' END AS route FROM conversations""",
}
