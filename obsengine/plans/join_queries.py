"""Queries on joins: context, bands, nearest in time, intervals, containment, integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsengine.functions import geometry as g
from obsengine.operators import joins
from obsengine.plans.common import HOUR, events, micros, table


def hours(df):
    return df.withColumn("hour", F.floor(F.col("us") / HOUR))


def semi_context_span(spark, sf_dir):
    e = hours(events(spark, sf_dir))
    there = joins.in_context(e.filter("event_type = 'error'"), e.filter("event_type = 'purchase'"), ["hour"])
    return there.groupBy("user_id").agg(F.count("*").alias("n"), (F.max("us") - F.min("us")).alias("span")).filter(F.col("span") >= 24 * HOUR)


def any_overlap(spark, sf_dir):
    e = hours(events(spark, sf_dir))
    met = joins.in_context(e.filter("event_type = 'signup'"), e.filter("event_type = 'purchase'"), ["user_id", "hour"])
    return met.agg((F.count("*") > 0).alias("overlaps"))


def pair_join_same_frame(spark, sf_dir):
    e = hours(events(spark, sf_dir))
    left = e.filter("event_type = 'error'").select("user_id", "hour", F.col("event_id").alias("error_id"))
    right = e.filter("event_type = 'purchase'").select("user_id", "hour", F.col("event_id").alias("purchase_id"))
    return left.join(right, ["user_id", "hour"])


def band_join_patch(spark, sf_dir):
    e = events(spark, sf_dir)
    rows = e.filter("event_type IN ('view', 'click')").select("event_id", "user_id", "us", "value")
    verdicts = e.filter("event_type = 'purchase'").select("user_id", F.col("us").alias("at"), F.col("event_id").alias("verdict_id"), F.col("value").alias("verdict"))
    pairs = joins.band(rows, verdicts, ["user_id"], "us", "at", 6 * HOUR)
    return pairs.groupBy("event_id").agg(F.max_by("verdict", F.struct("at", "verdict_id")).alias("patched"), F.count("*").alias("n"))


def asof_nearest(spark, sf_dir):
    e = events(spark, sf_dir)
    views = e.filter("event_type = 'view'").select("event_id", "user_id", "us")
    clicks = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("us").alias("click_us"))
    return joins.nearest(views, clicks, ["user_id"], "us", "click_us", "click_id", 3 * HOUR).select("event_id", "click_id", "click_us")


def active_intervals(spark, sf_dir):
    e = events(spark, sf_dir)
    spells = e.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("us").alias("start"), (F.col("us") + HOUR * F.ceil(F.col("value") / 10)).alias("stop"))
    moments = e.filter("event_type = 'click'").select("user_id", "event_id", "us")
    return joins.active_at(moments, spells, ["user_id"], "us", "start", F.col("stop") + 2 * HOUR, 6 * HOUR).select("event_id", "error_id")


def left_lookup_default(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    found = joins.lookup(docs, labels, ["doc_id"], {"quality": F.lit(-1), "toxic": F.lit(-1)}, "quality")
    return found.groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"))


def anti_pending(spark, sf_dir):
    return joins.pending(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


def array_membership_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array("lang", "source").alias("tags"))
    wanted = spark.createDataFrame([("en",), ("src1",), ("src2",), ("none",)], "tag string")
    return joins.membership(wanted, "tag", docs, "tags").groupBy("tag").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def fk_integrity(spark, sf_dir):
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    return joins.orphans(orders, "o_custkey", customers, "c_custkey").select("o_orderkey", "o_custkey")


def rrf_fusion(spark, sf_dir):
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    rank = lambda df, *order: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter("rank <= 50")
    long, new = rank(d, F.desc("n_chars"), "doc_id"), rank(d, F.desc("doc_id"))
    return joins.fused({"long": long, "new": new}, "doc_id").select("doc_id", F.round("rrf", 9).alias("rrf"), "first_list", "first_rank")


def boxes(df):
    """lineitem as boxes: an order is an image, a line a box."""
    x, y = F.col("l_extendedprice") % 1000, F.col("l_partkey") % 700
    w, h = F.col("l_quantity") * 8, F.col("l_quantity") * 6 + 10
    return df.select(
        F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("line"),
        F.struct(x.alias("x1"), y.cast("double").alias("y1"), (x + w).alias("x2"), (y + h).cast("double").alias("y2")).alias("box"),
    )


def iou_pairs(spark, sf_dir):
    b = boxes(table(spark, sf_dir, "lineitem"))
    left = b.select("image", F.col("line").alias("a"), F.col("box").alias("p"))
    right = b.select("image", F.col("line").alias("b"), F.col("box").alias("q"))
    pairs = left.join(right, "image").filter("a < b").withColumn("iou", F.round(g.iou(F.col("p"), F.col("q")), 9))
    return pairs.filter("iou >= 0.2").select("image", "a", "b", "iou")


def smallest_container(spark, sf_dir):
    b = boxes(table(spark, sf_dir, "lineitem"))
    items = b.select("image", F.col("line").alias("item"), ((F.col("box.x1") + F.col("box.x2")) / 2).alias("cx"), ((F.col("box.y1") + F.col("box.y2")) / 2).alias("cy"))
    people = b.select("image", F.col("line").alias("person"), "box")
    margin = 0.1 * (F.col("box.x2") - F.col("box.x1"))
    inside = (F.col("item") != F.col("person")) & F.col("cx").between(F.col("box.x1") - margin, F.col("box.x2") + margin) & F.col("cy").between(F.col("box.y1"), F.col("box.y2"))
    return joins.smallest_container(items, people, ["image"], inside, g.box_area(F.col("box")), "item", "person").select("image", "item", "person")


def promo_dates(spark, sf_dir):
    """Nearest again, on another table: each return's nearest order date of the same customer within 30 days."""
    o = table(spark, sf_dir, "orders")
    us = F.col("o_orderdate")
    stamped = o.select("o_custkey", "o_orderkey", (micros(us.cast("timestamp_ntz"))).alias("us"), "o_orderstatus")
    left = stamped.filter("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", "us")
    right = stamped.filter("o_orderstatus != 'F'").select("o_custkey", F.col("o_orderkey").alias("other"), F.col("us").alias("other_us"))
    return joins.nearest(left, right, ["o_custkey"], "us", "other_us", "other", 30 * 24 * HOUR).select("o_orderkey", "other")


QUERIES = {
    f.__name__: f
    for f in (
        semi_context_span, any_overlap, pair_join_same_frame, band_join_patch, asof_nearest, active_intervals, left_lookup_default,
        anti_pending, array_membership_join, fk_integrity, rrf_fusion, iou_pairs, smallest_container, promo_dates,
    )
}

E = f"e AS (SELECT *, epoch_us(ts) AS us, epoch_us(ts) // {HOUR} AS hour FROM events)"
BOXES = """b AS (SELECT l_orderkey AS image, l_linenumber AS line, l_extendedprice % 1000 AS x1, (l_partkey % 700)::DOUBLE AS y1,
  l_extendedprice % 1000 + l_quantity * 8 AS x2, (l_partkey % 700 + (l_quantity * 6 + 10))::DOUBLE AS y2 FROM lineitem)"""
ORACLE_SQL = {
    "semi_context_span": f"""WITH {E} SELECT user_id, count(*) AS n, max(us) - min(us) AS span FROM e
WHERE event_type = 'error' AND hour IN (SELECT hour FROM e WHERE event_type = 'purchase') GROUP BY user_id HAVING max(us) - min(us) >= {24 * HOUR}""",
    "any_overlap": f"""WITH {E} SELECT count(*) > 0 AS overlaps FROM e WHERE event_type = 'signup'
AND EXISTS (SELECT 1 FROM e AS p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.hour = e.hour)""",
    "pair_join_same_frame": f"""WITH {E} SELECT a.user_id, a.hour, a.event_id AS error_id, b.event_id AS purchase_id
FROM e AS a JOIN e AS b USING (user_id, hour) WHERE a.event_type = 'error' AND b.event_type = 'purchase'""",
    "band_join_patch": f"""WITH {E}, p AS (SELECT r.event_id, v.value, v.us, v.event_id AS vid FROM e AS r JOIN e AS v ON r.user_id = v.user_id
  AND abs(r.us - v.us) <= {6 * HOUR} WHERE r.event_type IN ('view', 'click') AND v.event_type = 'purchase')
SELECT event_id, arg_max(value, (us, vid)) AS patched, count(*) AS n FROM p GROUP BY event_id""",
    "asof_nearest": f"""WITH {E}, p AS (SELECT v.event_id, c.event_id AS click_id, c.us AS click_us, abs(v.us - c.us) AS d FROM e AS v
  LEFT JOIN e AS c ON v.user_id = c.user_id AND c.event_type = 'click' AND abs(v.us - c.us) <= {3 * HOUR} WHERE v.event_type = 'view')
SELECT event_id, click_id, click_us FROM p QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY d, click_us DESC, click_id DESC) = 1""",
    "active_intervals": f"""WITH {E} SELECT c.event_id, x.event_id AS error_id FROM e AS c JOIN e AS x ON c.user_id = x.user_id
AND c.us BETWEEN x.us AND x.us + {HOUR} * ceil(x.value / 10)::BIGINT + {2 * HOUR} WHERE c.event_type = 'click' AND x.event_type = 'error'""",
    "left_lookup_default": """SELECT lang, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic, count(*) AS n
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""",
    "anti_pending": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "array_membership_join": """SELECT tag, count(*) AS n, min(doc_id) AS first_id
FROM (SELECT doc_id, unnest([lang, source]) AS tag FROM documents) WHERE tag IN ('en', 'src1', 'src2', 'none') GROUP BY tag""",
    "fk_integrity": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
    "rrf_fusion": """
WITH a AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents QUALIFY r <= 50),
b AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS r FROM documents QUALIFY r <= 50),
u AS (SELECT *, 0 AS l FROM a UNION ALL SELECT *, 1 FROM b)
SELECT doc_id, round(sum(1.0 / (60 + r)), 9) AS rrf, min(l) AS first_list, arg_min(r, l)::INTEGER AS first_rank FROM u GROUP BY doc_id""",
    "iou_pairs": f"""WITH {BOXES}, p AS (SELECT a.image, a.line AS a, b.line AS b,
  greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i,
  (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM b AS a JOIN b ON a.image = b.image AND a.line < b.line)
SELECT image, a, b, round(i / (s - i), 9) AS iou FROM p WHERE round(i / (s - i), 9) >= 0.2""",
    "smallest_container": f"""WITH {BOXES}, p AS (SELECT i.image, i.line AS item, p.line AS person, (p.x2 - p.x1) * (p.y2 - p.y1) AS area FROM b AS i
  JOIN b AS p ON i.image = p.image AND i.line <> p.line
  AND (i.x1 + i.x2) / 2 BETWEEN p.x1 - 0.1 * (p.x2 - p.x1) AND p.x2 + 0.1 * (p.x2 - p.x1) AND (i.y1 + i.y2) / 2 BETWEEN p.y1 AND p.y2)
SELECT image, item, person FROM p QUALIFY row_number() OVER (PARTITION BY image, item ORDER BY area, person) = 1""",
    "promo_dates": f"""WITH p AS (SELECT a.o_orderkey, b.o_orderkey AS other, abs(epoch_us(a.o_orderdate) - epoch_us(b.o_orderdate)) AS d, b.o_orderdate AS t
  FROM orders AS a LEFT JOIN orders AS b ON a.o_custkey = b.o_custkey AND b.o_orderstatus <> 'F'
  AND abs(epoch_us(a.o_orderdate) - epoch_us(b.o_orderdate)) <= {30 * 24 * HOUR} WHERE a.o_orderstatus = 'F')
SELECT o_orderkey, other FROM p QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY d, t DESC, other DESC) = 1""",
}
