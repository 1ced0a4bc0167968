"""Queries on aggregates, selection, metrics and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsengine.functions import geometry as g
from obsengine.operators import aggregates as agg
from obsengine.operators import metrics, selection
from obsengine.plans.common import HOUR, events, table
from obsengine.plans.join_queries import boxes

ZONE = ((100.0, 100.0), (900.0, 150.0), (700.0, 600.0), (400.0, 300.0), (150.0, 650.0))
LINE = ((0.0, 0.0), (400.0, 300.0), (800.0, 100.0))
CAMERA = g.Camera(1700.0, 28.0, 3.4, 960.0, 540.0)


def run_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    of = lambda t: F.count_distinct(F.when(F.col("event_type") == t, F.col("user_id")))
    return e.agg(F.count_distinct("user_id").alias("tracks"), of("error").alias("with_error"), of("signup").alias("with_signup"), F.count_if(F.col("event_type") == "view").alias("views"))


def coverage_rollup(spark, sf_dir):
    per = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("us") / (24 * HOUR)).alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("n"))
    status = F.when(F.col("errors") >= 3, "alert").when(F.col("errors") > 0, "below_debounce").when(F.col("n") < 2, "no_evidence").otherwise("clear")
    return agg.rolled_up(per.withColumn("status", status), ["user_id"], "status")


def mode_reason(spark, sf_dir):
    return agg.mode(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


def majority_vote(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(agg.majority(F.when(F.col("event_type") != "click", F.col("event_type") == "view")).alias("verdict"))


def closest_in_window(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("day", F.floor(F.col("us") / (24 * HOUR)))
    return e.groupBy("user_id", "day").agg(F.min_by("event_id", F.struct("value", "event_id")).alias("event_id"), F.min("value").alias("value"))


def quantile_linear(spark, sf_dir):
    q = agg.linear_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"lower": 0.025, "median": 0.5, "upper": 0.975})
    return q.select("l_returnflag", *(F.round(c, 6).alias(c) for c in ("lower", "median", "upper")))


def quantile_nearest_rank(spark, sf_dir):
    return agg.nearest_rank(table(spark, sf_dir, "events"), ["user_id"], "value", 0.95)


def drift_profile(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.stddev_pop("value").alias("sd"), F.avg(F.col("value").between(10, 60).cast("double")).alias("share"))
    return e.filter("n >= 60").select("user_id", "n", F.round("sd", 6).alias("sd"), F.round("share", 6).alias("in_band"))


def weights(spark, sf_dir):
    return agg.class_weights(table(spark, sf_dir, "documents"), "lang").select("lang", "n", F.round("weight", 6).alias("weight"))


def leakage(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("split", F.when(F.col("source") < "src5", "train").otherwise("test"))
    return agg.leakage(d, "text", "split")


def score_rates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(agg.rate(F.col("quality") == 1, F.col("quality").isNotNull()).alias("good"), agg.rate(F.col("quality").isNull()).alias("missing"))


def promotion_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return metrics.promoted(d.withColumn("passed", F.col("quality") == 1), ["lang"], "passed")


def budget_topn(spark, sf_dir):
    order = [F.col("event_type") != "error", F.desc("value"), F.col("event_id")]
    return selection.budgeted(table(spark, sf_dir, "events"), ["user_id"], order, 12).select("event_id", "rank", "reviewed")


def hash_order(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", selection.hash_order(F.col("o_orderkey"), 42017).alias("h"))


def group_split(spark, sf_dir):
    return selection.grouped_split(table(spark, sf_dir, "documents"), "source", {"train": 0.7, "val": 0.15, "test": 0.15}, 42017)


def dedup_first(spark, sf_dir):
    return selection.first_copies(table(spark, sf_dir, "documents"), F.col("text"), ["doc_id"]).select("doc_id", "copy")


def upsert_last(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    old, new = e.filter("event_type = 'view'"), e.filter("event_type != 'view'")
    return selection.upserted(old, new, ["user_id"], "event_id")


def scored(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.withColumn("confidence", (F.col("n_chars") % 101) / F.lit(100.0)).withColumn("hit", F.col("quality") == 1)


def ap50_rank(spark, sf_dir):
    ap = metrics.average_precision(scored(spark, sf_dir), ["source"], "confidence", "hit", "doc_id", F.count_if("hit") + 1)
    return ap.select("source", F.round("ap", 9).alias("ap"))


def pr_at_threshold(spark, sf_dir):
    return metrics.precision_recall(scored(spark, sf_dir), ["source"], F.col("confidence") >= 0.6, F.col("hit")).select(
        "source", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall")
    )


def ece_bins(spark, sf_dir):
    return metrics.calibration_error(scored(spark, sf_dir), ["lang"], "confidence", F.col("hit")).select("lang", F.round("ece", 9).alias("ece"))


def binary_report(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("p", F.when(F.col("confidence") >= 0.6, 1).when(F.col("confidence") <= 0.3, 0))
    r = metrics.binary_report(s, ["lang"], "p", "quality")
    return r.select("lang", "n", *(F.round(c, 9).alias(c) for c in ("precision_0", "recall_0", "f1_0", "precision_1", "recall_1", "f1_1", "macro_f1", "abstained")))


def greedy_iou_match(spark, sf_dir):
    b = boxes(table(spark, sf_dir, "lineitem"))
    found = b.filter("line % 2 = 0").select("image", F.col("line").alias("det_id"), (F.col("box.x1") % 1).alias("confidence"), "box")
    return metrics.greedy_match(found, b.filter("line % 2 = 1").select("image", F.col("line").alias("truth_id"), "box"), "image", 0.2)


def spots(spark, sf_dir):
    at = g.point(F.col("l_extendedprice") % 1000, (F.col("l_partkey") % 700).cast("double"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", at.alias("p"))


def point_in_zone(spark, sf_dir):
    d = g.signed_distance(F.col("p"), g.path(*ZONE))
    return spots(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(d, 6).alias("distance"), (d > 0).alias("inside"))


def polyline_distance(spark, sf_dir):
    return spots(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(g.to_polyline(F.col("p"), g.path(*LINE)), 6).alias("distance"))


def backproject_points(spark, sf_dir):
    s = spots(spark, sf_dir).withColumn("spot", CAMERA.ground(F.col("p.x"), F.col("p.y"))).filter("spot IS NOT NULL")
    back = CAMERA.pixel(F.col("spot.x"), F.col("spot.z"))
    return s.select("l_orderkey", "l_linenumber", F.round("spot.x", 6).alias("x"), F.round("spot.z", 6).alias("z"), F.round(back["y"] - F.col("p.y"), 6).cast("int").alias("off"))


def distance_bands(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("lower", F.col("l_quantity") / 10).withColumn("upper", F.when(F.col("l_discount") > 0, F.col("l_quantity") / 10 + F.col("l_discount") * 10))
    return l.select(g.distance_band(F.when(F.col("upper").isNotNull(), F.col("lower")), F.col("upper"), 1.5, 3.0).alias("band")).groupBy("band").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        run_summary, coverage_rollup, mode_reason, majority_vote, closest_in_window, quantile_linear, quantile_nearest_rank, drift_profile,
        weights, leakage, score_rates, promotion_gate, budget_topn, hash_order, group_split, dedup_first, upsert_last, ap50_rank,
        pr_at_threshold, ece_bins, binary_report, greedy_iou_match, point_in_zone, polyline_distance, backproject_points, distance_bands,
    )
}


def _segments(points: tuple, closed: bool) -> list:
    pairs = list(zip(points, points[1:] + points[:1] if closed else points[1:]))
    return pairs


def _to_segment(a: tuple, b: tuple) -> str:
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = f"greatest(0, least(1, ((x - {a[0]}) * {dx} + (y - {a[1]}) * {dy}) / {dx * dx + dy * dy}))"
    return f"sqrt((x - {a[0]} - {t} * {dx}) ** 2 + (y - {a[1]} - {t} * {dy}) ** 2)"


def _crossings(points: tuple) -> str:
    return " + ".join(
        f"((({a[1]} > y) <> ({b[1]} > y)) AND x < {a[0]} + (y - {a[1]}) * {(b[0] - a[0]) / (b[1] - a[1])})::INTEGER" for a, b in _segments(points, True)
    )


SPOTS = "s AS (SELECT l_orderkey, l_linenumber, l_extendedprice % 1000 AS x, (l_partkey % 700)::DOUBLE AS y FROM lineitem)"
SCORED = "s AS (SELECT *, (n_chars % 101) / 100.0 AS confidence, quality = 1 AS hit FROM documents JOIN labels USING (doc_id))"
ORACLE_SQL = {
    "run_summary": """SELECT count(DISTINCT user_id) AS tracks, count(DISTINCT user_id) FILTER (event_type = 'error') AS with_error,
count(DISTINCT user_id) FILTER (event_type = 'signup') AS with_signup, count(*) FILTER (event_type = 'view') AS views FROM events""",
    "coverage_rollup": """
WITH p AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) AS n FROM events GROUP BY user_id, date_trunc('day', ts)),
s AS (SELECT user_id, CASE WHEN errors >= 3 THEN 'alert' WHEN errors > 0 THEN 'below_debounce' WHEN n < 2 THEN 'no_evidence' ELSE 'clear' END AS s FROM p),
a AS (SELECT user_id, bool_or(s = 'alert') AS a, bool_or(s = 'below_debounce') AS b, bool_and(s = 'no_evidence') AS e FROM s GROUP BY user_id)
SELECT user_id, CASE WHEN a THEN 'alert' WHEN b OR e THEN 'inconclusive' ELSE 'clear' END AS status,
       CASE WHEN a THEN 'detected' WHEN b THEN 'below_debounce' WHEN e THEN 'no_evidence' ELSE 'none_detected' END AS reason FROM a""",
    "mode_reason": """WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL)
SELECT user_id, event_type, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1""",
    "majority_vote": """WITH c AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'view') AS y, count(*) FILTER (event_type NOT IN ('view', 'click')) AS o FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN 2 * y > n THEN true WHEN 2 * o > n THEN false END AS verdict FROM c""",
    "closest_in_window": f"""SELECT user_id, epoch_us(ts) // {24 * HOUR} AS day, arg_min(event_id, (value, event_id)) AS event_id, min(value) AS value FROM events GROUP BY 1, 2""",
    "quantile_linear": """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.025), 6) AS lower, round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
round(quantile_cont(l_extendedprice, 0.975), 6) AS upper FROM lineitem GROUP BY 1""",
    "quantile_nearest_rank": """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, value AS quantile FROM r WHERE i = least(n - 1, floor(n * 0.95::DOUBLE))""",
    "drift_profile": """SELECT user_id, count(*) AS n, round(stddev_pop(value), 6) AS sd, round(avg((value BETWEEN 10 AND 60)::INTEGER), 6) AS in_band
FROM events GROUP BY user_id HAVING count(*) >= 60""",
    "weights": "SELECT lang, count(*) AS n, round(least(sqrt(max(count(*)) OVER () / count(*)), 3.0), 6) AS weight FROM documents GROUP BY lang",
    "leakage": """SELECT count(*) FILTER (n > 1) AS leaked FROM (SELECT count(DISTINCT CASE WHEN source < 'src5' THEN 'train' ELSE 'test' END) AS n FROM documents GROUP BY text)""",
    "score_rates": """SELECT source, round(count(*) FILTER (quality = 1) / nullif(count(quality), 0)::DOUBLE, 4) AS good,
round(count(*) FILTER (quality IS NULL) / count(*)::DOUBLE, 4) AS missing FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
    "promotion_gate": """SELECT lang, bool_and(coalesce(quality = 1, false)) AS promoted, count(*) FILTER (quality IS NULL) AS unmeasured
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""",
    "budget_topn": """WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type <> 'error', value DESC, event_id) AS rank FROM events)
SELECT event_id, rank, rank <= 12 AS reviewed FROM r""",
    "hash_order": "SELECT o_orderkey, sha256('42017:' || o_orderkey) AS h FROM orders",
    "dedup_first": "SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS copy FROM documents",
    "upsert_last": """SELECT user_id, event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type <> 'view' DESC, event_id DESC) = 1""",
    "ap50_rank": f"""WITH {SCORED}, c AS (SELECT *, sum(hit::INTEGER) OVER w AS tp, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY source ORDER BY confidence DESC, doc_id ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, max(tp / n) OVER (PARTITION BY source ORDER BY confidence DESC, doc_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p FROM c)
SELECT source, round(coalesce(sum(p) FILTER (hit), 0) / (count(*) FILTER (hit) + 1), 9) AS ap FROM e GROUP BY source""",
    "pr_at_threshold": f"""WITH {SCORED} SELECT source, round(count(*) FILTER (confidence >= 0.6 AND hit) / nullif(count(*) FILTER (confidence >= 0.6), 0)::DOUBLE, 9) AS precision,
round(count(*) FILTER (confidence >= 0.6 AND hit) / nullif(count(*) FILTER (hit), 0)::DOUBLE, 9) AS recall FROM s GROUP BY source""",
    "ece_bins": f"""WITH {SCORED}, t AS (SELECT lang, count(*) AS total FROM s GROUP BY lang),
b AS (SELECT lang, ceil(confidence::DOUBLE * 10) AS b, count(*) AS n, abs(avg(hit::INTEGER) - avg(confidence::DOUBLE)) AS gap FROM s WHERE confidence > 0 GROUP BY ALL)
SELECT lang, round(sum(n * gap) / max(total), 9) AS ece FROM b JOIN t USING (lang) GROUP BY lang""",
    "binary_report": f"""WITH {SCORED}, p AS (SELECT *, CASE WHEN confidence >= 0.6 THEN 1 WHEN confidence <= 0.3 THEN 0 END AS p FROM s),
f AS (SELECT lang, count(*) AS n, {", ".join(f"coalesce(count(*) FILTER (p = {c} AND quality = {c}) / nullif(count(*) FILTER ({of} = {c}), 0)::DOUBLE, 0) AS {m}_{c}" for c in (0, 1) for m, of in (("precision", "p"), ("recall", "quality")))},
  2 * count(*) FILTER (p = 0 AND quality = 0) / nullif(count(*) FILTER (p = 0) + count(*) FILTER (quality = 0), 0)::DOUBLE AS a,
  2 * count(*) FILTER (p = 1 AND quality = 1) / nullif(count(*) FILTER (p = 1) + count(*) FILTER (quality = 1), 0)::DOUBLE AS b,
  count(*) FILTER (p IS NULL) / count(*)::DOUBLE AS abstained FROM p GROUP BY lang)
SELECT lang, n, {", ".join(f"round({m}_{c}, 9) AS {m}_{c}" for c in (0, 1) for m in ("precision", "recall"))}, round(coalesce(a, 0), 9) AS f1_0, round(coalesce(b, 0), 9) AS f1_1, round((coalesce(a, 0) + coalesce(b, 0)) / 2, 9) AS macro_f1, round(abstained, 9) AS abstained FROM f""",
    "point_in_zone": f"""WITH {SPOTS}, d AS (SELECT *, least({", ".join(_to_segment(a, b) for a, b in _segments(ZONE, True))}) AS d, ({_crossings(ZONE)}) % 2 = 1 AS i FROM s)
SELECT l_orderkey, l_linenumber, round(CASE WHEN i THEN d ELSE -d END, 6) AS distance, i AND d > 0 AS inside FROM d""",
    "polyline_distance": f"""WITH {SPOTS} SELECT l_orderkey, l_linenumber, round(least({", ".join(_to_segment(a, b) for a, b in _segments(LINE, False))}), 6) AS distance FROM s""",
    "backproject_points": f"""WITH {SPOTS}, k AS (SELECT *, (y - 540) / 1700 AS dy, radians(28) AS r FROM s),
b AS (SELECT *, 3.4 / (cos(r) * (dy + tan(r))) AS k FROM k WHERE dy + tan(r) > 1e-9)
SELECT l_orderkey, l_linenumber, round(k * (x - 960) / 1700, 6) AS x, round(k * (cos(r) - dy * sin(r)), 6) AS z, 0 AS off FROM b""",
    "distance_bands": """WITH l AS (SELECT CASE WHEN l_discount > 0 THEN l_quantity / 10 END AS lower, CASE WHEN l_discount > 0 THEN l_quantity / 10 + l_discount * 10 END AS upper FROM lineitem)
SELECT CASE WHEN upper <= 1.5 THEN 'near' WHEN lower > 3.0 THEN 'clear' WHEN lower > 1.5 AND upper <= 3.0 THEN 'caution' ELSE 'indeterminate' END AS band, count(*) AS n FROM l GROUP BY 1""",
}
