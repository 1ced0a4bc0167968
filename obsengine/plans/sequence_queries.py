"""Queries on events as tracks in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsengine.operators import sequence as seq
from obsengine.plans.common import HOUR, events

DEBOUNCE = 12 * HOUR
GAP = 24 * HOUR

EPOCH = 1_704_067_200_000_000  # microseconds of hour 0


def debounced_incidents(spark, sf_dir):
    e = events(spark, sf_dir)
    errors = e.filter("event_type = 'error'")
    found = seq.debounced(errors, ["user_id"], "us", DEBOUNCE)
    confidence = errors.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("confidence"))  # of all rows, not just the run's
    return found.join(confidence, "user_id").select(
        F.concat_ws("-", F.lit("run"), F.col("user_id"), F.lit("R1"), F.col("first"), F.col("last")).alias("incident_id"),
        "user_id", F.col("first").alias("first_us"), (F.col("first") + DEBOUNCE).alias("confirmed_us"), F.col("last").alias("resolved_us"), "confidence",
    )


LONGEST = f"""
e AS (SELECT *, epoch_us(ts) AS us FROM events WHERE event_type = 'error'),
f AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) <= {{gap}} THEN 0 ELSE 1 END AS fresh FROM e),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS island FROM f),
r AS (SELECT user_id, island, min(us) AS first, max(us) AS last, count(*) AS n FROM g GROUP BY ALL),
l AS (SELECT user_id, first, last, last - first AS span FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY last - first DESC, first) = 1)"""


def longest_run(spark, sf_dir):
    return seq.longest_run(events(spark, sf_dir).filter("event_type = 'error'"), ["user_id"], "us", GAP)


def all_runs(spark, sf_dir):
    return seq.runs(events(spark, sf_dir).filter("event_type = 'error'"), ["user_id"], "us", GAP)


def ema_state(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("share", F.least(F.col("value") / 100, F.lit(1.0)))
    return seq.gated_state(e, ["user_id"], ["us", "event_id"], "share", F.col("event_type").isin("view", "click"), 0.35, 4, 0.7).withColumns(
        {"n": F.col("n").cast("int"), "average": F.round("average", 9)}
    )


def carry_forward(spark, sf_dir):
    e = events(spark, sf_dir)
    seen = F.when(F.col("event_type") == "purchase", F.col("value"))
    return seq.carry_forward(e, ["user_id"], ["us", "event_id"], seen, "last_purchase").select("event_id", "last_purchase")


def every_second_moment(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("day", F.floor(F.col("us") / (24 * HOUR))).withColumn("hour", F.floor(F.col("us") / HOUR))
    return seq.every_kth_moment(e, ["day"], "hour", 2).select("event_id")


def trailing_state(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", F.col("us").alias("t"), F.col("value").alias("x"), (F.col("value") * 2).alias("y"))
    moved = seq.trailing_motion(e, ["user_id"], "t", "x", "y", 48 * HOUR)
    return seq.operating_state(moved, 2.0, speed=30.0, displacement=60.0).select(
        "event_id", F.col("n_trailing").cast("long").alias("n_trailing"), F.round("displacement", 6).alias("displacement"), "operating_state"
    )


def greedy_spacing(spark, sf_dir):
    return seq.greedy_spacing(events(spark, sf_dir), ["user_id"], "us", "event_id", 36 * HOUR)


def throttled_crops(spark, sf_dir):
    """Crops of users no more often than every 36 hours, of events of a value over 30: what is too small doesn't count as taken."""
    return seq.throttled(events(spark, sf_dir), ["user_id"], "us", "event_id", F.col("value") > 30, 36 * HOUR)


def keyframe_bins(spark, sf_dir):
    """Twelve key frames of each user's quarter hours; views and clicks are people, purchases machines. Every fifth user has eight frames."""
    e = events(spark, sf_dir).withColumn("frame", F.when(F.col("user_id") % 5 == 0, F.floor((F.col("us") - EPOCH) / HOUR) % 8).otherwise(F.floor((F.col("us") - EPOCH) / HOUR * 4)).cast("long"))
    seen = e.filter("event_type IN ('view', 'click', 'purchase')").groupBy("user_id", "frame").agg(
        F.count_if(F.col("event_type") != "purchase").alias("people"), F.count_if(F.col("event_type") == "purchase").alias("machines")
    )
    runs = e.select("user_id").distinct().withColumn("total", F.when(F.col("user_id") % 5 == 0, 8).otherwise(2880).cast("long"))
    return seq.keyframes(seen, runs, "user_id", 12)


def anchored_segments(spark, sf_dir):
    rows = events(spark, sf_dir).groupBy("user_id", "us").agg(F.round(F.min("value"), 6).alias("v"))
    return seq.anchored_segments(rows, ["user_id"], "us", "v", 20.0, 2 * HOUR)


def linspace_thin(spark, sf_dir):
    return seq.evenly_thinned(events(spark, sf_dir), ["user_id"], ["us", "event_id"], 20).select("event_id", "user_id")


def stride_sample(spark, sf_dir):
    return seq.stride_sample(events(spark, sf_dir), ["event_type"], ["us", "event_id"], 300).select("event_id", "event_type")


def bin_argmax(spark, sf_dir):
    return seq.bin_best(events(spark, sf_dir), ["user_id"], ["us", "event_id"], F.floor(F.col("value") / 10), 8).select("user_id", "bin", "event_id")


def median_halves(spark, sf_dir):
    return seq.median_halves(events(spark, sf_dir), ["user_id"], "us", "value").select(
        "user_id", F.round("early", 9).alias("early"), F.round("late", 9).alias("late")
    )


def largest_gap_split(spark, sf_dir):
    return seq.largest_gap_split(events(spark, sf_dir), ["user_id"], "value", "event_id")


QUERIES = {
    f.__name__: f
    for f in (
        debounced_incidents, longest_run, all_runs, ema_state, carry_forward, every_second_moment, trailing_state, greedy_spacing,
        anchored_segments, throttled_crops, keyframe_bins, linspace_thin, stride_sample, bin_argmax, median_halves, largest_gap_split,
    )
}

RANKED = "row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS n"
ORACLE_SQL = {
    "debounced_incidents": f"""WITH {LONGEST.format(gap=2 * DEBOUNCE)}
SELECT concat_ws('-', 'run', user_id, 'R1', first, last) AS incident_id, user_id, first AS first_us, first + {DEBOUNCE} AS confirmed_us,
       last AS resolved_us, (SELECT round(avg(value), 6) FROM e WHERE e.user_id = l.user_id) AS confidence
FROM l WHERE span >= {DEBOUNCE}""",
    "longest_run": f"WITH {LONGEST.format(gap=GAP)} SELECT * FROM l",
    "all_runs": f"WITH {LONGEST.format(gap=GAP)} SELECT user_id, first, last, n FROM r",
    "ema_state": """
WITH v AS (SELECT user_id, list(least(value / 100, 1.0) ORDER BY ts, event_id) AS vs FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id),
a AS (SELECT user_id, len(vs) AS n, list_reduce(vs, lambda e, x: 0.65 * e + 0.35 * x) AS average FROM v)
SELECT user_id, n::INTEGER AS n, round(average, 9) AS average,
       CASE WHEN n >= 4 AND greatest(average, 1 - average) >= 0.7 THEN CASE WHEN average >= 0.5 THEN 'yes' ELSE 'no' END ELSE 'unknown' END AS state
FROM a""",
    "carry_forward": """
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
       OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events""",
    "every_second_moment": """
WITH m AS (SELECT DISTINCT date_trunc('day', ts) AS d, date_trunc('hour', ts) AS h FROM events),
k AS (SELECT h, row_number() OVER (PARTITION BY d ORDER BY h) - 1 AS i FROM m)
SELECT event_id FROM events JOIN k ON date_trunc('hour', ts) = h WHERE i % 2 = 0""",
    "trailing_state": f"""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t, value AS x FROM events),
w AS (SELECT event_id, list(x) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {48 * HOUR} PRECEDING AND CURRENT ROW) AS xs,
             list(t) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {48 * HOUR} PRECEDING AND CURRENT ROW) AS ts FROM e),
o AS (SELECT event_id, list_transform(list_sort(list_zip(ts, xs)), lambda p: p[2]) AS xs, len(xs) AS n FROM w),
k AS (SELECT *, greatest(1, n // 3) AS k FROM o),
m AS (SELECT event_id, n, sqrt(5) * abs(list_median(xs[n - k + 1:]) - list_median(xs[:k])) AS displacement FROM k)
SELECT event_id, n AS n_trailing, round(displacement, 6) AS displacement,
       CASE WHEN n >= 4 AND (displacement / 2 >= 30 OR displacement >= 60) THEN 'active' ELSE 'unknown' END AS operating_state FROM m""",
    "greedy_spacing": f"""
WITH v AS (SELECT user_id, list({{'id': event_id, 't': epoch_us(ts)}} ORDER BY ts, event_id) AS r FROM events GROUP BY user_id),
k AS (SELECT user_id, list_reduce(r, lambda acc, x: CASE WHEN x.t - acc[-1].t >= {36 * HOUR} THEN list_append(acc, x) ELSE acc END, r[1:1]) AS kept FROM v)
SELECT user_id, u.id AS id, u.t AS t FROM (SELECT user_id, unnest(kept) AS u FROM k)""",
    "throttled_crops": f"""
WITH v AS (SELECT user_id, list({{'id': event_id, 't': epoch_us(ts)}} ORDER BY ts, event_id) AS r FROM events WHERE value > 30 GROUP BY user_id),
k AS (SELECT user_id, list_reduce(r, lambda acc, x: CASE WHEN x.t - acc[-1].t >= {36 * HOUR} THEN list_append(acc, x) ELSE acc END, r[1:1]) AS kept FROM v)
SELECT user_id, u.id AS id, u.t AS t FROM (SELECT user_id, unnest(kept) AS u FROM k)""",
    "anchored_segments": f"""
WITH e AS (SELECT user_id, epoch_us(ts) AS us, round(min(value), 6) AS v FROM events GROUP BY ALL),
r AS (SELECT user_id, list({{'a': v, 'f': us, 'l': us, 'n': 1}} ORDER BY us, v) AS r FROM e GROUP BY user_id),
s AS (SELECT user_id, unnest(list_reduce(r[2:], lambda acc, x: CASE WHEN abs(x.a - acc[-1].a) > 20 THEN list_append(acc, x)
  ELSE list_append(acc[1:-2], {{'a': acc[-1].a, 'f': acc[-1].f, 'l': x.f, 'n': acc[-1].n + 1}}) END, r[1:1])) AS s FROM r)
SELECT user_id, s.f AS first, s.l AS last, s.n::BIGINT AS n FROM s WHERE s.l - s.f >= {2 * HOUR}""",
    "keyframe_bins": f"""
WITH e AS (SELECT user_id, event_type, CASE WHEN user_id % 5 = 0 THEN floor((epoch_us(ts) - {EPOCH}) / {HOUR})::BIGINT % 8 ELSE floor((epoch_us(ts) - {EPOCH}) / {HOUR} * 4)::BIGINT END AS frame, if(user_id % 5 = 0, 8, 2880) AS total FROM events),
k AS (SELECT user_id, frame, least(count(*) FILTER (event_type <> 'purchase'), 3) + if(count(*) FILTER (event_type = 'purchase') > 0, 2, 0) AS worth FROM e WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL),
b AS (SELECT user_id, total, bin, bin * total // 12 AS start, greatest(bin * total // 12 + 1, (bin + 1) * total // 12) AS stop FROM (SELECT DISTINCT user_id, total FROM e), range(12) AS t(bin)),
p AS (SELECT b.user_id, bin, total, (start + stop - 1) / 2 AS centre, (SELECT frame FROM k WHERE k.user_id = b.user_id AND frame >= start AND frame < stop ORDER BY worth DESC, abs(frame - (start + stop - 1) / 2), frame LIMIT 1) AS frame FROM b)
SELECT user_id, min(bin)::INTEGER AS bin, frame FROM (SELECT user_id, bin, least(coalesce(frame, round_even(centre, 0)::BIGINT), total - 1) AS frame FROM p) GROUP BY user_id, frame""",
    "linspace_thin": f"""
WITH r AS (SELECT event_id, user_id, {RANKED.format(key="user_id")} FROM events)
SELECT event_id, user_id FROM r WHERE n <= 20 OR list_contains(list_transform(range(20), lambda k: round_even(k * (n - 1) / 19.0, 0)::BIGINT), i)""",
    "stride_sample": f"""
WITH r AS (SELECT event_id, event_type, {RANKED.format(key="event_type")} FROM events)
SELECT event_id, event_type FROM r WHERE n <= 300 OR list_contains(list_transform(range(300), lambda k: (k * n) // 300), i)""",
    "bin_argmax": f"""
WITH r AS (SELECT event_id, user_id, value, {RANKED.format(key="user_id")} FROM events),
b AS (SELECT *, (i * 8) // n AS bin FROM r)
SELECT user_id, bin::INTEGER AS bin, event_id FROM b
QUALIFY row_number() OVER (PARTITION BY user_id, bin ORDER BY floor(value / 10) DESC, abs(i - (bin + 0.5) * n / 8), i) = 1""",
    "median_halves": """
WITH m AS (SELECT user_id, quantile_cont(epoch_us(ts)::DOUBLE, 0.5) AS m FROM events GROUP BY user_id)
SELECT user_id, round(avg(value) FILTER (epoch_us(ts) <= m), 9) AS early, round(avg(value) FILTER (epoch_us(ts) > m), 9) AS late
FROM events JOIN m USING (user_id) GROUP BY user_id""",
    "largest_gap_split": """
WITH s AS (SELECT user_id, value, lead(value) OVER w AS nxt, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id))
SELECT user_id, n, i AS n_low, nxt - value AS gap, value AS low, nxt AS high FROM s WHERE nxt IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY nxt - value DESC, i) = 1""",
}
