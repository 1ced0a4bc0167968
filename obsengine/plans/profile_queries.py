"""Queries on labelled clips: boxes made of events, users in clips of six, twelve hours a frame; and on calibration and intake."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsengine.operators import calibration, intake, profiles
from obsengine.plans.common import HOUR, events, table
from obsengine.plans.rule_queries import EPOCH

CLIPS, SAMPLED = 6, 20
#: What events of each type are boxes of; views and clicks are people.
NAMES = {"error": "helmet", "signup": "vest", "purchase": "ebox"}


def boxes(spark, sf_dir):
    """(clip, frame, row_id, track, name, box) of events."""
    e = events(spark, sf_dir)
    user, event, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")
    x = (user * 53 % 40) * 20
    y = (user * 31 % 20) * 10
    name = F.coalesce(*(F.when(kind == k, v) for k, v in NAMES.items()), F.lit("person"))
    person, still = name == "person", name == "ebox"
    left = F.when(person, x).when(still, user % 7 * 40 + event % (3 + user % 6 * 9)).otherwise(x + event % 70 - 10)
    up = F.when(person, y).when(still, user % 5 * 30 + event % 4).otherwise(y + event % 90 - 10)
    wide = F.when(person, 60).otherwise(20)
    tall = F.when(person, 30 + F.floor("value") % 150).otherwise(20)
    number = lambda c: c.cast("double")
    return e.select(
        F.concat(F.lit("clip"), (user % CLIPS).cast("string")).alias("clip"), F.floor((F.col("us") - EPOCH) / HOUR / 12).cast("long").alias("frame"), event.alias("row_id"),
        (user % 30).alias("track"), name.alias("name"),
        F.struct(number(left).alias("x1"), number(up).alias("y1"), number(left + wide).alias("x2"), number(up + tall).alias("y2")).alias("box"),
    )


def clip_profiles(spark, sf_dir):
    """Whole profiles of clips, compliance by about SAMPLED frames each."""
    p = profiles.profiled(boxes(spark, sf_dir), "clip", SAMPLED)
    return p.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in p.dtypes))


def people_with_helmets(spark, sf_dir):
    """The people of all frames with a helmet on, by row."""
    b = boxes(spark, sf_dir)
    return profiles.wearing(b.filter("name = 'person'"), b.filter("name = 'helmet'"), ["clip", "frame"], "row_id", *profiles.WEAR["helmet"])


HEADS, WAYS = 3, 10


def head_temperatures(spark, sf_dir):
    """Temperatures of three heads: the first values of an embedding are the logits of its label, the steeper the higher the head."""
    head = F.col("vec_id") % HEADS
    logits = F.transform(F.slice("embedding", 1, WAYS), lambda x: x.cast("double") * (1 + 4 * head))
    rows = table(spark, sf_dir, "embeddings").select(head.alias("head"), logits.alias("logits"), F.when(F.col("vec_id") % 11 == 0, -1).otherwise(F.col("label") % WAYS).alias("label"))
    return calibration.temperatures(rows, "head", "logits", "label").select("head", "n", F.round("temperature", 4).alias("temperature"))


#: What the names of annotations are; None: known, and left out.
CLASSES = {"click": "person", "view": "person", "purchase": "truck", "error": "crane", "signup": None}


def annotation_intake(spark, sf_dir):
    """Annotated images of users: an event is an object of its user's image, as its type names it; every ninth user has no image, and each of a dozen the same."""
    e = events(spark, sf_dir)
    user, event = F.col("user_id"), F.col("event_id")
    whole = lambda c: c.cast("int")
    x, y = event % 700 - 30, user * 7 % 500 - 20
    size = F.struct(F.lit(640).alias("width"), F.lit(480).alias("height"))
    item = F.struct(F.col("event_type").alias("name"), whole(x).alias("x1"), whole(y).alias("y1"), whole(x + F.floor("value") % 50).alias("x2"), whole(y + event % 60).alias("y2"), size.alias("size"))
    documents = e.groupBy(F.concat(F.lit("I0001"), F.lpad(user.cast("string"), 8, "0"), F.lit("000000_1")).alias("stem")).agg(F.collect_list(item).alias("labels"))
    images = e.filter(user % 9 != 0).select(F.concat(F.lit("I0001"), F.lpad(user.cast("string"), 8, "0"), F.lit("000000_1")).alias("stem"), F.when(user % 13 == 5, "same").otherwise(user.cast("string")).alias("sha256")).distinct()
    labels, _ = intake.converted(documents, images, CLASSES)
    shares = [F.floor(F.col(c) * 100_000 + 0.5001).alias(c) for c in ("xc", "yc", "w", "h")]
    return labels.select("stem", "group", "class_name", *shares)


QUERIES = {f.__name__: f for f in (clip_profiles, people_with_helmets, head_temperatures, annotation_intake)}

B = f"""b AS (SELECT clip, frame, row_id, track, name, x1, y1, x1 + if(name = 'person', 60, 20) AS x2, y1 + if(name = 'person', 30 + floor(value)::BIGINT % 150, 20) AS y2 FROM (
  SELECT *, CASE name WHEN 'person' THEN x WHEN 'ebox' THEN user_id % 7 * 40 + event_id % (3 + user_id % 6 * 9) ELSE x + event_id % 70 - 10 END AS x1,
    CASE name WHEN 'person' THEN y WHEN 'ebox' THEN user_id % 5 * 30 + event_id % 4 ELSE y + event_id % 90 - 10 END AS y1 FROM (
    SELECT 'clip' || (user_id % {CLIPS}) AS clip, floor((epoch_us(ts) - {EPOCH}) / {HOUR} / 12)::BIGINT AS frame, event_id AS row_id, event_id, user_id, value, user_id % 30 AS track,
      CASE event_type WHEN 'error' THEN 'helmet' WHEN 'signup' THEN 'vest' WHEN 'purchase' THEN 'ebox' ELSE 'person' END AS name, (user_id * 53 % 40) * 20 AS x, (user_id * 31 % 20) * 10 AS y FROM events)))"""
WORN = """EXISTS (SELECT 1 FROM b i WHERE i.clip = p.clip AND i.frame = p.frame AND i.name = '{0}' AND (i.x1 + i.x2) / 2 BETWEEN p.x1 AND p.x2
  AND (i.y1 + i.y2) / 2 BETWEEN p.y1 + (p.y2 - p.y1) * {1} - {3} AND p.y1 + (p.y2 - p.y1) * {2})"""
HELMET, VEST = (WORN.format(n, *profiles.WEAR[n]) for n in ("helmet", "vest"))
ORACLE_SQL = {
    "people_with_helmets": f"WITH {B} SELECT clip, frame, row_id FROM b p WHERE name = 'person' AND {HELMET}",
    "clip_profiles": f"""WITH {B},
f AS (SELECT clip, frame, row_number() OVER (PARTITION BY clip ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY clip) AS n FROM (SELECT DISTINCT clip, frame FROM b)),
k AS (SELECT clip, frame FROM f WHERE i % greatest(1, n // {SAMPLED}) = 0),
w AS (SELECT clip, count(*) AS n, count(*) FILTER ({HELMET}) AS helmet, count(*) FILTER ({VEST}) AS vest FROM b p WHERE name = 'person' AND y2 - y1 >= 40 AND (clip, frame) IN (SELECT (clip, frame) FROM k) GROUP BY clip),
h AS (SELECT clip, list_sort(list(y2 - y1)) AS t FROM b WHERE name = 'person' GROUP BY clip),
c AS (SELECT clip, list_sort(list(n)) AS t FROM (SELECT clip, frame, count(*) AS n FROM b WHERE name = 'person' GROUP BY ALL) GROUP BY clip),
s AS (SELECT clip, name, track, greatest(stddev_pop(x1), stddev_pop(y1)) AS drift FROM b WHERE name = 'ebox' GROUP BY ALL HAVING count(*) >= 300),
m AS (SELECT clip, max(drift) AS drift FROM s GROUP BY clip)
SELECT g.*, t_h[1 + floor(len(t_h) * 0.1)::BIGINT]::DOUBLE AS person_p10, t_h[1 + floor(len(t_h) * 0.5)::BIGINT]::DOUBLE AS person_p50, t_h[1 + floor(len(t_h) * 0.9)::BIGINT]::DOUBLE AS person_p90,
  t_c[1 + floor(len(t_c) * 0.9)::BIGINT] AS crowd_p90, t_c[-1] AS crowd_max, round(drift, 6) AS drift, CASE WHEN drift < 5 THEN 'fixed' WHEN drift < 25 THEN 'check' WHEN drift IS NOT NULL THEN 'moving' END AS camera,
  (SELECT count(*) FROM k WHERE k.clip = g.clip) AS sampled, coalesce(w.n, 0) AS n, coalesce(helmet, 0) AS helmet, coalesce(vest, 0) AS vest, round(1 - coalesce(helmet / nullif(w.n, 0), 0), 6) AS no_helmet,
  round(1 - coalesce(vest / nullif(w.n, 0), 0), 6) AS no_vest, round(frames / 25 / 60, 6) AS minutes
FROM (SELECT clip, count(*) AS boxes, count(DISTINCT frame) AS frames, max(x2)::DOUBLE + 1 AS width, max(y2)::DOUBLE + 1 AS height FROM b GROUP BY clip) g
LEFT JOIN (SELECT clip, t AS t_h FROM h) h USING (clip) LEFT JOIN (SELECT clip, t AS t_c FROM c) c USING (clip) LEFT JOIN m USING (clip) LEFT JOIN w USING (clip)""",
    "head_temperatures": f"""WITH RECURSIVE v AS (SELECT vec_id % {HEADS} AS head, label % {WAYS} AS y, list_transform(embedding[1:{WAYS}]::DOUBLE[], lambda x: x * (1 + 4 * (vec_id % {HEADS}))) AS z FROM embeddings WHERE vec_id % 11 <> 0),
s AS (SELECT head, 0 AS k, 0.1::DOUBLE AS lo, 4::DOUBLE AS hi FROM (SELECT DISTINCT head FROM v)
  UNION ALL SELECT head, k + 1, CASE WHEN up THEN lo ELSE mid END, CASE WHEN up THEN mid ELSE hi END FROM (
    SELECT s.head, k, lo, hi, (lo + hi) / 2 AS mid, sum(list_sum(list_transform(z, lambda x: x * exp((lo + hi) / 2 * (x - list_max(z))))) / list_sum(list_transform(z, lambda x: exp((lo + hi) / 2 * (x - list_max(z))))) - z[y + 1]) > 0 AS up
    FROM s JOIN v USING (head) WHERE k < 45 GROUP BY s.head, k, lo, hi))
SELECT head, (SELECT count(*) FROM v WHERE v.head = s.head) AS n, round(2 / (lo + hi), 4) AS temperature FROM s WHERE k = 45""",
    "annotation_intake": f"""WITH e AS (SELECT user_id, event_id, value, event_type, 'I0001' || lpad(user_id::VARCHAR, 8, '0') || '000000_1' AS stem FROM events),
i AS (SELECT stem FROM (SELECT DISTINCT stem, user_id, if(user_id % 13 = 5, 'same', user_id::VARCHAR) AS sha FROM e WHERE user_id % 9 <> 0) QUALIFY row_number() OVER (PARTITION BY sha ORDER BY stem) = 1),
b AS (SELECT stem, event_type, event_id % 700 - 30 AS x, user_id * 7 % 500 - 20 AS y, event_id % 700 - 30 + floor(value)::BIGINT % 50 AS xx, user_id * 7 % 500 - 20 + event_id % 60 AS yy FROM e WHERE stem IN (SELECT stem FROM i)),
c AS (SELECT stem, event_type, least(greatest(x, 0), least(xx, 640)) AS x1, greatest(greatest(x, 0), least(xx, 640)) AS x2, least(greatest(y, 0), least(yy, 480)) AS y1, greatest(greatest(y, 0), least(yy, 480)) AS y2 FROM b WHERE event_type <> 'signup')
SELECT stem, 'I0001/' || stem[6:13] AS group, CASE event_type WHEN 'purchase' THEN 'truck' WHEN 'error' THEN 'crane' ELSE 'person' END AS class_name,
  floor(round((x1 + x2) / 2 / 640, 6) * 100000 + 0.5001)::BIGINT AS xc, floor(round((y1 + y2) / 2 / 480, 6) * 100000 + 0.5001)::BIGINT AS yc, floor(round((x2 - x1) / 640, 6) * 100000 + 0.5001)::BIGINT AS w, floor(round((y2 - y1) / 480, 6) * 100000 + 0.5001)::BIGINT AS h
FROM c WHERE x2 - x1 >= 4 AND y2 - y1 >= 4""",
}
