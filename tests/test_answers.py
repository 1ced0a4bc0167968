"""Review, answers, wording gates and predicates on small fixtures."""

import json

import pandas as pd
from pyspark.sql import functions as F

from obsengine import schema
from obsengine.functions import predicates as p
from obsengine.operators import answers, review

INCIDENT = "incident_id string, run_id string, rule_id string, canonical_track_id string, first_seen_s double"


def test_answers(spark):
    asked = {
        1: ("", "empty_question", None), 2: ("Who is LIABLE for it?", "legal_verdict_request", None), 3: ("any helmet trouble?", "R1", "R1: 2 incidents, the first at 1.5 s"),
        4: ("was the vest fine", "R2", "R2: clear, none"), 5: ("what does the clause on helmets say", "regulation", "c1: wear helmets"), 6: ("how many?", "counts", "R1: 2, R3: 1"), 7: (None, "empty_question", None),
    }
    q = spark.createDataFrame([(i, "r", a[0]) for i, a in asked.items()] + [(9, "other", "how many?")], "question_id int, run_id string, question string")
    found = spark.createDataFrame([("a", "r", "R1", "t", 1.5), ("b", "r", "R1", "t", 9.0), ("c", "r", "R3", "t", 2.0)], INCIDENT)
    coverage = spark.createDataFrame([("r", "R2", "clear", "none")], schema.COVERAGE)
    clauses = spark.createDataFrame([("k2", ["R1"], "c2: later"), ("k1", ["R1", "R2"], "wear helmets")], "chunk_id string, rule_ids array<string>, text string").withColumn("clause_ref", F.lit("c1"))
    got = {r.question_id: (r.route, r.answer) for r in answers.answered(q, found, coverage, clauses).collect()}
    assert got == {i: a[1:] for i, a in asked.items()} | {9: ("counts", "no incidents")}
    lines = answers.context(found, 2).first().context.split("\n")
    assert lines == ["3 incidents", "R1 t 1.5", "R1 t 9.0"]
    full = found.limit(1).selectExpr("*", "'why' AS reason_code", "'' AS basis", "'high' AS severity", "'seen' AS observation_text", "array('r1', 'r2') AS references")
    assert full.select(answers.incident_query(full).alias("q")).first().q == "R1 why high seen r1 r2"


def test_briefings(spark):
    rows = [("a", 1, "c", "workers must wear safety helmets", ["Workers need safety helmets."]), ("b", 1, "c", "workers must wear helmets", ["Nothing of it."]), ("c", None, None, None, None)]
    got = {r.incident_id: (r.status, r.text) for r in answers.briefings(spark.createDataFrame(rows, "incident_id string, rank int, clause_ref string, text string, sentences array<string>")).collect()}
    assert got == {"a": ("grounded", "Workers need safety helmets."), "b": ("ungrounded_sentence", None), "c": ("no_retrieved_clause", None)}


def test_wording_gates(spark):
    good = {"reasoning": "A person was observed without a helmet for 12 seconds at the gate", "recommended_wording": "Please hand out a helmet now"}
    say = lambda **more: json.dumps(good | more)
    action = lambda text: say(recommended_wording=text)
    cases = {
        "good": (say(), []), "fenced": (f"```json\n{say()}\n```", []), "not json": ("nope", ["schema"]), "one key": (json.dumps({"reasoning": "x"}), ["schema"]), "null": (None, ["schema"]),
        "number": (action("Please hand out 99 helmets right now"), ["numbers"]), "law": (action("The helmet rule asks for it now"), ["citation"]), "verdict": (action("No helmet here is illegal now"), ["verdict"]),
        "authority": (action("Helmet missing, high severity for now"), ["authority"]), "track": (action("Give person-7 a helmet right now"), ["numbers", "entities"]), "known": (action("Give person-12 a helmet right now"), []),
        "claim": (action("Hand out a helmet near the crane"), ["claims:machinery"]), "concept": (say(reasoning="A person was observed with no cover on for 12 seconds", recommended_wording="Please look at this scene now"), ["action"]),
        "other": (say(reasoning="Something else entirely was going on over there just now"), ["observation"]), "far": (action("A helmet, well clear of all"), ["band"]), "short": (action("Helmet"), ["length"]),
    }
    df = spark.createDataFrame([(k, v[0], "person-12 no helmet 12 seconds near", "observed without helmet", "helmet", "near", "template") for k, v in cases.items()], "id string, raw string, source string, condition string, code string, band string, template string")
    got = {r.id: r for r in answers.gated(df, *map(F.col, ("raw", "source", "condition", "code", "band"))).collect()}
    assert {k: got[k].failed for k in cases} == {k: v[1] for k, v in cases.items()}
    assert got["good"].text.startswith("A person") and got["law"].text == "template"


def test_cache_and_seam(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "id int, crop string")
    cache = spark.createDataFrame([("a", "cached")], "key string, state string")

    def load():
        return lambda frame: pd.DataFrame({"key": frame["key"], "state": "model"})

    got = sorted(map(tuple, review.with_cache(rows, cache, F.col("crop"), load, "state string").collect()))
    assert got == [("a", "cached"), ("b", "model"), ("c", "model")]


def test_predicates(spark):
    b = F.struct(F.lit(10.0).alias("x1"), F.lit(10.0).alias("y1"), F.lit(80.0).alias("x2"), F.lit(180.0).alias("y2"))
    r = spark.range(1).select(
        p.assessable(b).alias("a"), p.pose_candidate(b, 1920.0, 1080.0).alias("pose"), p.contact_visible(b, 182.0).alias("contact"), p.contacts(b).alias("c"),
        p.letterboxed(F.lit(2160), F.lit(3840), 1920, 1080).alias("box"), p.gear_colour(F.lit("helmet"), F.lit("no_vest")).alias("colour"), p.negative_class(F.lit("no-vest")).alias("neg"),
        p.upright_observation(F.lit(0.9), F.lit(0.1), F.lit(0.7), F.lit(0.7), F.lit(-50)).alias("up"),
    ).first()
    assert r.a and r.pose and not r.contact and [x.x for x in r.c] == [10, 80] and tuple(r.box) == (656, 0, 608, 1080)
    assert r.colour == "missing" and r.neg and r.up
    checks = p.clip_checks(F.lit(1920), F.lit(1080), F.lit(70), F.lit(3.0))
    assert spark.range(1).select(*(c.alias(n) for n, c in checks.items())).first().asDict() == {"aspect": True, "duration": True, "width": True, "steady": False, "usable_drift": True}
