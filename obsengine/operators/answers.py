"""Questions on runs: guardrails, routing, deterministic answers, and grounded briefings of incidents."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsengine.functions import text as t
from obsengine.operators.retrieval import grounded

#: Phrases that ask for a verdict of law, terms that name a rule, and words of regulations. Fixed values.
LEGAL = (
    "is this legal", "is this illegal", "legally compliant", "compliance decision", "are they liable", "who is liable", "legal liability",
    "certify compliance",
)
RULE_TERMS = {
    "R1": ("r1", "helmet", "head", "hardhat"),
    "R2": ("r2", "vest", "hi-vis", "visibility", "hiviz"),
    "R3": ("r3", "restricted", "zone"),
    "R4": ("r4", "machine", "machinery", "plant", "excavator", "near"),
    "R5": ("r5", "edge", "fall", "height"),
}
REGULATION = ("regulation", "clause", "bocw", "law", "requirement", "require", "rule say", "rules say", "what does the rule")

#: What a generated wording may not say, and what it has to. Fixed values.
CITATION = r"(?i)(§|\b(rule|rules|act|bocw|section|clause|regulation)\b|\bIS\s*\d+)"
VERDICT = r"(?i)\b(compliant|non-compliant|violation|violates|illegal|unlawful|required by law|liable|penalty|must legally|breach)\b"
AUTHORITY = r"\b(R[1-5]|severity|high severity|medium severity)\b"
TRACK = r"(?i)\b(?:person|vehicle|worker)-\d+\b"
FAR = r"(?i)\b(far|distant|remote|safe distance away|well clear)\b"
CLAIMS = {
    "machinery": ("excavator", "crane", "truck", "loader", "roller", "bulldozer", "forklift", "lorry", "digger"),
    "protective item": ("harness", "goggles", "gloves", "boots", "respirator", "glasses", "earplugs", "scaffold"),
    "harm": ("injur", "accident", "fatal", "crush", "collision", "collide", "hurt", "died"),
    "environment": ("rain", "wet", "night", "dark", "wind", "storm", "slippery"),
}
CONCEPTS = {
    "helmet": ("helmet", "hard hat", "hardhat", "head protection", "headwear"),
    "vest": ("vest", "hi-vis", "high-visibility", "reflective", "high visibility"),
    "zone_access": ("zone", "area", "region", "authoris", "authoriz", "permit", "access", "allowed"),
    "machinery_separation": ("clear", "away", "separat", "distance", "gap", "reach", "apart", "path"),
    "edge_protection": ("edge", "guardrail", "rail", "barrier", "protect", "fall", "drop"),
}
UNSAYING = (
    "a", "an", "and", "are", "as", "at", "be", "been", "by", "for", "from", "has", "have", "in", "is", "it", "its", "of", "on", "or", "that", "the",
    "this", "to", "was", "were", "while", "with", "worker", "workers", "seen", "seems", "appears", "appear", "visible",
)


def incident_query(df: DataFrame) -> Column:
    """The incident's fields as a query text; missing and empty ones are dropped."""
    fields = [F.col(c) for c in ("rule_id", "reason_code", "basis", "severity", "observation_text", "action_text") if c in df.columns]
    fields += [F.array_join("references", " ")] if "references" in df.columns else []
    return F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in fields))


def routed(question: Column) -> Column:
    """empty_question, legal_verdict_request, regulation, a rule's id, or counts."""
    return (
        F.when(F.trim(F.coalesce(question, F.lit(""))) == "", "empty_question")
        .when(t.mentions(question, LEGAL), "legal_verdict_request")
        .when(t.mentions(question, REGULATION), "regulation")
        .otherwise(F.coalesce(t.routed(question, RULE_TERMS), F.lit("counts")))
    )


def answered(questions: DataFrame, incidents: DataFrame, coverage: DataFrame, clauses: DataFrame) -> DataFrame:
    """questions (question_id, run_id, question) with route and answer, from incidents, coverage and the first clause of a rule.

    A rule's incidents come before its coverage; a regulation question quotes a clause of the rule it names, if any.
    """
    q = questions.withColumn("route", routed(F.col("question"))).withColumn("rule_id", t.routed(F.col("question"), RULE_TERMS))
    per_rule = incidents.groupBy("run_id", "rule_id").agg(F.count("*").alias("n"), F.min("first_seen_s").alias("first"))
    counts = per_rule.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "rule_id", F.col("n").cast("string")))), ", ").alias("counts"))
    quotes = clauses.select(F.explode("rule_ids").alias("rule_id"), "chunk_id", "clause_ref", "text").groupBy("rule_id").agg(F.min_by(F.concat_ws(": ", "clause_ref", "text"), "chunk_id").alias("quote"))
    joined = (
        q.join(per_rule, ["run_id", "rule_id"], "left")
        .join(coverage.select("run_id", "rule_id", F.concat_ws(", ", "status", "reason_code").alias("covered")), ["run_id", "rule_id"], "left")
        .join(counts, "run_id", "left")
        .join(quotes, "rule_id", "left")
    )
    answer = (
        F.when(F.col("route").isin("empty_question", "legal_verdict_request"), None)
        .when((F.col("route") == "regulation") & F.col("quote").isNotNull(), F.col("quote"))
        .when(F.col("n").isNotNull(), F.format_string("%s: %d incidents, the first at %.1f s", "rule_id", "n", "first"))
        .when(F.col("covered").isNotNull(), F.concat_ws(": ", "rule_id", "covered"))
        .otherwise(F.coalesce("counts", F.lit("no incidents")))
    )
    return joined.select("question_id", "run_id", "route", answer.alias("answer"))


def briefings(hits: DataFrame) -> DataFrame:
    """hits (incident_id, rank, clause_ref, text, sentences array) as (incident_id, status, text): each sentence of the top
    clause's briefing has to share two terms with its evidence, else it is refused."""
    top = hits.filter("rank = 1 OR rank IS NULL")
    fine = F.forall("sentences", lambda s: grounded(s, F.col("text")))
    status = F.when(F.col("rank").isNull(), "no_retrieved_clause").when(fine, "grounded").otherwise("ungrounded_sentence")
    return top.select("incident_id", status.alias("status"), F.when(status == "grounded", F.array_join("sentences", " ")).alias("text"))


def context(incidents: DataFrame, most: int = 5) -> DataFrame:
    """(run_id, context): the first incidents of each run by id, one a line, and how many there are."""
    line = F.concat_ws(" ", "rule_id", "canonical_track_id", F.format_string("%.1f", "first_seen_s"))
    ranked = incidents.select("run_id", line.alias("line"), F.row_number().over(Window.partitionBy("run_id").orderBy("incident_id")).alias("k"))
    first = ranked.filter(F.col("k") <= most).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("first"))
    joined = incidents.groupBy("run_id").agg(F.count("*").alias("n")).join(first, "run_id")
    lines = F.array_join(F.transform("first", lambda r: r["line"]), "\n")
    return joined.select("run_id", F.concat_ws("\n", F.format_string("%d incidents", "n"), lines).alias("context"))


def gated(requests: DataFrame, raw: Column, source: Column, condition: Column, action: Column, band: Column) -> DataFrame:
    """requests with `failed`, the gates that a generated wording doesn't pass, and `text`, the wording, or the request's own template.

    raw is JSON with two strings, in a code fence or not; source: all that the request says; condition: what was observed;
    action: the code of the action, one of CONCEPTS; band: near or null. What isn't of that form fails `schema` alone.
    """
    bare = F.trim(F.regexp_replace(F.trim(raw), r"^```(?:json)?\s*|\s*```$", ""))
    parsed = F.from_json(bare, "reasoning string, recommended_wording string")
    keys = F.array_sort(F.json_object_keys(bare))
    fine = F.coalesce(keys == F.array(F.lit("reasoning"), F.lit("recommended_wording")), F.lit(False))
    fine = fine & parsed["reasoning"].isNotNull() & parsed["recommended_wording"].isNotNull()
    words = lambda c: F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""))
    body = F.concat_ws(" ", parsed["reasoning"], parsed["recommended_wording"])
    said, given = F.lower(body), F.lower(F.coalesce(source, F.lit("")))
    found = lambda c, pattern: F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    number = r"\d+(?:\.\d+)?"
    content = lambda c: t.without(F.transform(found(c, r"[A-Za-z][A-Za-z\-']*"), lambda w: F.btrim(F.lower(w), F.lit("'-"))), UNSAYING)
    new = lambda term: F.contains(said, F.lit(term)) & ~F.contains(given, F.lit(term))
    concept = F.coalesce(*(F.when(action == code, t.mentions(body, terms)) for code, terms in CONCEPTS.items()), F.lit(False))
    gates = {
        "length": ~(words(parsed["reasoning"]).between(8, 60) & words(parsed["recommended_wording"]).between(4, 35)),
        "citation": body.rlike(CITATION),
        "verdict": body.rlike(VERDICT),
        "authority": body.rlike(AUTHORITY),
        "numbers": F.size(F.array_except(found(body, number), found(given, number))) > 0,
        "entities": F.exists(found(body, TRACK), lambda x: ~F.contains(given, F.lower(x))),
        **{f"claims:{kind}": reduce(or_, map(new, terms)) for kind, terms in CLAIMS.items()},
        "action": ~concept,
        "observation": F.size(F.array_intersect(content(parsed["reasoning"]), content(F.coalesce(condition, F.lit(""))))) == 0,
        "band": band.isNotNull() & body.rlike(FAR),
    }
    failed = F.when(fine, t.failures(gates)).otherwise(F.array(F.lit("schema")))
    return requests.withColumn("failed", failed).withColumn("text", F.when(F.size("failed") == 0, body).otherwise(F.col("template")))
