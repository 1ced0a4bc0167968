"""One query for each operator of this subpackage, over whole tables, with the SQL that must agree."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from obsengine.llm import bpe, language_id, license_scan, merkle, packing, periodic_runs, quality_classifier, quality_rules, simhash, substring_dedup, telephony, toxicity, warc
from obsengine.llm.common import staged, table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), BYTE_BPE)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.payload_digests(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), BYTE_BPE)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = staged(quality_rules.ledger(table(spark, sf_dir, "documents")), "quality-ledger")
    return quality_rules.apply_policy(entries, "v2")


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = staged(quality_rules.ledger(table(spark, sf_dir, "documents")), "quality-ledger")
    return quality_rules.ablations(entries, "v2")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_manifest(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), rewritten=periodic_runs.planted))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.labelled(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # which imports this module

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_warc": op1_warc,
    "op2_bpe": op2_bpe,
    "op3_language_id": op3_language_id,
    "op4_telephony": op4_telephony,
    "op5_quality": op5_quality,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_simhash": op9_simhash,
    "op10_quality_rules": op10_quality_rules,
    "quality_rule_ablations": quality_rule_ablations,
    "op11_merkle": op11_merkle,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_license_scan": op13_license_scan,
    "pipeline": pipeline,
}
#: DuckDB has no base-32: the digest's bits are taken in fives.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
k AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first,
  array_to_string(list_transform(range(40), lambda i: right('000' || bin(('0x' || x[i + 1:i + 1])::INTEGER), 4)), '') AS bits FROM p)
SELECT page_id, octet_length(encode(h)) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5),
         lambda j: substr(bits, i * 5 + j + 1, 1)::INTEGER * (16 // (2 ** j)::INTEGER)))::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, nullif(first, page_id) AS refers_to FROM k"""

ORACLE_SQL = {
    "op1_warc": WARC_SQL,
    "op10_quality_rules": quality_rules.ORACLE_SQL,
    "quality_rule_ablations": quality_rules.ABLATIONS_SQL,
    "op11_merkle": merkle.ORACLE_SQL,
    "op13_license_scan": license_scan.ORACLE_SQL,
}
