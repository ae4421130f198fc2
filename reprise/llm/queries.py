"""The queries of this subpackage: one for each operator, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, lm, mixing, quality, secrets, simhash, substrings, tokens, toxicity, urls
from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    spans = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda s: F.concat_ws(":", s["kinds"], s["starts"], s["ends"]))
    n = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    base = F.array_join(F.filter("spans", lambda s: ~s.startswith("guess:")), ",")
    return found.withColumn("spans", spans).select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(base, 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"), F.size("costs").cast("long").alias("n_values"), F.array_max("costs").alias("max_cost"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.fit_and_score(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove(table(spark, sf_dir, "documents"), window=20)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokens.new_path(spark, "token-ids")
    tokens.write(table(spark, sf_dir, "documents"), path)
    return tokens.digests(spark, path)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed, times, place = mixing.copies(docs, mixing.plan(docs, max_repetition=1.5))
    return mixed.select("doc_id", "source", mixing.tokens_of(F.col("text")).alias("n_tokens"), F.col(times).alias("copies"), F.col(place).alias("place"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"), width=3, tau=2)
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = quality.judge(table(spark, sf_dir, "documents"))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_secret_scan, op2_lm_score, op3_substring_dedup, op4_token_ids, op5_mixing, op6_simhash, op7_decontamination, op8_toxicity, op9_url_filter, op10_quality_rules)}


def oracle_sql() -> dict[str, str]:
    return {"op9_url_filter": urls.oracle_sql(), "op10_quality_rules": quality.ORACLE_SQL}
