"""Scores of clusters: frequency, cost and stability, halved when they weren't seen of late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def recency_days(ts: Column, now: str) -> Column:
    """Days from an ISO text, UTC if it names no zone, to now; null if it can't be read."""
    zoned = F.when(ts.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"), ts).otherwise(F.concat(ts, F.lit("+00:00")))
    seconds = F.unix_micros(F.to_timestamp(F.lit(now))) / 1e6 - F.unix_micros(F.try_to_timestamp(zoned)) / 1e6
    return F.greatest(F.lit(0.0), seconds / 86400)


def magnitude(usd: Column, tokens: Column) -> Column:
    return F.when(usd > 0, usd).when(tokens > 0, tokens.cast("double")).otherwise(0.0)


def score(clusters: DataFrame, costs: DataFrame, variances: DataFrame, now: str) -> DataFrame:
    """clusters (cluster_id, distinct_sessions, last_seen, ...) with frequency, cost_score, stability and score."""
    c = clusters.join(costs, "cluster_id").join(variances, "cluster_id")
    tokens = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens")
    c = c.withColumn("__m", magnitude(F.col("usd"), tokens)).withColumn("__s", F.log(F.greatest(F.lit(1), "distinct_sessions").cast("double")))
    top = F.broadcast(c.agg(F.max("__s").alias("__ms"), F.max(F.log(F.col("__m") + 1)).alias("__mm"), F.max("turn_variance").alias("__mv")))
    positive = lambda x: F.when(x > 0, x).otherwise(1.0)
    c = c.join(top)
    frequency, cost = clamp(F.col("__s") / positive(F.col("__ms"))), clamp(F.log(F.col("__m") + 1) / positive(F.col("__mm")))
    stability = F.when(F.col("__mv") > 0, clamp(1 - F.col("turn_variance") / F.col("__mv"))).otherwise(1.0)
    old = F.coalesce(recency_days(F.col("last_seen"), now) > 7, F.lit(False))
    value = frequency * cost * stability * F.when(old, 0.5).otherwise(1.0)
    rounded = lambda x, n: F.bround(x, 6).alias(n)
    return c.select(*clusters.columns, "usd", "basis", "priced", rounded(frequency, "frequency"), rounded(cost, "cost_score"), rounded(stability, "stability"), rounded(value, "score"))


def turn_variance(members: DataFrame) -> DataFrame:
    return members.groupBy("cluster_id").agg(F.var_pop("session_turn_count").alias("turn_variance"))


def order(candidates: DataFrame) -> DataFrame:
    return candidates.orderBy(F.desc("score"), F.desc("distinct_sessions"), F.desc("run_count"), F.desc("usd"), F.lower("label"), "cluster_id")


def evidence(members: DataFrame, top: int = 3) -> DataFrame:
    """The latest asks of each cluster with different texts."""
    text = F.trim("raw_text")
    once = members.withColumn("__n", F.row_number().over(Window.partitionBy("cluster_id", text).orderBy(F.coalesce("ts", F.lit("")).desc(), "intent_ord"))).where("__n = 1")
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.coalesce("ts", F.lit("")).desc(), "intent_ord"))
    return once.withColumn("place", rank).where(F.col("place") <= top).select("cluster_id", "place", "intent_ord", "session_id", "ts", text.alias("text"))


def project_rollups(clusters: DataFrame, costs: DataFrame) -> DataFrame:
    """Each cluster's whole cost for each of its projects."""
    return clusters.join(costs, "cluster_id").select(F.explode("projects").alias("project"), "usd", "run_count").groupBy("project").agg(F.bround(F.sum("usd"), 6).alias("usd"), F.sum("run_count").alias("run_count"), F.count("*").alias("clusters"))
