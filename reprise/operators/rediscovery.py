"""How much exploration comes before the first change of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.shell import is_mutating


def flagged(calls: DataFrame) -> DataFrame:
    return calls.withColumn("mutating", is_mutating(F.col("name"), F.col("command")))


def sessions_of(calls: DataFrame) -> DataFrame:
    """One row a session: calls, prefix (null without a change), whether its prefix is a search and then two reads."""
    c = flagged(calls)
    low = F.lower(F.trim(F.coalesce("name", F.lit(""))))
    bounds = c.groupBy("session_key").agg(
        F.min("session_id").alias("session_id"), F.min("harness").alias("harness"), F.min("project").alias("project"), F.count("*").alias("calls"),
        F.min(F.when(F.col("mutating"), F.col("ord"))).alias("change"), F.min(F.when(low.isin(*V.SEARCH_TOOLS), F.col("ord"))).alias("search"),
    )
    before = c.join(bounds.select("session_key", "change", "search"), "session_key").where("ord < change").groupBy("session_key").agg(
        F.count("*").alias("prefix"), F.count_if(low.isin(*V.READ_TOOLS) & (F.col("ord") > F.col("search"))).alias("reads")
    )
    joined = bounds.join(before, "session_key", "left")
    prefix = F.when(F.col("change").isNotNull(), F.coalesce("prefix", F.lit(0)))
    loop = F.coalesce((F.col("search") < F.col("change")) & (F.col("reads") >= 2), F.lit(False))
    return joined.select("session_key", "session_id", "harness", "project", "calls", prefix.cast("long").alias("prefix"), loop.alias("loop"))


def summary(calls: DataFrame) -> DataFrame:
    """One row; rates are null with fewer than MIN_RESOLVABLE sessions that change something."""
    s = sessions_of(calls)
    total = s.agg(
        F.count("*").alias("sessions_with_tools"), F.count("prefix").alias("resolvable_sessions"), F.count_if(F.col("prefix").isNull()).alias("no_mutation_sessions"),
        F.percentile("prefix", 0.5).alias("median"), F.percentile("prefix", 0.9).alias("p90"), F.count_if("loop").alias("loops"),
        F.sum(F.coalesce("prefix", "calls")).alias("explored"), F.sum("calls").alias("calls"),
    )
    enough = F.col("resolvable_sessions") >= V.MIN_RESOLVABLE
    return total.select(
        "sessions_with_tools", "resolvable_sessions", "no_mutation_sessions", enough.alias("sufficient"), F.when(enough, F.col("median")).alias("median_prefix"),
        F.when(enough, F.col("p90")).alias("p90_prefix"), F.when(enough, 100.0 * F.col("loops") / F.col("resolvable_sessions")).alias("pattern_pct"),
        F.when(enough & (F.col("calls") > 0), 100.0 * F.col("explored") / F.col("calls")).alias("explore_pct"),
    )


def prefix_calls(calls: DataFrame) -> DataFrame:
    c = flagged(calls)
    change = c.where("mutating").groupBy("session_key").agg(F.min("ord").alias("change"))
    return c.join(change, "session_key").where("ord < change").drop("change")


def reread_files(calls: DataFrame, top: int = 5) -> DataFrame:
    """The files that prefixes of most distinct sessions read."""
    reads = prefix_calls(calls).where(F.lower(F.trim("name")).isin(*V.READ_TOOLS) & (F.trim(F.coalesce("path", F.lit(""))) != ""))
    return reads.groupBy(F.trim("path").alias("path")).agg(F.count_distinct("session_id").alias("sessions")).orderBy(F.desc("sessions"), "path").limit(top)


def by_project(calls: DataFrame) -> DataFrame:
    project = F.when(F.trim(F.coalesce("project", F.lit(""))) == "", "unknown").otherwise(F.trim("project"))
    return sessions_of(calls).where("prefix IS NOT NULL").groupBy(project.alias("project")).agg(F.count("*").alias("sessions"), F.bround(F.percentile("prefix", 0.5)).cast("long").alias("median_prefix"))


def harnesses(sessions: DataFrame, calls: DataFrame, without: bool = False) -> DataFrame:
    """Sessions of harnesses that have calls at all, or of those that have none."""
    return sessions.join(calls.select("harness").distinct(), "harness", "left_anti" if without else "left_semi")
