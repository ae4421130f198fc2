"""What a scan may claim, and what it covered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import sessions as S

# What a report says.
REPEATED, NULL, PARTIAL = "REPEATED WORK FOUND", "DEFENSIBLE NULL", "PARTIAL SCAN — NOT A CLEAN RESULT"
INSUFFICIENT, NO_HISTORY = "INSUFFICIENT HISTORY", "NO SUPPORTED HISTORY FOUND"
STABILITY = ((0.85, "Solved the same way every time."), (0.5, "Went smoothly most times."))
UNSTABLE = "Varied a lot between runs."


def verdict(statuses: Column, sessions: Column, min_runs: Column, candidates: Column, skipped: Column, malformed: Column, truncated: Column, failed: Column) -> Column:
    """The verdict of one scan; statuses: an array of the harnesses' statuses, failed: whether a stage gave up.

    A scan that left something out never counts as a clean result, unless there was nothing to scan.
    """
    partial = F.exists(statuses, lambda s: s.startswith("unreadable")) | (skipped > 0) | (malformed > 0) | truncated | failed
    none = F.coalesce(F.forall(statuses, lambda s: s == "absent"), F.lit(True))
    return F.when(none, NO_HISTORY).when(partial, PARTIAL).when(sessions < min_runs, INSUFFICIENT).when(candidates > 0, REPEATED).otherwise(NULL)


def stability_sentence(stability: Column) -> Column:
    (high, steady), (low, smooth) = STABILITY
    return F.when(stability >= high, steady).when(stability >= low, smooth).otherwise(UNSTABLE)


def coverage(found: S.Discovery, metrics: DataFrame, truncated: int = 0) -> DataFrame:
    """One row: statuses, discovered and parsed files, skipped files and folders, and what the records held."""
    skipped = found.skipped.agg(F.count_if(S.unreadable_dir(F.col("reason"))).alias("unreadable_dirs"), F.count_if(~S.unreadable_dir(F.col("reason"))).alias("files_skipped"))
    files = found.files.agg(F.count("*").alias("files"))
    statuses = found.sources.agg(F.sort_array(F.collect_list("status")).alias("statuses"))
    one = statuses.join(files).join(skipped).join(metrics)
    return one.withColumn("discovered", F.col("files") + F.col("files_skipped")).withColumn("truncated", F.lit(truncated))


def judge(coverage_: DataFrame, candidates: int, min_runs: int, failed: bool = False) -> DataFrame:
    """coverage with its verdict."""
    skipped = F.col("unreadable_dirs") + F.col("files_skipped")
    return coverage_.withColumn("verdict", verdict(F.col("statuses"), F.col("sessions"), F.lit(min_runs), F.lit(candidates), skipped, F.col("malformed_lines"), F.col("truncated") > 0, F.lit(failed)))
