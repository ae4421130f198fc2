"""A whole scan: session files to ranked repeated work, its cost, exploration, coverage and verdict."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cluster, cost, rank, rediscovery, suggest, verdict
from ..operators.graph import checkpoint
from ..sources import records
from ..sources import sessions as S


@dataclass
class Scan:
    """Relations of one scan, all written once except the small ones made of them."""

    found: S.Discovery
    sessions: DataFrame
    turns: DataFrame
    calls: DataFrame
    asks: DataFrame
    assigned: DataFrame
    candidates: DataFrame
    projects: DataFrame
    rediscovery: DataFrame
    coverage: DataFrame


MAX_PROJECTS = 1000  #: names that are masked in asks; the expression has a step for each


def project_names(sessions: DataFrame) -> list[str]:
    """The projects' names, so that asks that differ by them alone are the same; the MAX_PROJECTS with most sessions."""
    named = sessions.where(F.length(F.trim("project")) >= 3).groupBy("project").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "project").limit(MAX_PROJECTS)
    return [r.project for r in named.collect()]


def asks_of(turns: DataFrame, sessions: DataFrame, files: DataFrame) -> DataFrame:
    """The first request of each session that says something, and later ones that begin a new task.

    intent_ord grows along files from the smallest on, then along turns.
    """
    said = turns.where("role = 'user'").withColumn("substantive", T.is_substantive(F.col("text"))).where("substantive")
    first = F.min("ord").over(Window.partitionBy("session_key"))
    said = said.withColumn("first", first).where((F.col("ord") == F.col("first")) | T.is_new_task(F.col("text")))
    of = sessions.select("session_key", "session_id", "project", "started_at", F.col("turn_count").alias("session_turn_count")).join(files.select(F.col("path").alias("session_key"), "size_bytes"), "session_key")
    asks = said.join(of, "session_key").orderBy("size_bytes", "session_key", "ord").select(
        F.monotonically_increasing_id().alias("intent_ord"), "session_key", "session_id", "project", F.coalesce("ts", "started_at").alias("ts"), F.col("text").alias("raw_text"),
        T.normalize(F.col("text"), project_names(sessions)).alias("normalized"), "session_turn_count",
    )
    return checkpoint(asks)


def scan(spark: SparkSession, home: str, now: str, days: int = 14, min_runs: int = 3, max_bytes: int | None = None, at: float | None = None) -> Scan:
    """now: the ISO time that recency counts from; at: the same for the files' ages, as seconds. max_bytes: what is read at most, the smallest files first."""
    found = S.discover(spark, home, days, now=at)
    files = S.within_budget(found.files, max_bytes)
    left_out = files.where("truncated").count()
    files = files.where("NOT truncated").drop("truncated")
    recs = records.records(S.lines(spark, files))
    turns, calls = checkpoint(records.turns(recs)), checkpoint(records.tool_calls(recs))
    facts = checkpoint(records.sessions(recs, turns).join(files.select(F.col("path").alias("session_key"), "harness"), "session_key"))
    named = facts.select("session_key", "session_id", "project", "harness")
    asks = asks_of(turns, facts, files)
    v = checkpoint(cluster.vectors(asks))
    assigned = checkpoint(cluster.assign(asks, v))
    costed = checkpoint(cost.session_cost(cost.session_usage(turns.join(named, "session_key")), cost.prices(spark)))
    groups = checkpoint(cluster.clusters(asks, assigned, v, min_runs))
    members = asks.join(assigned, "intent_ord").join(groups.select("cluster_id"), "cluster_id", "left_semi")
    ranked = rank.score(groups, cost.cluster_cost(members, costed), rank.turn_variance(members), now)
    candidates = checkpoint(ranked.withColumn("stability_text", verdict.stability_sentence(F.col("stability"))))
    seen = verdict.coverage(found, records.metrics(recs, turns, calls), left_out)
    return Scan(
        found, facts, turns, calls, asks, assigned, candidates, cost.project_costs(costed), rediscovery.summary(calls.join(named, "session_key")),
        checkpoint(verdict.judge(seen, candidates.count(), min_runs)),
    )


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def report(done: Scan, top: int = 3, redacted: bool = True) -> dict:
    """The top candidates with evidence, projects by cost, exploration and coverage; bounded by top, projects and harnesses."""
    best = rank.order(done.candidates).limit(top)
    members = done.asks.join(done.assigned, "intent_ord").join(best.select("cluster_id"), "cluster_id", "left_semi")
    evidence = rank.evidence(members)
    show = (lambda c: T.redact(F.col(c))) if redacted else F.col
    shown = evidence.withColumn("text", show("text")).groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("place", "session_id", "ts", "text"))).alias("evidence"))
    projects = done.projects.orderBy(F.desc("usd"), F.desc("tokens"), F.lower("project"))
    return {
        "verdict": done.coverage.first()["verdict"], "candidates": _rows(rank.order(best.withColumn("label", show("label")).join(shown, "cluster_id", "left"))),
        "projects": _rows(projects), "rediscovery": _rows(done.rediscovery)[0], "coverage": _rows(done.coverage)[0], "sources": _rows(S.inventory(done.found).orderBy("harness")),
    }


def text_report(r: dict) -> str:
    out = [r["verdict"], ""]
    for place, c in enumerate(r["candidates"], 1):
        money = f"${c['usd']:.2f}" if c["priced"] else "not priced"
        out += [f"{place}. {c['label']}", f"   {c['distinct_sessions']} sessions, {c['run_count']} runs, {money}; {c['stability_text']}"]
        out += [f"   - {e['text']}" for e in c["evidence"] or ()]
    cov = r["coverage"]
    out += ["", f"{cov['sessions']} sessions, {cov['files_read']} of {cov['discovered']} files read, {cov['malformed_lines']} malformed lines, {cov['tool_calls']} tool calls"]
    return "\n".join(out + [f"{s['harness']}: {s['status']}, {s['files']} files, {s['size']}" for s in r["sources"]]) + "\n"


def json_report(r: dict) -> str:
    return json.dumps({"schema_version": "1", **r}, indent=2, ensure_ascii=False) + "\n"


def scaffold(done: Scan, place: int = 1) -> dict:
    """Text with slots and the shared steps of the candidate at a place of the ranking; no steps where too few sessions have any."""
    best = rank.order(done.candidates).limit(place).collect()
    if len(best) < place:
        return {}
    chosen = done.asks.join(done.assigned, "intent_ord").where(F.col("cluster_id") == best[-1]["cluster_id"])
    slots = suggest.slots(suggest.columns(chosen.select("cluster_id", F.col("intent_ord").alias("member"), F.col("raw_text").alias("text"))))
    calls = done.calls.join(chosen.select("session_key", "cluster_id").distinct(), "session_key")
    steps = suggest.procedures(suggest.steps(calls)).orderBy("kind", "place")
    return {"label": best[-1]["label"], "slots": _rows(slots.orderBy("at").drop("cluster_id")), "steps": _rows(steps.drop("cluster_id"))}
