"""What repeated sessions have in common: steps shared by most of them, and the places where their asks differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MIN_SESSIONS, MIN_STEPS = 2, 3  #: sessions with tool calls, and calls in all, below which no procedure is stated
SHOWN = {"common": 40, "varied": 20}  #: steps of a scaffold
EXAMPLES = 5
# Arguments that best say what a call does, in order of preference.
TELLING = ("command", "path", "target_directory", "file_path", "pattern", "query", "glob_pattern", "url", "prompt", "content", "old_string", "new_string")


def clip(c: Column, limit: int) -> Column:
    s = T.strip(T.collapse(c))
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.regexp_replace(F.substring(s, 1, limit - 1), r"(?U)\s+\z", ""), F.lit("…")))


def summary(given: Column) -> Column:
    """key=value of the most telling argument of a call's JSON input, else of its first argument with text."""
    args = F.from_json(given, "map<string, string>")
    said = lambda v: T.strip(v) != ""
    known = [F.when(said(args[k]), F.concat(F.lit(f"{k}="), clip(args[k], 64))) for k in TELLING]
    other = F.get(F.map_entries(F.map_filter(args, lambda k, v: said(v) & ~v.rlike(r"^[\[{]|^(?:true|false|-?[0-9.]+)$"))), F.lit(0))
    return F.coalesce(*known, F.concat(other["key"], F.lit("="), clip(other["value"], 64)), F.lit(""))


def coarse(summary_: Column) -> Column:
    """The argument's name, else the start of the summary with paths, ids and numbers masked."""
    s = F.regexp_replace(summary_, r"(?U)(?:~/|/|[A-Za-z]:\\)[^\s'\"`]+", "<path>")
    s = F.regexp_replace(F.regexp_replace(s, r"(?iU)\b[0-9a-f]{8,}\b", "<id>"), r"\d+", "<n>")
    return F.when(s.contains("="), F.substring_index(s, "=", 1)).otherwise(F.substring(s, 1, 40))


def steps(calls: DataFrame) -> DataFrame:
    """calls (name, input, ...) with summary and step, the key by which calls of different sessions are the same step."""
    return calls.withColumn("summary", summary(F.col("input"))).withColumn("step", F.concat_ws("|", "name", coarse(F.col("summary"))))


def procedures(steps_: DataFrame) -> DataFrame:
    """cluster_id, kind, place, step, name, summary, sessions of (cluster_id, session_key, ord, step, name, summary).

    A step that at least half of the cluster's sessions, and at least two, have is common; others vary. Steps stand as in
    the longest session that has them; the example is from the first. Clusters with too few calls give no rows.
    """
    runs = steps_.groupBy("cluster_id", "session_key").agg(F.count("*").alias("calls"))
    totals = runs.groupBy("cluster_id").agg(F.count("*").alias("n"), F.sum("calls").alias("total")).where((F.col("n") >= MIN_SESSIONS) & (F.col("total") >= MIN_STEPS))
    first = steps_.groupBy("cluster_id", "session_key", "step").agg(F.min("ord").alias("ord"), F.min_by(F.struct("name", "summary"), "ord").alias("shown"))
    placed = first.join(runs, ["cluster_id", "session_key"]).groupBy("cluster_id", "step").agg(
        F.count("*").alias("sessions"), F.min(F.struct(-F.col("calls"), "session_key", "ord")).alias("first"), F.min_by("shown", F.struct("session_key", "ord")).alias("shown"),
    )
    need = F.greatest(F.lit(2), F.floor((F.col("n") + 1) / 2))
    known = placed.join(totals, "cluster_id").withColumn("kind", F.when(F.col("sessions") >= need, "common").otherwise("varied"))
    known = known.withColumn("place", F.row_number().over(Window.partitionBy("cluster_id", "kind").orderBy("first")))
    fits = F.when(F.col("kind") == "common", SHOWN["common"]).otherwise(SHOWN["varied"])
    return known.where(F.col("place") <= fits).select("cluster_id", "kind", "place", "step", "shown.name", "shown.summary", "sessions")


def columns(texts: DataFrame) -> DataFrame:
    """cluster_id, member, t, first, spans of (cluster_id, member, text): spans are the runs of places, up to the shortest text's length, at which texts are all the same or aren't.

    Texts are held against that of the first member, and only places that differ become rows.
    """
    t = texts.select("cluster_id", "member", F.explode(F.filter(F.array(T.tokens(T.strip_locative(T.strip(F.col("text"))))), lambda x: F.size(x) > 0)).alias("t")).repartition("cluster_id")
    ends = t.groupBy("cluster_id").agg(F.min(F.size("t")).alias("n"), F.min("member").alias("first"), F.count("*").alias("members"))
    one = t.join(ends.where("members > 1"), "cluster_id").where("member = first").select("cluster_id", "n", F.col("t").alias("model")).dropDuplicates(["cluster_id"])
    differ = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("t", i) != F.get("model", i))
    vary = t.join(one, "cluster_id").select("cluster_id", F.explode(differ).alias("pos")).distinct().groupBy("cluster_id").agg(F.sort_array(F.collect_list("pos")).alias("v"))
    known = ends.join(vary, "cluster_id", "left").withColumn("v", F.coalesce("v", F.array().cast("array<int>")))
    begins = F.filter("v", lambda x, i: (i == 0) | (F.get("v", i - 1) != x - 1))
    after = F.transform(F.filter("v", lambda x, i: F.coalesce(F.get("v", i + 1) != x + 1, F.lit(True)) & (x + 1 < F.col("n"))), lambda x: x + 1)
    known = known.withColumn("at", F.sort_array(F.array_distinct(F.concat(F.array(F.lit(0)), begins, after))))
    same = ~F.coalesce(F.get("v", F.lit(0)) == 0, F.lit(False))  # of the first span; kinds take turns
    spans = F.transform("at", lambda x, k: F.struct(k.cast("long").alias("span"), ((k % 2 == 0) == same).alias("constant"), x.alias("at"), (F.coalesce(F.get("at", k + 1), F.col("n")) - x).alias("n")))
    return t.join(known.select("cluster_id", "first", spans.alias("spans")), "cluster_id")


def param_kind(c: Column) -> Column:
    s = F.regexp_replace(T.strip(c), "^[\"'`]+|[\"'`]+$", "")
    return (
        F.when(s.rlike(r"(?U)(?:~/|/|[A-Za-z]:\\)[^\s'\"`]+") | s.startswith("~/") | s.startswith("/"), "path").when(s.rlike(r"(?U)^[\w.+-]+\.[A-Za-z0-9]{1,12}$"), "filename")
        .when(s.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$") | s.rlike(r"(?i)^[0-9a-f]{7,40}$"), "identifier")
        .when(s.rlike(r"(?iU)^(?:\d+(?:\.\d+)?|cp-?\d+(?:\.\d+)?)$"), "number").otherwise("free text")
    )


def slots(columns_: DataFrame) -> DataFrame:
    """cluster_id, span, constant, at, kind, examples: runs of columns that vary are one slot, runs that don't are text.

    kind is the commonest of the different fillings' kinds, the earliest of equals; examples are the first fillings, or
    the one text.
    """
    told = F.filter("spans", lambda s: ~s["constant"] | (F.col("member") == F.col("first")))  # a text that all have is told by one
    filled = columns_.select("cluster_id", "member", F.inline(F.transform(told, lambda s: F.struct(s["span"].alias("span"), s["constant"].alias("constant"), s["at"].alias("at"), F.array_join(F.slice("t", s["at"] + 1, s["n"]), " ").alias("filling")))))
    different = filled.groupBy("cluster_id", "span", "constant", "at", "filling").agg(F.min("member").alias("member")).withColumn("kind", F.when(~F.col("constant"), param_kind(F.col("filling"))))
    kinds = different.groupBy("cluster_id", "span", "kind").agg(F.count("*").alias("n"), F.min("member").alias("m")).groupBy("cluster_id", "span").agg(F.max_by("kind", F.struct("n", -F.col("m"))).alias("kind"))
    place = F.row_number().over(Window.partitionBy("cluster_id", "span").orderBy("member"))
    shown = different.drop("kind").withColumn("n", place).where(F.col("n") <= EXAMPLES).groupBy("cluster_id", "span", "constant", "at").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "filling"))), lambda x: x["filling"]).alias("examples"))
    return shown.join(kinds, ["cluster_id", "span"]).select("cluster_id", "span", "constant", "at", F.when(~F.col("constant"), F.col("kind")).alias("kind"), "examples")
