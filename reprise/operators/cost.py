"""Usage and cost of sessions, projects and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab as V

TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens")
#: Bases from the best known to the least; the basis of a sum is the worst of its parts.
BASES = ("measured", "estimated", "unknown")


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(V.PRICES, "model_key string, input_rate double, output_rate double, cache_rate double")


def session_usage(turns: DataFrame) -> DataFrame:
    """One row a session_key: null-aware token sums, the first model named, characters of all turns, number of turns, first and last time in file order."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("ord")))
    sums = [F.sum(c).cast("long").alias(c) for c in TOKENS]
    u = turns.groupBy("session_key").agg(
        F.min_by("session_id", "ord").alias("session_id"), F.min_by("project", "ord").alias("project"), F.min_by("harness", "ord").alias("harness"), *sums,
        first("model").alias("model"), F.sum(F.length(F.coalesce("text", F.lit("")))).cast("long").alias("text_chars"), F.count("*").alias("turn_count"),
        first("ts").alias("started_at"), F.max_by("ts", F.when(F.col("ts").isNotNull() & (F.col("ts") != ""), F.col("ord"))).alias("ended_at"),
    )
    some = F.coalesce(*TOKENS).isNotNull()
    return u.withColumn("session_tokens", F.when(some, sum((F.coalesce(c, F.lit(0)) for c in TOKENS), F.lit(0))).cast("long"))


def carry_model(turns: DataFrame) -> DataFrame:
    """Each turn's own model, else the last one named before it in its file."""
    from pyspark.sql import Window

    w = Window.partitionBy("session_key").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("model", F.last(F.when(F.col("model") != "", F.col("model")), ignorenulls=True).over(w))


def price_of(df: DataFrame, prices_: DataFrame, model: str = "model") -> DataFrame:
    """df with model_key and rates of the longest key that begins the model, ignoring case, else those of the default key.

    The table of prices is fixed and small, so it is folded into one expression: an array of its rows, filtered and
    reduced a row. Keys that begin with an underscore and rows without all rates are ignored.
    """
    rows = [r for r in prices_.collect() if r.model_key and not r.model_key.startswith("_") and None not in r]
    default = next((r for r in rows if r.model_key == "default"), None)
    last = tuple(default)[1:] if default else (3.0, 15.0, 0.30)
    m = F.lower(F.trim(F.coalesce(model, F.lit(""))))
    chosen = F.when(F.lit(False), F.struct(*[F.lit(x).alias(n) for n, x in zip(("model_key", "input_rate", "output_rate", "cache_rate"), ("default", *last), strict=True)]))
    for r in sorted((r for r in rows if r.model_key != "default"), key=lambda r: (-len(r.model_key), r.model_key)):
        chosen = chosen.when(m.startswith(r.model_key.lower()), F.struct(*[F.lit(x).alias(n) for n, x in r.asDict().items()]))
    chosen = chosen.otherwise(F.struct(*[F.lit(x).alias(n) for n, x in zip(("model_key", "input_rate", "output_rate", "cache_rate"), ("default", *last), strict=True)]))
    return df.withColumn("__price", chosen).select(*df.columns, *[F.col(f"__price.{n}").alias(n) for n in ("model_key", "input_rate", "output_rate", "cache_rate")])


def session_cost(usage: DataFrame, prices_: DataFrame) -> DataFrame:
    """usage with basis, billed tokens, usd and priced. Tokens are measured, else estimated from characters, else unknown."""
    u = price_of(usage, prices_)
    measured = F.coalesce(*TOKENS).isNotNull()
    basis = F.when(measured, "measured").when(F.col("text_chars") > 0, "estimated").otherwise("unknown")
    u = u.withColumn("basis", basis)
    guess = F.greatest(F.lit(1), F.bround(F.col("text_chars") / 4)).cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0))
    u = u.withColumn("billed_input", F.when(measured, zero("input_tokens")).when(F.col("basis") == "estimated", guess).otherwise(0).cast("long"))
    u = u.withColumn("billed_output", F.when(measured, zero("output_tokens")).otherwise(0).cast("long")).withColumn("billed_cache", F.when(measured, zero("cache_read_tokens")).otherwise(0).cast("long"))
    usd = (F.col("billed_input") * F.col("input_rate") + F.col("billed_output") * F.col("output_rate") + F.col("billed_cache") * F.col("cache_rate")) / 1e6
    return u.withColumn("usd", F.bround(usd, 6)).withColumn("priced", measured & (F.coalesce("model", F.lit("")) != ""))


def worst(basis: Column) -> Column:
    """The worst basis of a group."""
    rank = F.max(F.array_position(F.array(*map(F.lit, BASES)), basis))
    return F.element_at(F.array(*map(F.lit, BASES)), rank.cast("int"))


def project_costs(costed: DataFrame) -> DataFrame:
    """Roll-up of sessions by project."""
    project = F.when(F.trim(F.coalesce("project", F.lit(""))) == "", "unknown").otherwise(F.trim("project"))
    return costed.groupBy(project.alias("project")).agg(
        F.sum("billed_input").alias("input_tokens"), F.sum("billed_output").alias("output_tokens"), F.sum("billed_cache").alias("cache_read_tokens"),
        F.bround(F.sum("usd"), 6).alias("usd"), worst(F.col("basis")).alias("basis"), F.count("*").alias("session_count"),
        F.bool_and("priced").alias("priced"), F.count_if(F.coalesce("model", F.lit("")) == "").alias("sessions_without_model"),
    ).withColumn("tokens", F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens"))


def pricing_coverage(usage: DataFrame) -> DataFrame:
    return usage.agg(
        F.count("*").alias("sessions"), F.count_if(F.coalesce("model", F.lit("")) == "").alias("without_model"), F.count_if(F.coalesce(*TOKENS).isNotNull()).alias("with_tokens"),
    )


def date_range(usage: DataFrame) -> DataFrame:
    days = usage.select(F.explode(F.array("started_at", "ended_at")).alias("ts")).where("ts <> ''").select(F.substring("ts", 1, 10).alias("day"))
    return days.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def cluster_cost(members: DataFrame, costed: DataFrame) -> DataFrame:
    """One cost a cluster: each distinct session once, by its first member."""
    from pyspark.sql import Window

    once = members.withColumn("__n", F.row_number().over(Window.partitionBy("cluster_id", "session_id").orderBy("intent_ord"))).where("__n = 1")
    named = F.when(F.bool_or(F.col("model_key") == "default"), "default").when(F.count_distinct("model_key") == 1, F.first("model_key")).otherwise("mixed")
    cost = costed.select("session_key", "billed_input", "billed_output", "billed_cache", "usd", "basis", "priced", "model_key")
    return once.select("cluster_id", "session_key").join(cost, "session_key").groupBy("cluster_id").agg(
        F.sum("billed_input").alias("input_tokens"), F.sum("billed_output").alias("output_tokens"), F.sum("billed_cache").alias("cache_read_tokens"),
        F.bround(F.sum("usd"), 6).alias("usd"), worst(F.col("basis")).alias("basis"), named.alias("price_model"), F.bool_and("priced").alias("priced"),
    )
