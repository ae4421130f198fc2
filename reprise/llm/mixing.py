"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Shares p of the sources' tokens become weights w ~ p**alpha. alpha is bisected to the largest value that reaches a target
entropy, or to the smallest whose repetition stays within a limit. The token budget is the least that leaves out no document
unless one is given. A source that gets r times its tokens is passed over floor(r) times whole; the rest is a prefix of
a permutation of its documents, cut where the budget ends. The permutation is the order of a hash; its prefix is found by
blocks (1024 a source), blocks of the block on the edge, and documents of that one, so no task orders a whole source, and it
is stated as one hash a source, so documents are not shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint

BLOCK_BITS = 10
FEW = 100_000  #: sources whose cuts are broadcast
STEPS, POINTS = 4, 15  #: of the section of [0, 1] in which alpha lies: an error of 16**-4
SEED = 42


def tokens_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source(c: Column) -> Column:
    return F.coalesce(c, F.lit("\0"))  # a null source is a source of its own


@dataclass(frozen=True)
class Plan:
    alpha: float
    budget: float
    cuts: DataFrame  #: source key, share, weight, passes, cut (the last hash of the partial pass, null if it is empty)


def _measures(sources: DataFrame, alphas: list[float]) -> list[tuple[float, float]]:
    """(entropy, highest repetition if no document is left out) for each alpha; one aggregate over the sources."""
    x = F.log("p")
    row = sources.where("n > 0").agg(*[
        F.struct(F.sum(F.exp(a * x)).alias("z"), F.sum(F.exp(a * x) * a * x).alias("e"), F.max(F.exp((a - 1) * x)).alias("hi"), F.min(F.exp((a - 1) * x)).alias("lo")).alias(f"m{i}")
        for i, a in enumerate(alphas)
    ]).first()
    import math

    return [(math.log(m.z) - m.e / m.z, m.hi / m.lo) if m.z else (0.0, 1.0) for m in row]


def solve(sources: DataFrame, target_entropy: float | None, max_repetition: float | None) -> float:
    """alpha. Entropy falls and repetition rises as alpha falls from 1 to 0 in any table of shares, so both are bisected."""
    if (target_entropy is None) == (max_repetition is None):
        raise ValueError("one of target_entropy and max_repetition")
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        alphas = [low + (high - low) * k / (POINTS + 1) for k in range(POINTS + 2)]
        met = _measures(sources, alphas)
        if target_entropy is not None:  # the largest alpha that has it
            good = [k for k, (h, _) in enumerate(met) if h >= target_entropy]
            k = max(good, default=0)
            low, high = alphas[k], alphas[min(k + 1, POINTS + 1)]
        else:  # the smallest alpha within the limit
            good = [k for k, (_, r) in enumerate(met) if r <= max_repetition]
            k = min(good, default=POINTS + 1)
            low, high = alphas[max(k - 1, 0)], alphas[k]
    return low if target_entropy is not None else high


def plan(docs: DataFrame, target_entropy: float | None = None, max_repetition: float | None = None, budget: float | None = None, seed: int = SEED) -> Plan:
    """docs: doc_id, source, text. Sources without a token are passed over once."""
    small = checkpoint(docs.select(_source(F.col("source")).alias("key"), order(F.col("source"), F.col("doc_id"), F.col("text"), seed).alias("h"), tokens_of(F.col("text")).alias("n")))
    totals = small.groupBy("key").agg(F.sum("n").alias("n"))
    whole = totals.agg(F.sum("n")).first()[0] or 0
    sources = checkpoint(totals.withColumn("p", F.col("n") / F.lit(float(max(whole, 1)))))
    alpha = solve(sources, target_entropy, max_repetition) if whole else 1.0
    if whole:
        power = F.exp(F.lit(alpha) * F.log("p"))
        scale, least = sources.where("n > 0").agg(F.sum(power), F.min(F.exp(F.lit(alpha - 1) * F.log("p")))).first()
        if budget is None:
            budget = whole * scale / least
        repeat = F.when(F.col("n") > 0, F.lit(float(budget)) * (power / F.lit(scale)) / F.col("n")).otherwise(F.lit(1.0))
        repeat = F.when(F.abs(repeat - F.round(repeat)) < 1e-9, F.round(repeat)).otherwise(repeat)
        weight = F.when(F.col("n") > 0, power / F.lit(scale)).otherwise(F.lit(0.0))
    else:
        budget, repeat, weight = 0.0, F.lit(1.0), F.lit(0.0)
    wanted = sources.select("key", F.col("p").alias("share"), weight.alias("weight"), F.floor(repeat).cast("long").alias("passes"), ((repeat - F.floor(repeat)) * F.col("n")).alias("left"))

    # where the partial pass ends: in which block, in which block of it, at which document
    left, rows = wanted.where("left >= 1").select("key", "left"), small
    top = F.shiftright("h", 64 - BLOCK_BITS)
    second = F.shiftright("h", 64 - 2 * BLOCK_BITS)
    cut = None
    for block in (top, second, F.col("h")):
        cells = rows.groupBy("key", block.alias("b")).agg(F.sum("n").alias("n"), F.max("h").alias("h"))
        sums = cells.withColumn("upto", F.sum("n").over(Window.partitionBy("key").orderBy("b"))).join(F.broadcast(left) if sources.count() <= FEW else left, "key")
        sums = checkpoint(sums)
        inside = sums.where("upto <= left").groupBy("key").agg(F.max("h").alias("cut"), F.max("upto").alias("done"))
        cut = inside.select("key", "cut") if cut is None else cut.unionByName(inside.select("key", "cut"))
        edge = sums.where("upto > left").groupBy("key").agg(F.min("b").alias("edge"))
        rows = rows.join(F.broadcast(edge) if sources.count() <= FEW else edge, "key").where(block == F.col("edge")).drop("edge")
        left = left.join(inside, "key", "left").select("key", (F.col("left") - F.coalesce("done", F.lit(0))).alias("left"))
    cuts = wanted.join(cut.groupBy("key").agg(F.max("cut").alias("cut")), "key", "left").select("key", "share", "weight", "passes", "cut")
    return Plan(alpha, float(budget), checkpoint(cuts))


def order(source: Column, doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """The place of a row in its source's permutation; rows with the same id and text share one."""
    return F.xxhash64(F.lit(seed), _source(source), doc_id.isNull(), doc_id.cast("long"), F.coalesce(text, F.lit("")))


def _free(name: str, columns: list[str]) -> str:
    """name, with as many underscores before it as it needs to be none of the columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def copies(docs: DataFrame, p: Plan, seed: int = SEED) -> tuple[DataFrame, str, str]:
    """docs with two more columns, and their names: how many times the mix has each row, and its place in the permutation.

    Names that docs has already are avoided. A null source is a source of its own; a null text has no tokens. Rows with the same
    source, id and text are cut together, so if there are many the realised tokens miss the budget by theirs at most.
    """
    times, place, key, cut = (_free(n, docs.columns) for n in ("__copies", "__place", "__key", "__cuts"))
    few = p.cuts.count() <= FEW
    cuts = p.cuts.select(F.col("key").alias(key), F.struct("passes", "cut").alias(cut))
    placed = docs.withColumn(place, order(docs["source"], docs["doc_id"], docs["text"], seed))
    joined = placed.join(F.broadcast(cuts) if few else cuts, _source(placed["source"]) == cuts[key], "left")
    extra = F.when(F.col(place) <= F.col(cut)["cut"], 1).otherwise(0)
    return joined.withColumn(times, F.col(cut)["passes"] + extra).drop(key, cut), times, place


def mix(docs: DataFrame, p: Plan, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of docs as often as the plan says."""
    counted, times, place = copies(docs, p, seed)
    again = _free("__copy", counted.columns)
    return counted.where(F.col(times) > 0).withColumn(again, F.explode(F.array_repeat(F.lit(1), F.col(times).cast("int")))).drop(again, times, place)
