"""Near-duplicates by the exact Jaccard similarity of word shingles, as a join by prefixes.

Under any fixed order of shingles, two sets with similarity of t or more share a shingle among the first
n - ceil(t * n) + 1 of each, n being the set's size. So every pair meets in the bucket of some shingle, and is verified on
the whole sets. The order is that of the hashes, with shingles that turned out common put last; the order changes the
work only, never the result.

Sets that share a shingle of their prefixes are ordered anew, rarest shingle first, counted among them. Texts made from one
by edits of their own then have their own shingles in front, and those with too many for any partner are no candidates.

Buckets aren't paired up at first: members are verified against the bucket's hub and linked into components, and only
pairs of different components are left to compare. Crowded buckets get further hubs before that. Sets that still crowd
them are then told apart by what each has beyond, or lacks of, the shingles that most of them have: of these differences
near sets share many, and others few, whereas all share the usual shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, release, texts, trim
from .components import components
from .simhash import majority, shingle_hashes

MANY = 64  #: members from which a shingle is common, and pairs a member of a bucket from which it gets a further hub
COMMON = 200_000  #: common shingles that tasks know, the most frequent first
ROUNDS = 5  #: of hubs; after them all pairs left are compared
STALLED = 2 / 3  #: of the pairs in crowded buckets are left after a round: further hubs would rule out as few
EARLIER = 16  #: buckets of a set that its row in a bucket knows
BINS = 1024  #: the same, finer, of sets that are read again
PIECES = 64  #: ranges of hashes whose shingles are counted, for a bound of similarity
WORDS = 16  #: of 64 bits each, that tell differences apart
FEW = 500_000  #: keys that are broadcast
FIRST = -(1 << 61)  #: hashes (as signed longs) below it are looked at first: three eighths of all
ROWS = 256  #: texts whose shingles are held at once
KEYS = ["__k1", "__k2"]


def prefix(s: np.ndarray, common: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of s of which a set that is near enough has one; common ones (by the high half of their hash, in order) come last."""
    size = len(s) - math.ceil(least * len(s) - 1e-9) + 1
    if len(common):
        high = s >> np.uint64(32) << np.uint64(32)
        late = common[np.minimum(np.searchsorted(common, high), len(common) - 1)] == high
        s = np.concatenate([s[~late], s[late]])
    return s[:size]


def _prefixes(docs: DataFrame, width: int, least: float, common: np.ndarray) -> DataFrame:
    """doc_id, keys, fp (the fingerprint), set (a hash of the shingle set), n (its size), first (its prefix), counts (of shingles, in PIECES). docs: with keys."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in (x.slice(k, ROWS) for x in batches for k in range(0, x.num_rows, ROWS)):
            every = [shingle_hashes(t, width) for t in b["text"].to_pylist()]
            fps = np.array([majority(h) for h in every], np.uint64).view(np.int64)
            sets = [np.unique(h) for h in every]
            names = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
            firsts = pa.array([prefix(s, shared.value, least).view(np.int64) for s in sets], pa.list_(pa.int64()))
            counts = pa.array([np.bincount((s >> np.uint64(64 - PIECES.bit_length() + 1)).astype(np.int64), minlength=PIECES) for s in sets], pa.list_(pa.int32()))
            columns = [b["doc_id"], *[b[k] for k in KEYS], pa.array(fps), pa.array(names), pa.array([len(s) for s in sets], pa.int32()), firsts, counts]
            yield pa.record_batch(columns, ["doc_id", *KEYS, "fp", "set", "n", "first", "counts"])
        trim()

    return texts(docs, KEYS).mapInArrow(run, "doc_id long, __k1 long, __k2 long, fp long, set long, n int, first array<long>, counts array<int>")


def _few(df: DataFrame) -> DataFrame:
    """df, broadcast if it has few rows. df: checkpointed."""
    return F.broadcast(df) if df.count() <= FEW else df


def sets(docs: DataFrame, width: int, least: float) -> DataFrame:
    """What :func:`_prefixes` returns, with common shingles last; they are counted in the prefixes of all documents."""
    every = _prefixes(docs, width, least, np.array([], np.uint64)).select(F.explode("first").alias("h"))
    # half of a hash says enough, as the order changes the work only
    half = checkpoint(every.select(F.shiftright("h", 32).cast("int").alias("half")).groupBy("half").count().where(F.col("count") > MANY).orderBy(F.desc("count"), "half").limit(COMMON).select("half"))
    halves = np.unique(np.array([r.half for r in half.collect()], np.int64).astype(np.uint64) << np.uint64(32))
    return checkpoint(_prefixes(docs, width, least, halves))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """set, all (its shingles), bins (their numbers in BINS ranges of hashes, 255 at most), of docs with a column set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(k, ROWS) for x in batches for k in range(0, x.num_rows, ROWS)):
            every = [np.unique(shingle_hashes(t, width)) for t in b["text"].to_pylist()]
            bins = [np.minimum(np.bincount((x >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes() for x in every]
            yield pa.record_batch([b["set"], pa.array([x.view(np.int64) for x in every], pa.list_(pa.int64())), pa.array(bins, pa.binary())], ["set", "all", "bins"])

    return docs.select("set", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "set long, all array<long>, bins binary")


def _close(pairs: DataFrame, whole: DataFrame, least: float) -> DataFrame:
    """The pairs whose bins don't rule them out: sets differ in as many shingles as their bins at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(k, ROWS) for x in batches for k in range(0, x.num_rows, ROWS)):
            x, y = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16) for c in ("x", "y"))
            most = (1 - least) / (1 + least) * (b["na"].to_numpy() + b["nb"].to_numpy()) + 1e-9
            yield pa.record_batch([b["a"], b["b"]], ["a", "b"]).filter(pa.array(np.abs(x - y).sum(axis=1) <= most))

    side = lambda c, n, x: whole.select(F.col("set").alias(c), F.size("all").alias(n), F.col("bins").alias(x))
    return pairs.join(side("a", "na", "x"), "a").join(side("b", "nb", "y"), "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long")


def _bar(least: float):
    """2 * least / (1 + least) of a set's shingles: near sets share half the sum of theirs or more."""
    return (2 * least / (1 + least) * F.col("n")).alias("bar")


def _meet(a: str, b: str):
    """Whether members a and b of a bucket can be near enough if its shingle is the first that they share."""
    return F.least(F.col(f"{a}.rest"), F.col(f"{b}.rest")) >= (F.col(f"{a}.bar") + F.col(f"{b}.bar")) / 2 - 1e-9


def _alike(x: str, y: str, na: str, nb: str, least: float):
    """Whether sets of na and nb shingles can be near enough by their counts in ranges x and y: they differ in as many shingles at least."""
    apart = F.aggregate(F.zip_with(x, y, lambda x, y: F.abs(x - y)), F.lit(0), lambda total, x: total + x)
    return apart <= (1 - least) / (1 + least) * (F.col(na) + F.col(nb)) + 1e-9


def _near(pairs: DataFrame, found: DataFrame, docs: DataFrame, width: int, least: float, counted: bool = False) -> DataFrame:
    """The pairs (a, b) of sets whose similarity is least or more. Counts rule out most others (counted: they have), whole sets decide. pairs: checkpointed."""
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    need = checkpoint(ends(pairs))
    known = found.join(_few(need), "set", "left_semi").select("set", "n", "counts", *KEYS).dropDuplicates(["set"])
    if counted:
        maybe, where = pairs, checkpoint(known.select("set", *KEYS))
    else:
        known = checkpoint(known)
        side = lambda c, n, x: known.select(F.col("set").alias(c), F.col("n").alias(n), F.col("counts").alias(x))
        one = pairs.join(side("a", "na", "x"), "a").join(side("b", "nb", "y"), "b")
        maybe = checkpoint(one.where(_alike("x", "y", "na", "nb", least)).select("a", "b"))
        where = checkpoint(known.select("set", *KEYS).join(ends(maybe), "set", "left_semi"))
    whole = checkpoint(_sets(docs.select(*KEYS, "text").join(_few(where), KEYS), width).dropDuplicates(["set"]))
    # whole sets go with pairs that nearly have the similarity only
    close = checkpoint(_close(maybe, whole, least))
    two = close.join(whole.select(F.col("set").alias("a"), F.col("all").alias("x")), "a").join(whole.select(F.col("set").alias("b"), F.col("all").alias("y")), "b")
    both = two.select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("n"))
    return both.where((F.col("n") == 0) | (F.col("i") / F.greatest(F.col("n") - F.col("i"), F.lit(1)) >= least)).select("a", "b")


def _smaller():
    """Whether a member of a bucket can be the one of the smaller bar of a pair if its shingle is the first that they share."""
    return F.col("rest") >= F.col("bar") - 1e-9


def _met(index: DataFrame) -> DataFrame:
    """Rows (h, set, rest, bar) of the buckets with two sets or more, one of which can be the smaller of a pair."""
    bucket = Window.partitionBy("h")
    rows = index.withColumns({"c": F.count("*").over(bucket), "some": F.max(_smaller()).over(bucket)})
    return rows.where("c > 1 and some").select("h", "set", "rest", "bar")


def rarest_first(index: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, least: float) -> DataFrame:
    """index of the same sets with their shingles ordered by the number of these sets that have them.

    A near pair's sets are both in index, so what no other of its sets has is shared by no pair: a set needs a share of
    `least` of shingles that others have to be near to any. nodes: set, n, keys.
    """
    hashes = lambda w: _sets(docs.select(*KEYS, "text").join(_few(w), KEYS), width).select("set", F.explode("all").alias("h"))
    # a row may be there twice, as copies share their keys: so sets of a shingle are told apart, and ranks are dense
    ends = lambda rows: rows.groupBy("h").agg(F.min("set").alias("set"), F.max("set").alias("last"), F.count("*").alias("c"))
    met = checkpoint(index.select("set").distinct())
    left = checkpoint(nodes.select("set", "n", *KEYS).distinct().join(_few(met), "set", "left_semi"))
    # what a set has alone in a part of the hashes is enough to rule out most, so that all shingles of few sets are dealt out
    for part in (F.col("h") < FIRST, F.lit(True)):
        own = checkpoint(ends(hashes(left).where(part)).where("set = last").groupBy("set").agg(F.count("*").alias("own")))
        release(docs.sparkSession)
        left = left.join(own, "set", "left").where(F.col("n") - F.coalesce("own", F.lit(0)) >= least * F.col("n") - 1e-9)
        left = checkpoint(left.select("set", "n", *KEYS))
    rows = hashes(left).join(ends(hashes(left)).where("set < last").select("h", "c"), "h")
    rows = rows.withColumn("place", F.dense_rank().over(Window.partitionBy("set").orderBy("c", "h")))
    rows = rows.withColumn("others", F.max("place").over(Window.partitionBy("set"))).join(_few(left.select("set", "n")), "set")
    rows = rows.withColumn("at", F.col("n") - F.col("others") + F.col("place") - 1)
    first = rows.where(F.col("at") <= F.col("n") - F.ceil(least * F.col("n") - 1e-9)).select("h", "set", (F.col("n") - F.col("at")).alias("rest"), _bar(least)).distinct()
    return checkpoint(_met(first))


def _edge(a: str, b: str):
    return [F.least(f"{a}.set", f"{b}.set").alias("a"), F.greatest(f"{a}.set", f"{b}.set").alias("b")]


def _usual(whole: DataFrame) -> DataFrame:
    """home, usual: the shingles that more than half of a home's sets have, which are fewer than two sets' on average. whole: set, home, all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = b["home"].take(pc.list_parent_indices(b["all"]))
            sums = pa.table({"home": of, "h": pc.list_flatten(b["all"])}).group_by(["home", "h"]).aggregate([([], "count_all")])
            yield from sums.rename_columns(["home", "h", "c"]).combine_chunks().to_batches()

    sizes = whole.groupBy("home").agg(F.count("*").alias("m"))
    counts = whole.select("home", "all").mapInArrow(run, "home long, h long, c long").groupBy("home", "h").agg(F.sum("c").alias("c"))
    usual = checkpoint(counts.join(sizes, "home").where("2 * c > m").groupBy("home").agg(F.collect_list("h").alias("usual")))
    return F.broadcast(usual) if (usual.agg(F.sum(F.size("usual"))).first()[0] or 0) <= FEW else usual


def differences(crowded: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(set, home, bits; an index of the pairs within each home, as in :func:`roots`; further pairs that may be near).

    bits: whether a set has an odd number of differences, by parts of their values. Two sets differ in as many shingles as bits at least.

    Sets that crowded buckets (rows h, set) connect are of one home. The difference D of a set is what it has beyond the home's
    usual shingles, and what it lacks of them. Two sets differ in |D1| + |D2| - 2 |D1 and D2| shingles, so near ones share half the
    sum of their bars, |D| - (1 - least) / (1 + least) n, or more. Two whose sum is 0 or less needn't share any; then both
    have such a sum with the set of the least bar too, and are near to it: these are the further pairs. Sets that aren't
    closer to the usual shingles than to none have no home.
    """
    hubs = crowded.groupBy("h").agg(F.min("set").alias("b"))
    home = checkpoint(components(crowded.join(hubs, "h").select(F.col("set").alias("a"), "b").distinct()).distinct().select(F.col("node").alias("set"), F.col("root").alias("home")))
    where = checkpoint(nodes.select("set", *KEYS).distinct().join(_few(home), "set", "left_semi"))
    whole = checkpoint(_sets(docs.select(*KEYS, "text").join(_few(where), KEYS), width).join(_few(home), "set").select("set", "home", "all").dropDuplicates(["set"]))
    usual = F.coalesce("usual", F.array().cast("array<long>"))
    beyond, lacks = F.array_except("all", usual), F.transform(F.array_except(usual, "all"), F.bitwise_not)
    apart = whole.join(_usual(whole), "home", "left").select("home", "set", F.size("all").alias("n"), F.concat(beyond, lacks).alias("d"))
    apart = checkpoint(apart.withColumn("bar", F.size("d") - (1 - least) / (1 + least) * F.col("n")).where(F.size("d") < F.col("n")))
    lowest = checkpoint(apart.groupBy("home").agg(F.min(F.struct("bar", "set")).alias("x")).select("home", F.col("x.bar").alias("low"), F.col("x.set").alias("b")))
    core = apart.join(_few(lowest), "home").where((F.col("set") != F.col("b")) & (F.col("bar") + F.col("low") <= 1e-9)).select(F.least("set", "b").alias("a"), F.greatest("set", "b").alias("b"))
    # rarest first; what a set alone has comes before all others
    rows = apart.select("set", "home", "bar", F.explode("d").alias("x")).select("set", "home", "bar", F.xxhash64("home", "x").alias("h"))
    rows = rows.join(rows.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "h")
    rows = rows.withColumn("rest", F.row_number().over(Window.partitionBy("set").orderBy(F.desc("c"), F.desc("h")))).join(_few(lowest), "home")
    index = rows.where(F.col("rest") >= (F.col("bar") + F.col("low")) / 2 - 1e-9).select("h", "set", "rest", "bar")
    word = lambda k: F.filter("d", lambda x: F.pmod(F.shiftright(x, 6), F.lit(WORDS)) == k)
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int"))
    bits = F.array(*[F.aggregate(word(k), F.lit(0).cast("long"), lambda total, x: total.bitwiseXOR(bit(x))) for k in range(WORDS)])
    return checkpoint(apart.select("set", "home", bits.alias("bits"))), checkpoint(_met(index)), checkpoint(core)


def _edge(a: str, b: str):
    return [F.least(f"{a}.set", f"{b}.set").alias("a"), F.greatest(f"{a}.set", f"{b}.set").alias("b")]


def roots(index: DataFrame, nodes: DataFrame, found: DataFrame, docs: DataFrame, width: int, least: float, maybe: DataFrame) -> DataFrame:
    """set, root (the smallest set that it is linked to by pairs of similarity least or more), for sets with a pair.

    index: h, set, rest, bar (see :func:`_bar`), of shingles h in more than one prefix; rest: the set's shingles from h on that others have.
    maybe: further pairs that may be near; they are verified with those of the first hubs. nodes: set, keys.
    """
    edges = linked = None

    def buckets(index: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(index with the root of each set; of buckets with pairs of different components: these pairs, whether they are too many to compare)."""
        rooted = index.join(linked.select(F.col("node").alias("set"), "root"), "set", "left").withColumn("root", F.coalesce("root", "set"))
        counts = rooted.groupBy("h", "root").agg(F.count("*").alias("c")).groupBy("h").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("own"))
        return rooted, checkpoint(counts.where("n * n > own").select("h", ((F.col("n") * F.col("n") - F.col("own")) / 2).alias("pairs"), (F.col("n") * F.col("n") - F.col("own") > 2 * MANY * F.col("n")).alias("crowded")))

    def rounds(index: DataFrame, maybe: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What buckets returns after rounds of hubs."""
        nonlocal edges, linked
        size, before = index.count(), math.inf
        left = index.withColumn("root", F.col("set")) if linked is None else buckets(index)[0]
        for k in range(ROUNDS):
            if k:
                crowded = open_.where("crowded")
                now = crowded.agg(F.sum("pairs")).first()[0] or 0
                if now <= size or now > STALLED * before:
                    break
                before = now
                left = checkpoint(rooted.join(crowded.select("h"), "h", "left_semi").select("h", "set", "rest", "bar", "root"))
            hubs = left.groupBy("h").agg(F.min_by(F.struct("set", "rest", "bar", "root"), F.struct(~_smaller(), F.xxhash64("set", F.lit(k)))).alias("x")).select("h", "x.*")
            pairs = left.alias("l").join(hubs.alias("r"), "h").where((F.col("l.root") != F.col("r.root")) & _meet("l", "r")).select(*_edge("l", "r"))
            pairs = (pairs if k else pairs.unionByName(maybe)).distinct()
            new = checkpoint(_near(checkpoint(pairs), found, docs, width, least))
            if k and new.isEmpty():
                break
            edges = new if edges is None else edges.unionByName(new)
            linked = checkpoint(components(edges).distinct())
            rooted, open_ = buckets(index)
            release(docs.sparkSession)
        return rooted, open_

    rooted, open_ = rounds(index, maybe)
    left = rooted.join(open_.select("h"), "h", "left_semi").select("h", "set", "rest", "bar", "root", F.lit(None).cast("long").alias("home"), F.lit(0).alias("kind"), F.array().cast("array<long>").alias("bits"))
    crowded = open_.where("crowded")
    if not crowded.isEmpty():
        home, inner, core = differences(checkpoint(rooted.join(crowded.select("h"), "h", "left_semi").select("h", "set")), nodes, docs, width, least)
        release(docs.sparkSession)
        apart, still = rounds(inner, core)
        # pairs within a home meet by their differences, all others as before
        rooted, open_ = buckets(index)
        outer = rooted.join(open_.select("h"), "h", "left_semi").join(_few(home.select("set", "home")), "set", "left")
        other, bucket = F.coalesce("home", "set"), Window.partitionBy("h")
        outer = outer.withColumns({"x": F.min(other).over(bucket), "y": F.max(other).over(bucket)}).where("x < y").withColumns({"kind": F.lit(0), "bits": F.array().cast("array<long>")})
        apart = apart.join(still.select("h"), "h", "left_semi").join(_few(home.select("set", "bits")), "set").withColumns({"home": F.lit(None).cast("long"), "kind": F.lit(1)})
        columns = ["h", "set", "rest", "bar", "root", "home", "kind", "bits"]
        left = outer.select(columns).unionByName(apart.select(columns))
    # pairs aren't made where counts rule them out, nor in a bucket after one that both sets are in (the last EARLIER of a set are known)
    left = checkpoint(left)
    counts = found.join(_few(checkpoint(left.select("set").distinct())), "set", "left_semi").select("set", "n", "counts").dropDuplicates(["set"])
    before = F.collect_list("h").over(Window.partitionBy("set", "kind").orderBy(F.desc("rest")).rowsBetween(-EARLIER, -1))
    left = checkpoint(left.withColumn("earlier", before).join(counts, "set"))
    release(docs.sparkSession)
    ordered = (F.struct("r.bar", "r.set") < F.struct("l.bar", "l.set")) & F.coalesce(F.col("l.home") != F.col("r.home"), F.lit(True))
    odd = F.aggregate(F.zip_with("l.bits", "r.bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    alike = (odd <= (1 - least) / (1 + least) * (F.col("l.n") + F.col("r.n")) + 1e-9) & _alike("l.counts", "r.counts", "l.n", "r.n", least)
    pairs = left.alias("l").join(left.where(_smaller()).alias("r"), "h").where(ordered & (F.col("l.root") != F.col("r.root")) & _meet("l", "r") & ~F.arrays_overlap("l.earlier", "r.earlier") & alike).select(*_edge("l", "r")).distinct()
    pairs = checkpoint(pairs)
    release(docs.sparkSession)
    new = checkpoint(_near(pairs, found, docs, width, least, True))
    if not new.isEmpty():
        linked = components(edges.unionByName(new)).distinct()
    return linked.select(F.col("node").alias("set"), "root")


def groups(found: DataFrame, docs: DataFrame, width: int, least: float, pairs: DataFrame) -> DataFrame:
    """doc_id, keys, root: documents have the same root if pairs with a similarity of least or more connect them.

    found: :func:`sets` of docs; pairs: (a, b) of sets that may be near.
    """
    # one row of each set; rows are told apart by keys, so that prefixes aren't shuffled
    first = found.groupBy("set").agg(F.min(F.struct(*KEYS)).alias("x"), F.count("*").alias("c")).where("c > 1")
    copies = checkpoint(found.select("set", *KEYS).join(first, "set").where(F.struct(*KEYS) != F.col("x")).select(*KEYS).distinct())
    nodes = found.join(_few(copies), KEYS, "left_anti").select("set", "n", "first", *KEYS)
    index = nodes.select("set", "n", F.posexplode("first").alias("at", "h")).select("h", "set", (F.col("n") - F.col("at")).alias("rest"), _bar(least))
    index = checkpoint(_met(index))
    release(docs.sparkSession)
    index = rarest_first(index, nodes, docs, width, least)
    release(docs.sparkSession)
    near = roots(index, nodes, found, docs, width, least, pairs)
    return found.select("doc_id", *KEYS, "set").join(near, "set", "left").select("doc_id", *KEYS, F.coalesce("root", "set").alias("root"))
