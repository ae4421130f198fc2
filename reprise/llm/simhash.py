"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are cut into parts of correlated bits. With thresholds t_1..t_m that sum to tau - m + 1, two fingerprints
within tau bits agree within t_i bits on some part i; a part with threshold -1 needs no probing. A dynamic programme
picks the number of parts and their thresholds with the least probes and candidates, as estimated from the sizes of each part's
buckets over all fingerprints. Pairs of a bucket are verified on all 64 bits.

Buckets with more than MANY fingerprints aren't paired up. Their fingerprints are linked exactly through points half
way: two fingerprints within tau bits have a point within ceil(tau/2) bits of one and floor(tau/2) of the other, so
each sends itself to all points around it and is linked to the smallest fingerprint that meets it there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, checkpoint, keep_one, texts, with_key
from .components import components

BITS = 64
MANY = 64  #: fingerprints of a bucket that are compared in pairs; others are linked another way, with the same result
PROBES = 100  #: keys that a fingerprint is looked up under at most (tau + 1 parts of threshold 0 need tau + 1)
CHUNK = 1 << 16  #: shingles whose bits are counted at once
BATCH = 1024  #: whole texts that go to Python at once where near-duplicates are dropped


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 (seed 42) of all shingles of a text, repeats included; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words) - width + 1
    if n <= 1:
        return np.array([hashed(joined, 42)] if words else [], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate([[0], np.cumsum(lengths)])
    return np.fromiter((hashed(joined[a:e], 42) for a, e in zip(starts[:n].tolist(), (starts[width:] - 1).tolist(), strict=True)), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; 0 for none."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(h), CHUNK):
        counts += np.unpackbits(h[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, width: int) -> int:
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int, keys: list[str] | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), keys (further columns of longs)."""
    keys = keys or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b["text"].to_pylist()], np.uint64)
            yield pa.record_batch([b["doc_id"], pa.array(fps.view(np.int64)), *[b[k] for k in keys]], ["doc_id", "fp", *keys])

    return texts(docs, keys).mapInArrow(run, "doc_id long, fp long" + "".join(f", {k} long" for k in keys))


def _correlations(fps: DataFrame) -> tuple[np.ndarray, int]:
    """|correlation| of each pair of bits over all fingerprints, and their number; sent to the driver: 64 * 64 sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = np.unpackbits(b["fp"].to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x
            n += len(x)
        if n:
            yield pa.record_batch([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(total.ravel(), float(n)))], ["k", "v"])

    got = {r.k: r.s for r in fps.select("fp").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("s")).collect()}
    n = got.pop(BITS * BITS, 0.0)
    both = np.array([got.get(k, 0.0) for k in range(BITS * BITS)]).reshape(BITS, BITS) / max(n, 1.0)
    p = np.diag(both)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    return np.abs((both - np.outer(p, p)) / np.outer(spread, spread)), int(n)


def parts_of(correlation: np.ndarray, m: int) -> list[list[int]]:
    """Bits in m parts of like size; each part is grown by the bit that its bits are most correlated with."""
    left, parts = set(range(BITS)), []
    for k in range(m):
        want = len(left) // (m - k)
        part = [max(left, key=lambda b: (correlation[b, sorted(left - {b})].sum() if len(left) > 1 else 0, -b))]
        left.discard(part[0])
        while len(part) < want:
            part.append(max(left, key=lambda b: (correlation[b, part].sum(), -b)))
            left.discard(part[-1])
        parts.append(sorted(part))
    return parts


def allocate(pairs: list[float], widths: list[int], n: int, tau: int, most: int) -> tuple[float, list[int]] | None:
    """(estimated cost, thresholds that sum to tau - m + 1) with the least cost, or None if every choice probes more than `most` keys a fingerprint.

    pairs: those that share each part's bucket; widths: bits of each part. The cost is the probes, and the pairs that they meet.
    """
    best: dict[tuple[int, int], tuple[float, list[int]]] = {(0, 0): (0.0, [])}  # by thresholds and probes so far
    for i, width in enumerate(widths):
        step: dict[tuple[int, int], tuple[float, list[int]]] = {}
        for (used, probes), (c, ts) in best.items():
            for t in range(-1, tau + 1):
                ball = sum(math.comb(width, k) for k in range(t + 1))  # buckets that a fingerprint probes
                if probes + ball <= most:
                    new = (c + ball * (pairs[i] + n), [*ts, t])
                    key = (used + t, probes + ball)
                    if key not in step or new < step[key]:
                        step[key] = new
        best = step
    return min((v for (used, _), v in best.items() if used == tau - len(widths) + 1), default=None)


def _key(fp: Column, bits: list[int]) -> Column:
    """The bits of a part; a mask is as good a key as packed bits."""
    mask = sum(1 << b for b in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def _around(fp: Column, bits: list[int], radius: int) -> Column:
    """All values that differ from fp in radius of the bits at most."""
    flips = [_signed(sum(1 << b for b in c)) for r in range(radius + 1) for c in combinations(bits, r)]
    return F.transform(F.array(*[F.lit(f) for f in flips]), lambda f: fp.bitwiseXOR(f))


def links(fps: DataFrame, tau: int) -> DataFrame:
    """(a, b) so that the components of all links are those of all pairs of different fingerprints within tau bits.

    fps: fp, different values. Every row returned is such a pair.
    """
    correlation, n = _correlations(fps)
    forms = {m: parts_of(correlation, m) for m in range(1, tau + 2)}
    cells = [F.struct(F.lit(m).alias("m"), F.lit(i).alias("part"), _key(F.col("fp"), p).alias("key")) for m, parts in forms.items() for i, p in enumerate(parts)]
    every_form = fps.select(F.explode(F.array(*cells)).alias("x")).select("x.*").groupBy("m", "part", "key").agg(F.count("*").alias("n")).where("n > 1")
    every_form = checkpoint(every_form)
    pairs = {(r.m, r.part): float(r.s) for r in every_form.groupBy("m", "part").agg(F.sum(F.col("n").cast("double") * F.least("n", F.lit(MANY))).alias("s")).collect()}
    plans = {m: allocate([pairs.get((m, i), 0.0) for i in range(m)], [len(p) for p in parts], n, tau, PROBES) for m, parts in forms.items()}
    m = min((m for m, plan in plans.items() if plan), key=lambda m: plans[m][0])
    parts, thresholds = forms[m], plans[m][1]
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("part"), _key(F.col("fp"), p).alias("key")) for i, p in enumerate(parts)])).alias("x")).select("fp", "x.part", "x.key")
    sizes = every_form.where(F.col("m") == m).select("part", "key", "n")
    probed = [i for i in range(m) if thresholds[i] >= 0]
    index = keyed.where(F.col("part").isin(probed))
    hot = sizes.where(F.col("n") > MANY).where(F.col("part").isin(probed)).select("part", "key")

    # pairs of the other buckets; only the probing side is looked up with flips, the index side as it is
    flips = F.array(*[F.struct(F.lit(i).alias("part"), _around(_key(F.col("fp"), parts[i]), parts[i], thresholds[i]).alias("keys")) for i in probed])
    probes = fps.select("fp", F.explode(flips).alias("x")).select(F.col("fp").alias("other"), "x.part", F.explode("x.keys").alias("key"))
    if all(thresholds[i] == 0 for i in probed):
        full = sizes.where((F.col("n") > 1) & (F.col("n") <= MANY)).select("part", "key")
        index = index.join(full, ["part", "key"], "left_semi")
        probes = probes.join(full, ["part", "key"], "left_semi")
    else:
        index = index.join(hot, ["part", "key"], "left_anti")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= tau
    cold = index.join(probes, ["part", "key"]).where((F.col("fp") != F.col("other")) & near).select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))

    # fingerprints of full buckets: with those that probe them from nearby buckets if some threshold is above 0
    crowd = keyed.select("fp", "part", "key") if all(thresholds[i] == 0 for i in probed) else probes.select(F.col("other").alias("fp"), "part", "key")
    crowd = crowd.join(hot, ["part", "key"], "left_semi").select("fp").distinct()
    every = list(range(BITS))
    wide, narrow = (tau + 1) // 2, tau // 2
    met = crowd.select("fp", F.explode(_around(F.col("fp"), every, wide)).alias("mid"))
    near_mid = met if wide == narrow else crowd.select("fp", F.explode(_around(F.col("fp"), every, narrow)).alias("mid"))
    hubs = near_mid.groupBy("mid").agg(F.min("fp").alias("hub"))
    warm = met.join(hubs, "mid").where("fp <> hub").select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b"))
    if wide != narrow:  # the smallest of the nearer ones is reached by the others of them over a farther one only
        warm = warm.unionByName(near_mid.join(hubs, "mid").where("fp <> hub").select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")))
    return cold.unionByName(warm).distinct()


def _rooted(fps: DataFrame, tau: int) -> DataFrame:
    """fp, first (its smallest doc_id), root (the smallest fingerprint that links reach)."""
    nodes = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes.select("fp"), tau)).withColumnRenamed("node", "fp")
    return nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def groups(docs: DataFrame, width: int = 5, tau: int = 3) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach).

    Equal fingerprints are one node, so copies are not paired. Texts without words have fingerprint 0 and are linked like
    others. A null doc_id is in a group like others but never its name, unless all of the group are null.
    """
    fps = checkpoint(fingerprints(docs, width))
    named = _rooted(fps, tau)
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(named.join(names, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, width: int = 5, tau: int = 2, least: float = 0.8) -> DataFrame:
    """docs, all columns, with one row of each group: the one of the smallest doc_id, nulls last.

    Groups are connected by pairs whose sets of shingles have a Jaccard similarity of `least` or more. Fingerprints within tau
    bits are found by the scheme above, and verified on the sets; as they are a small part of such pairs, a join by
    prefixes (shingles.py) finds the others. Rows are told apart by doc_id and text, so texts that repeat a doc_id or have
    none are documents of their own; of rows equal in both one stays. Texts without words are one group, and texts of fewer
    words than a shingle are copies if they have the same words. Tables may have further columns of any name but __k1 and __k2.
    """
    from . import shingles

    with batches_of(docs.sparkSession, BATCH):
        keyed = with_key(docs.select("doc_id", "text"))
        found = shingles.sets(keyed, width, least)
        nodes = checkpoint(found.groupBy("fp").agg(F.min("set").alias("set")))
        near = links(nodes.select("fp"), tau)
        name = lambda c: nodes.select(F.col("fp").alias(c), F.col("set").alias(f"set_{c}"))
        pairs = near.join(name("a"), "a").join(name("b"), "b").select(F.least("set_a", "set_b").alias("a"), F.greatest("set_a", "set_b").alias("b"))
        same = found.select("fp", "set").distinct().join(nodes.select("fp", F.col("set").alias("a")), "fp").where("set <> a").select("a", F.col("set").alias("b"))
        groups_ = checkpoint(shingles.groups(found, keyed, width, least, pairs.unionByName(same)))
    return keep_one(docs, groups_)
