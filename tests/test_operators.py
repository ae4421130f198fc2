"""Cost, exploration, clustering and ranking on small tables."""

import math
import random
import re

from pyspark.sql import functions as F

from reprise import queries
from reprise.functions import text as T
from reprise.operators import cluster, cost, rank, rediscovery

TURNS = "session_key string, session_id string, project string, harness string, ord long, role string, text string, ts string, model string, input_tokens long, output_tokens long, cache_read_tokens long"


def test_costs(spark):
    rows = [
        ("a", "a", "p", "h", 0, "user", "x" * 400, "2026-01-01", None, None, None, None),
        ("b", "b", "p", "h", 0, "assistant", "y", "2026-01-02", "Claude-Sonnet-4-x", 1_000_000, None, None),
        ("c", "c", None, "h", 0, "user", "", None, None, None, None, None),
        ("d", "d", "q", "h", 0, "assistant", "z", None, "gpt-4o-mini-1", 0, 1_000_000, 0),
        ("e", "e", "q", "h", 0, "assistant", "z", None, "never-seen", 500_000, 0, 0),
    ]
    c = {r.session_key: r for r in cost.session_cost(cost.session_usage(spark.createDataFrame(rows, TURNS)), cost.prices(spark)).collect()}
    assert (c["a"].basis, c["a"].billed_input, c["a"].priced) == ("estimated", 100, False)
    assert (c["b"].basis, c["b"].usd, c["b"].priced, c["b"].model_key) == ("measured", 3.0, True, "claude-sonnet-4")
    assert (c["c"].basis, c["c"].usd, c["c"].session_tokens) == ("unknown", 0.0, None)
    assert (c["d"].usd, c["d"].model_key, c["e"].usd) == (0.6, "gpt-4o-mini", 1.5)
    costed = cost.session_cost(cost.session_usage(spark.createDataFrame(rows, TURNS)), cost.prices(spark))
    p = {r.project: r for r in cost.project_costs(costed).collect()}
    assert (p["q"].usd, p["q"].session_count, p["p"].basis, p["unknown"].sessions_without_model) == (2.1, 2, "estimated", 1)


def test_rediscovery(spark):
    calls = []
    for k in range(5):
        names = ["Glob", "Grep", "Read", "Read", "StrReplace"] if k == 0 else ["Read", "Write"]
        calls += [(f"s{k}", f"s{k}", "h", "p", i, n, "/f" if n == "Read" else None, None) for i, n in enumerate(names)]
    calls += [("look", "look", "h", "p", 0, "Read", "/g", None)]
    df = spark.createDataFrame(calls, "session_key string, session_id string, harness string, project string, ord long, name string, path string, command string")
    s = rediscovery.summary(df).first()
    assert (s.resolvable_sessions, s.no_mutation_sessions, s.median_prefix, s.pattern_pct) == (5, 1, 1.0, 20.0)
    assert math.isclose(s.explore_pct, 100 * 9 / 14)
    assert [(r.path, r.sessions) for r in rediscovery.reread_files(df).collect()] == [("/f", 5)]
    few = rediscovery.summary(df.where("session_key IN ('s1', 's2')")).first()
    assert not few.sufficient and few.median_prefix is None


def _one_pass(vectors):
    centroids, sizes, first, out = [], [], [], {}
    for o, v in sorted(vectors.items()):
        best, at = 0.0, -1
        for k, c in enumerate(centroids):
            s = sum(w * c.get(t, 0.0) for t, w in v.items())
            if s > best + 1e-12:
                best, at = s, k
        if at >= 0 and best >= 0.45:
            mixed = {t: (centroids[at].get(t, 0) * sizes[at] + v.get(t, 0)) / (sizes[at] + 1) for t in centroids[at].keys() | v.keys()}
            n = math.sqrt(sum(x * x for x in mixed.values()))
            centroids[at], sizes[at] = {t: x / n for t, x in mixed.items()}, sizes[at] + 1
        else:
            centroids.append(v)
            sizes.append(1)
            first.append(o)
            at = len(first) - 1
        out[o] = first[at]
    return out


def test_greedy_pass_equals_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words[(g % 6) * 10 : (g % 6) * 10 + 12], k=6)) for g in range(60)] + ["", "the"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "intent_ord long, normalized string")
    v = cluster.vectors(df).cache()
    vectors = {}
    for r in v.collect():
        vectors.setdefault(r.intent_ord, {})[r.term] = r.w
    want = _one_pass(vectors) | {60: 60}
    assert {r.intent_ord: r.cluster_id for r in cluster.assign(df, v).collect() if r.intent_ord != 61} == {k: c for k, c in want.items() if k != 61}


def test_clusters_need_distinct_sessions(spark):
    asks = ["Fix the failing auth tests in the login module", "Repair failing authentication tests in login module", "Fix the failing auth test suite for the login module"]
    rows = [(i, f"s{i}", "p", "2026-09-01T00:00:00", a) for i, a in enumerate(asks)] + [(9, "s9", "p", "", "Deploy the weather dashboard to staging tonight")]
    df = spark.createDataFrame(rows, "intent_ord long, session_id string, project string, ts string, raw_text string").withColumn("normalized", T.normalize(F.col("raw_text")))
    v = cluster.vectors(df)
    found = cluster.clusters(df, cluster.assign(df, v), v).collect()
    assert [(c.id, c.distinct_sessions, c.run_count) for c in found] == [("c1", 3, 3)]
    same = df.withColumn("session_id", F.lit("s"))
    assert cluster.clusters(same, cluster.assign(same, v), v).count() == 0


def test_rank_decays_and_prefers_stable(spark):
    c = spark.createDataFrame([(1, 3, "2026-09-03T00:00:00", "a"), (2, 3, "2026-08-20T00:00:00", "b")], "cluster_id long, distinct_sessions long, last_seen string, label string")
    costs = spark.createDataFrame([(1, 10, 0, 0, 1.0, "measured", True), (2, 10, 0, 0, 1.0, "measured", True)], "cluster_id long, input_tokens long, output_tokens long, cache_read_tokens long, usd double, basis string, priced boolean")
    var = spark.createDataFrame([(1, 0.0), (2, 0.0)], "cluster_id long, turn_variance double")
    assert {r.cluster_id: r.score for r in rank.score(c, costs, var, "2026-09-03T18:00:00+00:00").collect()} == {1: 1.0, 2: 0.5}


def test_vectors_read_texts_once_for_tf_and_once_for_df(spark):
    df = spark.createDataFrame([(1, "red fox"), (1, "fox"), (2, "red"), (3, "")], "intent_ord long, normalized string")
    v = cluster.vectors(df)
    w = {(r.intent_ord, r.term): r.w for r in v.collect()}
    fox, red = 2 * (math.log(5 / 2) + 1), math.log(5 / 3) + 1
    assert math.isclose(w[1, "fox"], fox / math.hypot(fox, red)) and math.isclose(w[1, "red"], red / math.hypot(fox, red)) and w[2, "red"] == 1.0 and len(w) == 3
    plan = v._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bJoin (?:Inner|Cross)", plan)) == 2  # idf and the number of asks; no norms of a second reading


def test_clusters_are_made_of_whole_texts(spark, tmp_path):
    start, ends = " ".join(f"word{i}" for i in range(80)), [" ".join(f"{k}{i}" for i in range(2000)) for k in ("left", "right")]
    rows = [(i, "s", f"{start} {ends[i % 2]}") for i in range(4)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.intent_ord: r.cluster_id for r in queries.cluster_intents(spark, str(tmp_path)).collect()} == {0: 0, 1: 1, 2: 0, 3: 1}
    assert [r.run_count for r in queries.cluster_precision_filter(spark, str(tmp_path)).collect()] == [2, 2]


def test_greedy_pass_with_large_and_growing_clusters(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choices(words[:20] + words[(g % 9) * 20 : (g % 9) * 20 + 30], k=rng.choice([2, 8, 40]))) for g in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "intent_ord long, normalized string")
    v = cluster.vectors(df).cache()
    vectors = {}
    for r in v.collect():
        vectors.setdefault(r.intent_ord, {})[r.term] = r.w
    assigned = cluster.assign(df, v)
    assert {r.intent_ord: r.cluster_id for r in assigned.collect()} == _one_pass(vectors)
    assert "FlatMapGroups" not in assigned._jdf.queryExecution().optimizedPlan().toString()  # no whole component in a frame of one task


def test_pairs_of_a_group_meet_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK", 4)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(25)], k=rng.choice([1, 4, 9])))) for i in range(50)] + [(60, ""), (61, "lonely")]
    df = spark.createDataFrame(rows, "intent_ord long, normalized string")
    v = cluster.vectors(df).cache()
    group = df.select("intent_ord", F.when(F.col("intent_ord") < 37, 0).when(F.col("intent_ord") < 49, 7).otherwise(F.col("intent_ord")).cast("long").alias("cluster_id"))
    of, vectors = {r.intent_ord: r.cluster_id for r in group.collect()}, {}
    for r in v.collect():
        vectors.setdefault(r.intent_ord, {})[r.term] = r.w
    want = {(of[a], a, b): sum(w * y[t] for t, w in x.items() if t in y) for a, x in vectors.items() for b, y in vectors.items() if a < b and of[a] == of[b] and x.keys() & y.keys()}
    found = cluster.pairwise_cosine(v, group)
    got = {(r.cluster_id, r.a, r.b): r.cosine for r in found.collect()}
    assert got.keys() == want.keys() and found.count() == len(want) and all(math.isclose(got[k], want[k]) for k in want)
