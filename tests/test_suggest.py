from pyspark.sql import functions as F

from reprise.operators import suggest as G
from reprise.operators import verdict as V


def test_summaries(spark):
    rows = [('{"path": "/a", "command": " ls  -la "}',), ('{"zoo": "x", "n": 3}',), ('{"n": 3}',), (None,), ("not json",)]
    got = [r.s for r in spark.createDataFrame(rows, "i string").select(G.summary(F.col("i")).alias("s")).collect()]
    assert got == ["command=ls -la", "zoo=x", "", "", ""]
    assert spark.range(1).select(G.coarse(F.lit("see /a/b 12 deadbeef00"))).first()[0] == "see <path> <n> <id>"


def test_procedures(spark):
    runs = {"s1": ["a", "b"], "s2": ["c", "a", "b", "a"], "s3": ["b"]}
    rows = [("c", s, i, x, x, f"{s}{i}") for s, xs in runs.items() for i, x in enumerate(xs)] + [("few", "s1", 0, "a", "a", "")]
    got = G.procedures(spark.createDataFrame(rows, "cluster_id string, session_key string, ord int, step string, name string, summary string"))
    assert [(r.kind, r.step, r.summary, r.sessions) for r in got.orderBy("kind", "place").collect()] == [("common", "a", "s10", 2), ("common", "b", "s11", 3), ("varied", "c", "s20", 1)]


def test_slots(spark):
    texts = ["fix file a.py in 12 now", "fix file b.py in 7 now please", "fix file a.py in 7 now", "  "]
    got = G.slots(G.columns(spark.createDataFrame([("c", i, t) for i, t in enumerate(texts)], "cluster_id string, member int, text string"))).orderBy("span").collect()
    assert [(r.constant, r.at, r.kind, r.examples) for r in got] == [
        (True, 0, None, ["fix file"]), (False, 2, "filename", ["a.py", "b.py"]), (True, 3, None, ["in"]), (False, 4, "number", ["12", "7"]), (True, 5, None, ["now"]),
    ]


def test_verdicts(spark):
    def of(statuses, sessions=5, candidates=0, skipped=0, malformed=0, truncated=False):
        s = F.array(*[F.lit(x) for x in statuses]).cast("array<string>")
        return spark.range(1).select(V.verdict(s, F.lit(sessions), F.lit(3), F.lit(candidates), F.lit(skipped), F.lit(malformed), F.lit(truncated), F.lit(False))).first()[0]

    assert of([]) == of(["absent"] * 3) == V.NO_HISTORY
    assert of(["found", "unreadable: no"]) == of(["found"], skipped=1) == of(["found"], malformed=1) == of(["found"], truncated=True) == V.PARTIAL
    assert (of(["found"], sessions=2), of(["found"], candidates=1), of(["found"])) == (V.INSUFFICIENT, V.REPEATED, V.NULL)


def test_slots_make_rows_of_differing_places_alone(spark):
    texts = [("one", 5, "a b c d"), ("two", 1, "x same y same same"), ("two", 2, "x same z same other tail"), ("all", 1, "p q"), ("all", 2, "r s t"), ("copy", 1, "k l"), ("copy", 2, "k l"), ("none", 1, " ")]
    columns = G.columns(spark.createDataFrame(texts, "cluster_id string, member int, text string"))
    assert columns.count() == 7  # a row a text, not a token
    got = {(r.cluster_id, r.span): (r.constant, r.at, r.examples) for r in G.slots(columns).collect()}
    assert got == {
        ("one", 0): (True, 0, ["a b c d"]), ("two", 0): (True, 0, ["x same"]), ("two", 1): (False, 2, ["y", "z"]), ("two", 2): (True, 3, ["same"]), ("two", 3): (False, 4, ["same", "other"]),
        ("all", 0): (False, 0, ["p q", "r s"]), ("copy", 0): (True, 0, ["k l"]),
    }
