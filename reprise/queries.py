"""Named queries over the test tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vocab as V
from .functions import text as T
from .operators import cluster, cost, rank, rediscovery, suggest, verdict
from .operators.graph import checkpoint, running_sum
from .sources import adapters as A
from .sources import records

NOW = "2026-09-03T18:00:00+00:00"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {A.SQL}{sql}"
        return f

    return add


def _r(c, n: int = 4):
    return F.round(c, n)


# ---- sessions, usage and cost

_USAGE = """,
usage AS (SELECT session_key, min(session_id) AS session_id, min(project) AS project, min(harness) AS harness, sum(input_tokens)::BIGINT AS input_tokens,
  sum(output_tokens)::BIGINT AS output_tokens, sum(cache_read_tokens)::BIGINT AS cache_read_tokens, arg_min(model, ord) FILTER (model IS NOT NULL) AS model,
  sum(length(text))::BIGINT AS text_chars, count(*) AS turn_count, arg_min(ts, ord) AS started_at, arg_max(ts, ord) AS ended_at,
  (sum(coalesce(input_tokens, 0)) + sum(coalesce(output_tokens, 0)) + sum(coalesce(cache_read_tokens, 0)))::BIGINT AS all_tokens FROM turns GROUP BY session_key)"""
_PRICES = ",\nprices(model_key, input_rate, output_rate, cache_rate) AS (VALUES " + ", ".join(f"('{k}', {i}::DOUBLE, {o}::DOUBLE, {c}::DOUBLE)" for k, i, o, c in V.PRICES) + ")"
_PRICED = """,
matched AS (SELECT u.session_key, max(length(p.model_key)) AS len FROM usage u JOIN prices p ON p.model_key <> 'default' AND starts_with(lower(trim(u.model)), lower(p.model_key)) GROUP BY 1),
rated AS (SELECT u.*, p.* FROM usage u LEFT JOIN matched m ON m.session_key = u.session_key JOIN prices p ON p.model_key = coalesce(lower(substr(trim(u.model), 1, m.len)), 'default')),
billed AS (SELECT *, coalesce(input_tokens, output_tokens, cache_read_tokens) IS NOT NULL AS measured,
  CASE WHEN coalesce(input_tokens, output_tokens, cache_read_tokens) IS NOT NULL THEN coalesce(input_tokens, 0) WHEN text_chars > 0 THEN greatest(1, round_even(text_chars / 4, 0)::BIGINT) ELSE 0 END AS billed_input,
  coalesce(output_tokens, 0) AS billed_output, coalesce(cache_read_tokens, 0) AS billed_cache FROM rated),
costed AS (SELECT *, CASE WHEN measured THEN 'measured' WHEN text_chars > 0 THEN 'estimated' ELSE 'unknown' END AS basis, (measured AND model IS NOT NULL) AS priced,
  (billed_input * input_rate + billed_output * output_rate + billed_cache * cache_rate) / 1e6 AS usd FROM billed)"""
_COSTED = _USAGE + _PRICES + _PRICED


def _usage(spark, d):
    return cost.session_usage(A.turns(spark, d))


def _costed(spark, d):
    return cost.session_cost(_usage(spark, d), cost.prices(spark))


@query(_USAGE + " SELECT session_key, input_tokens, output_tokens, cache_read_tokens, CASE WHEN coalesce(input_tokens, output_tokens, cache_read_tokens) IS NOT NULL THEN all_tokens END AS session_tokens, model, text_chars, turn_count FROM usage")
def session_usage(spark: SparkSession, d: str) -> DataFrame:
    return _usage(spark, d).select("session_key", *cost.TOKENS, "session_tokens", "model", "text_chars", "turn_count")


@query(_COSTED + " SELECT session_key, basis, priced, model_key, billed_input::BIGINT AS billed_input, billed_output::BIGINT AS billed_output, billed_cache::BIGINT AS billed_cache, round(usd, 4) AS usd FROM costed")
def session_cost(spark, d):
    return _costed(spark, d).select("session_key", "basis", "priced", "model_key", "billed_input", "billed_output", "billed_cache", _r("usd").alias("usd"))


@query(_COSTED + """ SELECT project, sum(billed_input)::BIGINT AS input_tokens, sum(billed_output)::BIGINT AS output_tokens, sum(billed_cache)::BIGINT AS cache_read_tokens, round(sum(round(usd, 6)), 3) AS usd,
  CASE max(CASE basis WHEN 'measured' THEN 1 WHEN 'estimated' THEN 2 ELSE 3 END) WHEN 1 THEN 'measured' WHEN 2 THEN 'estimated' ELSE 'unknown' END AS basis,
  count(*) AS session_count, bool_and(priced) AS priced, count_if(model IS NULL)::BIGINT AS sessions_without_model FROM costed GROUP BY project""")  # fmt: skip
def project_costs(spark, d):
    return cost.project_costs(_costed(spark, d)).drop("tokens").withColumn("usd", _r("usd", 3))


@query(_COSTED + " SELECT DISTINCT model, model_key, input_rate, output_rate, cache_rate FROM rated")
def model_price_match(spark, d):
    return cost.price_of(_usage(spark, d), cost.prices(spark)).select("model", "model_key", "input_rate", "output_rate", "cache_rate").distinct()


@query(" SELECT session_key, ord, last_value(model IGNORE NULLS) OVER (PARTITION BY session_key ORDER BY ord ROWS UNBOUNDED PRECEDING) AS model FROM turns")
def model_carry_forward(spark, d):
    return cost.carry_model(A.turns(spark, d)).select("session_key", "ord", "model")


@query(_USAGE + " SELECT session_key, session_id, project, started_at, ended_at FROM usage")
def session_bounds(spark, d):
    return _usage(spark, d).select("session_key", "session_id", "project", "started_at", "ended_at")


@query(_USAGE + " SELECT min(day) AS first_day, max(day) AS last_day FROM (SELECT substr(started_at, 1, 10) AS day FROM usage UNION ALL SELECT substr(ended_at, 1, 10) FROM usage)")
def date_range(spark, d):
    return cost.date_range(_usage(spark, d))


@query(_USAGE + " SELECT count(*) AS sessions, count_if(model IS NULL)::BIGINT AS without_model, count_if(coalesce(input_tokens, output_tokens, cache_read_tokens) IS NOT NULL)::BIGINT AS with_tokens FROM usage")
def pricing_coverage(spark, d):
    return cost.pricing_coverage(_usage(spark, d))


@query(""", sizes AS (SELECT session_key, sum(length(text))::BIGINT AS bytes FROM turns GROUP BY 1)
SELECT session_key, bytes, sum(bytes) OVER (ORDER BY bytes, session_key)::BIGINT AS upto, sum(bytes) OVER (ORDER BY bytes, session_key) > 100000 AS truncated FROM sizes""")
def byte_budget_scan(spark, d):
    sizes = A.turns(spark, d).groupBy("session_key").agg(F.sum(F.length("text")).alias("bytes"))
    return running_sum(sizes, "bytes", "session_key", "upto").select("session_key", "bytes", "upto", (F.col("upto") > 100000).alias("truncated"))


# ---- exploration before the first change

_MUTATING = {c: m for c, m in zip(A.COMMANDS, (False, False, True, False, True, True, True, True), strict=True)}
_CALLS = f""",
flagged AS (SELECT *, CASE WHEN name IN ('Edit', 'Write') THEN true WHEN name = 'Shell' THEN command IN ({", ".join(f"'{c}'" for c, m in _MUTATING.items() if m)}) ELSE false END AS mutating FROM tool_calls),
bounds AS (SELECT session_key, min(harness) AS harness, min(project) AS project, count(*) AS calls, min(ord) FILTER (mutating) AS change, min(ord) FILTER (name = 'Grep') AS search FROM flagged GROUP BY 1),
prefixed AS (SELECT b.session_key, b.harness, b.project, b.calls, CASE WHEN b.change IS NOT NULL THEN b.change - 1 END AS prefix,
  coalesce(b.search < b.change AND (SELECT count(*) FROM flagged f WHERE f.session_key = b.session_key AND f.ord < b.change AND f.ord > b.search AND f.name = 'Read') >= 2, false) AS loop FROM bounds b)"""


@query(_CALLS + " SELECT session_key, ord, name, mutating FROM flagged")
def tool_mutation_flags(spark, d):
    return rediscovery.flagged(A.tool_calls(spark, d)).select("session_key", "ord", "name", "mutating")


@query(_CALLS + " SELECT session_key, calls, prefix, loop FROM prefixed")
def exploration_prefix(spark, d):
    return rediscovery.sessions_of(A.tool_calls(spark, d)).select("session_key", "calls", "prefix", "loop")


@query(_CALLS + " SELECT harness, count(*) AS sessions, count_if(loop)::BIGINT AS loops FROM prefixed GROUP BY 1")
def explore_loop(spark, d):
    return rediscovery.sessions_of(A.tool_calls(spark, d)).groupBy("harness").agg(F.count("*").alias("sessions"), F.count_if("loop").alias("loops"))


@query(_CALLS + """ SELECT count(*) AS sessions_with_tools, count(prefix) AS resolvable_sessions, count_if(prefix IS NULL)::BIGINT AS no_mutation_sessions, count(prefix) >= 5 AS sufficient,
  quantile_cont(prefix, 0.5)::DOUBLE AS median_prefix, round(quantile_cont(prefix, 0.9)::DOUBLE, 4) AS p90_prefix, round(100.0 * count_if(loop) / count(prefix), 4) AS pattern_pct, round(100.0 * sum(coalesce(prefix, calls)) / sum(calls), 4) AS explore_pct FROM prefixed""")  # fmt: skip
def rediscovery_summary(spark, d):
    s = rediscovery.summary(A.tool_calls(spark, d))
    return s.select("sessions_with_tools", "resolvable_sessions", "no_mutation_sessions", "sufficient", "median_prefix", _r("p90_prefix").alias("p90_prefix"), _r("pattern_pct").alias("pattern_pct"), _r("explore_pct").alias("explore_pct"))


@query(_CALLS + " SELECT path, count(DISTINCT f.session_key) AS sessions FROM flagged f JOIN bounds b ON b.session_key = f.session_key AND f.ord < b.change WHERE name = 'Read' GROUP BY path ORDER BY sessions DESC, path LIMIT 5")
def top_reread_files(spark, d):
    return rediscovery.reread_files(A.tool_calls(spark, d))


@query(_CALLS + " SELECT project, count(*) AS sessions, round_even(quantile_cont(prefix, 0.5), 0)::BIGINT AS median_prefix FROM prefixed WHERE prefix IS NOT NULL GROUP BY 1")
def project_prefix_median(spark, d):
    return rediscovery.by_project(A.tool_calls(spark, d))


_SOME_CALLS = ", partial_calls AS (SELECT * FROM tool_calls WHERE harness <> 'cursor')" + _USAGE


def _some_calls(spark, d):
    return A.tool_calls(spark, d).where("harness <> 'cursor'")


@query(_SOME_CALLS + " SELECT session_key, harness FROM usage WHERE harness IN (SELECT harness FROM partial_calls)")
def harness_semi(spark, d):
    return rediscovery.harnesses(_usage(spark, d), _some_calls(spark, d)).select("session_key", "harness")


@query(_SOME_CALLS + " SELECT session_key, harness FROM usage WHERE harness NOT IN (SELECT harness FROM partial_calls)")
def harness_anti(spark, d):
    return rediscovery.harnesses(_usage(spark, d), _some_calls(spark, d), without=True).select("session_key", "harness")


# ---- texts


def _intents(spark, d):
    r = A.requests(spark, d)
    return r.withColumn("normalized", T.normalize(F.col("raw_text")))


def _whole_intents(spark, d):
    """Asks that are compared by all of their text."""
    return A.requests(spark, d).withColumn("normalized", T.normalize(F.col("raw_text"), whole=True))


@query()
def substantive_filter(spark, d):
    c = A.turns(spark, d).where("role = 'user'")
    return c.select("session_key", "ord", T.is_substantive(F.col("text")).alias("substantive"), T.has_imperative(F.col("text")).alias("imperative"))


@query()
def first_ask_or_new_task(spark, d):
    t = A.turns(spark, d).where("role = 'user'").withColumn("query", T.unwrap(F.col("text"))["text"])
    t = t.withColumn("substantive", T.is_substantive(F.col("query"))).where("substantive")
    first = F.min("ord").over(Window.partitionBy("session_key"))
    return t.withColumn("first", first).where((F.col("ord") == F.col("first")) | T.is_new_task(F.col("query"))).select("session_key", "ord", T.normalize(F.col("query")).alias("normalized"))


_NORM_STEPS = (
    (r"\bcp-?\d+(?:\.\d+)?\b|\bcheckpoint\s+\d+(?:\.\d+)?\b", " <checkpoint> "), (r"https?://\S+|www\.\S+", " <url> "), (r"(^|[^A-Za-z0-9])(?:~/|/|[A-Za-z]:\\)[^\s''\"`]+", r"\1 "),
    (r"[^\s]+/[^\s]+", " <subpath> "), (r"\b(?:crates|packages|apps|internal|cmd|pkg|src)(?:/[A-Za-z0-9._-]+|\s+[A-Za-z0-9._-]*[./-][A-Za-z0-9._-]*)", " <subpath> "),
    (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", " <id> "), (r"(^|[^\pL\pN_])[0-9a-f]{7,40}($|[^\pL\pN_])", r"\1 <sha> \2"), (r'"(?:\\.|[^"\n])*"|' + r"''(?:\\.|[^''\n])*''", " <str> "),
    (r"(^|[^\pL\pN_])\d{3,}($|[^\pL\pN_])", r"\1 <num> \2"), (r"[^\pL\pN_\s<>]+", " "),
)


def _norm_sql() -> str:
    s = "lower(substr(raw_text, 1, 400))"
    for p, r in [x for step in _NORM_STEPS for x in [step] * (1 + (step[0].startswith("(^|[^\\pL")))]:  # twice where a match takes the separator of the next
        s = f"regexp_replace({s}, '{p}', '{r}', 'g')"
    stop = ", ".join(f"'{w}'" for w in V.STOPWORDS)
    return f"array_to_string(list_slice(list_filter(string_split(trim(regexp_replace({s}, '\\s+', ' ', 'g')), ' '), lambda t: t <> '' AND t NOT IN ({stop})), 1, 30), ' ')"


_NORM = f", intents AS (SELECT *, {_norm_sql()} AS normalized FROM requests)"
_FOLD = "CASE t " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in V.TOKEN_FOLD.items()) + " ELSE t END"
_FOLDED = _NORM + f""",
split AS (SELECT intent_ord, unnest(string_split(normalized, ' ')) AS t FROM intents WHERE normalized <> ''),
once AS (SELECT intent_ord, t, {_FOLD} AS f FROM split),
folded AS (SELECT intent_ord, CASE WHEN f = t AND length(t) > 4 AND ends_with(t, 's') AND NOT ends_with(t, 'ss') THEN (SELECT {_FOLD} FROM (SELECT substr(once.t, 1, length(once.t) - 1) AS t)) ELSE f END AS term FROM once)"""
_VECTORS = _FOLDED + """,
idf AS (SELECT term, count(DISTINCT intent_ord) AS df, ln((1.0 + (SELECT count(*) FROM intents)) / (1 + count(DISTINCT intent_ord))) + 1 AS idf FROM folded GROUP BY term),
tf AS (SELECT intent_ord, term, count(*) / (sum(count(*)) OVER (PARTITION BY intent_ord)) AS tf FROM folded GROUP BY 1, 2),
vec AS (SELECT intent_ord, tf.term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY intent_ord)) AS w FROM tf JOIN idf ON idf.term = tf.term),
grouped AS (SELECT intent_ord, min(intent_ord) OVER (PARTITION BY substr(raw_text, 1, 40)) AS cluster_id FROM intents)"""  # fmt: skip


def _grouped(spark, d):
    return A.requests(spark, d).select("intent_ord", F.min("intent_ord").over(Window.partitionBy(F.substring("raw_text", 1, 40))).alias("cluster_id"))


@query(_NORM + " SELECT intent_ord, normalized FROM intents")
def normalize_text(spark, d):
    return _intents(spark, d).select("intent_ord", "normalized")


@query(_FOLDED + " SELECT term, count(*) AS n FROM folded GROUP BY 1")
def token_fold(spark, d):
    return _intents(spark, d).select(F.explode(T.fold_tokens(F.col("normalized"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(_VECTORS + " SELECT term, df, round(idf, 6) AS idf FROM idf")
def doc_frequency_idf(spark, d):
    return cluster.idf(_intents(spark, d)).withColumn("idf", _r("idf", 6))


@query(_VECTORS + " SELECT intent_ord, term, round(w, 6) AS w FROM vec")
def tfidf_vectors(spark, d):
    return cluster.vectors(_intents(spark, d)).withColumn("w", _r("w", 6))


@query(_VECTORS + " SELECT g.cluster_id, a.intent_ord AS a, b.intent_ord AS b, round(sum(a.w * b.w), 6) AS cosine FROM vec a JOIN vec b ON a.term = b.term AND a.intent_ord < b.intent_ord JOIN grouped g ON g.intent_ord = a.intent_ord JOIN grouped h ON h.intent_ord = b.intent_ord AND h.cluster_id = g.cluster_id GROUP BY 1, 2, 3")
def pairwise_cosine(spark, d):
    return cluster.pairwise_cosine(cluster.vectors(_intents(spark, d)), _grouped(spark, d)).withColumn("cosine", _r("cosine", 6))


@query(_VECTORS + """, pairs AS (SELECT g.cluster_id, sum(a.w * b.w) AS s FROM vec a JOIN vec b ON a.term = b.term AND a.intent_ord < b.intent_ord JOIN grouped g ON g.intent_ord = a.intent_ord JOIN grouped h ON h.intent_ord = b.intent_ord AND h.cluster_id = g.cluster_id GROUP BY 1),
sizes AS (SELECT cluster_id, count(*) AS n FROM grouped GROUP BY 1)
SELECT s.cluster_id, n, CASE WHEN n <= 1 THEN 1.0::DOUBLE ELSE round(coalesce(p.s, 0) / (n * (n - 1) / 2), 4) END AS cohesion FROM sizes s LEFT JOIN pairs p ON p.cluster_id = s.cluster_id""")  # fmt: skip
def group_cohesion(spark, d):
    return cluster.cohesion(cluster.vectors(_intents(spark, d)), _grouped(spark, d)).withColumn("cohesion", _r("cohesion"))


@query(_VECTORS + """, sums AS (SELECT cluster_id, term, sum(w) AS s FROM vec JOIN grouped USING (intent_ord) GROUP BY 1, 2),
scores AS (SELECT g.cluster_id, g.intent_ord, round(coalesce(sum(v.w * (s.s - v.w)), 0), 9) AS score FROM grouped g LEFT JOIN vec v USING (intent_ord) LEFT JOIN sums s ON s.cluster_id = g.cluster_id AND s.term = v.term GROUP BY 1, 2)
SELECT cluster_id, arg_min(intent_ord, (-score, intent_ord)) AS intent_ord FROM scores GROUP BY 1""")  # fmt: skip
def group_medoid(spark, d):
    return cluster.medoid(cluster.vectors(_intents(spark, d)), _grouped(spark, d)).select("cluster_id", "intent_ord")


@query()
def cluster_intents(spark, d):
    return cluster.assign(_whole_intents(spark, d))


@query()
def cluster_precision_filter(spark, d):
    i = _whole_intents(spark, d).withColumn("ts", F.lit(None).cast("string"))
    v = checkpoint(cluster.vectors(i))
    return cluster.clusters(i, checkpoint(cluster.assign(i, v)), v, min_runs=2)


@query(", hits AS (SELECT intent_ord, trim(regexp_replace(regexp_replace(raw_text, '\\b[A-Za-z0-9+/]{40,}={0,2}\\b', '<redacted>', 'g'), '\\s+', ' ', 'g')) AS t FROM requests) SELECT intent_ord, CASE WHEN length(t) > 120 THEN rtrim(substr(t, 1, 119)) || '…' ELSE t END AS shown FROM hits")
def redact_text(spark, d):
    return A.requests(spark, d).select("intent_ord", T.redact(F.col("raw_text")).alias("shown"))


@query()
def label_score(spark, d):
    return A.requests(spark, d).select("intent_ord", _r(T.label_score(F.col("raw_text")), 1).alias("score"), T.clean_label(F.col("raw_text")).alias("label"))


# ---- ranking, over clusters of sessions that share a project and a model


_CLUSTERS = _COSTED + """,
members AS (SELECT dense_rank() OVER (ORDER BY project, coalesce(model, '')) AS cluster_id, session_key, session_id, project, ended_at AS ts, turn_count AS session_turn_count, split_part(session_key, '-', 2)::BIGINT AS intent_ord, basis, priced, model_key, billed_input, billed_output, billed_cache, round(usd, 6) AS usd FROM costed),
ccost AS (SELECT cluster_id, sum(billed_input)::BIGINT AS input_tokens, sum(billed_output)::BIGINT AS output_tokens, sum(billed_cache)::BIGINT AS cache_read_tokens, sum(usd) AS usd,
  CASE max(CASE basis WHEN 'measured' THEN 1 WHEN 'estimated' THEN 2 ELSE 3 END) WHEN 1 THEN 'measured' WHEN 2 THEN 'estimated' ELSE 'unknown' END AS basis,
  CASE WHEN bool_or(model_key = 'default') THEN 'default' WHEN count(DISTINCT model_key) = 1 THEN min(model_key) ELSE 'mixed' END AS price_model, bool_and(priced) AS priced FROM members GROUP BY 1),
cfacts AS (SELECT cluster_id, count(*) AS run_count, count(DISTINCT session_id) AS distinct_sessions, min(ts) AS first_seen, max(ts) AS last_seen, var_pop(session_turn_count) AS turn_variance, min(project) AS project FROM members GROUP BY 1)"""  # fmt: skip


def _members(spark, d):
    c = _costed(spark, d).withColumn("kind", F.coalesce("model", F.lit("")))
    kinds = c.select("project", "kind").distinct()  # a few rows, which are numbered
    numbered = kinds.withColumn("cluster_id", F.dense_rank().over(Window.orderBy("project", "kind")).cast("long"))
    return c.join(numbered, ["project", "kind"]).select(
        "cluster_id", "session_key", "session_id", "project", F.col("ended_at").alias("ts"), F.col("turn_count").alias("session_turn_count"),
        F.substring_index("session_key", "-", -1).cast("long").alias("intent_ord"),
    )


def _cluster_costs(spark, d):
    return cost.cluster_cost(_members(spark, d), _costed(spark, d))


def _facts(m):
    return m.groupBy("cluster_id").agg(
        F.count("*").alias("run_count"), F.count_distinct("session_id").alias("distinct_sessions"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.sort_array(F.collect_set("project")).alias("projects")
    )


@query(_CLUSTERS + " SELECT cluster_id, input_tokens, output_tokens, cache_read_tokens, round(usd, 4) AS usd, basis, price_model, priced FROM ccost")
def cluster_cost(spark, d):
    return _cluster_costs(spark, d).withColumn("usd", _r("usd"))


@query(_CLUSTERS + """, mag AS (SELECT *, CASE WHEN usd > 0 THEN usd ELSE (input_tokens + output_tokens + cache_read_tokens)::DOUBLE END AS m FROM ccost JOIN cfacts USING (cluster_id)),
top AS (SELECT max(ln(distinct_sessions)) AS ms, max(ln(m + 1)) AS mm, max(turn_variance) AS mv FROM mag),
part AS (SELECT cluster_id, distinct_sessions, run_count, least(1, greatest(0, ln(distinct_sessions) / CASE WHEN ms > 0 THEN ms ELSE 1 END)) AS f, least(1, greatest(0, ln(m + 1) / CASE WHEN mm > 0 THEN mm ELSE 1 END)) AS c,
  CASE WHEN mv > 0 THEN least(1, greatest(0, 1 - turn_variance / mv)) ELSE 1 END AS s, CASE WHEN epoch(TIMESTAMP '2026-09-03 18:00:00' - strptime(last_seen, '%Y-%m-%dT%H:%M:%S')) / 86400 > 7 THEN 0.5 ELSE 1 END AS decay FROM mag, top)
SELECT cluster_id, distinct_sessions, run_count, round(f, 4) AS frequency, round(c, 4) AS cost_score, round(s, 4) AS stability, round(f * c * s * decay, 4) AS score FROM part""")  # fmt: skip
def candidate_scores(spark, d):
    m = _members(spark, d)
    s = rank.score(_facts(m), _cluster_costs(spark, d), rank.turn_variance(m), NOW)
    return s.select("cluster_id", "distinct_sessions", "run_count", *[_r(c).alias(c) for c in ("frequency", "cost_score", "stability", "score")])


@query(""", asks AS (SELECT project AS cluster_id, conv_ord AS intent_ord, session_id, ts, trim(text) AS text FROM (SELECT *, split_part(session_key, '-', 2)::BIGINT * 1000000 + ord AS conv_ord FROM turns WHERE role = 'user')),
one AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, text ORDER BY ts DESC, intent_ord) AS n FROM asks),
placed AS (SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY ts DESC, intent_ord) AS place, intent_ord, session_id, ts, text FROM one WHERE n = 1)
SELECT * FROM placed WHERE place <= 3""")
def evidence_topk(spark, d):
    t = A.turns(spark, d).where("role = 'user'")
    place = F.substring_index("session_key", "-", -1).cast("long") * 1000000 + F.col("ord")
    asks = t.select(F.col("project").alias("cluster_id"), place.alias("intent_ord"), "session_id", "ts", F.col("text").alias("raw_text"))
    return rank.evidence(asks).withColumn("place", F.col("place").cast("long"))


@query(_CLUSTERS + " SELECT project, round(sum(usd), 3) AS usd, sum(run_count)::BIGINT AS run_count, count(*) AS clusters FROM cfacts JOIN ccost USING (cluster_id) GROUP BY 1")
def project_rollup_explode(spark, d):
    return rank.project_rollups(_facts(_members(spark, d)), _cluster_costs(spark, d)).withColumn("usd", _r("usd", 3))


# ---- records, procedures and verdicts


def _turn_records(spark, d):
    """Turns as the JSON records of a harness, to be read back."""
    usage = F.struct("input_tokens", "output_tokens", F.col("cache_read_tokens").alias("cache_read_input_tokens"))
    message = F.struct("role", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content"), usage.alias("usage"))
    line = F.to_json(F.struct(F.col("session_id").alias("sessionId"), F.concat(F.lit("/home/dev/"), "project").alias("cwd"), F.col("ts").alias("timestamp"), "model", message.alias("message")))
    return records.records(A.turns(spark, d).select("session_key", F.col("ord").cast("long").alias("ord"), line.alias("line")))


def _call_records(spark, d):
    given = F.struct("path", "command")
    block = F.struct(F.lit("tool_use").alias("type"), "name", given.alias("input"))
    line = F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(F.array(block).alias("content")).alias("message")))
    return records.records(A.tool_calls(spark, d).select("session_key", "ord", line.alias("line")))


_SAID = r", said AS (SELECT * REPLACE (regexp_replace(text, '^\s+|\s+$', '', 'g') AS text) FROM turns WHERE regexp_matches(text, '\S'))"


@query(_SAID + """ SELECT session_key, ord::BIGINT AS ord, role, text, ts, input_tokens, output_tokens, cache_read_tokens,
  last_value(model IGNORE NULLS) OVER (PARTITION BY session_key ORDER BY ord ROWS UNBOUNDED PRECEDING) AS model FROM said""")  # fmt: skip
def record_turns(spark, d):
    return records.turns(_turn_records(spark, d))


@query(_SAID + """ SELECT session_key, min(session_id) AS session_id, min(project) AS project, arg_min(ts, ord) AS started_at, arg_max(ts, ord) AS ended_at, count(*) AS turn_count,
  0::BIGINT AS malformed, 'ok' AS parse_status FROM said GROUP BY session_key""")  # fmt: skip
def record_sessions(spark, d):
    r = _turn_records(spark, d)
    return records.sessions(r, records.turns(r))


@query(" SELECT session_key, ord, name, path, command FROM tool_calls")
def record_tool_calls(spark, d):
    return records.tool_calls(_call_records(spark, d)).select("session_key", "ord", "name", "path", "command")


@query(""", keyed AS (SELECT project AS cluster_id, session_key, ord, name, name || '|' || CASE WHEN command IS NOT NULL THEN 'command' WHEN path IS NOT NULL THEN 'path' ELSE '' END AS step FROM tool_calls),
runs AS (SELECT cluster_id, session_key, count(*) AS calls FROM keyed GROUP BY ALL),
totals AS (SELECT cluster_id, count(*) AS n, sum(calls) AS total FROM runs GROUP BY 1 HAVING count(*) >= 2 AND sum(calls) >= 3),
placed AS (SELECT cluster_id, step, min(name) AS name, count(DISTINCT session_key) AS sessions, min(row(-calls, session_key, ord)) AS first FROM keyed JOIN runs USING (cluster_id, session_key) GROUP BY 1, 2),
kinds AS (SELECT *, CASE WHEN sessions >= greatest(2, (n + 1) // 2) THEN 'common' ELSE 'varied' END AS kind FROM placed JOIN totals USING (cluster_id)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, kind ORDER BY first) AS place FROM kinds)
SELECT cluster_id, kind, place, step, name, sessions FROM ordered WHERE place <= CASE kind WHEN 'common' THEN 40 ELSE 20 END""")  # fmt: skip
def procedure_steps(spark, d):
    calls = A.tool_calls(spark, d).select(F.col("project").alias("cluster_id"), "session_key", "ord", "name", F.to_json(F.struct("path", "command")).alias("input"))
    return suggest.procedures(suggest.steps(calls)).select("cluster_id", "kind", F.col("place").cast("long").alias("place"), "step", "name", "sessions")


@query()
def ask_slots(spark, d):
    asks = _grouped(spark, d).join(A.requests(spark, d), "intent_ord").select("cluster_id", F.col("intent_ord").alias("member"), F.col("raw_text").alias("text"))
    return suggest.slots(suggest.columns(asks))


@query(_CLUSTERS + f""", top AS (SELECT max(turn_variance) AS mv FROM cfacts)
SELECT cluster_id, CASE WHEN s >= 0.85 THEN '{verdict.STABILITY[0][1]}' WHEN s >= 0.5 THEN '{verdict.STABILITY[1][1]}' ELSE '{verdict.UNSTABLE}' END AS sentence
FROM (SELECT cluster_id, round(CASE WHEN mv > 0 THEN least(1, greatest(0, 1 - turn_variance / mv)) ELSE 1 END, 6) AS s FROM cfacts, top)""")  # fmt: skip
def stability_bands(spark, d):
    m = _members(spark, d)
    s = rank.score(_facts(m), _cluster_costs(spark, d), rank.turn_variance(m), NOW)
    return s.select("cluster_id", verdict.stability_sentence(F.col("stability")).alias("sentence"))


@query(_SAID + f""", facts AS (SELECT harness, count(DISTINCT session_key) AS sessions, count_if(length(text) > 2000)::BIGINT AS malformed FROM said GROUP BY 1)
SELECT harness, sessions, malformed, CASE WHEN harness = 'cursor' THEN '{verdict.NO_HISTORY}' WHEN malformed > 0 THEN '{verdict.PARTIAL}' WHEN sessions < 20 THEN '{verdict.INSUFFICIENT}'
  WHEN sessions % 2 > 0 THEN '{verdict.REPEATED}' ELSE '{verdict.NULL}' END AS verdict FROM facts""")  # fmt: skip
def scan_verdict(spark, d):
    """A verdict a harness, as if each were a scan: long turns count as malformed lines, an odd number of sessions as a candidate."""
    t = A.turns(spark, d).where(F.col("text").rlike(r"\S")).groupBy("harness").agg(F.count_distinct("session_key").alias("sessions"), F.count_if(F.length(T.strip(F.col("text"))) > 2000).alias("malformed"))
    status = F.array(F.when(F.col("harness") == "cursor", "absent").otherwise("found"))
    return t.withColumn("verdict", verdict.verdict(status, F.col("sessions"), F.lit(20), F.col("sessions") % 2, F.lit(0), F.col("malformed"), F.lit(False), F.lit(False)))
