"""JSON records of session files to turns, tool calls and sessions.

A column of a record is the first path that holds anything, whatever its type; only then is the type looked at. All of
it is expressions over VARIANT. Messages nest to TEXT_DEPTH objects and tool blocks to TOOL_DEPTH levels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

TEXT_DEPTH = 3  #: objects within objects that a text is looked for in
TOOL_DEPTH = 8  #: levels of objects and lists that tool blocks are looked for in

# Paths of each column in order of preference, and the names of roles, texts and tool blocks.
SESSION_ID = ("sessionId", "session_id", "id", "payload.id", "payload.session_id")
PROJECT = ("cwd", "project", "project_path", "payload.cwd", "payload.project")
TIMESTAMP = ("timestamp", "time", "created_at", "payload.timestamp", "payload.created_at")
MODEL = ("model", "message.model", "payload.model", "usage.model")
ROLE = ("role", "message.role", "payload.role", "payload.message.role")
TYPE = ("type", "payload.type", "payload.msg_type")
TEXT = ("text", "content", "message", "message.content", "message.text", "payload.text", "payload.message", "payload.content", "payload.message.content")
USAGE = ("usage", "message.usage", "payload.usage")
INPUT = ("input_tokens", "inputTokens", "prompt_tokens", "promptTokens")
OUTPUT = ("output_tokens", "outputTokens", "completion_tokens", "completionTokens")
CACHE = (
    "usage.cache_read_input_tokens", "usage.cache_read_tokens", "usage.cacheReadInputTokens", "usage.cacheReadTokens",
    "message.usage.cache_read_input_tokens", "message.usage.cache_read_tokens", "message.usage.cacheReadInputTokens",
    "payload.usage.cache_read_input_tokens", "payload.usage.cacheReadInputTokens", "cache_read_tokens", "cacheReadInputTokens",
)
USER = ("user", "human")
ASSISTANT = ("assistant", "model", "bot")
USER_TYPES = ("user", "human", "user_message")
ASSISTANT_TYPES = ("assistant", "agent", "agent_message", "assistant_message")
EVENT_USER, EVENT_ASSISTANT = ("user_message", "user"), ("agent_message", "assistant_message")
TEXT_BLOCKS = ("text", "output_text", "input_text", "message")
TOOL_BLOCKS = ("tool_use", "function_call", "tool_call")
TOOL_PATHS = ("path", "file_path", "target_file", "target_directory")
NO_FOLDER = ("sessions", "history", "projects")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value written, and computed, once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def at(v: Column, path: str) -> Column:
    """What v holds at a dotted path; null where there is nothing or JSON's null."""
    return let(F.try_variant_get(v, "$." + path, "variant"), lambda x: F.when(~F.is_variant_null(x), x))


def first_of(v: Column, paths) -> Column:
    found = F.array(*[F.try_variant_get(v, "$." + p, "variant") for p in paths])
    return F.get(F.filter(found, lambda x: x.isNotNull() & ~F.is_variant_null(x)), F.lit(0))


def kind(x: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, BIGINT, DOUBLE, DECIMAL; null for null."""
    return F.regexp_extract(F.schema_of_variant(x), "^[A-Z]+", 0)


def string(x: Column) -> Column:
    """The value if it's a string."""
    return let(x, lambda y: F.when(kind(y) == "STRING", F.try_variant_get(y, "$", "string")))


def integer(x: Column) -> Column:
    """Whole numbers, fractions cut, and strings that spell a whole number; no booleans."""

    def one(y: Column) -> Column:
        spelled = F.regexp_extract(F.try_variant_get(y, "$", "string"), r"^\s*([+-]?\d+(?:_\d+)*)\s*$", 1)
        as_text = F.replace(spelled, F.lit("_"), F.lit("")).try_cast("long")
        exact, cut = F.try_variant_get(y, "$", "long"), F.try_variant_get(y, "$", "double").try_cast("long")
        return F.when(kind(y) == "STRING", as_text).when(kind(y) == "BIGINT", exact).when(kind(y).isin("DOUBLE", "DECIMAL"), cut)

    return let(x, one)


def moment(x: Column) -> Column:
    """ISO text: strings as they are, numbers as seconds or, above 1e12, as milliseconds of UTC; anything else as its JSON."""

    def one(y: Column) -> Column:
        return F.when(kind(y) == "STRING", F.try_variant_get(y, "$", "string")).when(kind(y).isin("BIGINT", "DOUBLE", "DECIMAL"), let(F.try_variant_get(y, "$", "double"), _clock)).when(y.isNotNull(), F.to_json(y))

    return let(x, one)


def _clock(n: Column) -> Column:
    def text(micros: Column) -> Column:
        wall = F.date_format(F.to_utc_timestamp(F.timestamp_micros(micros), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
        part = F.pmod(micros, F.lit(1000000))
        return F.concat(wall, F.when(part == 0, "").otherwise(F.format_string(".%06d", part)), F.lit("+00:00"))

    return let(F.bround(F.when(n > 1e12, n / 1000).otherwise(n) * 1e6).try_cast("long"), text)


def role(v: Column) -> Column:
    """user or assistant, by the role that a record names, else by its type; null for others."""
    said, kind_of, nested = F.lower(string(first_of(v, ROLE))), F.lower(string(first_of(v, TYPE))), F.lower(string(at(v, "payload.type")))

    def one(s: Column) -> Column:
        event = F.when(s["kind"] == "event_msg", s["nested"])
        return (
            F.when(s["said"].isin(*USER), "user").when(s["said"].isin(*ASSISTANT), "assistant").when(event.isin(*EVENT_USER), "user").when(event.isin(*EVENT_ASSISTANT), "assistant")
            .when(s["kind"].isin(*USER_TYPES), "user").when(s["kind"].isin(*ASSISTANT_TYPES), "assistant")
        )

    return let(F.struct(said.alias("said"), kind_of.alias("kind"), nested.alias("nested")), one)


def _block(b: Column) -> Column:
    """Text of one member of a list of blocks; null if it has none."""
    named, piece = string(at(b, "type")), string(first_of(b, ("text", "content", "value")))
    fits = at(b, "type").isNull() | F.coalesce(named.isin(*TEXT_BLOCKS), F.lit(False))
    return F.when(kind(b) == "STRING", F.try_variant_get(b, "$", "string")).when((kind(b) == "OBJECT") & fits, F.nullif(piece, F.lit("")))


def flat_text(x: Column) -> Column:
    """Text of a string, a list of strings and blocks, or an object around either; null if there is none."""
    for _ in range(TEXT_DEPTH):
        x = let(x, lambda y: F.when(kind(y) == "OBJECT", first_of(y, ("content", "text", "message"))).otherwise(y))

    def one(y: Column) -> Column:
        parts = F.filter(F.transform(F.try_variant_get(y, "$", "array<variant>"), _block), lambda p: p.isNotNull())
        joined = let(parts, lambda p: F.when(F.size(p) > 0, F.array_join(p, "\n")))
        return F.when(kind(y) == "STRING", F.try_variant_get(y, "$", "string")).when(kind(y) == "ARRAY", joined)

    return let(x, one)


def text_of(v: Column) -> Column:
    """The first of the texts at the paths of TEXT; the empty text counts."""
    found = F.transform(F.array(*[F.try_variant_get(v, "$." + p, "variant") for p in TEXT]), flat_text)
    return F.get(F.filter(found, lambda t: t.isNotNull()), F.lit(0))


def _tokens(v: Column, names) -> Column:
    return integer(first_of(v, [*[f"{u}.{n}" for u in USAGE for n in names], *names[:2]]))


def records(lines: DataFrame) -> DataFrame:
    """session_key, ord, line, v of the lines that aren't blank; v is null where the line is no JSON object."""
    said = lines.select("session_key", "ord", T.strip(F.col("line")).alias("line")).where("line <> ''")
    parsed = said.withColumn("v", F.try_parse_json("line"))
    return parsed.withColumn("v", F.when(F.substring("line", 1, 1) == "{", F.col("v")))


def turns(recs: DataFrame) -> DataFrame:
    """session_key, ord, role, text, ts, token counts and model: one row a message of a user or an assistant that has text."""
    v = F.col("v")
    t = recs.where("v IS NOT NULL").select("session_key", "ord", "v", role(v).alias("role")).where("role IS NOT NULL")
    t = t.withColumn("raw", text_of(v)).where(T.strip(F.col("raw")) != "").withColumn("said", T.unwrap(F.col("raw"))).where("said.text <> ''")
    named = string(first_of(v, MODEL))
    out = t.select(
        "session_key", "ord", "role", F.col("said.text").alias("text"), F.coalesce("said.ts", moment(first_of(v, TIMESTAMP))).alias("ts"),
        _tokens(v, INPUT).alias("input_tokens"), _tokens(v, OUTPUT).alias("output_tokens"), integer(first_of(v, CACHE)).alias("cache_read_tokens"),
        F.when(named != "", named).alias("model"),
    )
    before = Window.partitionBy("session_key").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("model", F.last("model", ignorenulls=True).over(before))


def tool_blocks(recs: DataFrame) -> DataFrame:
    """session_key, ord, place, b: each tool block, also those within others. place: the positions that lead to it. Levels are walked within a row."""

    def inner(x: Column) -> Column:
        members = F.when(kind(x["b"]) == "OBJECT", F.map_values(F.try_variant_get(x["b"], "$", "map<string, variant>"))).otherwise(F.try_variant_get(x["b"], "$", "array<variant>"))
        placed = F.transform(members, lambda m, i: F.struct(F.concat(x["place"], F.array(i)).alias("place"), m.alias("b")))
        return F.filter(placed, lambda m: kind(m["b"]).isin("OBJECT", "ARRAY"))

    def deeper(state: Column, _: Column) -> Column:
        return let(F.flatten(F.transform(state["level"], inner)), lambda n: F.struct(F.concat(state["every"], n).alias("every"), n.alias("level")))

    some = F.lit(False)
    for name in TOOL_BLOCKS:
        some = some | F.col("line").contains(name)
    top = F.array(F.struct(F.array().cast("array<int>").alias("place"), F.col("v").alias("b")))
    every = F.aggregate(F.sequence(F.lit(1), F.lit(TOOL_DEPTH)), F.struct(top.alias("every"), top.alias("level")), deeper, lambda s: s["every"])
    found = F.filter(every, lambda x: (kind(x["b"]) == "OBJECT") & string(at(x["b"], "type")).isin(*TOOL_BLOCKS))
    return recs.where(some & F.col("v").isNotNull()).select("session_key", "ord", F.inline(found))


def _truthy(x: Column) -> Column:
    """x unless it's an empty string, zero, false or an empty list or object."""
    return let(x, lambda y: F.when(~F.to_json(y).isin('""', "0", "0.0", "false", "[]", "{}"), y))


def tool_calls(recs: DataFrame) -> DataFrame:
    """session_key, ord (from 1 along a session), name, path, command, input (JSON text) of each tool block."""
    b = F.col("b")
    name = F.coalesce(*[_truthy(at(b, k)) for k in ("name", "tool", "call")])
    held = let(F.coalesce(_truthy(at(b, "input")), _truthy(at(b, "arguments"))), lambda g: F.when(kind(g) == "OBJECT", g))
    given = F.col("given")
    path = F.coalesce(*[F.when(T.strip(string(at(given, k))) != "", T.strip(string(at(given, k)))) for k in TOOL_PATHS])
    along = Window.partitionBy("session_key").orderBy("ord", "place")
    return tool_blocks(recs).select("session_key", "ord", "place", name.alias("name"), held.alias("given")).select(
        "session_key", F.row_number().over(along).cast("long").alias("ord"), F.coalesce(F.try_variant_get("name", "$", "string"), F.lit("tool")).alias("name"),
        path.alias("path"), string(at(given, "command")).alias("command"), F.to_json(given).alias("input"),
    )


def project_of(named: Column, path: Column) -> Column:
    """The last part of a working folder, else a label made from the session file's own path."""
    base = F.regexp_extract(F.regexp_replace(named, "/+$", ""), "([^/]*)$", 1)
    folder = F.regexp_extract(path, "(?:^|/)projects/([^/]+)", 1)
    encoded = F.regexp_extract(F.regexp_replace(folder, "^-+|-+$", ""), "([^-]*)$", 1)
    parent = F.regexp_extract(path, "([^/]+)/[^/]+$", 1)
    derived = F.when(folder != "", F.when(encoded != "", encoded).otherwise(folder)).when((parent != "") & ~parent.isin(*NO_FOLDER), parent)
    return F.when(named != "", F.when(base != "", base).otherwise(named)).otherwise(F.coalesce(derived, F.lit("unknown")))


def sessions(recs: DataFrame, turns_: DataFrame, harness: Column | None = None) -> DataFrame:
    """session_key, session_id, project, started_at, ended_at, turn_count, malformed, parse_status of files that have a turn.

    The first record of a file that names an id or a project decides, whether it's a turn or not.
    """
    ident, where = string(first_of(F.col("v"), SESSION_ID)), string(first_of(F.col("v"), PROJECT))
    facts = recs.select("session_key", "ord", F.when(ident != "", ident).alias("id"), F.when(where != "", where).alias("cwd"), F.col("v").isNull().alias("bad"))
    facts = facts.groupBy("session_key").agg(
        F.min_by("id", F.when(F.col("id").isNotNull(), F.col("ord"))).alias("id"), F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("ord"))).alias("cwd"), F.count_if("bad").alias("malformed"),
    )
    dated = F.when(F.col("ts") != "", F.col("ord"))
    spans = turns_.groupBy("session_key").agg(F.min_by("ts", dated).alias("started_at"), F.max_by("ts", dated).alias("ended_at"), F.count("*").alias("turn_count"))
    stem = F.regexp_replace(F.regexp_extract("session_key", "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return facts.join(spans, "session_key").select(
        "session_key", F.coalesce("id", stem).alias("session_id"), project_of(F.col("cwd"), F.col("session_key")).alias("project"), "started_at", "ended_at", "turn_count", "malformed",
        F.when(F.col("malformed") > 0, F.format_string("partial: %d malformed line(s)", "malformed")).otherwise("ok").alias("parse_status"),
    )


def metrics(recs: DataFrame, turns_: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: files_read, sessions, malformed_lines, turns, tool_calls."""
    r = recs.agg(F.count_distinct("session_key").alias("files_read"), F.count_if(F.col("v").isNull()).alias("malformed_lines"))
    t = turns_.agg(F.count_distinct("session_key").alias("sessions"), F.count("*").alias("turns"))
    return r.join(t).join(calls.agg(F.count("*").alias("tool_calls")))
