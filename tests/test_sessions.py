import json
import os

import pytest

from reprise.sources import records as R
from reprise.sources import sessions as S

NESTED = {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "a"}, {"type": "image", "text": "no"}, "b"], "usage": {"prompt_tokens": "7", "completion_tokens": 2.9}}}
LINES = [
    {"type": "system", "sessionId": "s-1", "cwd": "/home/dev/acme-api/", "content": "hello"},
    {"type": "user", "timestamp": 1756900000, "message": {"role": "user", "content": [{"type": "text", "text": "  fix it "}]}},
    "{not json",
    {"role": "Assistant", "text": "done", "timestamp": "2026-09-01T00:00:00Z", "model": "o3", "usage": {"input_tokens": True, "output_tokens": 3, "cache_read_input_tokens": 4}},
    "[1, 2]",
    NESTED,
    {"role": "assistant", "message": {"content": [{"type": "tool_use", "name": "Grep", "input": {"pattern": "x"}}, {"type": "tool_use", "name": "Read", "input": {"file_path": " /a/b.py "}}]}},
    {"type": "function_call", "tool": "Shell", "arguments": {"command": "ls", "path": " "}},
    {"type": "event_msg", "payload": {"type": "user_message", "message": "<timestamp>Friday, Sep 4, 2026, 1:33 AM (UTC-4)</timestamp>\n<user_query>again</user_query>", "extra": None}},
    {"role": "user", "text": None, "content": "   "},
    "",
]


@pytest.fixture(scope="module")
def recs(spark):
    rows = [("/h/.codex/sessions/day/one.jsonl", i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(LINES)]
    rows += [("/h/.claude/projects/-home-dev-demo/two.jsonl", 0, '{"role": "user", "text": "hi"}'), ("/h/.claude/projects/-x/none.jsonl", 0, '{"a": 1}')]
    return R.records(spark.createDataFrame(rows, "session_key string, ord long, line string")).cache()


def test_turns(recs):
    got = [tuple(r)[2:] for r in R.turns(recs).where("session_key LIKE '%one%'").orderBy("ord").collect()]
    assert got == [
        ("user", "fix it", "2025-09-03T11:46:40+00:00", None, None, None, None),
        ("assistant", "done", "2026-09-01T00:00:00Z", None, 3, 4, "o3"),
        ("assistant", "a\nb", None, 7, 2, None, "o3"),
        ("user", "again", "2026-09-04T01:33:00-04:00", None, None, None, "o3"),
    ]


def test_tool_calls(recs):
    got = [tuple(r)[1:5] for r in R.tool_calls(recs).orderBy("session_key", "ord").collect()]
    assert got == [(1, "Grep", None, None), (2, "Read", "/a/b.py", None), (3, "Shell", None, "ls")]


def test_sessions(recs):
    t = R.turns(recs)
    got = {r.session_id: r for r in R.sessions(recs, t).collect()}
    assert set(got) == {"s-1", "two"}  # a file without turns is no session
    one = got["s-1"]
    assert (one.project, one.started_at, one.ended_at, one.turn_count, one.parse_status) == ("acme-api", "2025-09-03T11:46:40+00:00", "2026-09-04T01:33:00-04:00", 4, "partial: 2 malformed line(s)")
    assert (got["two"].project, got["two"].parse_status, got["two"].started_at) == ("demo", "ok", None)
    m = R.metrics(recs, t, R.tool_calls(recs)).first()
    assert (m.files_read, m.malformed_lines, m.sessions, m.turns, m.tool_calls) == (3, 2, 2, 5, 3)


def test_no_records(spark):
    none = R.records(spark.createDataFrame([], "session_key string, ord long, line string"))
    t = R.turns(none)
    assert t.count() == 0 and R.sessions(none, t).count() == 0 and R.metrics(none, t, R.tool_calls(none)).first().files_read == 0


def test_discovery_and_lines(spark, tmp_path):
    home = tmp_path / "home"
    claude, cursor = home / ".claude/projects/-home-dev-demo", home / ".cursor/projects/home-u-projects-Demo-App/agent-transcripts/sub"
    for d in (claude, cursor, home / ".codex"):
        d.mkdir(parents=True)
    (home / ".codex/sessions").write_text("a file")
    (claude / "a+b c[1].jsonl").write_bytes(b'{"n": 1}\r\n\xff\n{"n": 3}\n')
    (claude / "_hidden.jsonl").write_text("x\ny")
    (claude / "notes.txt").write_text("no")
    (claude / "old.jsonl").write_text("old")
    os.utime(claude / "old.jsonl", (1, 1))
    (tmp_path / "away.jsonl").write_text("away")
    (claude / "link.jsonl").symlink_to(tmp_path / "away.jsonl")
    (cursor / "child.jsonl").write_text("z\n")
    found = S.discover(spark, str(home))
    files = {os.path.basename(r.path): r for r in found.files.collect()}
    assert set(files) == {"a+b c[1].jsonl", "_hidden.jsonl", "child.jsonl"} and files["child.jsonl"].project == "Demo-App"
    assert [(os.path.basename(r.path), r.reason) for r in found.skipped.collect()] == [("link.jsonl", S.OUTSIDE)]
    status = {r.harness: r.status for r in found.sources.collect()}
    assert status["claude_code"] == status["cursor"] == "found" and status["codex"].startswith("unreadable: not a directory")
    assert {r.harness: (r.files, r.size) for r in S.inventory(found).collect()} == {"claude_code": (2, "24 B"), "codex": (0, "0 B"), "cursor": (1, "2 B")}
    got = sorted((os.path.basename(r.session_key), r.ord, r.line) for r in S.lines(spark, found.files).collect())
    assert got == [("_hidden.jsonl", 0, "x"), ("_hidden.jsonl", 1, "y"), ("a+b c[1].jsonl", 0, '{"n": 1}'), ("a+b c[1].jsonl", 1, "�"), ("a+b c[1].jsonl", 2, '{"n": 3}'), ("child.jsonl", 0, "z")]
    assert {r.session_key for r in S.lines(spark, found.files).collect()} == {r.path for r in found.files.collect()}
    cut = {os.path.basename(r.path): r.truncated for r in S.within_budget(found.files, 5).collect()}
    assert cut == {"child.jsonl": False, "_hidden.jsonl": False, "a+b c[1].jsonl": True}


def test_nothing_to_discover(spark, tmp_path):
    found = S.discover(spark, str(tmp_path), harnesses=("codex", "other"))
    assert {tuple(r) for r in found.sources.collect()} == {("codex", "absent"), ("other", "absent")}
    assert S.lines(spark, found.files).count() == 0


def test_tool_blocks_are_found_in_one_reading(spark):
    leaf = {"type": "tool_use", "name": "Deep", "input": {"path": " /d "}}
    block = {"type": "function_call", "tool": "Outer", "arguments": {"command": "ls", "more": [1, None, leaf]}}
    lines = [json.dumps({"message": {"content": ["text", {"z": block}, {"type": "tool_call", "input": []}]}}), '{"type": "tool_use"}', "[1]", '{"a": null, "b": "tool_use"}']
    recs = R.records(spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "session_key string, ord long, line string"))
    found = R.tool_calls(recs)
    assert [(r.ord, r.name, r.path, r.command) for r in found.orderBy("ord").collect()] == [(1, "Outer", None, "ls"), (2, "Deep", "/d", None), (3, "tool", None, None), (4, "tool", None, None)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") + plan.count("ExistingRDD") == 1
