import json

import pytest

from reprise.__main__ import parser
from reprise.operators import verdict as V
from reprise.plans import scan as P

ASKS = (
    "Please refactor the billing invoice parser to support multi currency totals",
    "Refactor billing invoice parser so it can support multi currency totals",
    "refactor the invoice billing parser and support multi currency totals",
)


def test_scan(spark, tmp_path):
    home = tmp_path / ".claude/projects/-home-dev-demo"
    home.mkdir(parents=True)
    for k, ask in enumerate(ASKS):
        tool = {"type": "tool_use", "name": "Read", "input": {"path": f"/a/{k}.py"}}
        usage = {"input_tokens": 2000, "output_tokens": 400, "cache_read_input_tokens": 100}
        rows = [
            {"type": "user", "sessionId": f"s{k}", "cwd": "/home/dev/kernel", "timestamp": f"2026-09-0{k + 1}T00:00:00Z", "message": {"role": "user", "content": ask + " sk-" + "a1" * 20 * (k == 2)}},
            {"type": "assistant", "model": "claude-opus-4-20250514", "message": {"role": "assistant", "content": [{"type": "text", "text": "done"}, tool], "usage": usage}},
        ]
        (home / f"sess-{k}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    done = P.scan(spark, str(tmp_path), "2026-09-03T18:00:00+00:00")
    r = P.report(done)
    assert r["verdict"] == V.REPEATED and len(r["candidates"]) == 1
    c = r["candidates"][0]
    assert (c["distinct_sessions"], c["run_count"], round(c["usd"], 5), c["priced"], c["last_seen"]) == (3, 3, 0.18045, True, "2026-09-03T00:00:00Z")
    assert len(c["evidence"]) == 3 and "a1a1" not in P.json_report(r) and r["projects"][0]["project"] == "kernel"
    assert P.text_report(r).startswith(V.REPEATED) and "$0.18" in P.text_report(r)
    s = P.scaffold(done)
    assert [(x["kind"], x["step"], x["sessions"]) for x in s["steps"]] == [("common", "Read|path", 3)] and s["slots"] and P.scaffold(done, 2) == {}


def test_no_history(spark, tmp_path):
    r = P.report(P.scan(spark, str(tmp_path), "2026-09-03T18:00:00+00:00"))
    assert r["verdict"] == V.NO_HISTORY and r["candidates"] == []


def test_arguments(capsys):
    for flag in ("--days", "--top", "--min-runs"):
        with pytest.raises(SystemExit):
            parser().parse_args([flag, "-1"])
        assert flag in capsys.readouterr().err
