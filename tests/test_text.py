"""Truth tables of the text predicates and of normalisation."""

from pyspark.sql import functions as F

from reprise.functions import shell as S
from reprise.functions import text as T


def values(spark, f, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_substantive(spark):
    yes = ["Fix the failing auth tests in the login module", "Please add a retry to the upload client now", "fix this:\nTraceback (most recent call last)\n  File \"/a.py\", line 3\nValueError: x"]
    no = [
        "ok", "thanks!!!", None, "x" * 1300, "**Done** here is a long status reply", "fair, that is a good point and I will keep it",
        "report.pdf, notes.txt send me these files please", "a paragraph here\n\nand another one\n\nand a third one of them", "see this ```python\nprint(1)\n``` and tell me more",
        "Traceback (most recent call last)\n  File \"/a.py\", line 3\nValueError: bad\nvalue\nmore\nlines",
    ]
    assert values(spark, T.is_substantive, yes) == [True] * len(yes)
    assert values(spark, T.is_substantive, no) == [False] * len(no)


def test_new_task(spark):
    got = values(spark, T.is_new_task, [
        "actually make it blue instead of the red one", "Wait, rewrite the billing client from scratch so that it retries failed calls and logs every attempt",
        "Write the migration guide for the parser", "the weather is nice over there today",
    ])
    assert got == [False, True, True, False]


def test_imperative_position(spark):
    pad = " word" * 30
    got = values(spark, T.has_imperative, ["can you fix it" + pad, "so then now the fix" + pad, "so then now what fix" + pad, "one two three four five six fix", ""])
    assert got == [True, True, False, True, False]


def test_normalize(spark):
    got = values(spark, T.normalize, [
        "In /home/me/app, fix the parser at https://x.y/z and see /tmp/a/b", "Update crates/core for checkpoint 12 with 'quoted text' and 12345", "café münchen naïve", "commit deadbeef1 now",
    ])
    assert got == ["fix parser <url> see", "update <subpath> <checkpoint> <str> <num>", "café münchen naïve", "commit <sha>"]
    named = T.normalize(F.lit("Fix Acme-API tests"), ["acme-api"])
    assert spark.range(1).select(named.alias("v")).first().v == "fix <project> tests"


def test_fold_redact_label(spark):
    assert values(spark, T.fold_tokens, ["authentication tests widgets glass cats"]) == [["auth", "test", "widget", "glass", "cats"]]
    assert values(spark, T.redact, ["key sk-abcdefghijkl and Bearer abcdefgh123"]) == ["key <redacted> and <redacted>"]
    assert values(spark, T.label_score, ["", "*x", "Fix it", "the update of it", "thanks a lot", "nothing to see"]) == [-100.0, -50.0, 10.0, 9.9, -50.0, 0.0]
    long = "Refactor the session parser so that every record of every file is read in one pass and typed"
    assert values(spark, T.clean_label, ["**bold** ask", long]) == ["bold ask", "Refactor the session parser so that every record of every file is…"]


def test_unwrap(spark):
    got = values(spark, T.unwrap, ["<timestamp>Friday, Sep 4, 2026, 1:33 AM (UTC-4)</timestamp>\n<user_query>do it</user_query>", "plain", "<timestamp>Feb 30, 2026, 1:00 AM</timestamp>x"])
    assert [(g.text, g.ts) for g in got] == [("do it", "2026-09-04T01:33:00-04:00"), ("plain", None), ("x", None)]


def test_shell(spark):
    cases = {
        "": True, "ls -la": False, "cat a | grep b": False, "rm -rf x": True, "A=1 sudo env B=2 ls": False, "sed -i s/a/b/ f": True, "sed -n 1p f": False, "git status": False,
        "git commit -m x": True, "git branch -d x": True, "git stash list": False, "git stash": True, "git": False, "ls; npm i": True, "X=1": True, "/usr/bin/cat x": False, ";": False,
    }
    assert values(spark, S.shell_is_mutating, list(cases)) == list(cases.values())


def test_boilerplate_goes_in_any_case(spark):
    texts = ["a Implement the plan as specified b", "DON’T STOP until you have completed all the to-dos, x", "İMPLEMENT THE PLAN AS SPECIFIED", "REaD-ONLY exploratıon of ſ", "plain plan", None]
    want = ["a   b", " , x", " ", "  of ſ", "plain plan", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", T.strip_boilerplate(F.col("t")).alias("t")).collect()
    assert [r.t for r in sorted(rows)] == want
