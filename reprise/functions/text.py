"""Predicates and normalisation of request texts, as column expressions.

White space and word characters are Unicode's, so patterns carry (?U) and name the separators that Java leaves out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab as V

SP = r"[\s\x1c-\x1f]"  # under (?U)
URL = r"(?iU)https?://[^\s\x1c-\x1f]+|www\.[^\s\x1c-\x1f]+"
PATH = r"(?U)(?<![A-Za-z0-9])(?:~/|/|[A-Za-z]:\\)[^\s\x1c-\x1f'\"`]+"
PUNCT = r"(?U)[^\w\s\x1c-\x1f<>]+"
LOCATIVE = r"(?iU)^(?:in|at|inside)\s+(?:cursor\b|(?:~/|/|[A-Za-z]:\\)[^\s,]+)\s*,\s*"
UUID = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
SHA = r"(?iU)\b[0-9a-f]{7,40}\b"
NUM = r"(?U)\b\d{3,}\b"
QUOTED = "|".join(rf"{q}[^{q}\n\\]*+(?:\\(?:.|)[^{q}\n\\]*+)*{q}" for q in "\"'")  # repeats a group for backslashes only: deep ones overflow Java's stack
CHECKPOINT = r"(?iU)\bcp-?\d+(?:\.\d+)?\b|\bcheckpoint\s+\d+(?:\.\d+)?\b"
SLASH_TOKEN = r"(?U)(?<![^\s])[^\s]+/[^\s]+"  # a match begins where its token does
REPO_SEGMENT = r"(?iU)\b(?:crates|packages|apps|internal|cmd|pkg|src)(?:/[A-Za-z0-9._-]+|\s+[A-Za-z0-9._-]*[./-][A-Za-z0-9._-]*)"
FILENAME = r"(?U)^[\w.+-]+\.[A-Za-z0-9]{1,10}$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{SP}+|{SP}+\z", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){SP}+", " ")


def tokens(c: Column) -> Column:
    return F.filter(F.split(collapse(c), " "), lambda t: t != "")


def starts_with_any(c: Column, prefixes) -> Column:
    return c.rlike("^(?:" + "|".join(map(re.escape, prefixes)) + ")")


def strip_locative(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), LOCATIVE, "")


def strip_boilerplate(c: Column) -> Column:
    """Plain search rules most texts out before a pattern is tried. Lower case of upper case is as wide as (?iu)."""

    def cut(x: Column) -> Column:
        for phrase in sorted(V.BOILERPLATE_PHRASES, key=len, reverse=True):  # one after another: they overlap
            x = F.regexp_replace(x, "(?iu)" + re.escape(phrase), " ")
        return x

    plain = F.coalesce(c, F.lit(""))
    for mark, put in (("’", "'"), ("‘", "'")):
        plain = F.replace(plain, F.lit(mark), F.lit(put))
    said = lambda x: F.exists(F.array(F.lower(F.replace(F.upper(x), F.lit("İ"), F.lit("i")))), lambda y: _any(y, V.BOILERPLATE_PHRASES))
    return F.element_at(F.transform(F.array(plain), lambda x: F.when(said(x), cut(x)).otherwise(x)), 1)


def has_imperative(c: Column) -> Column:
    """An ask verb among the first tokens, where only soft words may stand from the fourth on, or anywhere in a short text."""
    t = tokens(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), URL, " "), PATH, " "), PUNCT, " "))
    verb = lambda x: x.isin(*V.IMPERATIVE_VERBS)
    at = lambda i: F.get(t, F.lit(i))
    soft = lambda i: at(i).isin(*V.SOFT_WORDS)
    early = F.exists(F.slice(t, 1, 4), verb) | (soft(3) & verb(at(4))) | (soft(3) & soft(4) & verb(at(5)))
    return F.coalesce(early, F.lit(False)) | ((F.size(t) <= 24) & F.exists(t, verb))


def is_continuation(c: Column) -> Column:
    return strip(F.regexp_replace(collapse(F.lower(strip(c))), PUNCT, "")).isin(*V.CONTINUATIONS)


def is_meta_comment(c: Column) -> Column:
    return starts_with_any(F.translate(F.lower(strip(c)), "’–", "'-"), V.META_PREFIXES)


def is_file_fetch(c: Column) -> Column:
    s, asked = collapse(F.lower(strip(c))), F.lit(False)
    for phrase in V.FILE_FETCH_PHRASES:
        asked = asked | s.contains(phrase)
        s = F.replace(s, F.lit(phrase), F.lit(" "))
    t = F.filter(F.transform(tokens(F.translate(s, ",", " ")), lambda x: F.regexp_replace(x, "^[.,;:]+|[.,;:]+$", "")), lambda x: (x != "") & ~x.isin(*V.FILE_FETCH_FILLER))
    return F.when(F.size(t) == 0, asked).otherwise(F.forall(t, lambda x: x.rlike(FILENAME)))


def is_multi_paragraph(c: Column) -> Column:
    paragraphs = F.filter(F.transform(F.split(c, rf"(?U)\n{SP}*\n"), strip), lambda p: p.rlike("[A-Za-z]{3,}"))
    return (F.size(paragraphs) >= 3) | (F.size(F.filter(paragraphs, lambda p: F.length(p) >= 180)) >= 2)


def is_conversational(c: Column) -> Column:
    return strip(c).startswith("**") | c.rlike(r"\*\*[^*\n]{12,}\*\*") | is_multi_paragraph(c) | c.rlike(r"```[^\n]*\n")


def _lines(c: Column) -> Column:
    return F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")


def _any(c: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def prose_preamble(c: Column) -> Column:
    """What stands before a pasted trace, or the first lines, three at most, before code."""
    at = F.regexp_instr(c, F.lit(V.STACK_START))
    begins = starts_with_any

    def step(state: Column, line: Column) -> Column:
        low = F.lower(strip(line))
        code = begins(low, [h.strip() for h in V.CODE_LINE_HINTS]) | _any(F.substring(low, 1, 30), V.CODE_LINE_HINTS)
        trace = low.rlike(r"^file ['\"].+, line \d+") | low.rlike(r"(?U)^\w+(error|exception):")
        stop = F.when(low == "", F.size(state["prose"]) > 0).otherwise(code | trace)
        prose = F.when(stop | (low == ""), state["prose"]).otherwise(F.array_append(state["prose"], line))
        return F.when(state["stop"], state).otherwise(F.struct((stop | (F.size(prose) >= 3)).alias("stop"), prose.alias("prose")))

    start = F.struct(F.lit(False).alias("stop"), F.array().cast("array<string>").alias("prose"))
    head = F.aggregate(_lines(c), start, step, lambda s: strip(F.array_join(s["prose"], "\n")))
    return F.when(at > 1, strip(F.substring(c, F.lit(1), at - 1))).otherwise(head)


def is_blob(c: Column) -> Column:
    """A pasted trace or file with no ask before it."""
    lower = F.lower(c)
    lines = F.filter(F.transform(_lines(c), lambda x: F.lower(strip(x))), lambda x: x != "")
    hits = sum((lower.contains(h).cast("int") for h in V.STACK_HINTS), F.lit(0))
    hits = hits + F.size(F.filter(lines, lambda x: x.rlike(r"^file ['\"].+['\"], line \d+"))) + F.size(F.filter(lines, lambda x: x.rlike(r"(?U)^\w+error:") | x.rlike(r"(?U)^\w+exception:")))
    code = F.size(F.filter(lines, lambda x: _any(F.substring(x, 1, 40), V.CODE_LINE_HINTS)))
    n = F.size(lines)
    stack = (hits >= 2) | ((hits >= 1) & (n >= 5))
    file = (n >= 8) & (code >= F.greatest(F.lit(3), F.floor(n / 3))) & (F.length(c) >= 200)
    before = prose_preamble(c)
    return (stack | file) & ~((before != "") & has_imperative(before))


def is_substantive(c: Column) -> Column:
    raw = strip(F.coalesce(c, F.lit("")))
    stripped = strip_boilerplate(strip_locative(raw))
    collapsed = strip(collapse(stripped))
    return (
        (F.length(raw) <= V.MAX_INTENT_CHARS) & ~is_conversational(stripped) & (F.length(collapsed) >= V.MIN_INTENT_CHARS)
        & ~is_continuation(collapsed) & ~is_meta_comment(collapsed) & ~is_file_fetch(collapsed) & ~is_blob(stripped)
    )


def is_new_task(c: Column) -> Column:
    text = strip(F.coalesce(c, F.lit("")))
    hedged = starts_with_any(F.lower(text), V.CORRECTION_PREFIXES)
    return is_substantive(text) & has_imperative(text) & ~(hedged & (F.length(text) < 80))


def normalize(c: Column, projects: list[str] = (), whole: bool = False) -> Column:
    """The text that asks are compared by: that of the first characters and tokens, or of the whole text."""
    s = strip_boilerplate(strip_locative(c))
    s = F.lower(s if whole else F.substring(s, 1, V.NORMALIZED_MAX_CHARS))
    for pattern, put in ((CHECKPOINT, " <checkpoint> "), (URL, " <url> "), (PATH, " "), (SLASH_TOKEN, " <subpath> "), (REPO_SEGMENT, " <subpath> ")):
        s = F.regexp_replace(s, pattern, put)
    for name in sorted({p.strip() for p in projects if p and len(p.strip()) >= 3}, key=lambda p: (-len(p), p)):
        s = F.regexp_replace(s, rf"(?iu)(?<![A-Za-z0-9]){re.escape(name)}(?![A-Za-z0-9])", " <project> ")
    for pattern, put in ((UUID, " <id> "), (SHA, " <sha> "), (QUOTED, " <str> "), (NUM, " <num> "), (PUNCT, " ")):
        s = F.regexp_replace(s, pattern, put)
    kept = F.filter(tokens(s), lambda t: ~t.isin(*V.STOPWORDS))
    return F.array_join(kept if whole else F.slice(kept, 1, V.NORMALIZED_MAX_TOKENS), " ")


def fold_tokens(normalized: Column) -> Column:
    """Tokens with variants of a word as one term."""
    table = F.create_map(*[F.lit(x) for kv in V.TOKEN_FOLD.items() for x in kv])

    def one(t: Column) -> Column:
        folded = F.coalesce(F.element_at(table, t), t)
        plural = (folded == t) & (F.length(t) > 4) & t.endswith("s") & ~t.endswith("ss")
        short = F.substring(t, F.lit(1), F.length(t) - 1)
        return F.when(plural, F.coalesce(F.element_at(table, short), short)).otherwise(folded)

    return F.transform(tokens(normalized), one)


def redact(c: Column, limit: int | None = V.EVIDENCE_LIMIT) -> Column:
    s = F.coalesce(c, F.lit(""))
    for p in V.SECRET_PATTERNS:
        s = F.regexp_replace(s, p, "<redacted>")
    s = strip(collapse(s))
    return s if limit is None else F.when(F.length(s) > limit, F.concat(F.regexp_replace(F.substring(s, 1, limit - 1), rf"(?U){SP}+\z", ""), F.lit("…"))).otherwise(s)


def label_score(c: Column) -> Column:
    """How well a text would do as a label: 10 and less for an early verb, negative for a reply."""
    raw = F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?U)^{SP}+", "")
    probe = F.regexp_replace(strip_locative(raw), "^[*_\"'`“”‘’ \\t]+", "")
    t = F.slice(F.regexp_extract_all(F.lower(probe), F.lit("([a-z0-9]+(?:-[a-z0-9]+)?)"), F.lit(1)), 1, 5)
    skip = ("please", "you", "me", "us", "to", "the", "a", "an")
    first = F.aggregate(
        F.transform(t, lambda x, i: F.when(x.isin(*V.LABEL_VERBS), i).when(x.isin(*skip), F.lit(-1)).otherwise(F.lit(-2))),
        F.lit(-1), lambda a, x: F.when(a == -1, x).otherwise(a),
    )
    penalty = raw.rlike("^[*\"'`“”‘’]") | starts_with_any(F.lower(raw), V.LABEL_PENALTY_PREFIXES)
    return F.when(raw == "", -100.0).when(penalty, -50.0).when(F.size(t) == 0, -10.0).when(first >= 0, 10.0 - 0.1 * first).otherwise(0.0)


def clean_label(c: Column, limit: int = V.LABEL_LIMIT) -> Column:
    s = F.regexp_replace(unwrap(c)["text"], rf"(?U)^{SP}+", "")
    s = F.regexp_replace(F.regexp_replace(s, r"^(?:\*\*)+", ""), r"^[*_ \t]+", "")
    opener = "|".join(map(re.escape, V.LABEL_PENALTY_PREFIXES))
    s = F.when(starts_with_any(F.lower(s), V.LABEL_PENALTY_PREFIXES), F.regexp_replace(s, rf"(?iu)^(?:{opener})[ .,;:—-]*", "")).otherwise(s)
    s = F.when(s.rlike('^["“][^"”]+["”]'), strip(F.regexp_replace(s, '(?U)^["“]([^"”]+)["”][\\s]*', "$1 "))).otherwise(s)
    s = strip_locative(F.regexp_replace(s, "^[\"'`“”‘’]+", ""))
    s = F.regexp_replace(s, r"(?isU)^(.{12,}?)\s+Prompt:\s*.*\z", "$1")
    s = strip(collapse(F.replace(s, F.lit("**"), F.lit(""))))
    cut = F.substring(s, 1, limit)
    cut = F.when(cut.contains(" "), F.regexp_replace(cut, " [^ ]*$", "")).otherwise(cut)
    cut = F.regexp_replace(cut, "[.,;:!?—\\- ]+$", "")
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.when(cut == "", F.substring(s, 1, max(1, limit - 1))).otherwise(cut), F.lit("…")))


def content_words(label: Column) -> Column:
    """Words of a label that say something; a slash divides words."""
    said = F.filter(tokens(F.translate(F.lower(label), "/", " ")), lambda t: ~t.isin(*V.NON_CONTENT) & ~t.startswith("<"))
    plain = F.transform(said, lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}_-]+", ""))
    return F.size(F.filter(plain, lambda t: (t != "") & ~t.isin(*V.NON_CONTENT)))


def unwrap(c: Column) -> Column:
    """struct(text, ts): the text of the first user_query tag, without timestamp tags; ts from a timestamp tag as ISO text."""
    raw = F.coalesce(c, F.lit(""))
    query = r"(?is)<user_query>(.*?)</user_query>"
    inner = F.when(raw.rlike(query), F.regexp_extract(raw, query, 1)).otherwise(raw)
    tag = r"(?is)<timestamp>(.*?)</timestamp>"
    text = F.regexp_replace(F.regexp_replace(inner, tag, ""), r"(?i)</?(?:timestamp|user_query)\b[^>]*>", "")
    ts = F.when(raw.rlike(tag), clock(strip(F.regexp_extract(raw, tag, 1))))
    return F.struct(strip(text).alias("text"), ts.alias("ts"))


def clock(c: Column) -> Column:
    """ISO text of an ISO time (UTC if it names no zone) or of "Fri, Sep 4, 2026, 1:33 AM (UTC-4)"; null if it's neither."""
    iso = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"
    with_zone = F.when(c.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"), F.regexp_replace(c, "Z$", "+00:00")).otherwise(F.concat(c, F.lit("+00:00")))
    p = r"(?i)^(?:[A-Za-z]+,\s+)?([A-Za-z]+)\s+(\d{1,2}),\s+(\d{4}),\s+(\d{1,2}):(\d{2})\s*(AM|PM)\s*(?:\((?:UTC\s*)?([+-])?(\d{1,2})(?::(\d{2}))?\))?"
    g = lambda k: F.regexp_extract(c, p, k)
    months = F.create_map(*[F.lit(x) for kv in V.MONTHS.items() for x in kv])
    hour = (g(4).cast("int") % 12) + F.when(F.upper(g(6)) == "PM", 12).otherwise(0)
    wall = F.try_make_timestamp_ntz(g(3).cast("int"), F.element_at(months, F.lower(g(1))), g(2).cast("int"), hour, g(5).cast("int"), F.lit(0).cast("decimal(16,6)"))
    zone = F.when(g(8) == "", "+00:00").otherwise(F.concat(F.when(g(7) == "-", "-").otherwise("+"), F.lpad(g(8), 2, "0"), F.lit(":"), F.when(g(9) == "", "00").otherwise(g(9))))
    return F.when(c.rlike(iso), F.replace(with_zone, F.lit(" "), F.lit("T"))).when(c.rlike(p), F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"), zone))
