"""Secret scans: three base patterns, and the guess cost of values in credential context.

The guess cost of a value is the least sum, over its cuttings into spans, of the log10 of the guesses that each span
takes: words of a list (by rank, with capitals and digits for letters), dates and years, repeats, walks on the keyboard,
and single characters tried by brute force. A dynamic programme over positions finds it in time linear in the length.
A value that a credential name introduces, and that the base patterns don't cover, is reported as kind ``guess`` if
its cost reaches the threshold.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

KINDS = ("assign", "access", "hex", "guess")  #: order of spans that start together
THRESHOLD = 9.0  #: log10 of guesses

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run that is long enough; a part of a run that is too short isn't longer
HEX = re.compile(r"[0-9a-f]{24,}")
_NAME = r"(?:password|passwd|passphrase|passcode|pwd|pass|pin|secret|token|credentials?|auth|(?:api|access|private|client|session|master|encryption|signing)[_\- ]?(?:key|secret|token))"
_VALUE = r"""(?:["'`]([^"'`\n]{4,})["'`]|([^\s"'`<>(){}\[\],;]{4,}))"""
#: What introduces a value, and the value up to a space, quote or closing bracket: names with a sign behind them, options and headers;
#: and names in a sentence, where only values of letters and others count.
CONTEXTS = tuple(
    (re.compile(p + _VALUE, re.IGNORECASE | re.ASCII), strict)
    for p, strict in (
        (_NAME + r"""["'`]?\x20{0,4}(?:[:=]|=>|:=|->)\x20{0,4}""", False),
        (rf"--?{_NAME}[\x20=]", False),
        (r"\b(?:bearer|basic)\x20{1,4}", True),
        (_NAME + r"\x20{1,4}(?:is|was|to|set to|changed to)\x20{1,4}:?\x20?", True),
    )
)
#: The password of a URL's user.
USERINFO = re.compile(r"://[^\s:/@]{1,64}:([^\s/@]{4,})@")
HINTS = (":", "=", "pass", "pwd", "secret", "token", "bearer", "basic", "->")

# Words that guessers try first, most frequent first.
WORDS = (
    "password pass admin login welcome monkey dragon master hello letmein secret shadow sunshine princess football baseball superman "
    "batman trustno iloveyou access default guest root user test demo changeme example sample string token key value null none true "
    "false your my the and for this that with love money summer winter spring autumn monday friday january july december michael "
    "jordan daniel thomas robert charlie george andrew jessica ashley amanda nicole london berlin paris company office server system "
    "oracle mysql postgres database service backup public private internet computer google apple orange banana cookie coffee cheese "
    "killer hunter ranger soccer hockey tigger buster pepper ginger flower purple yellow silver golden diamond star magic freedom "
    "whatever nothing placeholder redacted enter here type text xxxx todo required optional field input env config"
).split()
RANK = {w: i + 1 for i, w in enumerate(dict.fromkeys(WORDS))}
LONGEST_WORD = max(map(len, RANK))
LEET = str.maketrans("01345@$!7", "oieasasit")
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:\d{4}([-/.]?)\d{1,2}\1\d{1,2}|\d{1,2}([-/.]?)\d{1,2}\2(?:\d{4}|\d{2}))")
YEAR = re.compile(r"(?:19|20)\d\d")
SPOKEN = re.compile(r"(?=[a-z]*[aeiouy])(?:[^aeiouy\W\d_]{0,3}[aeiouy]{1,3}){1,6}[^aeiouy\W\d_]{0,3}")  #: a word that no list has, but that can be spoken
SPOKEN_COST = 6.0  #: log10 of the guesses of such a word of 4 to 14 letters: the end of a list of a million
PER_SPAN = math.log10(2)  #: cost of each further cut


def _neighbours() -> dict[str, str]:
    out = {}
    for y, row in enumerate(ROWS):
        for x, c in enumerate(row):
            near = [(y, x - 1), (y, x + 1), (y - 1, x), (y - 1, x + 1), (y + 1, x - 1), (y + 1, x)]
            out[c] = "".join(ROWS[b][a] for b, a in near if 0 <= b < len(ROWS) and 0 <= a < len(ROWS[b]))
    return out


NEAR = _neighbours()


def _brute(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100)


def _spans(v: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, log10 of guesses) of each cheap span."""
    low, n = v.lower(), len(v)
    plain = low.translate(LEET)
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            for text, extra in ((low, 0.0), (plain, 0.5)):
                if (r := RANK.get(text[i:j])) and (not extra or text[i:j] != low[i:j]):
                    part = v[i:j]
                    caps = 0.0 if part == part.lower() else 0.3 if part[1:] == part[1:].lower() or part == part.upper() else 1.0
                    yield i, j, math.log10(r + 1) + extra + caps
        if (i == 0 or not low[i - 1].isalpha()) and (m := SPOKEN.match(low, i)) and 4 <= m.end() - i <= 14 and not low[m.end() : m.end() + 1].isalpha() and v[i + 1 : m.end()].islower():
            yield i, m.end(), SPOKEN_COST
        if m := YEAR.match(v, i):
            yield i, m.end(), 2.0
        if m := DATE.match(v, i):
            yield i, m.end(), 4.3 + 0.3 * bool(m[1] or m[2])
        if i == 0 or low[i] not in NEAR.get(low[i - 1], ""):  # where a walk begins
            j, turns, last = i + 1, 0, 0
            while j < n and low[j] in NEAR.get(low[j - 1], ""):
                step = NEAR[low[j - 1]].index(low[j]) + 1
                turns, last, j = turns + (step != last), step, j + 1
            if j - i >= 3:
                yield i, j, math.log10(47 * (j - i)) + 0.7 * turns
        for p in range(1, 9):  # a unit of p characters that repeats
            if i >= p and v[i : i + p] == v[i - p : i]:
                continue
            k = 1
            while v[i + k * p : i + (k + 1) * p] == v[i : i + p] and k * p < n:
                k += 1
            if k >= 2 and k * p >= 3:
                yield i, i + k * p, min(sum(map(_brute, v[i : i + p])), math.log10(RANK.get(low[i : i + p], 10**9) + 1)) + math.log10(k)


def guess_cost(value: str) -> float:
    """log10 of the guesses that value takes; 0 for the empty one."""
    n = len(value)
    best = [0.0] + [math.inf] * n
    by_start: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in _spans(value):
        by_start.setdefault(i, []).append((j, cost))
    for i in range(n):
        best[i + 1] = min(best[i + 1], best[i] + _brute(value[i]))
        for j, cost in by_start.get(i, ()):
            best[j] = min(best[j], best[i] + cost + PER_SPAN * bool(i))
    return best[n]


@lru_cache(100_000)
def _cost(value: str) -> float:
    return guess_cost(value)


def values(text: str) -> list[tuple[int, int, float]]:
    """(start, end, log10 of the guesses) of all values in credential context, in order, none twice; of any length."""
    found: dict[tuple[int, int], float] = {}
    low = text.lower()
    if any(h in low for h in HINTS):
        spans = [(m.span(1 if m[1] is not None else 2), strict) for pattern, strict in CONTEXTS for m in pattern.finditer(text)] + [(m.span(1), False) for m in USERINFO.finditer(text)]
        for (start, end), strict in spans:
            value = text[start:end].rstrip(".,;:!?") if text[end : end + 1] not in ("'", '"', "`") else text[start:end]
            if strict and not (any(c.isalpha() for c in value) and any(not c.isalpha() for c in value)):
                continue
            if len(value) >= 4:
                found[start, start + len(value)] = _cost(value) if len(value) <= 200 else guess_cost(value)
    return [(a, e, c) for (a, e), c in sorted(found.items())]


def find(text: str, threshold: float = THRESHOLD, known: list[tuple[int, int, float]] | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans by start, then kind. A value in credential context whose cost reaches threshold is one, unless a base span covers it. known: values(text)."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    base, last = list(found), -1
    for start, end, cost in values(text) if known is None else known:
        if cost >= threshold and start >= last and not any(a <= start and end <= b for _, a, b in base):
            found.append(("guess", start, end))
            last = end
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, and for each text the arrays kinds, starts, ends of its spans (code points, end exclusive) and the spans' texts; value_starts, value_ends and
    costs of all values in credential context, whether they are spans or not.

    A null or empty text has no spans; repeated rows have the same ones; texts may be of any length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = b["text"].to_pylist()
            known = [values(t) for t in whole]
            spans = [find(t, threshold, v) for t, v in zip(whole, known, strict=True)]
            lists = [[[s[k] for s in found] for found in spans] for k in range(3)] + [[[t[a:e] for _, a, e in s] for s, t in zip(spans, whole, strict=True)]]
            lists += [[[v[k] for v in found] for found in known] for k in range(3)]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.record_batch([b["doc_id"], *(pa.array(x, pa.list_(k)) for x, k in zip(lists, kinds, strict=True))], ["doc_id", "kinds", "starts", "ends", "found", "value_starts", "value_ends", "costs"])

    return texts(docs).mapInArrow(run, "doc_id long, kinds array<string>, starts array<long>, ends array<long>, found array<string>, value_starts array<long>, value_ends array<long>, costs array<double>")
