"""Toxicity: a weighted lexicon, matched by an Aho-Corasick automaton on folded text, normalised by length.

Folding lower-cases, maps look-alike letters of other scripts and digits used as letters to the Latin letters they
stand for, and turns punctuation to spaces. The lexicon's entries are word beginnings and whole words; their weights are
log odds learned from labels. Matches inside an exception phrase don't count. A document's measures are the sum of
the weights of the different entries found, and the sum over all matches divided by the root of the number of words;
a logistic regression on both gives the score.

Learning reads a bounded sample: the MAX_TRAIN labelled rows with the smallest hash of their doc_id.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

MAX_TRAIN = 12_000  #: labelled rows that learning reads
MIN_TOXIC, MIN_LOG_ODDS = 4, 2.5  #: toxic rows that have an entry, its log odds
PRIOR = 4  #: toxic rows that an entry of SEED counts as seen in beside those that have it
SHORTEST, LONGEST = 4, 9  #: letters of a word beginning

# Letters that look like Latin ones, digits and signs written for letters.
LOOKS_LIKE = dict(zip("аеорсухікѕјԁһո" + "αεορικντυ" + "01345789@$", "aeopcyxiksjdhn" + "aeopikvtu" + "oieastbgas"))
FOLD = str.maketrans({c: " " for c in "!\"#%&'()*+,-./:;<=>?[\\]^_`{|}~\t\n\r\v\f’“”«»…–—"} | LOOKS_LIKE)
#: General insults, known before any label is read.
SEED = (
    "idiot", "moron", "stupid", "imbecile", "dumb", "fool", "loser", "scum", "trash", "garbage", "filth", "vermin", "pathetic", "worthless", "useless", "disgusting", "repulsive", "clown", "jerk",
    "creep", "freak", "pig", "coward", "liar", "bastard", "bitch", "whore", "slut", "crap", "shit", "fuck", "idiota", "estúpido", "imbécil", "basura", "asqueroso", "inútil", "crétin", "stupide",
    "connard", "salaud", "ordure", "dégoûtant", "dumm", "arschloch", "abschaum", "wertlos", "ekelhaft", "scheisse", "schlampe",
)
#: Phrases in which an entry is harmless.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "clown fish", "worthless check", "stupid simple", "loser bracket")


def fold(text: str) -> str:
    """Folded words, each with one space before and one after."""
    return f" {' '.join(text.lower().translate(FOLD).split())} "


def entries_of(word: str) -> list[str]:
    """The lexicon entries that a folded word can match."""
    return [f" {word[:k]}" for k in range(SHORTEST, min(LONGEST, len(word)) + 1)] + [f" {word} "] * (len(word) >= SHORTEST - 1)


def held_out(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary")) % 4 == 2


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    coefficients: tuple[float, float, float]  #: constant, sum of different entries, sum a root word

    def matcher(self):
        """text -> (sum of weights of the different entries, sum of all matches a root word)."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for k, w in self.weights.items():
            found.add_word(k, (k, w, len(k)))
        for phrase in EXCEPTIONS if self.weights else ():
            found.add_word(f" {phrase} ", ("", 0.0, len(phrase) + 2))
        if self.weights:
            found.make_automaton()

        def match(text: str) -> tuple[float, float]:
            if not self.weights:
                return 0.0, 0.0
            t = fold(text)
            hits = [(end - n + 1, end, k, w) for end, (k, w, n) in found.iter(t)]
            if not hits:
                return 0.0, 0.0
            safe = [(a, b) for a, b, k, _ in hits if not k]
            hits = [h for h in hits if h[2] and not any(a <= h[0] and h[1] <= b for a, b in safe)]
            return sum({k: w for *_, k, w in hits}.values()), sum(h[3] for h in hits) / math.sqrt(max(1, t.count(" ") - 1))

        return match

    def score(self, measures: tuple[float, float]) -> float:
        z = self.coefficients[0] + self.coefficients[1] * measures[0] + self.coefficients[2] * measures[1]
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def learn(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Labels that are null, or of rows that are held out, are not read; a doc_id labelled twice is toxic if once so, and of rows that repeat a doc_id all texts are learned from. Without labels of both kinds no text matches."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IS NOT NULL AND doc_id IS NOT NULL")
    chosen = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    spark = docs.sparkSession
    rows = chosen.collect()  # max_train pairs of numbers
    n_bad = sum(r.toxic > 0 for r in rows)
    n_good = len(rows) - n_bad
    if not n_bad or not n_good:
        return Model({}, (50.0 if n_bad else -50.0, 0.0, 0.0))
    known_rows = pa.table({"doc_id": pa.array([r.doc_id for r in rows], pa.int64()), "toxic": pa.array([r.toxic for r in rows], pa.int32())})
    sample = texts(docs).join(F.broadcast(spark.createDataFrame(known_rows)), "doc_id")

    def counted(of: frozenset | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts: Counter[str] = Counter()
            for b in batches:
                for text in b["text"].to_pylist():
                    mine = {e for w in set(fold(text).split()) for e in entries_of(w)}
                    counts.update(mine if of is None else mine & of)
            yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["entry", "n"])

        return run

    schema = "entry string, n long"
    total = lambda df: df.groupBy("entry").agg(F.sum("n").alias("n"))
    # entries in MIN_TOXIC toxic rows or more: as many as the words of max_train texts have, divided by that, at most
    bad = {r.entry: r.n for r in total(sample.where("toxic > 0").select("text").mapInArrow(counted(None), schema)).where(F.col("n") >= MIN_TOXIC).collect()}
    seed = {f" {fold(w).strip()} " for w in SEED}
    good = {r.entry: r.n for r in total(sample.where("toxic = 0").select("text").mapInArrow(counted(frozenset({*bad, *seed})), schema)).collect()}
    prior = lambda e: PRIOR if e in seed else 0
    odds = {e: math.log((bad.get(e, 0) + prior(e) + 0.5) / (n_bad + 1)) - math.log((good.get(e, 0) + 0.5) / (n_good + 1)) for e in {*bad, *seed}}
    weights: dict[str, float] = {}
    for e in sorted((e for e, w in odds.items() if w >= MIN_LOG_ODDS), key=lambda e: (len(e.strip()), e)):
        word = e.strip()  # an entry that says no more than a shorter one is left out
        if not any(weights.get(f" {word[:k]}", -9) >= odds[e] - 1 for k in range(SHORTEST, len(word) + e.endswith(" "))):
            weights[e] = odds[e]
    model = Model(weights, (0.0, 0.0, 0.0))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = model.matcher()
        for b in batches:
            a = [match(t) for t in b["text"].to_pylist()]
            yield pa.record_batch([b["toxic"], pa.array([x[0] for x in a], pa.float64()), pa.array([x[1] for x in a], pa.float64())], ["y", "a", "b"])

    at = sample.select("text", "toxic").mapInArrow(measured, "y int, a double, b double").collect()  # max_train rows of three numbers, or more if ids repeat
    return Model(weights, _logistic(at))


def _logistic(at: list, steps: int = 30, ridge: float = 1e-3) -> tuple[float, float, float]:
    """Newton steps for a regression on three numbers a row."""
    import numpy as np

    x, y = np.array([(1.0, r.a, r.b) for r in at]), np.array([float(r.y > 0) for r in at])
    c = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        c = c + np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * len(x) / 1000 * np.eye(3), x.T @ (y - p) - ridge * len(x) / 1000 * c)
    return tuple(float(v) for v in c)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score. A null or empty text has no match and so gets the score of the constant; equal texts get equal scores, of any length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = model.matcher()  # once a task
        for b in batches:
            yield pa.record_batch([b["doc_id"], pa.array([model.score(match(t)) for t in b["text"].to_pylist()], pa.float64())], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of docs, all columns of any name, whose text scores below threshold. Null and empty texts stay unless the constant alone is above it."""

    at = docs.columns.index(next(c for c in docs.columns if c.lower() == "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = model.matcher()  # once a task
        for b in batches:
            yield b.filter(pa.array([model.score(match(t or "")) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training_rows(doc_ids: list[int]) -> list[int]:
    """Those of the ids that learning may read; the same rule outside of Spark."""
    return [d for d in doc_ids if zlib.crc32(str(d).encode()) % 4 != 2]
