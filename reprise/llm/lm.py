"""Language-model scores by a log-bilinear neural model, trained by noise-contrastive estimation.

The score of a token after two tokens is (P1[c1] + P2[c2]) . Q[w] + b[w]. The model's outcomes are the most frequent
tokens and, for all others, classes by the last bytes of the token; within a class a token has the share that its count has in
the class, and one share is kept for tokens never seen. So every token has a probability, and they add up to 1.

Training reads every training text once, in ROUNDS rounds. Texts are dealt by a hash to groups of about GROUP tokens and
to rounds; so groups depend on the corpus alone, not on how it is partitioned. In a round each group trains a copy of the
model on its texts of that round, in minibatches with noise tokens from the unigram distribution shared by a batch; the
copies are averaged by their tokens in an aggregate, and the next round starts from the average. As scores are sums over the
two places, exp(score) factors, and the sums over all outcomes for all pairs of contexts are one matrix product of two
exponentiated tables: tokens get exactly normalised log probabilities without a sum over the vocabulary for each.

Counts cover all training tokens. Scoring takes those of the KNOWN most frequent tokens from a table of that size and
joins the rest by token.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, texts
from .words import Slots, Words, chunks, mix

END = "\n"  #: no word has it
WORDS, CLASSES, SIZE = 1536, 512, 32  #: outcomes of their own, classes for the others, length of vectors
KNOWN = 250_000  #: tokens at most; those of the count where they would become more are left to the join
TAIL = 3  #: bytes of a token that give its class
NOISE, BATCH, ROUNDS, RATE = 32, 1024, 4, 0.05
GROUP = 1 << 21  #: training tokens of a group, in all rounds; a text of more is in one group
ROWS = 1024  #: texts that are scored at once
FLUSH = 1_000_000  #: different tokens that a task counts before it sends them


def held_out(c: Column) -> Column:
    """Whether a doc_id is held out; a null one isn't."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def counts_of(docs: DataFrame) -> DataFrame:
    """token, c over all texts; each text ends with END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["token", "c"])

        counts: Counter[bytes] = Counter()
        for b in batches:
            for text in b["text"].to_pylist():
                counts.update(_words(text))
                if len(counts) > FLUSH:
                    yield sent()
                    counts.clear()
            counts[END.encode()] += b.num_rows
        if counts:
            yield sent()

    return docs.select("text").mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def classes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class of each token, by its last TAIL bytes."""
    code = np.zeros(len(starts), np.uint64)
    for k in range(TAIL):
        at = ends - 1 - k
        code = code * np.uint64(257) + np.where(at >= starts, data[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (mix(code) % np.uint64(CLASSES)).astype(np.int32)


def _listed(tokens: list[bytes]) -> Words:
    """Tokens as words of one text."""
    n = np.array([len(t) for t in tokens], np.int64)
    ends = np.cumsum(n)
    data = np.frombuffer(b"".join(tokens), np.uint8)
    return Words(slice(0, 1), data, np.array([0, len(data)]), ends - n, ends, np.array([0, len(tokens)]))


def _names(w: Words) -> tuple[np.ndarray, np.ndarray]:
    return w.hashes() | np.uint64(1), w.sums() & np.uint64(0xFFFF)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Vocabulary:
    n: int  #: training tokens
    v: int  #: different ones
    table: Slots  #: 1 + place of the KNOWN most frequent tokens; the end has place `end`
    end: int
    count: np.ndarray  #: of each of those
    outcome: np.ndarray  #: of each of those
    mass: np.ndarray  #: of each class: its tokens' counts, each and once more plus one half
    unigram: np.ndarray  #: of each outcome

    @property
    def n_words(self) -> int:
        return len(self.unigram) - CLASSES

    def outcomes(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(place in the table or -1, outcome) of the words of each text and of its end."""
        at = self.table.find(*_names(w)).astype(np.int64) - 1
        out = np.where(at >= 0, self.outcome[np.maximum(at, 0)], self.n_words + classes_of(w.data, w.starts, w.ends))
        return np.insert(at, w.first[1:], self.end), np.insert(out, w.first[1:], 0).astype(np.int16)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """counts: token, c, to be read four times. The driver gets KNOWN tokens and the sums of each class."""
    n, v = counts.agg(F.sum("c"), F.count("*")).first()
    # by classes of counts first, so that all tasks together send KNOWN tokens at most
    grade = F.floor(16 * F.log2("c"))
    low, many = None, 0
    for r in sorted(counts.groupBy(grade.alias("g")).count().collect(), key=lambda r: -r.g):
        many += r["count"]
        if many > KNOWN:
            break
        low = r.g
    top = counts.where(grade >= F.lit(low if low is not None else 1 << 30)).toPandas().sort_values(["c", "token"], ascending=[False, True])
    tokens, count = [t.encode() for t in top["token"]], top["c"].to_numpy(np.int64)
    end = END.encode()
    if end not in tokens:  # no training text
        tokens, count = [*tokens, end], np.append(count, 0)
    words = [end, *[t for t in tokens[:WORDS] if t != end]][:WORDS]
    index = {t: k for k, t in enumerate(words)}
    listed = _listed(tokens)
    own = np.array([index.get(t, -1) for t in tokens], np.int32)
    outcome = np.where(own >= 0, own, len(words) + classes_of(listed.data, listed.starts, listed.ends))
    table = Slots()
    table.add(*_names(listed), np.arange(1, len(tokens) + 1, dtype=np.uint64))
    mine = frozenset(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, many = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for b in batches:
            tokens_ = b["token"].cast(pa.binary()).to_pylist()
            others = np.array([t not in mine for t in tokens_], bool)
            w = _listed(tokens_)
            k, c = classes_of(w.data, w.starts, w.ends)[others], b["c"].to_numpy()[others]
            np.add.at(total, k, c)
            many += np.bincount(k, minlength=CLASSES)
        yield pa.record_batch([pa.array(np.arange(CLASSES)), pa.array(total), pa.array(many)], ["k", "total", "many"])

    mass = np.full(CLASSES, 0.5)
    for r in counts.mapInArrow(run, "k long, total long, many long").groupBy("k").agg(F.sum("total").alias("total"), F.sum("many").alias("many")).collect():
        mass[r.k] += r.total + 0.5 * r.many
    place = {t: k for k, t in enumerate(tokens)}
    unigram = np.concatenate([count[[place[w] for w in words]] + 0.5, mass])
    return Vocabulary(n or 0, v or 0, table, place[end], count, outcome, mass, unigram / unigram.sum())


@dataclass
class Model:
    p1: np.ndarray
    p2: np.ndarray
    q: np.ndarray
    b: np.ndarray

    @classmethod
    def new(cls, unigram: np.ndarray, seed: int = 42) -> Model:
        rng = np.random.default_rng(seed)
        make = lambda: rng.normal(0, 0.1, (len(unigram), SIZE)).astype(np.float32)
        return cls(make(), make(), make(), np.log(unigram).astype(np.float32))

    def rows(self) -> np.ndarray:
        return np.column_stack([self.p1, self.p2, self.q, self.b])

    @classmethod
    def of_rows(cls, x: np.ndarray) -> Model:
        x = x.astype(np.float32)
        return cls(*(np.ascontiguousarray(x[:, k * SIZE : (k + 1) * SIZE]) for k in range(3)), np.ascontiguousarray(x[:, -1]))

    def log_sums(self) -> np.ndarray:
        """log of the sum over outcomes of exp(score), for each pair of contexts."""
        first, second = self.p1 @ self.q.T, self.p2 @ self.q.T + self.b
        high1, high2 = first.max(axis=1), second.max(axis=1)
        return np.log(np.exp(first - high1[:, None]) @ np.exp(second - high2[:, None]).T + np.float32(1e-30)) + high1[:, None] + high2

    def log_probabilities(self, c1: np.ndarray, c2: np.ndarray, w: np.ndarray, sums: np.ndarray) -> np.ndarray:
        out = np.empty(len(w), np.float32)
        for k in range(0, len(w), 1 << 15):
            a, e = k, k + (1 << 15)
            out[a:e] = np.einsum("ij,ij->i", self.p1[c1[a:e]] + self.p2[c2[a:e]], self.q[w[a:e]]) + self.b[w[a:e]] - sums[c1[a:e], c2[a:e]]
        return out


def _contexts(w: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens two and one before each; END (outcome 0) before the first of each text. ends: places of the last tokens."""
    c2 = np.concatenate([[0], w[:-1]])
    starts = np.concatenate([[0], ends[:-1] + 1])
    c2[starts] = 0
    c1 = np.concatenate([[0], c2[:-1]])
    c1[starts] = 0
    return c1.astype(np.int16), c2.astype(np.int16)


class _Trainer:
    """Noise-contrastive estimation with AdaGrad on one copy of the model."""

    def __init__(self, model: Model, unigram: np.ndarray, seed: int):
        self.m = Model(*(x.copy() for x in (model.p1, model.p2, model.q, model.b)))
        self.squares = [np.full(len(unigram), 1.0, np.float32) for _ in range(4)]
        self.cumulative = np.cumsum(unigram)
        self.log_noise = np.log(NOISE * unigram).astype(np.float32)
        self.rng = np.random.default_rng(seed)

    def _step(self, k: int, at: np.ndarray, slope: np.ndarray) -> None:
        """Add the slopes of equal places, then move those rows."""
        order = np.argsort(at, kind="stable")
        places = at[order]
        first = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
        total, rows = np.add.reduceat(slope[order], first, axis=0), places[first]
        squares, target = self.squares[k], (self.m.p1, self.m.p2, self.m.q, self.m.b)[k]
        squares[rows] += total * total if total.ndim == 1 else np.einsum("ij,ij->i", total, total) / SIZE
        scale = np.float32(RATE) / np.sqrt(squares[rows])
        target[rows] += total * (scale if total.ndim == 1 else scale[:, None])

    def train(self, c1: np.ndarray, c2: np.ndarray, w: np.ndarray) -> None:
        m, order = self.m, self.rng.permutation(len(w))
        for at in range(0, len(w), BATCH):
            x = order[at : at + BATCH]
            a, c, t = c1[x], c2[x], w[x]
            noise = np.searchsorted(self.cumulative, self.rng.random(NOISE) * self.cumulative[-1]).clip(max=len(m.b) - 1)
            h = m.p1[a] + m.p2[c]
            qt, qn = m.q[t], m.q[noise]
            right = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", h, qt) + m.b[t] - self.log_noise[t], -30, 30)))
            wrong = 1 / (1 + np.exp(-np.clip(h @ qn.T + m.b[noise] - self.log_noise[noise], -30, 30)))
            dh = right[:, None] * qt - wrong @ qn
            dq = np.concatenate([right[:, None] * h, -(wrong.T @ h)])
            both = np.concatenate([t, noise.astype(np.int16)])
            self._step(0, a, dh)
            self._step(1, c, dh)
            self._step(2, both, dq)
            self._step(3, both, np.concatenate([right, -wrong.sum(axis=0)]))


def coded(docs: DataFrame, vocabulary_: Vocabulary) -> DataFrame:
    """What training and scoring read of each text: doc_id, key (a number of the row), name (a hash of doc_id and text), w (outcomes, 16 bits each),
    n, known (tokens, and those in the table that were counted), base (their base score), inside (logarithms of the shares in classes), rest (tokens that aren't in the table)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_)
    base = float(np.log10(vocabulary_.n + 0.5 * (vocabulary_.v + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocab = shared.value
        logs, log_mass = np.log10(vocab.count + 0.5), np.log10(vocab.mass)
        key = TaskContext.get().partitionId() << 33
        for b in batches:
            for words in chunks(b["text"]):
                words = replace(words, data=LOWER[words.data])
                at, w = vocab.outcomes(words)
                ends = words.first[1:] + np.arange(1, len(words.first))  # tokens up to each text's end
                begins = np.concatenate([[0], ends[:-1]])
                there, other = at >= 0, w >= vocab.n_words
                mine = np.where(there, logs[np.maximum(at, 0)], 0.0)
                inside = np.where(other & there, mine, 0.0)
                inside[other] -= log_mass[w[other] - vocab.n_words]
                sums = lambda x: np.add.reduceat(x, begins)
                missing = np.flatnonzero(~there)
                raw, k = words.data.tobytes(), missing - np.searchsorted(ends, missing, "right")
                rest = [raw[a:e] for a, e in zip(words.starts[k].tolist(), words.ends[k].tolist(), strict=True)]
                cuts = pa.array(np.searchsorted(missing, np.concatenate([[0], ends])), pa.int32())
                n = len(ends)
                two = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * np.concatenate([[0], ends])).astype(np.int32).tobytes()), pa.py_buffer(w.tobytes())])
                columns = [*(b[c].slice(words.rows.start, n) for c in ("doc_id", "name")), pa.array(np.arange(key, key + n)), two, pa.array(ends - begins), pa.array(sums((there & (vocab.count[np.maximum(at, 0)] > 0)).astype(np.int64)))]
                columns += [pa.array(sums(mine) - (ends - begins) * base), pa.array(sums(inside)), pa.ListArray.from_arrays(cuts, pa.array(rest, pa.binary()).cast(pa.string()))]
                yield pa.record_batch(columns, ["doc_id", "name", "key", "w", "n", "known", "base", "inside", "rest"])
                key += n

    schema = "doc_id long, name long, key long, w binary, n long, known long, base double, inside double, rest array<string>"
    return texts(docs).withColumn("name", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")).mapInArrow(run, schema)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all outcomes of the texts, where each text's last one is)."""
    each = [np.frombuffer(x.as_buffer(), np.int16) for x in column]
    return np.concatenate(each), np.cumsum([len(x) for x in each]) - 1


def train(texts_: DataFrame, vocabulary_: Vocabulary, rounds: int = ROUNDS, group: int = GROUP) -> Model:
    """texts_: name and w of all training texts, to be read once a round. The driver gets outcomes * (3 * SIZE + 1) numbers a round."""
    sc = texts_.sparkSession.sparkContext
    unigram = vocabulary_.unigram
    model, width = Model.new(unigram), 3 * SIZE + 1
    groups = max(1, round(vocabulary_.n / group))
    dealt = texts_.select("w", "name", F.pmod(F.xxhash64("name", F.lit("group")), F.lit(groups)).alias("g"), F.pmod(F.xxhash64("name", F.lit("round")), F.lit(rounds)).alias("turn"))

    def learner(turn: int, start):
        def learn(mine: pa.Table) -> pa.Table:
            trainer = _Trainer(start.value, unigram, seed=turn)
            w, ends = _flat(mine.sort_by("name")["w"])
            trainer.train(*_contexts(w, ends), w)
            x = trainer.m.rows() * np.float32(len(w))
            columns = {f"x{j}": pa.array(x[:, j].astype(np.float64)) for j in range(width)}
            return pa.table({"r": pa.array(np.arange(len(x), dtype=np.int32)), "n": pa.array(np.full(len(x), float(len(w)))), **columns})

        return learn

    for turn in range(rounds):
        schema = "r int, n double" + "".join(f", x{j} double" for j in range(width))
        copies = dealt.where(F.col("turn") == turn).groupBy("g").applyInArrow(learner(turn, sc.broadcast(model)), schema)
        # a row for each outcome of each copy; their sums are taken in steps
        total = copies.groupBy("r").agg(F.sum("n").alias("n"), *[F.sum(f"x{j}").alias(f"x{j}") for j in range(width)]).toPandas().sort_values("r")
        if len(total):
            model = Model.of_rows(total[[f"x{j}" for j in range(width)]].to_numpy() / total[["n"]].to_numpy())
    return model


_SUMS: dict = {}  # log_sums of the model that a worker used last


def score(local: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of each text; log10. A null or empty text is its end alone. local: :func:`coded`, to be read twice."""
    mine = local.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = mine.value
        if _SUMS.get("of") is not m:
            _SUMS.clear()
            _SUMS.update(of=m, sums=m.log_sums())
        for b in (x.slice(k, ROWS) for x in batches for k in range(0, x.num_rows, ROWS)):
            w, ends = _flat(b["w"])
            of_tokens = m.log_probabilities(*_contexts(w, ends), w, _SUMS["sums"]).astype(np.float64)
            model_score = np.add.reduceat(of_tokens, np.concatenate([[0], ends[:-1] + 1])) / np.log(10) + b["inside"].to_numpy()
            yield pa.record_batch([*(b[c] for c in ("doc_id", "key", "n", "known", "base")), pa.array(model_score)], ["doc_id", "key", "n", "known", "base", "model"])

    scored = local.select("doc_id", "key", "n", "known", "base", "inside", "w").mapInArrow(run, "doc_id long, key long, n long, known long, base double, model double")
    rest = local.select("key", F.explode("rest").alias("token")).groupBy("key", "token").agg(F.count("*").alias("times"))
    found = rest.join(counts, "token", "left").groupBy("key").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("seen")
    )
    more = lambda c: F.coalesce(c, F.lit(0))
    return scored.join(found, "key", "left").select(
        "doc_id", F.col("n").alias("n_tokens"), (F.col("known") + more(F.col("seen"))).cast("long").alias("n_known"),
        (F.col("base") + more(F.col("logs"))).alias("base_score"), (F.col("model") + more(F.col("logs"))).alias("score"),
    )


def fit_and_score(docs: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those that aren't held out; with held_out and train_tokens.

    Rows that repeat a doc_id are separate documents; one without an id isn't held out. Texts may be of any length.
    """
    counts = checkpoint(counts_of(texts(docs.where(~held_out(F.col("doc_id"))))))
    vocab = vocabulary(counts)
    local = checkpoint(coded(docs, vocab))
    model = train(local.where(~held_out(F.col("doc_id"))).select("name", "w"), vocab)
    scored = score(local, counts, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(vocab.n).cast("long").alias("train_tokens"), "base_score", "score")
