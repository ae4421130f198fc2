"""Token ids in files of shards, compressed by Re-Pair.

A file is a Parquet table with one row a shard of SHARD ids at least (the last of a partition may have less):

    part, seq     place in the order of documents: by part, then seq
    before        ids of the part before the shard
    doc_ids       ids of the documents, in order (null allowed)
    n_tokens      ids of each document
    symbols       symbols that each document was compressed to
    base          the first nonterminal; smaller symbols are token ids
    rules         two little-endian unsigned 32-bit symbols for each nonterminal, base + 0, base + 1, ...
    lengths       ids that each nonterminal expands to (unsigned 32-bit), so a place in a document is found without decoding
    sequence      the symbols of all documents (unsigned 32-bit)

Pairs never span documents, so each document can be decoded alone. Spark's own writer commits the files, so a lost
executor's shards are written again, and any store that Spark writes to will do.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, texts, trim
from .words import Slots, Words, chunks, mix

END = 2
SHARD = 1 << 18
PER_PASS, LEAST = 1 << 13, 16  #: new rules of a pass at most, occurrences of a pair at least
SLOTS_LOG = 17
CACHED = 400_000  #: pieces whose ids a worker remembers for good
CHUNK = 1 << 19  #: bytes of texts that are looked up together
TAILS, PLAIN = np.zeros(256, bool), np.zeros(256, bool)  #: signs that are pieces of their own behind letters and digits; those
TAILS[list(b".,;:!?")] = True
PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
BEFORE = ("", " ", "\n")
# The white space other than ASCII's six that a splitter may know, by its bytes in UTF-8.
ODD_ONE = [0x1C, 0x1D, 0x1E, 0x1F]
ODD_TWO = [0xC285, 0xC2A0]
ODD_THREE = [0xE19A80, 0xE1A08E, *range(0xE28080, 0xE28090), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080]
ODD_LEADS = np.zeros(256, bool)
ODD_LEADS[[*ODD_ONE, 0xC2, 0xE1, 0xE2, 0xE3]] = True
# How byte-level tokenizers cut texts into pieces, and the letters that stand for bytes in their vocabularies.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_VISIBLE = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
BYTE_LETTERS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
SCHEMA = "part int, seq long, before long, doc_ids array<long>, n_tokens array<long>, symbols array<long>, base long, rules binary, lengths binary, sequence binary"


def _letters(text: str) -> str:
    return text.encode().decode("latin1").translate(BYTE_LETTERS)


class _Table:
    """Ids of pieces of text by their hash: the first CACHED pieces for good, later ones for a while. pool[0] ends a document."""

    def __init__(self, end: int):
        self.first, self.late = Slots(), Slots()
        self.pool, self.used, self.fixed = np.full(1 << 16, end, np.uint32), 1, 1

    def find(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        """place in pool << 16 | number of ids of each, or 0."""
        out = self.first.find(h, c)
        if self.late.count and len(left := np.flatnonzero(out == 0)):
            out[left] = self.late.find(h[left], c[left])
        return out

    def tidy(self) -> None:
        """Forget later pieces, if they are too many."""
        if self.late.count > CACHED // 8:
            self.late, self.used = Slots(), self.fixed

    def add(self, h: np.ndarray, c: np.ndarray, ids: list[bytes]) -> None:
        """New pieces, each once. Pieces of 2**16 ids and more aren't kept."""
        n = np.array([len(x) // 4 for x in ids], np.uint64)
        if len(n) and n.max() >= 1 << 16:
            few = np.flatnonzero(n < 1 << 16)
            h, c, n, ids = h[few], c[few], n[few], [ids[k] for k in few.tolist()]
        flat = np.frombuffer(b"".join(ids), "<u4")
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(max(self.used, len(flat)), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        places = ((np.uint64(self.used) + np.cumsum(n, dtype=np.uint64) - n) << np.uint64(16)) | n
        self.used += len(flat)
        if self.first.count < CACHED:
            self.first.add(h, c, places)
            self.fixed = self.used
        else:
            self.late.add(h, c, places)


class Encoder:
    """Ids of texts by a tokenizer file. Texts of single spaces and line ends between words are looked up by word, all at once."""

    def __init__(self, path: str, end: int = END):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        made = json.loads(self.tokenizer.to_str())
        split = made.get("pre_tokenizer") or {}
        #: whether texts fall into pieces by PATTERN, each of which the model alone turns into ids
        self.by_piece = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not made.get("normalizer") and not made["model"].get("dropout")
        self.table, self.end = _Table(end), np.array([end], np.uint32)
        self.small: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.apart = not any("\u0120" in t.lstrip("\u0120") for t in vocabulary)  # no token has a space behind another letter
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.begins[[k for t, k in vocabulary.items() if t[:1] == "\u0120"]] = True

    def whole(self, text: str) -> np.ndarray:
        """Ids of any text, by the library."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _piece(self, piece: str) -> bytes:
        got = self.small.get(piece)
        if got is None:
            if len(self.small) > 10_000:
                self.small.clear()
            got = self.small[piece] = array("I", [t.id for t in self.tokenizer.model.tokenize(_letters(piece))]).tobytes()
        return got

    def pieces(self, units: list[str]) -> list[bytes]:
        """Ids of units: a word, with a space or a line end before it or nothing, that no piece of the text crosses."""
        out: list = [None] * len(units)
        whose = [k for k, u in enumerate(units) if u[:1] == " " and u[1:].isalpha()]  # one piece
        spaced = ["\u0120" + u[1:] if u.isascii() else _letters(u) for u in map(units.__getitem__, whose)]
        for k, ids in zip(whose, self._spaced(spaced), strict=True):
            out[k] = ids
        return [b"".join(map(self._piece, PATTERN.findall(u))) if ids is None else ids for u, ids in zip(units, out, strict=True)]

    def _spaced(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that begin with the letter for a space: some at once, as no token goes on into such a letter."""
        model = self.tokenizer.model.tokenize
        if not self.apart:
            return [np.array([t.id for t in model(p)], "<u4").tobytes() for p in pieces]
        ids = np.array([t.id for k in range(0, len(pieces), 64) for t in model("".join(pieces[k : k + 64]))], "<u4")
        cuts = [*np.flatnonzero(self.begins[ids]).tolist(), len(ids)]
        raw = ids.tobytes()
        return [raw[4 * a : 4 * e] for a, e in zip(cuts, cuts[1:])]

    def _regular(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(what stands before each word: 0 nothing, 1 a space, 2 a line end; whether each text has nothing else and no other white space)."""
        n, data = len(w.first) - 1, w.data
        some = np.diff(w.first) > 0
        gap = np.zeros(len(w), np.int8)
        size = w.starts[1:] - w.ends[:-1]
        before = data[np.maximum(w.starts - 1, 0)] if len(w) else data[:0]
        gap[1:] = np.where(size == 1, np.where(before[1:] == 0x20, 1, np.where(before[1:] == 0x0A, 2, 3)), 3)
        heads = w.first[:-1][some]
        gap[heads] = np.where(w.starts[heads] == w.offsets[:-1][some], 0, 3)
        bad = np.zeros(n, bool)
        bad[w.text_of()[gap == 3]] = True
        bad[some] |= w.ends[w.first[1:][some] - 1] != w.offsets[1:][some]
        bad[~some] = np.diff(w.offsets)[~some] > 0
        # other white space, by its bytes; and what the library takes for special tokens
        at = np.flatnonzero(ODD_LEADS[data])
        if len(at):
            three = np.concatenate([data, np.zeros(2, np.uint8)])
            code = (three[at].astype(np.int64) << 16) | (three[at + 1].astype(np.int64) << 8) | three[at + 2]
            odd = at[(three[at] < 0x80) | np.isin(code >> 8, ODD_TWO) | np.isin(code, ODD_THREE)]
            bad[np.searchsorted(w.offsets, odd, "right") - 1] = True
        for s in self.special:
            if s[:2] in (raw := data.tobytes()):
                bad |= np.array([s in w.text(i) for i in range(n)], bool)
        return gap, ~bad

    def _places(self, h: np.ndarray, c: np.ndarray, units) -> tuple[np.ndarray, np.ndarray]:
        """(place in the pool, number) of the ids of each unit; number 0 where they aren't kept. units: places -> strings."""
        self.table.tidy()
        got = self.table.find(h, c)
        if len(new := np.flatnonzero(got == 0)):
            _, some = np.unique(h[new], return_index=True)
            some = new[some]
            self.table.add(h[some], c[some], self.pieces(units(some)))
            got[new] = self.table.find(h[new], c[new])
        return (got >> np.uint64(16)).astype(np.int64), (got & np.uint64(0xFFFF)).astype(np.int64)

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a column without nulls, with the end."""
        for w in chunks(column, CHUNK):
            if not self.by_piece:
                yield from (np.concatenate([self.whole(w.text(i).decode("utf-8", "replace")), self.end]) for i in range(len(w.first) - 1))
                continue
            gap, regular = self._regular(w)
            w, gap = _cut_tails(w, gap)
            at, n = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
            if len(use := np.flatnonzero(np.repeat(regular, np.diff(w.first)))):
                raw = w.data.tobytes()

                def units(some: np.ndarray) -> list[str]:
                    k = use[some]
                    return [BEFORE[g] + raw[a:e].decode() for g, a, e in zip(gap[k].tolist(), w.starts[k].tolist(), w.ends[k].tolist(), strict=True)]

                h, c = mix(w.hashes()[use] + gap[use].astype(np.uint64)) | np.uint64(1), w.sums()[use] & np.uint64(0xFFFF)
                at[use], n[use] = self._places(h, c, units)
                if len(lost := use[n[use] == 0]):  # two units share a hash, or a unit has too many ids
                    regular[w.text_of()[lost]] = False
            at, n = np.insert(at, w.first[1:], 0), np.insert(n, w.first[1:], 1)  # ends
            upto = np.cumsum(n)
            ids = self.table.pool[np.repeat(at - (upto - n), n) + np.arange(upto[-1])]
            bounds = np.concatenate([[0], upto[w.first[1:] + np.arange(len(w.first) - 1)]]).tolist()
            for i, fine in enumerate(regular.tolist()):
                yield ids[bounds[i] : bounds[i + 1]] if fine else np.concatenate([self.whole(w.text(i).decode("utf-8", "replace")), self.end])


def _cut_tails(w: Words, gap: np.ndarray) -> tuple[Words, np.ndarray]:
    """w and gap with a sign behind a letter or digit as a word of its own: it is a piece of its own, and words with it are many."""
    last = w.ends - 1
    tail = TAILS[w.data[last]] & (last > w.starts) & PLAIN[w.data[last - 1]] if len(w) else np.zeros(0, bool)
    extra = np.cumsum(tail)
    k = np.arange(len(w)) + extra - tail
    size = len(w) + int(tail.sum())
    starts, ends, before = np.empty(size, np.int64), np.empty(size, np.int64), np.zeros(size, np.int8)
    starts[k], ends[k], before[k] = w.starts, w.ends - tail, gap
    t = k[tail] + 1
    starts[t], ends[t] = last[tail], w.ends[tail]
    return replace(w, starts=starts, ends=ends, first=w.first + np.concatenate([[0], extra])[w.first]), before


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end: int = END) -> Encoder:
    if (path, end) not in _ENCODERS:
        _ENCODERS[path, end] = Encoder(path, end)
    return _ENCODERS[path, end]


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---- Re-Pair


def _slots(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS_LOG)).astype(np.int64)


def _counted(keys: np.ndarray, at: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, rank) among at, in order, of the most frequent pairs that occur least times or more; rank numbers the pairs."""
    order = at[np.argsort(keys[at], kind="stable")]
    k = keys[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.empty(0, np.int64)
    n = np.diff(np.append(first, len(k)))
    good = np.flatnonzero(n >= least)
    good = good[np.argsort(-n[good], kind="stable")[:most]]
    rank = np.full(len(first), -1, np.int64)
    rank[good] = np.arange(len(good))
    each = np.repeat(rank, n)
    where, which = order[each >= 0], each[each >= 0]
    back = np.argsort(where, kind="stable")
    return where[back], which[back]


def _frequent(keys: np.ndarray, least: int, most: int, all_: bool) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`_counted` of all places; unless all are asked for, of the pairs that share a slot of a hash one is enough."""
    slot = _slots(keys)
    counts = np.bincount(slot, minlength=1 << SLOTS_LOG)
    if all_:
        return _counted(keys, np.flatnonzero((counts >= least)[slot]), least, most)
    full = counts >= least
    if full.sum() > most:
        full &= counts >= np.partition(counts, -most)[-most]
    some = np.flatnonzero(full[slot])
    chosen = np.zeros(1 << SLOTS_LOG, np.uint64)
    chosen[slot[some]] = keys[some]
    at = some[chosen[slot[some]] == keys[some]]
    exact = np.bincount(slot[at], minlength=1 << SLOTS_LOG)
    at = at[exact[slot[at]] >= least]
    return at, slot[at]


def compress(ids: np.ndarray, last: np.ndarray, least: int = LEAST, per_pass: int = PER_PASS):
    """(symbols, last, base, rules): last marks the end of each document; rules is an array of pairs.

    Each pass replaces the most frequent pairs together, those that occur least times or more, until there is none. Of
    pairs that overlap the left one is taken, and a pair that is then left with one place stays as it is.
    """
    symbols, base = ids.astype(np.uint32), int(ids.max()) + 1 if len(ids) else 0
    rules: list[np.ndarray] = []
    made, slow = 0, False  # slow: the last pass found little, so the next one looks at all pairs
    while len(symbols) > 1:
        keys = (symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:]
        free = np.flatnonzero(~last[:-1])
        where, which = _frequent(keys[free], least, per_pass, slow)
        at = free[where]
        found = len(at)
        if found:
            run = np.cumsum(np.append(True, np.diff(at) != 1))  # of successive places every other one is taken
            starts = np.flatnonzero(np.append(True, np.diff(run) != 0))
            taken = (np.arange(len(at)) - starts[run - 1]) % 2 == 0
            at, which = at[taken], which[taken]
            often = np.bincount(which) >= 2  # places that overlap may leave a pair once
            at, which = at[often[which]], which[often[which]]
        if not len(at) and slow:
            break
        slow = slow or found < len(symbols) // 16
        if not len(at):
            slow = True
            continue
        some = np.zeros(int(which.max()) + 1, np.int64)
        some[which] = at  # a place of each pair
        used = np.bincount(which, minlength=len(some)) > 0
        pairs, which = keys[some[used]], (np.cumsum(used) - 1)[which]
        rules.append(np.column_stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)]).astype(np.uint32))
        symbols = symbols.copy()
        symbols[at] = (base + made + which).astype(np.uint32)
        last = last.copy()
        last[at] = last[at + 1]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols, last = symbols[stay], last[stay]
        made += len(pairs)
    return symbols, last, base, np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)


def expansion_lengths(base: int, rules: np.ndarray) -> np.ndarray:
    """Ids of each nonterminal; a rule refers to earlier ones only, or to those of an earlier pass."""
    out = np.zeros(len(rules), np.int64)
    while len(rules) and (out == 0).any():
        inside = rules.astype(np.int64) - base
        size = np.where(inside < 0, 1, out[np.maximum(inside, 0)])
        out = np.where((size > 0).all(axis=1), size.sum(axis=1), 0)
    return out.astype(np.uint32)


def _spread(symbols: np.ndarray, base: int, size: np.ndarray, begin: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The ids of symbols, from those of nonterminals that are spelled out in flat."""
    inside = symbols.astype(np.int64) - base
    high = inside >= 0
    each = np.ones(len(symbols), np.int64)
    each[high] = size[inside[high]]
    place = np.cumsum(each) - each
    out = np.empty(int(each.sum()), np.uint32)
    out[place[~high]] = symbols[~high]
    n, at = each[high], place[high]
    done = np.cumsum(n) - n
    step = np.arange(int(n.sum()))
    out[step + np.repeat(at - done, n)] = flat[step + np.repeat(begin[inside[high]] - done, n)]
    return out


def expand(symbols: np.ndarray, base: int, rules: np.ndarray) -> np.ndarray:
    """The ids of any piece of a sequence: nonterminals are spelled out once, those of each depth together, then copied to their places."""
    if not len(rules) or not len(symbols):
        return symbols.astype(np.uint32)
    size, inside = expansion_lengths(base, rules).astype(np.int64), rules.astype(np.int64) - base
    begin, flat = np.cumsum(size) - size, np.empty(int(size.sum()), np.uint32)
    open_ = np.ones(len(rules), bool)
    while open_.any():  # of what is spelled out
        now = np.flatnonzero(open_ & ~((inside >= 0) & open_[np.maximum(inside, 0)]).any(axis=1))
        n, made = size[now], _spread(rules[now].ravel(), base, size, begin, flat)
        flat[np.arange(len(made)) + np.repeat(begin[now] - (np.cumsum(n) - n), n)] = made
        open_[now] = False
    return _spread(symbols, base, size, begin, flat)


def unfold(symbols: np.ndarray, base: int, rules: np.ndarray) -> np.ndarray:
    """The ids of a few symbols, without spelling out the other rules: all nonterminals are replaced by their pairs, again and again."""
    while len(high := np.flatnonzero(symbols >= base)) and len(rules):
        pairs = rules[symbols[high].astype(np.int64) - base]
        symbols = np.insert(symbols, high + 1, pairs[:, 1])
        symbols[high + np.arange(len(high))] = pairs[:, 0]
    return symbols.astype(np.uint32)


def part_of(shard: dict, k: int, low: int = 0, high: int | None = None) -> np.ndarray:
    """Ids low to high (exclusive) of the shard's document k. Lengths of expansions tell which symbols they lie in; only those are decoded."""
    first = sum(shard["symbols"][:k])
    symbols = np.frombuffer(shard["sequence"], "<u4", shard["symbols"][k], 4 * first)
    base, lengths, rules = shard["base"], np.frombuffer(shard["lengths"], "<u4"), np.frombuffer(shard["rules"], "<u4").reshape(-1, 2)
    inside = symbols.astype(np.int64) - base
    each = np.where(inside >= 0, lengths[np.maximum(inside, 0)], 1) if len(lengths) else np.ones(len(symbols), np.int64)
    ends = np.cumsum(each)
    high = shard["n_tokens"][k] if high is None else min(high, shard["n_tokens"][k])
    low = max(0, low)
    if low >= high:
        return np.empty(0, np.uint32)
    a, e = np.searchsorted(ends, low, "right"), np.searchsorted(ends, high, "left") + 1
    skipped = int(ends[a - 1]) if a else 0
    return unfold(symbols[a:e], base, rules)[low - skipped : high - skipped]


# ---- files


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, shard: int = SHARD) -> None:
    """Encode all texts, each with end after it, and write them in ascending doc_id (nulls first; rows that repeat a doc_id in the order of the table).

    Rows of one doc_id may lie in several tasks. A null text is empty; a text of any length is in one shard.
    """
    keyed = texts(docs).withColumn("u", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange("doc_id", "u").sortWithinPartitions("doc_id", "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, before = TaskContext.get().partitionId(), 0, 0
        coder = encoder(tokenizer or _default_path(), end)
        doc_ids: list[pa.Array] = []
        coded: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            n = np.array([len(c) for c in coded], np.int64)
            last = np.zeros(int(n.sum()), bool)
            last[np.cumsum(n) - 1] = True
            symbols, last, base, rules = compress(np.concatenate(coded), last)
            per_doc = np.diff(np.flatnonzero(last), prepend=-1)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), x) for x in (pa.concat_arrays(doc_ids), pa.array(n), pa.array(per_doc))]
            raw = (pa.array([x.astype("<u4").tobytes()], pa.binary()) for x in (rules, expansion_lengths(base, rules), symbols))
            columns = [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([before], pa.int64()), *lists, pa.array([base], pa.int64()), *raw]
            return pa.record_batch(columns, ["part", "seq", "before", "doc_ids", "n_tokens", "symbols", "base", "rules", "lengths", "sequence"])

        for b in batches:
            for k, ids in enumerate(coder.encode(b["text"])):
                doc_ids.append(b["doc_id"].slice(k, 1))
                coded.append(ids)
                size += len(ids)
                if size >= shard:
                    yield flush()
                    doc_ids, coded, size, seq, before = [], [], 0, seq + 1, before + size
        if coded:
            yield flush()
        doc_ids, coded = [], []
        trim()

    ordered.select("doc_id", "text").mapInArrow(run, SCHEMA).write.mode("overwrite").parquet(path)


def _shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards of a file with the number of ids before each. The driver adds up one number for each task that wrote."""
    shards = spark.read.parquet(path)
    total = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    sizes = shards.select("part", (F.col("before") + total).alias("n")).groupBy("part").agg(F.max("n").alias("n"))
    at, starts = 0, []
    for part, n in sorted((r.part, r.n) for r in sizes.collect()):
        starts.append((part, at))
        at += n
    known = spark.createDataFrame(pa.table({"part": pa.array([p for p, _ in starts], pa.int32()), "start": pa.array([n for _, n in starts], pa.int64())}))
    columns = ["doc_ids", "n_tokens", "symbols", "base", "rules", "lengths", "sequence"]
    return shards.join(F.broadcast(known) if len(starts) < 100_000 else known, "part").select(*columns, (F.col("start") + F.col("before")).alias("before"))


def lookup(spark: SparkSession, path: str, doc_ids: list[int], low: int = 0, high: int | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before), ids (low to high of them) of some documents, each decoded alone."""
    wanted = frozenset(doc_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                begins = np.cumsum([0, *r["n_tokens"]]).tolist()
                found = [(d, begins[k] + r["before"], part_of(r, k, low, high).tolist()) for k, d in enumerate(r["doc_ids"]) if d in wanted]
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*found) if found else ((), (), ()), (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["doc_id", "start", "ids"])

    here = _shards(spark, path).where(F.arrays_overlap("doc_ids", F.array(*map(F.lit, sorted(wanted))).cast("array<bigint>")))
    return here.mapInArrow(run, "doc_id long, start long, ids array<long>")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Of each shard: doc_ids, where each begins and ends, all ids, ids before the shard."""
    for b in batches:
        for k in range(b.num_rows):
            ids = expand(np.frombuffer(b["sequence"][k].as_buffer(), "<u4"), b["base"][k].as_py(), np.frombuffer(b["rules"][k].as_buffer(), "<u4").reshape(-1, 2))
            n = b["n_tokens"][k].values.to_numpy()
            ends = np.cumsum(n)
            yield b["doc_ids"][k].values, ends - n, ends, ids, b["before"][k].as_py()


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), ids (an array) of each document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, begins, ends, ids, before in _decoded(batches):
            for k in range(0, len(ends), 512):
                lo, hi = begins[k], ends[min(k + 512, len(ends)) - 1]
                lists = pa.ListArray.from_arrays(pa.array(np.append(begins[k : k + 512], hi) - lo, pa.int32()), pa.array(ids[lo:hi].astype(np.int64)))
                yield pa.record_batch([doc_ids.slice(k, 512), pa.array(begins[k : k + 512] + before), lists], ["doc_id", "start", "ids"])

    return _shards(spark, path).mapInArrow(run, "doc_id long, start long, ids array<long>")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, begins, ends, ids, before in _decoded(batches):
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(begins.tolist(), ends.tolist(), strict=True)]
            yield pa.record_batch([doc_ids, pa.array(begins + before), pa.array(ends - begins), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _shards(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    import uuid

    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
