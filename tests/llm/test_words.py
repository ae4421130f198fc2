"""Words as flat arrays against Python's own splitting."""

import numpy as np
import pyarrow as pa
import pytest

from reprise.llm import words as W

TEXTS = ["", " ", "a", "a b", "  é ü\tb\n", "x", "", "a", " one two three", "b" * 3_000_000 + " a " + "c" * 900_000, "a b " * 700_000, "\x1c\x85 a"]


@pytest.mark.parametrize("at", [0, 3])
def test_words(at):
    column, seen = pa.array(["skipped", *TEXTS])[1:][at:], {}
    rows = []
    for w in W.chunks(column):
        h = w.hashes()
        for i in range(w.rows.stop - w.rows.start):
            a, e = w.first[i], w.first[i + 1]
            mine = [w.data[s:t].tobytes() for s, t in zip(w.starts[a:e].tolist(), w.ends[a:e].tolist())]
            rows.append(mine)
            assert w.text(i).decode() == column[w.rows.start + i].as_py()
            for x, y in zip(mine, h[a:e].tolist()):
                assert seen.setdefault(x, y) == y
        assert (w.left() == np.concatenate([np.arange(n, 0, -1) for n in np.diff(w.first)] or [[]])).all()
    assert rows == [t.encode().split() for t in column.to_pylist()]
    assert len(set(seen.values())) == len(seen)


def test_grams_and_least():
    x = np.random.default_rng(1).integers(0, 1 << 62, 50).astype(np.uint64)
    for n in (1, 2, 5, 13, 20):
        g = W.grams(x, n)
        want = [sum(int(v) * pow(W.MULTIPLIER, k, 1 << 64) for k, v in enumerate(x[i : i + n])) % (1 << 64) for i in range(len(x) - n + 1)]
        assert g.tolist() == want
        assert W.least(x, n).tolist() == [min(x[i : i + n]) for i in range(len(x) - n + 1)]
        assert W.least(x, n, np.maximum).tolist() == [max(x[i : i + n]) for i in range(len(x) - n + 1)]
    assert len(W.grams(x[:3], 5)) == 0
