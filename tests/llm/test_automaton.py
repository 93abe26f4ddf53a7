"""The automaton against a literal one: states, failure arcs, one walk from left to right."""

import collections
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lexspark.llm import lm

rnd = random.Random(9)
VOCAB = [f"w{i}" for i in range(25)] + ["A", "Ä", "x," * 30]


def _rows():
    texts = [None, "", " \t\n", "one", "one one one one"] + [" ".join(rnd.choice(VOCAB) for _ in range(rnd.randrange(1, 40))) for _ in range(60)]
    texts += texts[5:12] + [texts[6].upper(), "w1 " * 500]
    rows = [(i * 3, t, "t") for i, t in enumerate(texts)]
    return rows + [(9007199254740993, "w1 w2", "t"), (None, "w1 w3 w4", "t"), (None, None, "t"), (3, "w1 w2 again", "t")]


class Literal:
    """States by history, arcs with counts, and failure arcs, kept in dictionaries."""

    def __init__(self, texts):
        self.arcs = collections.defaultdict(collections.Counter)
        for t in texts:
            for i, w in enumerate(t):
                self.arcs[()][w] += 1
                self.arcs[(t[i - 1] if i else "<s>",)][w] += 1
                if i:
                    self.arcs[(t[i - 2] if i > 1 else "<s>", t[i - 1])][w] += 1
        self.n, self.v = sum(self.arcs[()].values()), len(self.arcs[()])

    def step(self, state, w):
        """Probability of w from a state."""
        if not state:
            return (self.arcs[()][w] + 1) / (self.n + self.v + 1)
        out, back = self.arcs.get(state, {}), lm.BACK[len(state) - 1]
        left = sum(out.values())
        if w in out:  # the arc
            return (out[w] + back * self.step(state[1:], w)) / (left + back)
        return back / (left + back) * self.step(state[1:], w)  # the failure arc

    def walk(self, text):
        state, total = ("<s>",), 0.0
        for w in text:
            total += math.log10(self.step(state, w))
            state = (*state, w)[-2:]
            while state and state not in self.arcs:  # the longest seen end
                state = state[1:]
        return total


def _tokens(t):
    return (t or "").encode().lower().split() + [None]


@pytest.mark.parametrize(("block", "bucket"), [(lm.BLOCK, lm.BUCKET), (300, 100)])
def test_walk(spark, monkeypatch, block, bucket):
    monkeypatch.setattr(lm, "BLOCK", block)
    monkeypatch.setattr(lm, "BUCKET", bucket)
    rows = _rows()
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(True))
    own = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _, _ in rows]
    d = spark.createDataFrame(rows, "doc_id long, text string, id string").repartition(3)
    a = Literal([_tokens(t) for (_, t, _), k in zip(rows, own, strict=True) if k])
    want = []
    for (i, t, _), k in zip(rows, own, strict=True):
        w = _tokens(t)
        c = [a.arcs[()][x] for x in w]
        want.append((i, not k, len(w), sum(x > 0 for x in c), a.n, sum(math.log10((x + 1) / (a.n + a.v + 1)) for x in c), a.walk(w)))
    got = sorted(map(tuple, lm.score(d, train).collect()), key=str)
    for g, x in zip(got, sorted(want, key=str), strict=True):
        assert g[:5] == x[:5] and math.isclose(g[5], x[5], rel_tol=1e-9) and math.isclose(g[6], x[6], rel_tol=1e-9)


def test_arcs_and_failure_arc_sum_to_one():
    texts = [_tokens(" ".join(rnd.choice(VOCAB) for _ in range(30))) for _ in range(20)]
    a = Literal(texts)
    for state in [(), ("<s>",), (b"w1",), (b"w1", b"w2"), ("<s>", b"w3"), (b"none",)]:
        assert math.isclose(sum(a.step(state, w) for w in a.arcs[()]) + a.step(state, "unknown"), 1.0, rel_tol=1e-9)


def test_empty_table_and_no_training(spark):
    d = spark.createDataFrame(_rows(), "doc_id long, text string, id string")
    assert lm.score(d.limit(0), F.lit(True)).count() == 0
    r = lm.score(d, F.lit(False)).agg(F.sum("n_known"), F.max("train_tokens"), F.max("score")).first()
    assert tuple(r) == (0, 0, 0.0)


def test_hashes_are_packed_whole():
    import numpy as np

    for h in (np.array([], np.uint64), np.array([0, 64, 2**63, 2**64 - 64], np.uint64), np.array([5], np.uint64)):
        for shift in (0, 6):
            own = h & ~np.uint64((1 << shift) - 1)
            w = lm.Writer()
            w.hashes(own, shift)
            w.squeezed(own.astype("<u4"))
            r = lm.Reader(w.bytes())
            assert r.hashes(shift).tolist() == own.tolist() and len(r.squeezed("<u4")) == len(h)
