"""Near-duplicates in a dense group with many pairs just below the similarity."""

import random

import pytest
from pyspark.sql import functions as F

from lexspark.llm import minhash


def _group(n, edits, seed=1):
    rnd, docs = random.Random(seed), []
    for i in range(n):
        words = [f"w{k}" for k in range(150)]
        for k in rnd.sample(range(150), rnd.choice(edits)):
            words[k] = f"x{i}_{k}"
        docs.append((i, " ".join(words)))
    return docs


def _brute(docs):
    sets = [{tuple(w[j : j + 4]) for j in range(len(w) - 3)} for w in (t.split() for _, t in docs)]
    least = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((least[a], least[b]))
                least = [x if c == y else c for c in least]
    return dict(enumerate(least))


@pytest.mark.parametrize(("depth", "block", "guests"), [(1, 2000, 1 << 15), (minhash.DEPTH, 4000, 20), (0, minhash.BLOCK, minhash.GUESTS)])
def test_dense_group(spark, monkeypatch, depth, block, guests):
    """Nodes that stay large at full depth give the components of brute force."""
    for name, value in (("SMALL", 3), ("DEPTH", depth), ("BLOCK", block), ("GUESTS", guests)):
        monkeypatch.setattr(minhash, name, value)
    docs = _group(150, [1, 3, 5, 6])
    out = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4).collect()
    assert {r.doc_id: r.component_id for r in out} == _brute(docs)


def test_rows_of_a_dense_group_grow_in_proportion(spark, monkeypatch):
    """Pairs below the similarity: twice the group makes about twice the rows, with production values."""
    rows, stored = {}, minhash.stored

    def counted(df, name):
        out = stored(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(minhash, "stored", counted)
    seen = []
    for n in (1000, 2000, 4000):
        rows.clear()
        docs = spark.createDataFrame(_group(n, [6, 7, 8]), "doc_id long, text string")
        minhash.near_duplicates(docs, 4).agg(F.count("*")).collect()
        seen.append(dict(rows))
    for less, more in zip(seen, seen[1:]):
        for name in ("calls", "asked", "nodes", "pairs", "links"):
            assert more.get(name, 0) <= 2.5 * less.get(name, 0) + 500, (name, seen)


def test_common_shingles_are_counted_by_matrix():
    """Hosts and guests share what sets share, of common shingles and of rare ones."""
    import numpy as np

    rng = np.random.default_rng(2)
    draw = lambda: np.unique(np.concatenate([np.arange(90)[rng.random(90) < 0.9], rng.integers(1000, 3000, 40)])).astype(np.uint64)
    hosts, guests = [(i, i, draw()) for i in range(300)], [draw() for _ in range(9)]
    table = minhash._Hosts(hosts)
    assert table.dense.shape[1] > 50 and (table.column < 0).any()
    assert table.shared(guests).tolist() == [[len(set(u.tolist()) & set(h[2].tolist())) for h in hosts] for u in guests]
