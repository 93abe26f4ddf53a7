"""Cases that earlier forms of the operators got wrong."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.llm import embeddings, host_rules, langid, sharding

rnd = random.Random(11)


def test_long_text_keeps_its_history(monkeypatch):
    sample = {k: ["".join(rnd.choice(a) for _ in range(400)) for _ in range(5)] for k, a in {"x": "abc ", "y": "bcd "}.items()}
    m, text = langid.fit(sample), "abc bcd ABC dcb " * 20
    whole, n = m.entropy([text, "a", text[:50]])
    monkeypatch.setattr(langid, "PART", 7)
    parts, k = m.entropy([text, "a", text[:50]])
    assert np.allclose(whole, parts, atol=1e-5) and n.tolist() == k.tolist() == [320, 1, 50]


def test_kneser_ney_against_brute_force():
    texts = ["abracadabra abba", "bab ab a", "cab"]
    m = langid.fit({"x": texts, "y": ["zzz zz"]})
    counts = {4: collections.Counter()}
    for t in texts:
        p = [langid.START] * 3 + [ord(c) for c in t]
        counts[4].update(tuple(p[i : i + 4]) for i in range(len(t)))
    for n in (3, 2, 1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])

    def prob(g):
        if not g:
            return 1 / langid.ALPHABET
        same = [c for h, c in counts[len(g)].items() if h[:-1] == g[:-1]]
        low = prob(g[1:])
        return max(counts[len(g)][g] - 0.75, 0) / sum(same) + 0.75 * len(same) / sum(same) * low if same else low

    for t in ["abba cab", "xyz", "b", "abracadab zz"]:
        p = [langid.START] * 3 + [ord(c) for c in t]
        want = -sum(math.log2(prob(tuple(p[i : i + 4]))) for i in range(len(t))) / len(t)
        assert abs(m.entropy([t])[0][0, 0] - want) < 1e-4


def test_language_of_long_texts_only_is_learned(spark):
    rows = [(1, "la lo li " * 400, "aa"), (2, "zx qw kj " * 400, "bb"), (3, None, "cc"), (4, "text", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sample_of(d, F.lit(True), "text", "lang", "doc_id", 100)
    assert {k: [len(t) for t in v] for k, v in got.items()} == {"aa": [100], "bb": [100]}


def test_slots_do_not_follow_the_file_split(spark, tmp_path):
    rows = [(i, f"text {i % 50}") for i in range(400)] + [(7, "same")] * 30 + [(None, None)] * 20
    d = spark.createDataFrame(rows, "doc_id long, text string")
    maps = str(tmp_path / "maps")
    one, first = sharding.shard(d.repartition(2), maps=maps)
    two, other = sharding.shard(d.repartition(5))
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, two.collect()), key=str)
    by = collections.defaultdict(list)
    for r in one.collect():
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    more, third = sharding.shard(d, n_shards=9, maps=maps)
    assert (first.version, other.version, third.version) == (1, 1, 2) and third.n_shards == 9
    assert sharding.SlotMap.load(spark, maps, 1) == first and {r.map_version for r in more.collect()} == {2}
    # a second computation of the map: slots stay but for those that a shard above the mean gives up
    size = collections.Counter()
    for r in more.collect():
        size[r.virtual_slot] += r.size
    assert first.rebalanced(dict(size), 9) == third
    load = collections.Counter()
    for slot, n in size.items():
        load[third.shards[slot]] += n
    assert max(load.values()) - min(load.values()) <= max(size.values())


@pytest.mark.parametrize("kinds", [1, 3, 500])
def test_equal_hashes_are_not_equal_windows(spark, monkeypatch, kinds):
    weak = f"shiftleft(pmod({host_rules.HASH}, {kinds}L), 40)"
    monkeypatch.setattr(host_rules, "HASH", weak)
    texts = [" ".join(f"w{rnd.randrange(k)}" for _ in range(n)) for n, k in [(60, 1000), (80, 30), (100, 12), (3, 2), (4, 1), (5, 1), (90, 4)] for _ in range(6)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("h"))
    got = {r.doc_id: r.n_repeat_words for r in host_rules.judge(d).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"\S+", t)
        tri = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        assert got[i] == len({j + k for j in range(len(w) - 2) if tri[tuple(w[j : j + 3])] > 1 for k in range(3)}), t


def _links(rows):
    """Brute force: links and components of (id, vector)."""
    ok = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    ids, links, comp = list(ok), collections.Counter(), {i: i for i, _ in rows}
    for a in ids:
        for b in ids:
            u, v = ok[a], ok[b]
            if a < b and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.9:
                links[a] += 1
                links[b] += 1
                lo, hi = sorted((comp[a], comp[b]))
                comp = {k: lo if c == hi else c for k, c in comp.items()}
    return {i: (links[i], comp[i]) for i, _ in rows}


def test_vectors_of_all_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [2.0, 4.0]), (4, [2.0, -1.0]), (5, [3.0]), (6, [0.5]), (7, [-1.0]), (8, [1.0, 2.0, 3.0])]
    base = rng.normal(size=(10, 4))
    rows += [(100 + i, (base[i % 10] + rng.normal(size=4) * 0.2).tolist()) for i in range(60)]
    rows += [(200, None), (201, []), (202, [0.0, 0.0]), (203, [None, 1.0]), (204, [float("nan"), 1.0])]
    d = spark.createDataFrame([(i, v, "t", 0.5) for i, v in rows], "vec_id long, embedding array<double>, tile string, x double").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(d, tile=16).collect()}
    want = _links(rows)
    assert got == want
    assert got[1] == (2, 1)


def test_vector_without_an_id(spark):
    d = spark.createDataFrame([(None, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.1])], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(d).collect()}
    assert got == {None: (0, None, True), 2: (1, 2, True), 3: (1, 2, False)}
