"""Repeats in rows that share an id or have none."""

import random
from collections import Counter

from lexspark.llm import suffixes


def test_rows_without_or_of_one_id(spark):
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("abcdefghijklmnop ") for _ in range(n))
    part = text(300)
    clean, twice = [text(120), text(2000), text(90), ""], text(150)
    rows = [(None, clean[0]), (None, text(700) + part + text(200)), (None, clean[1]), (None, None), (5, clean[2]), (5, text(40) + part + text(900)), (5, clean[3]), (None, twice), (None, twice), (9, text(500) + twice)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    first = next(t for _, t in rows if t and part in t)
    want = Counter((i, (t or "").replace(part, "") if i == 5 and t != first else (t or "").replace(twice, "") if i == 9 else t or "") for i, t in rows)
    got = suffixes.remove_repeats(df).collect()
    assert Counter((r.doc_id, bytes(r.kept).decode()) for r in got) == want
    assert sum(r.n_removed for r in got) == len(part) + len(twice)
    out = suffixes.without_repeats(df).collect()
    assert Counter((r.doc_id, r.text or "") for r in out) == want


def test_order_among_rows_without_id(spark):
    rnd = random.Random(4)
    part = "".join(rnd.choice("abcdefgh ") for _ in range(400))
    rows = [(None, part + str(i) * 30) for i in range(5)]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(r.n_removed for r in got) == [0] + [400] * 4


def test_small_buckets_and_windows(spark, monkeypatch):
    """Anchors held in many small pieces give the bytes of brute force."""
    for name, value in (("BUCKET", 500), ("WINDOWS", 3), ("FLUSH", 50)):
        monkeypatch.setattr(suffixes, name, value)
    rnd = random.Random(6)
    text = lambda n: "".join(rnd.choice("abcdefghijklmnop ") for _ in range(n))
    parts = [text(rnd.randrange(90, 300)) for _ in range(6)]
    rows = [(i, "".join(rnd.choice(parts)[rnd.randrange(20) :] + text(rnd.randrange(0, 60)) for _ in range(4))) for i in range(40)]
    seen, want = set(), {}
    for i, t in rows:
        gone = [False] * len(t)
        for at in range(len(t) - 99):
            if t[at : at + 100] in seen:
                gone[at : at + 100] = [True] * 100
            seen.add(t[at : at + 100])
        want[i] = "".join(c for c, g in zip(t, gone, strict=True) if not g)
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: bytes(r.kept).decode() for r in got} == want
