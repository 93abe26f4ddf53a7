"""Periodic runs against every period of every place."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from lexspark.llm import queries, runs

SCHEMA = "doc_id long, text string, n_runs string, k string"


def brute(w: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    n, out = len(w), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            size = j - i + p
            if j > i and size >= max(6, 4 * p) and not any(w[i + q : i + size] == w[i : i + size - q] for q in range(1, p)):
                out.append((i, size, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id: int | None, text: str | None) -> tuple:
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(found), *top, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def texts(rnd: random.Random) -> list[str]:
    """Words of a few letters with blocks that repeat, also inside copies of longer passages."""
    out = []
    for _ in range(150):
        w = [rnd.choice("abcde"[: rnd.choice([1, 2, 3, 5])]) for _ in range(rnd.randint(0, 60))]
        block = [rnd.choice("abé") for _ in range(rnd.randint(1, 7))] * rnd.randint(1, 9)
        at = rnd.randrange(len(w) + 1)
        w = w[:at] + block + w[at:]
        out.append(" ".join(w * rnd.choice([1, 1, 2, 3])))
    return out


def test_query_equals_brute_force(spark, tmp_path):
    own = texts(random.Random(5)) + ["", " \t\n", "a", "a a a a a", "a a a a a a", "x\x0by\x0cx y\rx y x\ty", "a b a b " * 4]
    rows = [(i, t, "x", "y") for i, t in enumerate(own)] + [(None, "q r " * 9, "x", "y"), (None, None, None, None), (3, own[3], "x", "y"), (3, own[3], "x", "y")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_runs(spark, str(tmp_path)).collect()
    want = [(r[0], *expected(r[0], r[1])) for r in rows]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(r[1] > 0 for r in want) > 50


def test_batches_do_not_matter(spark, monkeypatch):
    rows = [(i, t, None, None) for i, t in enumerate(texts(random.Random(6)))]
    docs = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(map(tuple, runs.periodic_runs(docs).collect()))
    lens = np.array([len(t.split()) for _, t, _, _ in rows])
    assert lens.max() > 60 and len(whole) == len(rows)
    one = []
    for i, t, _, _ in rows:
        x = np.unique(t.split(), return_inverse=True)[1]
        s, e, p = runs.runs(x, np.zeros(len(x), np.int64))
        one.append((i, [(int(a), int(b - a), int(c)) for a, b, c in zip(s, e, p, strict=True)]))
    assert [(r[0], r[1]) for r in whole] == [(i, len(f)) for i, f in one]
    assert all(f == brute(rows[i][1].split()) for i, f in one)


def test_real_outputs_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "to be to be to be to be or not", None, None)], SCHEMA)
    assert runs.periodic_runs(docs).first()["collapsed"] == "to be or not"
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_long_texts(spark):
    rnd = random.Random(7)
    base = [str(rnd.randrange(50)) for _ in range(30_000)]
    cases = [["a"] * 200_000, base * 4, (base[:7] * 5_000) + base, [w for i in range(400) for w in ["x"] * (i % 9) + ["y"]]]
    rows = [(i, " ".join(w), None, None) for i, w in enumerate(cases)]
    got = {r.doc_id: r for r in runs.periodic_runs(spark.createDataFrame(rows, SCHEMA).withColumn("more", F.lit(1))).collect()}
    assert (got[0].n_runs, got[0].start, got[0].length, got[0].period, got[0].collapsed) == (1, 0, 200_000, 1, "a")
    assert (got[1].start, got[1].length, got[1].period) == (0, 120_000, 30_000)
    assert (got[2].start, got[2].period) == (0, 7) and got[2].length >= 35_000
    assert got[3].n_runs == len(brute(cases[3]))
