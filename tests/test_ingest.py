"""Ingestion against a sequential pass, with failures after every write; event streams against a replay."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lexspark.operators import dedup, state
from lexspark.operators.versions import Files, Store
from lexspark.sources import etl, readers, sinks
from lexspark.streaming import events


def grams(text):
    w = text.split()
    return [" ".join(w[i : i + 8]) for i in range(len(w) - 7)]


def sequential(texts, seed=()):
    """Which texts a pass in order accepts."""
    indexed, out = set(seed), []
    for t in texts:
        g = grams(t)
        ok = not g or sum(x in indexed for x in g) / len(g) < 0.05
        if ok:
            indexed.update(g[::10])
        out.append(ok)
    return out


def corpus(rnd, n):
    """Texts of which many repeat parts of others, and half hold one passage."""
    line = " ".join(f"common{i}" for i in range(9))
    out = []
    for i in range(n):
        w = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.randint(0, 120))]
        if out and rnd.random() < 0.6:
            other = out[rnd.randrange(max(0, len(out) - 15), len(out))].split()
            a = rnd.randrange(len(other) + 1)
            w[rnd.randrange(len(w) + 1) :] = other[a : a + rnd.randint(5, 60)]
        if i % 2:
            w = w + line.split() + [f"v{rnd.randrange(10**6)}" for _ in range(80)]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("last", [0, 10**6])
def test_greedy_equals_the_sequential_pass(spark, monkeypatch, last):
    monkeypatch.setattr(dedup, "LAST_ROWS", last)
    texts = corpus(random.Random(3), 500 if last else 120)
    seed = grams(texts[40])[::3]
    docs = spark.createDataFrame([(i * 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    hashed = spark.createDataFrame([(g,) for g in seed], "t string").select(F.substring(F.sha2("t", 256), 1, 16).alias("g"))
    got = {r.doc_id: r.accepted for r in dedup.greedy(docs, seed=hashed).collect()}
    want = sequential(texts, seed)
    assert [got[i * 2] for i in range(len(texts))] == want and 0.2 < sum(want) / len(want) < 0.95


def test_a_gram_of_all_documents_makes_rows_in_proportion(spark, monkeypatch):
    made = []
    real = dedup.stored
    monkeypatch.setattr(dedup, "stored", lambda df, name: (lambda t: (made.append(t.count()), t)[1])(real(df, name)))
    sizes = []
    for n in (100, 200):
        line = " ".join(f"c{i}" for i in range(12))
        docs = spark.createDataFrame([(i, line + " " + " ".join(f"d{i}_{j}" for j in range(60))) for i in range(n)], "doc_id long, text string")
        made.clear()
        dedup.greedy(docs).count()
        sizes.append(max(made))
    assert sizes[1] <= 2 * sizes[0]


PAGES = [" ".join(f"word{i}" for i in range(a, a + 60)) for a in (0, 70, 140, 210, 280, 350)]


def source(tmp_path):
    texts = [PAGES[0], PAGES[1], PAGES[0], PAGES[0] + " and more at its end", "short", PAGES[2], PAGES[1] + " x", PAGES[3], PAGES[1] + " x", PAGES[4], PAGES[5]]
    rows = [{"title": f"t{i:02}", "text": t, "year": 2000, "author": None, "source": "s", "source_url": None} for i, t in enumerate(texts)]
    (tmp_path / "pages.jsonl").write_text("\n".join(map(json.dumps, rows)))
    return readers.Source("s", "jsonl", str(tmp_path / "pages.jsonl"), "https://example.org/")


def state_of(store):
    docs = sorted((r.title, r.source_url) for r in store.table("corpus").collect())
    return docs, sorted(r.g for r in store.table("grams").collect()), etl.cursor(store, "s")


def test_augment_in_runs(spark, tmp_path):
    src = source(tmp_path)
    whole, parts = etl.opened(spark, str(tmp_path / "a")), etl.opened(spark, str(tmp_path / "b"))
    assert etl.augment(whole, src) == {"pages": 11, "new": 6, "near": 2, "exact": 2}
    assert [t for t, _ in state_of(whole)[0]] == ["t00", "t01", "t05", "t07", "t09", "t10"]
    first = etl.augment(parts, src, n_docs=2, n_pages=6)
    assert first == {"pages": 2, "new": 2, "near": 0, "exact": 0}
    assert etl.augment(parts, src, n_pages=5)["pages"] == 5
    etl.augment(parts, src)
    assert etl.augment(parts, src) == {"pages": 0, "new": 0, "near": 0, "exact": 0}
    assert state_of(parts) == state_of(whole)
    # a corpus that another source has filled counts from the first run on
    other = readers.Source("o", "jsonl", src.path, "https://example.org/")
    assert etl.augment(parts, other)["new"] == 0


def test_augment_after_a_failure_at_each_write(spark, tmp_path, monkeypatch):
    src = source(tmp_path)
    clean = etl.opened(spark, str(tmp_path / "clean"))
    etl.augment(clean, src)
    want = state_of(clean)
    write, create = Store._write, Files.create
    for at in range(6):
        store, left = etl.opened(spark, str(tmp_path / f"s{at}")), [at]

        def failing(real, left=left):
            def call(self, *a):
                left[0] -= 1
                if left[0] == -1:
                    raise OSError("lost")
                return real(self, *a)

            return call

        monkeypatch.setattr(Store, "_write", failing(write))
        monkeypatch.setattr(Files, "create", failing(create))
        try:
            etl.augment(store, src)
            broke = False
        except OSError:
            broke = True
        monkeypatch.setattr(Store, "_write", write)
        monkeypatch.setattr(Files, "create", create)
        assert broke == (at < 5)  # pages, commit; documents, grams, commit
        etl.augment(store, src)
        assert state_of(store) == want


def log(rnd, n):
    out = []
    for i in range(n):
        kind = rnd.choice(["upsert"] * 8 + ["delete_by_sense", "delete_by_form"])
        form, sense = rnd.choice("abcd"), rnd.choice(["s1", "s2", "s3", "s4", "s5"])
        key = (form, rnd.randrange(6), 0) if kind == "upsert" else (form, None, None) if kind == "delete_by_form" else (None, None, None)
        out.append((f"e{i}", kind, *key, sense if kind != "delete_by_form" else None, rnd.randrange(40), i))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_events_in_any_order_and_twice(spark, tmp_path, seed):
    rnd = random.Random(seed)
    own = log(rnd, 120)
    want = sorted(map(tuple, state.replay(spark.createDataFrame(own, events.EVENT)).collect()))
    mixed = own + rnd.sample(own, 60)
    rnd.shuffle(mixed)
    bad = [(None, "upsert", "a", 1, 0, "s1", 99, 1), ("x1", "guess", "a", 1, 0, "s1", 99, 1), ("x2", "upsert", "a", 1, 0, "s1", None, 1)]
    for i in range(3):
        spark.createDataFrame(mixed[i::3] + bad[i : i + 1], events.EVENT).coalesce(1).write.parquet(str(tmp_path / f"in/f{i}"))
    glob = str(tmp_path / "in/*")
    store = events.follow(spark, glob, str(tmp_path / "out"), files=1)
    assert store.snapshot().marks["epoch"] == 2
    got = lambda: sorted(map(tuple, store.table("labels").collect()))
    assert got() == want and len(want) > 5
    n = {}
    for r in want:
        n[r[3]] = n.get(r[3], 0) + 1
    assert {r.sense_key: r.n for r in store.table("counts").collect()} == n
    assert store.table("dead").count() == 3 and store.table("seen").count() == 120
    # new files with old events change nothing
    spark.createDataFrame(own, events.EVENT).coalesce(1).write.parquet(str(tmp_path / "in/f9"))
    events.follow(spark, glob, str(tmp_path / "out"))
    assert got() == want and store.table("seen").count() == 120


def test_late_events(spark, tmp_path):
    e = lambda i, at, sense: (f"e{i}", "upsert", "a", i, 0, sense, at, 0)
    store = Store(spark, str(tmp_path / "s"), events.TABLES)
    for rows in ([e(1, 100, "x"), e(2, 10, "x")], [e(3, 89, "x"), e(4, 90, "y"), e(5, 120, "y")], [e(1, 100, "x"), e(6, 109, "x")]):
        store.update(lambda now, rows=rows: events.applied(now, spark.createDataFrame(rows, events.EVENT), 10))
    assert {r.doc_id for r in store.table("labels").collect()} == {1, 2, 4, 5}
    assert {(r.event_id, r.reason) for r in store.table("dead").collect()} == {("e3", "late"), ("e1", "late"), ("e6", "late")}
    assert {r.event_id for r in store.table("seen").collect()} == {"e5"}


def test_a_list_is_there_whole_at_any_time(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "list")
    forms = lambda x: spark.createDataFrame([(f,) for f in x], "form string")
    read = lambda: [r.form for r in sinks.read_list(spark, path).collect()]
    sinks.write_list(forms("cab"), path, ["form"])
    monkeypatch.setattr(Files, "create", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        sinks.write_list(forms("xyz"), path, ["form"])
    assert read() == ["a", "b", "c"]
    monkeypatch.undo()
    sinks.write_list(sinks.read_list(spark, path).union(forms("d")), path, ["form"])
    assert read() == ["a", "b", "c", "d"]
