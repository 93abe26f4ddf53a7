"""Commits of several writers, failures between writes, job claims, and the dictionary on top of them."""

import threading

import pytest
from pyspark.sql import functions as F

from lexspark.operators import dictionary, jobs, review, versions
from lexspark.operators.versions import Change, Store, Table

TABLES = {"kv": Table("k string, v int", ("k",)), "log": Table("k string")}


def kv(store):
    return {r.k: r.v for r in store.table("kv").collect()}


def test_snapshots_marks_and_folding(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "MOST_PARTS", 4)
    s = Store(spark, str(tmp_path / "s"), TABLES)
    assert s.version() == 0 and kv(s) == {}
    want, old = {}, {}
    for i in range(8):
        rows = spark.createDataFrame([("a", i), (f"k{i}", i)], TABLES["kv"].schema)
        gone = spark.createDataFrame([(f"k{i - 1}",), ("none",)], "k string")
        v = s.update(lambda now, rows=rows, gone=gone, i=i: Change({"kv": rows, "log": rows.select("k")}, {"kv": gone}, {"n": i}))
        want = {"a": i, f"k{i}": i}
        old[v] = dict(want)
        assert kv(s) == want
    assert s.version() > 8  # folded in between
    assert all({r.k: r.v for r in s.table("kv", v).collect()} == w for v, w in old.items())
    assert s.snapshot().marks == {"n": 7} and s.table("log").count() == 16
    assert s.update(lambda now: None) == s.version()
    s.clean(1)
    assert kv(s) == want and s.table("log").count() == 16 and len(s.files.names("_commits")) == 1
    with pytest.raises(ValueError):
        s.update(lambda now: Change(drop={"log": now.table("log")}))


def test_writers_of_one_key_follow_each_other(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), TABLES)

    def add(now):
        t = now.table("kv").where("k = 'n'").select("k", F.col("v") + 1)
        one = spark.createDataFrame([("n", 1)], TABLES["kv"].schema)
        return Change({"kv": t.toDF("k", "v").union(one).groupBy("k").agg(F.max("v").alias("v"))})

    def work():
        for _ in range(4):
            s.update(add, ["n"])

    threads = [threading.Thread(target=work) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert kv(s) == {"n": 12}


def test_conflicts_are_by_key(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), TABLES)
    row = lambda k, v: spark.createDataFrame([(k, v)], TABLES["kv"].schema)
    calls = []

    def slow(key):
        def change(now):
            calls.append(key)
            if len(calls) == 1:  # another writer comes first
                s.update(lambda now: Change({"kv": row("x", 7)}), ["x"])
            return Change({"kv": row(key, now.table("kv").count())})

        return change

    s.update(slow("y"), ["y"])
    assert calls == ["y"] and kv(s) == {"x": 7, "y": 0}
    calls.clear()
    s.update(slow("x"), ["x"])
    assert calls == ["x", "x"] and kv(s)["x"] == 2
    with pytest.raises(versions.Conflict):
        s.update(lambda now: s.update(lambda n: Change({"kv": row("x", 1)}), ["x"]) and Change({"kv": row("x", 2)}), ["x"], tries=2)


def test_jobs_are_claimed_once(spark, tmp_path):
    q = jobs.Queue(spark, str(tmp_path / "q"))
    q.add(spark.range(1000).select("id"))
    q.add(spark.range(500, 1000).select("id"))
    got: dict[str, list[str]] = {"a": [], "b": []}

    def work(name):
        while True:
            token, ids = q.claim(name, 250, 3600)
            if not ids:
                return
            got[name] += ids
            q.settle(token, spark.createDataFrame([(i, "broken" if i.endswith("7") else None) for i in ids], "id string, error string"))

    threads = [threading.Thread(target=work, args=(n,)) for n in got]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not set(got["a"]) & set(got["b"]) and len(set(got["a"] + got["b"])) == 1000
    assert {r.state: r["count"] for r in q.states().groupBy("state").count().collect()} == {"done": 900, "failed": 100}


def test_a_dead_lease_returns(spark, tmp_path):
    q = jobs.Queue(spark, str(tmp_path / "q"))
    q.add(spark.createDataFrame([("a",), ("b",)], "id string"))
    dead, ids = q.claim("dead", 2, 60, now=1000.0)
    assert ids == ["a", "b"] and q.claim("late", 2, 60, now=1059.0)[1] == []
    token, ids = q.claim("next", 1, 60, now=1060.0)
    assert ids == ["a"]
    done = spark.createDataFrame([("a", None), ("b", None)], "id string, error string")
    q.settle(dead, done.where("id = 'a'"))  # too late: the job is another one's
    assert {r.id: (r.state, r.worker, r.tries) for r in q.states().collect()} == {"a": ("claimed", "next", 2), "b": ("claimed", "dead", 1)}
    q.settle(token, done)
    assert {r.id: r.state for r in q.states().collect()} == {"a": "done", "b": "claimed"}


SENSE = "id string, form string, position int, definition string, pos string, morph_base string, morph_relation string, model string"


def senses(spark, rows):
    return spark.createDataFrame([(*r, *(None,) * (8 - len(r))) for r in rows], SENSE)


def filled(spark, path):
    d = dictionary.opened(spark, str(path))
    rows = [("r1", "run", 1, "to move"), ("r2", "run", 2, "a race"), ("R1", "Run", 1, " TO MOVE"), ("R2", "Run", 2, "a place"), ("f1", "FOO", 1, "x"), ("f2", "Foo", 1, "X "), ("f3", "Foo", 2, "y"), ("c1", "cats", 1, "many cats"), ("c2", "cats", 2, "a musical", "noun"), ("t1", "top", 1, "strong one", None, None, None, "strong")]
    s = senses(spark, rows)
    forms = sorted({r[1] for r in rows}) + ["cat", "lone"]
    dictionary.write_entries(d, spark.createDataFrame([(f, None) for f in forms], "form string, variant_of string"), s, "2024-01-01")
    at = s.select("form", F.xxhash64("id").alias("doc_id"), F.lit(3).cast("long").alias("byte_offset"), F.col("id").alias("sense_key"), F.lit(2).alias("rating"), F.lit("2024-01-02").cast("timestamp").alias("updated_at"))
    dictionary.upsert_labels(d, at)
    return d


def shown(d):
    out = {}
    for r in d.table("senses").orderBy("form", "position").collect():
        out.setdefault(r.form, []).append((r.id, r.position, r.definition, r.pos, r.morph_base, r.morph_relation, r.model))
    return out


def test_entries_are_replaced_by_id(spark, tmp_path):
    d = filled(spark, tmp_path / "d")
    new = senses(spark, [("r2", "run", 5, "a race"), ("r9", "run", 6, "new"), ("c1", "run", 7, "many cats")])
    dictionary.write_entries(d, spark.createDataFrame([("run", "Run")], "form string, variant_of string"), new, "2024-05-05")
    s = shown(d)
    assert [x[:3] for x in s["run"]] == [("r2", 1, "a race"), ("r9", 2, "new"), ("c1", 3, "many cats")]
    assert [x[0] for x in s["cats"]] == ["c2"]
    at = {r.id: str(r.updated_at)[:7] for r in d.table("senses").collect()}
    assert (at["r2"], at["r9"], at["c1"], at["R1"]) == ("2024-01", "2024-05", "2024-01", "2024-01") and "r1" not in at
    assert {r.form: r.variant_of for r in d.table("entries").collect()}["run"] == "Run"


def test_two_writers_of_an_entry(spark, tmp_path):
    """The second one's change is made of what the first one wrote; another entry's writer is not in the way."""
    d = filled(spark, tmp_path / "d")
    calls = []

    def add(name):
        def change(old):
            calls.append(name)
            if calls == ["second"]:
                dictionary.update_entries(d, ["run"], add("first"), "2024-03-03")
                dictionary.update_entries(d, ["top"], lambda old: old.limit(0), "2024-03-03")
            n = old.count()
            return old.drop("updated_at").unionByName(senses(spark, [(f"n{n}", "run", n + 1, name)]))

        return change

    dictionary.update_entries(d, ["run"], add("second"), "2024-04-04")
    assert calls == ["second", "first", "second"]
    assert [(x[0], x[2]) for x in shown(d)["run"]] == [("r1", "to move"), ("r2", "a race"), ("n2", "first"), ("n3", "second")] and "top" not in shown(d)
    assert dictionary.update_entries(d, ["run"], lambda old: None, "2025-01-01") == d.version()


def test_decisions_are_one_version(spark, tmp_path):
    d = filled(spark, tmp_path / "d")
    before = d.version()
    rows = [
        ("Run", "normalize_case", None, "run", None, None, None), ("FOO", "normalize_case", None, "foo", None, None, None), ("Foo", "normalize_case", None, "foo", None, None, None),
        ("lone", "delete_entry", None, "noise", None, None, None), ("top", "delete_entry", None, "weak hand", None, None, None), ("ghost", "delete_entry", None, "no entry", None, None, None),
        ("cats", "morph_redirect", 1, None, "cat", "plural", True), ("cats", "morph_redirect", 2, "Plural of dog.", "dog", "plural", True), ("cats", "update_pos", 2, "verb", None, None, None), ("cats", "rewrite", 9, "no such sense", None, None, None),
        ("run", "rewrite", 2, "a contest", None, None, None), ("run", "prune", 1, None, None, None, None), ("top", "rewrite", 1, "overruled", None, None, None), ("top", "prune", 1, None, None, None, None), ("run", "sing", 1, None, None, None, None),
    ]
    v = dictionary.apply_decisions(d, spark.createDataFrame(rows, dictionary.DECISIONS), "weak", "2024-06-06")
    assert v == before + 1
    s = shown(d)
    assert sorted(s) == ["cat", "cats", "foo", "run", "top"]
    assert [x[:3] for x in s["foo"]] == [("f1", 1, "x"), ("f3", 2, "y")]
    assert s["run"] == [("r2", 1, "a contest", None, None, None, "weak")]
    assert s["cats"] == [("c1", 1, "Plural of cat.", None, "cat", "plural", "weak"), ("c2", 2, "a musical", "verb", None, None, "weak")]
    assert [x[1:] for x in s["cat"]] == [(1, "many cats", None, None, None, None)]
    assert s["top"][0][2] == "strong one"
    assert sorted(r.form for r in d.table("entries").collect()) == ["cat", "cats", "foo", "run", "top"]
    assert {(r.form, r.sense_key) for r in d.table("labels").collect()} == {("run", "r2"), ("cats", "c1"), ("cats", "c2"), ("top", "t1")}
    assert [tuple(r) for r in d.table("blocked").collect()] == [("lone", "noise")]
    # the same again changes nothing but what a form that is left lets through
    dictionary.apply_decisions(d, spark.createDataFrame([r for r in rows if r[0] in ("Run", "FOO", "lone", "ghost")], dictionary.DECISIONS), "weak", "2024-07-07")
    assert shown(d) == s


def test_reviews_end_in_the_dictionary(spark, tmp_path):
    """Decisions of reviewers, as events, applied as one version: induction, phrases and operations on senses."""
    d = filled(spark, tmp_path / "d")
    ops = [("cats", [("morph_redirect", 1, "cat"), ("update_pos", 2, "verb"), ("prune", 7, None)]), ("Run", [("normalise", 1, "run")]), ("lone", [("delete_entry", None, "noise")]), ("top", [("delete_entry", None, "x"), ("prune", 1, None)])]
    phrases = spark.createDataFrame([("new one", "approve", ["first", " FIRST ", "second", ""]), ("run", "approve", ["a Race", "third"]), ("later", "approve", []), ("bad", "blocklist", [])], "form string, verdict string, definitions array<string>")
    reviews = spark.createDataFrame(ops, f"form string, ops {review.OPS}").unionByName(review.phrases(phrases))
    v = dictionary.apply_decisions(d, dictionary.from_events(review.events(reviews, d.table("senses"))), "strong", "2024-06-06")
    assert v == d.version() and v == 3
    s = shown(d)
    assert [x[1:3] for x in s["new one"]] == [(1, "first"), (2, "second")] and [x[1:3] for x in s["run"]] == [(1, "to move"), (2, "a race"), (3, "third")]
    assert [(x[2], x[4]) for x in s["cats"]] == [("many cats", "cat"), ("a musical", None)] and [x[2] for x in s["cat"]] == ["many cats"] and s["cats"][1][3] == "verb"
    assert "Run" not in s and s["top"][0][2] == "strong one"
    forms = {r.form for r in d.table("entries").collect()}
    assert "new one" in forms and not {"lone", "Run", "later", "bad"} & forms
    assert {(r.form, r.reason) for r in d.table("blocked").collect()} == {("lone", "noise"), ("bad", "deleted")}


def test_a_failure_leaves_the_version_before(spark, tmp_path, monkeypatch):
    """Each write of a change to two tables fails once, the commit last; the change is then made again."""
    write, create = Store._write, versions.Files.create
    for at in range(4):
        s = Store(spark, str(tmp_path / f"s{at}"), TABLES)
        row = lambda v: spark.createDataFrame([("a", v)], TABLES["kv"].schema)
        change = lambda v: lambda now: Change({"kv": row(v), "log": row(v).select("k")}, marks={"v": v})  # noqa: B023, E731
        s.update(change(1))
        left = [at]

        def failing(real, left=left):
            def call(self, *a):
                left[0] -= 1
                if left[0] == -1:
                    raise OSError("lost")
                return real(self, *a)

            return call

        monkeypatch.setattr(Store, "_write", failing(write))
        monkeypatch.setattr(versions.Files, "create", failing(create))
        if at < 3:
            with pytest.raises(OSError):
                s.update(change(2))
            assert kv(s) == {"a": 1} and s.table("log").count() == 1 and s.snapshot().marks == {"v": 1}
        monkeypatch.undo()
        s.update(change(2))
        assert kv(s) == {"a": 2} and s.table("log").count() == 2
