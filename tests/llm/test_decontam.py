"""Decontamination against a search of every window at every place."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lexspark.llm import decontam, queries

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def low(text: str | None) -> list[str]:
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    wins: dict[tuple, set] = {}
    for i, t in items:
        w = low(t)
        for a in range(max(len(w) - 9, min(len(w), 1))):
            wins.setdefault(tuple(w[a : a + 10]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, ids = low(t), set(), set()
        for size in {len(x) for x in wins}:
            for a in range(len(w) - size + 1):
                if (x := tuple(w[a : a + size])) in wins:
                    hit |= set(range(a, a + size))
                    ids |= wins[x] - {None}
        named = sorted(map(str, ids), key=str.encode)
        out.append((d, len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return out


def tables(seed: int, short: bool) -> tuple[list[tuple], list[tuple]]:
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "b", "Ñu", "été", "x1", "Q"])
    text = lambda n: rnd.choice([" ", ", ", "--", "\n"]).join(word() for _ in range(n))
    items = [(i, text(rnd.randint(10, 30))) for i in range(25)]
    items += [(100, items[0][1]), (2, text(12)), (None, text(15)), (101, None), (102, " .;"), (103, "")]
    if short:
        items += [(104, "été x1 x1"), (105, "q"), (106, text(9)), (107, text(6)), (108, "ÉTÉ")]
    docs = []
    for i in range(120):
        w = re.findall(r"\S+", text(rnd.randint(0, 80)))
        for _ in range(rnd.randint(0, 2)):
            part = re.findall(WORD, items[rnd.randrange(25)][1])
            a = rnd.randrange(len(part))
            at = rnd.randrange(len(w) + 1)
            w[at:at] = [x.upper() if rnd.random() < 0.3 and x.isascii() else x for x in part[a : a + rnd.randint(5, 30)]]
        docs.append((i, " ".join(w)))
    return docs + [(None, items[3][1]), (None, items[3][1]), (None, None), (1, docs[1][1]), (1, items[4][1]), (200, ""), (201, "?!")], items


@pytest.mark.parametrize(("seed", "short", "most"), [(1, False, 10**6), (2, True, 10**6), (3, True, 0)])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, seed, short, most):
    docs, items = tables(seed, short)
    monkeypatch.setattr(decontam.contaminated, "__defaults__", (*decontam.contaminated.__defaults__[:-1], most))
    extra = {"n": F.lit(1), "w": F.lit("x"), "key": F.lit(2), "size": F.lit(3)}
    spark.createDataFrame(docs, "doc_id long, text string").withColumns(extra).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").withColumns(extra).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = queries.op13_decontamination(spark, str(tmp_path)).collect()
    want = brute(docs, items)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert 20 < sum(r[5] for r in want) <= len(want) and (short or sum(r[5] for r in want) < len(want))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert [tuple(r) for r in decontam.contaminated(docs, items.limit(0)).orderBy("doc_id").collect()] == [(1, 3, 0, 0, [], False), (2, 0, 0, 0, [], False)]
    assert decontam.contaminated(docs.limit(0), items).count() == 0
    assert decontam.contaminated(docs, items).where("contaminated").select("doc_id", "n_hit", "item_ids").first()[:] == (1, 3, ["1"])


def test_rows_of_a_passage_in_all_documents_and_items(spark):
    """Rows grow with the documents, not with documents times items."""
    passage = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(i, f"x{i} {passage} y{i}") for i in range(300)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"{passage} z{i}") for i in range(100)], "item_id long, text string")
    got = decontam.contaminated(docs, items).collect()
    assert len(got) == 300 and all(r.n_hit == 30 and r.n_items == 100 for r in got)


def test_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = decontam.contaminated(docs, items)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow", "CartesianProduct"))
