"""Manifests against trees built node by node."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lexspark.llm import merkle, queries

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def h(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def up(nodes: list[str], fanout: int) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def way(tree: list[list[str]], at: int, fanout: int) -> list[list[str]]:
    """The run of every level on the way up, with None for the node itself."""
    out = []
    for nodes in tree[:-1]:
        lo = at // fanout * fanout
        out.append([None if j == at else nodes[j] for j in range(lo, min(lo + fanout, len(nodes)))])
        at //= fanout
    return out


def brute(rows: list[tuple], fanout: int = 2) -> list[tuple]:
    def leaf(r: tuple) -> str:
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    first = lambda v: (v is not None, v if v is not None else 0)
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda r: (first(r[0]), leaf(r)))
        trees[g] = up([leaf(r) for r in groups[g]], fanout)
    top = up([trees[g][-1][0] for g in langs], fanout)
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(groups[g]):
            steps = way(trees[g], i, fanout) + way(top, k, fanout)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            x = leaf((*r[:3], r[3] + 1, r[4])) if changed else leaf(r)
            for run in steps:
                x = h("".join(x if v is None else v for v in run))
            proof = h("".join(v for run in steps for v in run if v))
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], proof, x, not changed))
    return out


def rows(n: int) -> list[tuple]:
    langs = ["en", "fr", None, "é", "en", "en"]
    out = [(i * 3, f"s{i % 4}" if i % 5 else None, langs[i % 6], i if i % 7 else None, f"text ñ {i}" if i % 11 else None) for i in range(n)]
    return out + [(None, None, None, None, None), (None, "a", "lone", 1, ""), (3, "s", "en", 5, "other"), (6, "s", "en", 5, "twice"), (6, "s", "en", 5, "twice")]


def key(r: tuple) -> tuple:
    return tuple(str(x) for x in r)


@pytest.mark.parametrize("n", [1, 2, 33, 150])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, n):
    # small blocks, so that trees take several tables
    monkeypatch.setattr(merkle.manifest, "__defaults__", (2, 2))
    spark.createDataFrame(rows(n), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_merkle(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows(n)), key=key)
    assert 0 < sum(not r["verified"] for r in got) < len(got) or n < 33


def test_wider_runs_and_extra_columns(spark):
    own = [r for r in rows(60) if r[0] is not None]
    docs = spark.createDataFrame(own, DOCS).withColumns({"path": F.lit(1), "AT": F.lit("x"), "tree": F.lit(2), "block": F.lit(3), "row": F.lit(4), "_g": F.lit(5)})
    docs = docs.withColumn("leaf", merkle.leaf(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))))
    got = merkle.folded_roots(merkle.manifest(docs, "lang", ["doc_id"], 3, 2), "leaf", "folded", 3)
    assert {"tree", "block", "row", "_g", "text"} <= set(got.columns) and got.columns.count("path") == 1
    got = got.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(), "folded").collect()
    want = brute(own, 3)
    assert sorted(map(tuple, got), key=key) == sorted([(*r[:5], r[3]) for r in want], key=key)


def test_empty_table_and_single_row(spark, tmp_path):
    docs = spark.createDataFrame([(7, "s", "en", 1, "t")], DOCS)
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    docs.write.parquet(str(tmp_path / "one/documents.parquet"))
    assert queries.op12_merkle(spark, str(tmp_path / "none")).count() == 0
    r = queries.op12_merkle(spark, str(tmp_path / "one")).first()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == h("")
