"""Merkle manifest of a dataset: a root, and a proof for every row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm._common import stored
from lexspark.operators.ranking import numbered

FANOUT = 2
#: Levels of a block: a task hashes trees of FANOUT ** HEIGHT nodes, one after the other.
HEIGHT = 12
#: Characters of a digest.
HEX = 64


def field(c: Column) -> Column:
    """A value as a leaf holds it: `-` for null, else its number of UTF-8 bytes, a colon, and itself."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row of values."""
    return F.sha2(F.concat(*map(field, values)), 256)


def matrix(digests: Sequence[bytes | str]) -> np.ndarray:
    """Hex digests as a contiguous matrix of bytes, a row each."""
    return np.array(digests, f"S{HEX}").view(np.uint8).reshape(-1, HEX)


def parents(nodes: np.ndarray, fanout: int) -> np.ndarray:
    """The digests of every `fanout` consecutive rows; the last run may have fewer."""
    whole = len(nodes) // fanout * fanout
    runs = [r.tobytes() for r in nodes[:whole].reshape(-1, fanout * HEX)]
    if whole < len(nodes):
        runs.append(nodes[whole:].tobytes())
    return matrix([hashlib.sha256(r).hexdigest().encode() for r in runs])


def levels(nodes: np.ndarray, n: int, fanout: int, height: int) -> list[np.ndarray]:
    """The matrices of a block, upwards: up to one node if all n of its tree are in it, else `height` levels."""
    out = [nodes]
    while len(out[-1]) > 1 if n <= fanout**height else len(out) <= height:
        out.append(parents(out[-1], fanout))
    return out


def paths(tree: list[np.ndarray], at: np.ndarray, fanout: int) -> list[list[str]]:
    """Each node's siblings, a text for each level: the digests of the run's others, left to right."""
    out: list[list[str]] = [[] for _ in at]
    for nodes in tree[:-1]:
        run = at[:, None] // fanout * fanout + np.arange(fanout)
        there = (run < len(nodes)) & (run != at[:, None])
        text = nodes.tobytes().decode()
        for own, r, ok in zip(out, run.tolist(), there.tolist(), strict=True):
            own.append("".join([text[j * HEX : (j + 1) * HEX] for j, k in zip(r, ok, strict=True) if k]))
        at = at // fanout
    return out


def fold(digest: str, at: int, path: Sequence[str], fanout: int = FANOUT) -> str:
    """The digest at the top, from one below, its place and the siblings on its way."""
    for run in path:
        left = at % fanout * HEX
        digest = hashlib.sha256((run[:left] + digest + run[left:]).encode()).hexdigest()
        at //= fanout
    return digest


def _block(fanout: int, height: int) -> Column:
    return F.floor(F.col("at") / fanout**height).alias("block")


def _sorted(t: pa.Table) -> pa.Table:
    return t.take(pa.array(np.argsort(t.column("at").to_numpy(), kind="stable")))


def tops(nodes: DataFrame, fanout: int, height: int) -> DataFrame:
    """The nodes that the blocks of nodes(tree, at, n, digest) make."""
    size = fanout**height

    def run(key: tuple, t: pa.Table) -> pa.Table:
        n = t.column("n")[0].as_py()
        top = levels(matrix(_sorted(t).column("digest").to_pylist()), n, fanout, height)[-1]
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int64()), "at": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([-(-n // size)], pa.int64()), "digest": [top.tobytes().decode()]})

    return nodes.select("tree", _block(fanout, height), "at", "n", "digest").groupBy("tree", "block").applyInArrow(run, "tree long, at long, n long, digest string")


def proofs(nodes: DataFrame, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """nodes with the top digest of their tree and the path to it, array<string>.

    nodes(tree, at, n, digest, more columns): at counts the n nodes of a tree from 0 without gaps;
    other columns are carried along. A block is fanout ** height nodes, the first one aligned; its
    levels are hashed at once, and its top is a node of the next table, until every tree has one
    node. Paths then come down: a block's nodes share the way from its top on.
    """
    if (nodes.agg(F.max("n")).first()[0] or 1) == 1:
        return nodes.withColumns({"top": F.col("digest"), "path": F.array().cast("array<string>")})
    above = proofs(stored(tops(nodes, fanout, height), "merkle"), fanout, height)
    size = fanout**height
    names = nodes.columns

    def lower(t: pa.Table, up: pa.Table) -> pa.Table:
        t = _sorted(t)
        at = t.column("at").to_numpy()
        tree = levels(matrix(t.column("digest").to_pylist()), t.column("n")[0].as_py(), fanout, height)
        top, rest = up.column("top")[0].as_py(), up.column("path")[0].as_py()
        ways = [[*p, *rest] for p in paths(tree, at % size, fanout)]
        return t.select(names).append_column("top", pa.array([top] * len(at))).append_column("path", pa.array(ways, pa.list_(pa.string())))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
    own = nodes.withColumn("block", _block(fanout, height)).groupBy("tree", "block")
    return own.cogroup(above.select("tree", F.col("at").alias("block"), "top", "path").groupBy("tree", "block")).applyInArrow(lower, f"{kinds}, top string, path array<string>")


def manifest(rows: DataFrame, group: str, order: Sequence[str], fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """rows with their place and proof: at, path, subroot, tree_at, tree_path and root.

    rows(leaf, the group, the columns of order, more). The leaves of a group, by order, make a
    tree whose top is its subroot; the subroots, by group (null first, else bytewise), make the tree
    of the root. While a level has several nodes, every `fanout` consecutive ones become one. path and
    tree_path hold the siblings from the leaf to the subroot and from there to the root.

    Places come from a range partitioning, so no group, however large, meets in one task, and a
    task holds one block. Rows that tie in order are placed by their leaf; repeated rows are leaves
    of their own; nulls come first; an empty table gives an empty result. A column of rows that has
    the name of one of the result's gives way to it.
    """
    result = ("at", "path", "subroot", "tree_at", "tree_path", "root")
    kept = [c for c in rows.columns if c.lower() not in result]
    by = {f"_o{i}": F.col(c) for i, c in enumerate(order)}
    rows = rows.select(F.struct(*kept).alias("row"), F.col(group).alias("_g"), *[c.alias(k) for k, c in by.items()], F.col("leaf").alias("digest"))
    at = numbered(rows, ["_g", *by, "digest"], "_no").select("row", F.col("_g").alias("_own"), "digest", "_no")
    groups = stored(at.groupBy(F.col("_own").alias("_g")).agg(F.min("_no").alias("tree"), F.count("*").alias("n")), "groups")
    leaves = stored(at.join(groups, F.col("_own").eqNullSafe(F.col("_g"))).select("tree", (F.col("_no") - F.col("tree")).alias("at"), "n", "digest", "row"), "leaves")
    first = stored(tops(leaves, fanout, height), "merkle")
    above = stored(proofs(first, fanout, height), "merkle")

    subroots = numbered(above.groupBy("tree").agg(F.min("top").alias("digest")).withColumnRenamed("tree", "group"), ["group"], "at")
    n = subroots.agg(F.count("*").alias("n"))
    trees = proofs(stored(subroots.join(F.broadcast(n), F.lit(True)).withColumn("tree", F.lit(0).cast("long")), "subroots"), fanout, height)  # one row
    trees = trees.select(F.col("group").alias("tree"), F.col("at").alias("tree_at"), F.col("path").alias("tree_path"), F.col("top").alias("root"))
    above = stored(above.select("tree", F.col("at").alias("block"), F.col("top").alias("subroot"), F.col("path").alias("rest")).join(trees, "tree"), "merkle")
    size = fanout**height

    def lower(t: pa.Table, up: pa.Table) -> pa.Table:
        t = _sorted(t)
        at = t.column("at").to_numpy()
        tree = levels(matrix(t.column("digest").to_pylist()), t.column("n")[0].as_py(), fanout, height)
        rest = up.column("rest")[0].as_py()
        out = t.select(["row", "at"]).append_column("path", pa.array([[*p, *rest] for p in paths(tree, at % size, fanout)], pa.list_(pa.string())))
        for c in ("subroot", "tree_at", "tree_path", "root"):
            out = out.append_column(c, pa.array([up.column(c)[0].as_py()] * len(at), up.schema.field(c).type))
        return out

    own = leaves.withColumn("block", _block(fanout, height)).groupBy("tree", "block")
    proven = own.cogroup(above.groupBy("tree", "block")).applyInArrow(lower, f"row {rows.schema['row'].dataType.simpleString()}, at long, path array<string>, subroot string, tree_at long, tree_path array<string>, root string")
    return proven.select("row.*", *result)


def folded_roots(proven: DataFrame, leaf_col: str, name: str, fanout: int = FANOUT) -> DataFrame:
    """proven (as manifest() gives it) with the root that follows from the digests in leaf_col; null for null."""
    names = proven.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for digest, *way in zip(*(b.column(c).to_pylist() for c in (leaf_col, "at", "path", "tree_at", "tree_path")), strict=True):
                out.append(digest and fold(fold(digest, way[0], way[1], fanout), way[2], way[3], fanout))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in proven.schema.fields)
    return proven.mapInArrow(run, f"{kinds}, `{name}` string")


def proof_digest() -> Column:
    """The digest of a proof's siblings, level by level up to the root, left to right."""
    return F.sha2(F.concat(F.array_join("path", ""), F.array_join("tree_path", "")), 256)
