"""Near-duplicate embeddings by tiled comparison of PCA-ordered dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm._common import stored
from lexspark.llm._graph import components

#: Vectors a tile; two tiles of 64 dimensions in doubles are 4 MB.
TILE = 4096
#: Tiles of a band: 16 MB a side of two bands that meet, at 32 tiles a million vectors.
BAND = 8
#: Bands of a table at least, for enough tasks, if it has so many tiles.
BANDS = 12
#: Rows of a block inside a tile.
BLOCK = 1024
#: Leading dimensions accumulated before each bound, as shares of all.
STEPS = (0.125, 0.25, 0.5)
SLACK = 1e-9


def rotation(vectors: DataFrame, dims: int) -> np.ndarray:
    """Principal axes of the unit vectors(u array<double>), largest variance first.

    Each task sends one dims x dims matrix of sums; they are added in the executors by key
    before the driver takes the one total.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((dims, dims))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            g += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims), pa.int32()), pa.array(g.ravel())], ["i", "v"])

    sums = vectors.select("u").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    g = np.zeros(dims * dims)
    for r in sums:
        g[r.i] = r.v
    return np.linalg.eigh(g.reshape(dims, dims))[1][:, ::-1].copy()


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) whose product reaches threshold - SLACK, rows of unit norm, PCA-ordered.

    Blocks accumulate leading dimensions first. After each step the rest of a product is at most
    the product of the suffix norms; a block stops when no pair can reach the threshold, and goes
    on with single pairs when few can.
    """
    d = x.shape[1]
    stops = sorted({max(1, int(d * s)) for s in STEPS} | {d})
    tail = lambda m: {s: np.sqrt((m[:, s:] ** 2).sum(axis=1)) for s in stops}
    tx, ty = tail(x), tail(y)
    out_i, out_j = [], []
    for a in range(0, len(x), BLOCK):
        for b in range(0, len(y), BLOCK):
            xb, yb = x[a : a + BLOCK], y[b : b + BLOCK]
            part, done, few = None, 0, None
            for s in stops:
                if few is None:
                    more = xb[:, done:s] @ yb[:, done:s].T
                    part = more if part is None else part + more
                    able = part + tx[s][a : a + BLOCK, None] * ty[s][None, b : b + BLOCK] >= threshold - SLACK
                    n = np.count_nonzero(able)
                    if not n:
                        break
                    if n * 50 < able.size:
                        i, j = np.nonzero(able)
                        few = (i, j, part[i, j])
                else:
                    i, j, v = few
                    v = v + np.einsum("ij,ij->i", xb[i, done:s], yb[j, done:s])
                    ok = v + tx[s][a + i] * ty[s][b + j] >= threshold - SLACK
                    few = (i[ok], j[ok], v[ok])
                    if not ok.any():
                        break
                done = s
            else:
                i, j = few[:2] if few else np.nonzero(able)
                out_i.append(i + a)
                out_j.append(j + b)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *out_i]), np.concatenate([none, *out_j])


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the links join: each vector that has a link, with the least of its component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    x = np.flatnonzero(root != np.arange(n))
    return x, root[x]


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """One row a vector: (vec_id, n_links, component_id, kept), linked by cosine >= threshold.

    Equal vectors form one class first. Class representatives are turned to the principal axes,
    sorted by the first and cut into tiles, and these into bands of up to BAND; a pair of bands is
    compared in one task, tile by tile, unless the gap between their first coordinates alone puts
    all cosines below the threshold. So a vector is copied once for each band that can hold
    partners, not for each tile. A task sends the sums of links by vector and a spanning forest of
    its links, never all pairs. Survivors of the bounds are confirmed with the unrotated vectors
    in double precision. Vectors of each length are compared among themselves.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing
    (n_links 0, own component). Equal ids are one vector for components; a row without an id has
    none, links with nothing and is kept. Other columns are not read;
    an empty table gives an empty result. The work grows with the square of the tables' tiles,
    as every comparison of all vectors does that may miss no link; memory does not.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"))
    fine = F.forall("v", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))) & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull()
    v = stored(v.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("k", F.sha2(F.concat_ws(",", F.transform("v", lambda x: (x + 0.0).cast("string"))), 256)), "vectors")
    classes = v.where("fine").groupBy("k").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("m"), F.first("v").alias("v"))
    big = F.array_max(F.transform("v", F.abs))
    scaled = classes.withColumn("v", F.transform("v", lambda x: x / big))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    classes = stored(scaled.withColumn("u", F.transform("v", lambda x: x / norm)).select("k", "rep", "m", "u", F.size("v").alias("d")), "classes")
    found = None
    for r in classes.groupBy("d").count().where("count > 1").orderBy("d").collect():  # one row a length
        own = classes.where(F.col("d") == r.d)
        done = _compare(own, rotation(own, r.d), r["count"], threshold, tile)
        found = done if found is None else found.unionByName(done)
    if found is None:
        found = spark.createDataFrame([], "a long, b long, links long")
    comp = components(found.where("a <> b").select("a", "b"))
    links = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    of = classes.join(comp, F.col("rep") == F.col("node"), "left").join(links, "rep", "left").select("k", F.coalesce("component", "rep").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("l"))
    out = v.select("vec_id", "fine", F.col("k")).join(of, "k", "left").select("vec_id", F.when(F.col("fine"), F.coalesce("l", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(F.col("fine"), F.coalesce("c", "vec_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _compare(classes: DataFrame, axes: np.ndarray, n: int, threshold: float, tile: int) -> DataFrame:
    """(a, b, links): with a = b, the sum of a's links in one task; with a <> b, an edge of a task's forest."""
    spark = classes.sparkSession
    first = F.aggregate(F.zip_with("u", F.array(*[F.lit(float(a)) for a in axes[:, 0]]), lambda x, a: x * a), F.lit(0.0), lambda s, x: s + x)
    placed = classes.select("rep", "m", "u", first.alias("x"))
    tiles = max(1, -(-n // tile))
    size = min(BAND, max(1, tiles // BANDS))
    g = -(-tiles // size)
    cuts = placed.approxQuantile("x", [i / g for i in range(1, g)], 0.1 / g) if g > 1 else []
    by = F.lit(0)
    if cuts:
        by = F.size(F.filter(F.lit([float(c) for c in cuts]), lambda c: c <= F.col("x")))
    placed = placed.withColumn("band", by.cast("int"))
    span = {r.band: (r.lo, r.hi) for r in placed.groupBy("band").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
    gap = (2 - 2 * threshold + SLACK) ** 0.5  # unit vectors of that cosine lie no farther apart
    todo = [(i, j) for i in sorted(span) for j in sorted(span) if i <= j and span[j][0] - span[i][1] <= gap]
    role = spark.createDataFrame([(i, f"{i}-{j}", 0) for i, j in todo] + [(j, f"{i}-{j}", 1) for i, j in todo if i != j], "band int, pair string, side int")
    # one row a vector and pair of bands: the join is by band, and the pairs spread over all tasks
    dealt = placed.join(role, "band")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "x", "rep"])
        own = len(set(pdf.pair.iloc[0].split("-"))) == 1
        u, m, ids, at = np.vstack(pdf.u), pdf.m.to_numpy(np.float64), pdf.rep.to_numpy(), pdf.x.to_numpy()
        split = int((pdf.side == 0).sum())
        z = u @ axes
        sums, edges = np.zeros(len(ids)), []
        for a in range(0, split, tile):
            a1 = min(a + tile, split)
            for b in range(a, split, tile) if own else range(split, len(ids), tile):
                b1 = min(b + tile, split if own else len(ids))
                if max(at[b] - at[a1 - 1], at[a] - at[b1 - 1]) > gap:
                    continue
                i, j = tile_links(z[a:a1], z[b:b1], threshold)
                i, j = i + a, j + b
                if a == b:
                    i, j = i[i < j], j[i < j]
                ok = np.concatenate([np.empty(0, bool), *[np.einsum("ij,ij->i", u[i[s : s + 65536]], u[j[s : s + 65536]]) >= threshold for s in range(0, len(i), 65536)]])
                i, j = i[ok], j[ok]
                sums += np.bincount(i, m[j], len(ids)) + np.bincount(j, m[i], len(ids))
                edges.append(_forest(len(ids), i, j))
        x, y = (np.concatenate([np.empty(0, np.int64), *[e[k] for e in edges]]) for k in (0, 1))
        x, y = _forest(len(ids), x, y)
        got = np.flatnonzero(sums)
        return pd.DataFrame({"a": np.concatenate([ids[got], ids[x]]).astype(np.int64), "b": np.concatenate([ids[got], ids[y]]).astype(np.int64), "links": np.concatenate([sums[got], np.zeros(len(x))]).astype(np.int64)})

    return stored(dealt.select("rep", "m", "u", "x", "pair", "side").groupBy("pair").applyInPandas(compare, "a long, b long, links long"), "tiles")
