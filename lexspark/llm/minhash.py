"""Near-duplicate documents by a chosen-path similarity join over minwise tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm._common import R1, R2, U64, drop_stored, mix, scratch, stored, tokens
from lexspark.llm._graph import components

#: Coordinates of a signature: the least of as many hashes over a document's shingles.
COORDINATES = 64
#: Trees, which draw on the same coordinates. A pair of similarity s agrees in a of these with a
#: binomial chance and is missed by all trees with (1 - (a / COORDINATES)**d)**TREES after d
#: branchings: at s = 0.8 that is 3e-8 for d = 2, 7e-6 for d = 3, 2e-4 for d = 4, 1.5e-3 for d = 5.
TREES = 24
#: Nodes of up to so many documents are compared exhaustively; larger ones branch.
SMALL = 64
#: Shingles of the documents that share a block: 8 MB.
BLOCK = 1 << 20
#: Guests of a block that one task compares.
GUESTS = 1 << 15
#: Branchings after the first, three in all, before what is left of a large node is compared whole:
#: so deep, the trees still find all but 7e-6 of the pairs of similarity 0.8.
DEPTH = 2
#: Pairs whose signatures agree in a smaller share are not confirmed: 5 deviations below 0.8.
LEAST_SEEN = 0.55
#: Signatures that agree in this share are most likely of linked sets.
WELL = 0.85
#: Bits of the map that tells which texts are needed again: 4 MB.
BITMAP = 1 << 25

_A = mix(np.arange(1, COORDINATES + 1, dtype=U64) * R1) | U64(1)
_B = mix(np.arange(1, COORDINATES + 1, dtype=U64) * R2)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the width-word shingles; fewer words count as one shingle."""
    n = len(words)
    if not n:
        return words
    if n < width:
        width = n
    h = np.zeros(n - width + 1, U64)
    for j in range(width):
        h = h * R1 + words[j : n - width + 1 + j]
    return np.unique(mix(h + U64(width * int(R2) % 2**64)))


def signature(s: np.ndarray) -> np.ndarray:
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, U64)
    for i in range(0, len(s), 4096):
        low = np.minimum(low, (_A[:, None] * s[None, i : i + 4096] + _B[:, None]).min(axis=1))
    return (low >> U64(32)).astype(np.uint32).view(np.int32)


def _per_text(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    step = 512
    for i in range(0, len(batch), step):
        hashes, counts = tokens(batch.column(1).slice(i, step).to_pylist())
        at = 0
        for n in counts:
            yield shingles(hashes[at : at + n], width)
            at += n


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, sig): set size, 128-bit key of the set and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, k1, k2, sigs = [], [], [], []
            for s in _per_text(b, width):
                n.append(len(s))
                k1.append(int(mix(s).sum(dtype=U64).astype(np.int64)))
                k2.append(int(mix(s ^ R1).sum(dtype=U64).astype(np.int64)))
                sigs.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sigs, pa.list_(pa.int32()))], ["doc_id", "n_shingles", "k1", "k2", "sig"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, sig array<int>")


def _sets(rows: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, s): the sets of the documents with these ids, and of a few others.

    The ids go out as a bitmap of BITMAP bits, whatever their number, so the texts stay where
    they are; a document whose bit another one has set is computed for nothing.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP))
    found = ids.select(bit.alias("h")).groupBy(F.floor(F.col("h") / 32768).cast("int").alias("b")).agg(F.bitmap_construct_agg(F.pmod("h", F.lit(32768))).alias("m")).collect()
    bits = np.zeros(BITMAP // 8, np.uint8)
    for r in found:
        bits[r.b * 4096 : (r.b + 1) * 4096] = np.frombuffer(r.m, np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 512):
                part = b.slice(i, 512)
                h = part.column(2).to_numpy()
                part = part.filter(pa.array((shared.value[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in _per_text(part, width)], pa.binary())], ["doc_id", "s"])

    return rows.where("doc_id is not null").select("doc_id", "t", bit.alias("h")).mapInArrow(run, "doc_id long, s binary")


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs(a, b) whose full sets have 100 * intersection >= percent * union."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = stored(_sets(docs, ids, width), "sets")
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for x, y in zip(t.column(2), t.column(3), strict=True):
                u, v = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                common = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * common >= percent * (len(u) + len(v) - common))
            yield t.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    out = stored(both.mapInArrow(run, "a long, b long"), "links")
    drop_stored(sets)
    return out


def _calls(members: DataFrame, percent: int) -> DataFrame:
    """(rep, block, guest): which documents of members(node, rep, crep, n, sig, block) to compare where.

    Two documents of a node and of different components, whose sizes and signatures do not rule
    out a link, meet in the block of the lesser one; the other is a guest there.
    """
    least = int(LEAST_SEEN * COORDINATES * percent / 80)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            lists, reps, own, blocks = t.column(0), [], [], []
            at, flat = lists.offsets.to_numpy(), lists.values
            rep, crep, n, home = (flat.field(k).to_numpy() for k in ("rep", "crep", "n", "block"))
            sig = flat.field("sig").flatten().to_numpy().reshape(-1, COORDINATES)
            for i, j in zip(at[:-1], at[1:], strict=True):
                r, c, size = rep[i:j], crep[i:j], n[i:j]
                fit = (r[:, None] > r) & (c[:, None] != c) & (100 * np.minimum(size[:, None], size) >= percent * np.maximum(size[:, None], size))
                x, y = np.nonzero(fit)
                for k in range(0, len(x), 4096):
                    u, v = x[k : k + 4096], y[k : k + 4096]
                    fit[u, v] = (sig[i + u] == sig[i + v]).sum(axis=1) >= least
                hosts = fit.any(axis=0)
                for k in np.flatnonzero(hosts | fit.any(axis=1)):
                    reps.append(r[k])
                    own.append(home[i + k] if hosts[k] else None)
                    blocks.append(np.unique(home[i:j][fit[k]]))
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(own, pa.int64()), pa.array(blocks, pa.list_(pa.int64()))], ["rep", "own", "blocks"])

    lists = members.groupBy("node").agg(F.collect_list(F.struct("rep", "crep", "n", "block", "sig")).alias("m")).select("m")
    found = lists.mapInArrow(run, "rep long, own long, blocks array<long>").groupBy("rep").agg(F.max("own").alias("own"), F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("blocks"))
    found = stored(found, "found")
    guests = found.select("rep", F.explode("blocks").alias("block"), F.lit(True).alias("guest"))
    return guests.unionByName(found.where("own is not null").select("rep", F.col("own").alias("block"), F.lit(False).alias("guest")))


class _Hosts:
    """The sets of a block's hosts, made ready to count what a guest shares with each.

    Shingles that many hosts hold become columns of a matrix, the others lists of hosts. The
    matrix has at most 8 x BLOCK cells, whatever the block holds.
    """

    def __init__(self, hosts: list[tuple[int, int, np.ndarray]]) -> None:
        self.ids, self.of, self.sizes = (np.array(x) for x in ([h[0] for h in hosts], [h[1] for h in hosts], [len(h[2]) for h in hosts]))
        every = np.concatenate([h[2] for h in hosts])
        order = np.argsort(every, kind="stable")
        self.owner = np.repeat(np.arange(len(hosts)), self.sizes)[order]
        self.keys, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every))
        common = np.flatnonzero(np.diff(self.first) > max(64, len(hosts) // 8))
        self.column = np.full(len(self.keys), -1)
        self.column[common] = np.arange(len(common))
        self.dense = np.zeros((len(hosts), len(common)), np.float32)
        for c, k in enumerate(common):
            self.dense[self.owner[self.first[k] : self.first[k + 1]], c] = 1

    def shared(self, guests: list[np.ndarray]) -> np.ndarray:
        """The number of shingles that each guest shares with each host."""
        rows = np.zeros((len(guests), self.dense.shape[1]), np.float32)
        out = np.zeros((len(guests), len(self.ids)), np.int64)
        for i, u in enumerate(guests):
            pos = np.minimum(np.searchsorted(self.keys, u), len(self.keys) - 1)
            pos = pos[self.keys[pos] == u]
            col = self.column[pos]
            rows[i, col[col >= 0]] = 1
            pos = pos[col < 0]
            length = self.first[pos + 1] - self.first[pos]
            hit = np.repeat(self.first[pos] - np.cumsum(length) + length, length) + np.arange(length.sum())
            out[i] = np.bincount(self.owner[hit], minlength=len(self.ids))
        return out + np.rint(rows @ self.dense.T).astype(np.int64)


def _dealt(calls: DataFrame) -> DataFrame:
    """calls(rep, block, guest) with a part: a block's guests in parts of about GUESTS, its hosts in every part."""
    parts = calls.where("guest").groupBy("block").agg(F.ceil(F.count("*") / GUESTS).alias("parts"))
    at = calls.join(stored(parts, "parts"), "block")
    spread = F.when(F.col("guest"), F.array(F.pmod(F.xxhash64("rep"), F.col("parts")))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    return at.select("rep", "block", "guest", F.explode(spread).alias("part"))


def _blocks(calls: DataFrame, comp: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links(a, b) between the hosts of each block and its guests, on full sets.

    A task holds the sets of one block's hosts at a time, and guests pass by one after the other.
    """
    sets = stored(_sets(docs, calls.select(F.col("rep").alias("doc_id")).distinct(), width), "sets")
    named = calls.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").select("block", "part", "guest", "rep", F.coalesce("component", "rep").alias("c"))
    at = named.join(sets.select(F.col("doc_id").alias("rep"), "s"), "rep").select("block", "part", "guest", "rep", "c", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hosts, table = None, [], None
        for t in batches:
            out: list[tuple[int, int]] = []
            guests: list[tuple[int, int, np.ndarray]] = []

            def compare() -> None:
                if guests and table is not None:
                    n = np.array([len(u) for _, _, u in guests])
                    common = table.shared([u for _, _, u in guests])
                    linked = 100 * common >= percent * (table.sizes[None, :] + n[:, None] - common)
                    for i in np.flatnonzero(linked.any(axis=1)):
                        own = np.flatnonzero(linked[i] & (table.of != guests[i][1]))
                        # one link to each component is enough
                        _, once = np.unique(table.of[own], return_index=True)
                        out.extend((int(x), guests[i][0]) for x in table.ids[own][once])
                guests.clear()

            for block, part, guest, rep, c, s in zip(*(t.column(k).to_pylist() for k in range(5)), t.column(5), strict=True):
                if (block, part) != now:
                    compare()
                    now, hosts, table = (block, part), [], None
                u = np.frombuffer(s.as_buffer(), U64)
                if not guest:
                    hosts.append((rep, c, u))
                elif hosts:
                    if table is None:
                        table = _Hosts(hosts)
                    guests.append((rep, c, u))
                    if len(guests) == 64:
                        compare()
            compare()
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])

    out = stored(at.repartition("block", "part").sortWithinPartitions("block", "part", "guest").mapInArrow(run, "a long, b long"), "links")
    drop_stored(sets)
    return out


def _agreement(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: (doc_id, n_shingles, component_id, kept).

    Documents are linked if the Jaccard similarity of their sets of width-word shingles is
    percent / 100 or more; every link used is confirmed on the full sets. component_id is the
    smallest doc_id reachable, kept says whether that is the document itself.

    Documents with equal sets are one class, formed by a key of the set. For each of TREES trees
    the class representatives are dealt to nodes by the value of one signature coordinate. Every
    member of a node is compared with its least one, in nodes of more than SMALL with one drawn by
    hash too. Then only nodes with several components so far matter: small ones are compared
    exhaustively across components, larger ones branch again by a coordinate chosen by node. What
    still is large after DEPTH more branchings is dense: there, members outside the largest
    component are compared with all members, exactly. These comparisons make no rows of pairs: a
    document is sent once to each block of documents that it may be linked with, and compared
    with all of these on the full sets. So no group is cut off, and none is expanded into all its
    pairs. A dense group of up to BLOCK shingles is one block, so its rows grow in proportion to
    it; beyond, a document goes to one block for each BLOCK shingles of its group, and to none of
    other groups. The pairs compared there grow with the square, as similarities just below the
    threshold demand. Pairs of similarity 0.8 that all trees miss: 7e-6 of them, fewer above.

    A null or empty text, or one of white space, links with nothing; fewer than width words are
    one shingle. Equal ids are one document for linking. A row without an id has no component
    and is kept. Columns besides id and text are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    with scratch(docs.sparkSession) as keep:
        return keep(_linked(rows, width, percent), "near-duplicates").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _linked(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of rows(doc_id, t); see near_duplicates()."""
    sk = stored(sketches(rows, width), "sketches")
    linked = sk.where("n_shingles > 0 and doc_id is not null")
    reps = stored(linked.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "classes")

    #: one id may carry several texts: all its classes are joined by links that need no check
    same_id = linked.select("doc_id", "k1", "k2").join(reps.select("k1", "k2", "rep"), ["k1", "k2"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    first = F.array(*[F.xxhash64(F.lit(t), F.element_at("sig", t * 37 % COORDINATES + 1)) for t in range(TREES)])
    level = reps.select("rep", "n", F.explode(first).alias("node"))
    sizes = level.groupBy("node").agg(F.count("*").alias("size"), F.min("rep").alias("p"), F.min_by("rep", F.xxhash64("node", "rep")).alias("q"), F.sum("n").alias("weight")).where("size > 1")
    shared = stored(level.join(sizes, "node"), "nodes")
    ends = F.when(F.col("size") > SMALL, F.array("p", "q")).otherwise(F.array("p"))
    stars = shared.select("rep", F.explode(ends).alias("o")).where("rep <> o").select(F.least("rep", "o").alias("a"), F.greatest("rep", "o").alias("b"))

    def seen(p: DataFrame) -> DataFrame:
        """Distinct pairs that sizes and signatures do not rule out, with the agreement."""
        x, y = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
        both = p.distinct().join(x, "a").join(y, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        return both.select("a", "b", _agreement(F.col("sa"), F.col("sb")).alias("agree")).where(F.col("agree") >= int(LEAST_SEEN * COORDINATES * percent / 80))

    cand = stored(seen(stars), "pairs")
    # first, one pair of each class: with the least id among those that agree well, so that a dense
    # group meets at one member, else the one that agrees best
    both = cand.select("a", "b", "agree").unionByName(cand.select(F.col("b").alias("a"), F.col("a").alias("b"), "agree"))
    well = F.col("agree") >= int(WELL * COORDINATES)
    best = both.groupBy("a").agg(F.max_by("b", F.struct(well, F.when(well, -F.col("b")).otherwise(F.col("agree")))).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = _confirmed(best, rows, width, percent)
    comp = stored(components(links), "components")

    def labelled(p: DataFrame, *ids: str) -> DataFrame:
        """p with each id's component so far, as c<id>."""
        for k in ids:
            p = p.join(comp.select(F.col("node").alias("_n"), F.col("component").alias("_c")), F.col(k) == F.col("_n"), "left").withColumn("c" + k, F.coalesce("_c", k)).drop("_n", "_c")
        return p

    def joined(pairs: DataFrame) -> None:
        """Confirms pairs between components and joins these."""
        nonlocal links, comp
        open_ = stored(labelled(pairs, "a", "b").where("ca <> cb").select("a", "b").distinct(), "rest")
        if not open_.isEmpty():
            links = links.unionByName(_confirmed(open_, rows, width, percent))
            comp = stored(components(links), "components")
        drop_stored(open_)

    joined(cand.select("a", "b"))
    # what is linked but not yet joined is sought by blocks: of the largest node that holds a
    # document, so much as makes BLOCK shingles
    home = shared.groupBy("rep").agg(F.max(F.struct("size", "node", "weight")).alias("h")).select("rep", F.xxhash64("h.node", F.pmod(F.xxhash64("rep"), F.ceil(F.col("h.weight") / BLOCK))).alias("block"))
    info = stored(reps.select("rep", "n", "sig").join(home, "rep"), "blocks")
    level = labelled(shared.select("node", "rep"), "rep")
    leaves, tables = None, [shared, info]
    for depth in range(DEPTH + 1):
        level = stored(level, "level")
        # the sizes are stored, so that the join below can split a node that holds much of the rows
        mixed = stored(level.groupBy("node").agg(F.count("*").alias("size"), F.min("crep").alias("lo"), F.max("crep").alias("hi")).where("lo <> hi").select("node", "size"), "sizes")
        nodes = stored(level.join(mixed, "node"), "nodes")
        drop_stored(level)
        tables += [nodes, mixed]
        small, large = nodes.where(F.col("size") <= SMALL).select("node", "rep", "crep"), nodes.where(F.col("size") > SMALL)
        leaves = small if leaves is None else leaves.unionByName(small)
        if depth == DEPTH or large.isEmpty():
            break
        level = large.join(info.select("rep", "sig"), "rep").select("rep", "crep", F.xxhash64("node", F.element_at("sig", F.pmod("node", F.lit(COORDINATES)).cast("int") + 1)).alias("node"))
    calls = _calls(leaves.join(info, "rep"), percent)
    if depth == DEPTH:
        share = large.groupBy("node", "crep").count().groupBy("node").agg(F.max_by("crep", F.struct("count", "crep")).alias("most"))
        odd = large.join(share, "node").where("crep <> most").select("node", "rep").join(info.select("rep", "block"), "rep")
        guests = large.join(stored(odd.select("node", "block").distinct(), "odd"), "node").select("rep", "block", F.lit(True).alias("guest"))
        calls = calls.unionByName(guests).unionByName(odd.select("rep", "block", F.lit(False).alias("guest")))
    calls = stored(_dealt(stored(calls.distinct(), "asked")), "calls")
    if not calls.isEmpty():
        links = links.unionByName(_blocks(calls, comp, rows, width, percent))
    comp = stored(components(links.unionByName(same_id)), "components")
    for t in (*tables, cand, calls):
        drop_stored(t)

    of_rep = reps.select("k1", "k2", "rep").join(comp, F.col("rep") == F.col("node"), "left").select("k1", "k2", F.coalesce("component", "rep").alias("of_set"))
    out = sk.select("doc_id", "n_shingles", "k1", "k2").join(of_rep, ["k1", "k2"], "left")
    cid = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.coalesce("of_set", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", cid.alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that near_duplicates() drops; columns as they are, whatever their names."""
    gone = near_duplicates(docs, width, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    own = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).cast("long").alias("id"))
    return own.join(gone, F.col("id") == F.col("gone"), "left_anti").select("doc.*")
