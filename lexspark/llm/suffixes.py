"""Exact repeated-substring removal by range-partitioned sorting of anchored suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm._common import CHUNK, R1, R2, U64, chunked, mix, powers, scratch, stored

#: Bytes of the strings that make an anchor.
GRAM = 32
#: Bytes of text for each bucket of anchors.
BUCKET = 16 << 20
#: Anchors gathered in a task before repeats among them are taken out.
FLUSH = 1 << 20
#: Windows sorted at once.
WINDOWS = 200_000
LEAD = 16
#: Stands for a null id.
LEAST = -(2**63)

_I1, _I2 = (U64(pow(int(r), -1, 2**64)) for r in (R1, R2))
_ANCHOR = [("k", U64), ("g", U64), ("doc", np.int64), ("s", np.int32), ("r", np.uint8), ("n", np.uint8)]


def _poly(buf: np.ndarray, r: np.uint64) -> np.ndarray:
    """Prefix sums of the polynomial hash of buf."""
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * powers(r, len(buf)), out=out[1:])
    return out


def anchors(buf: np.ndarray, valid: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Anchors of the width-byte windows of buf that start where valid is true.

    A window's anchor is the leftmost of its GRAM-byte strings with the least hash, so equal
    windows have it at the same place. Returns, for each run of windows with one anchor, the
    first and the last window, the anchor, its hash and the hash of the run's bytes.
    """
    gram = min(GRAM, width)
    w = width - gram + 1
    starts = np.flatnonzero(valid)
    if not len(starts):
        return (starts,) * 5
    p1 = _poly(buf, R1)
    n = len(buf) - gram + 1
    h = mix((p1[gram:] - p1[:n]) * powers(_I1, n))
    low = U64((1 << 24) - 1)
    key = np.full(-(-(n + w) // w) * w, np.iinfo(np.uint64).max, U64)
    key[:n] = (h & ~low) | np.arange(n, dtype=U64)
    cells = key.reshape(-1, w)
    up = np.minimum.accumulate(cells, axis=1).ravel()
    down = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(down[starts], up[starts + w - 1]) & low).astype(np.int64)
    new = np.concatenate(([True], (np.diff(starts) > 1) | (np.diff(at) != 0)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(starts)])) - 1
    s, e, a = starts[first], starts[last], at[first]
    p2 = _poly(buf, R2)
    seg = (p2[e + width] - p2[s]) * powers(_I2, len(buf))[s]
    return s, e, a, h[a], mix(seg ^ mix(((a - s) * 256 + (e - s)).astype(U64)))


def doc_anchors(ids: list[int], texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Anchor records of whole texts, in arrays of about CHUNK bytes of text each."""

    def of(parts: list[bytes], part_ids: list[int], base: int) -> np.ndarray:
        buf = np.frombuffer(b"".join(parts), np.uint8)
        lens = np.array([len(p) for p in parts])
        begin = np.cumsum(lens) - lens
        room = np.repeat(begin + lens - width, lens)
        valid = np.arange(len(buf)) <= room
        s, e, a, k, g = anchors(buf, valid, width)
        out = np.empty(len(s), _ANCHOR)
        which = np.searchsorted(begin + lens, s, side="right")
        out["k"], out["g"], out["doc"] = k, g, np.array(part_ids, np.int64)[which] if len(s) else 0
        out["s"], out["r"], out["n"] = s - begin[which] + base if len(s) else 0, a - s, e - s + 1
        return out

    at = 0
    for run in chunked(texts):
        own = ids[at : at + len(run)]
        at += len(run)
        if len(run) == 1 and len(run[0]) > CHUNK:
            for base in range(0, len(run[0]) - width + 1, CHUNK):
                yield of([run[0][base : base + CHUNK + width - 1]], own, base)
        else:
            yield of(run, own, 0)


def merged(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of intervals [s, e) by document; intervals that touch become one."""
    if not len(doc):
        return doc, s, e
    o = np.lexsort((s, doc))
    doc, s, e = doc[o], s[o].astype(np.int64), e[o].astype(np.int64)
    new_doc = np.concatenate(([True], doc[1:] != doc[:-1]))
    # ends reached so far, kept apart by document with an offset
    shift = (np.cumsum(new_doc) - 1) * (int(e.max()) + 1)
    reach = np.maximum.accumulate(e + shift)
    new = np.concatenate(([True], new_doc[1:] | (s[1:] + shift[1:] > reach[:-1])))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(doc)])) - 1
    return doc[first], s[first], reach[last] - shift[last]


def split_repeats(x: np.ndarray, width: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Anchor records without those whose whole run occurs earlier, and the bytes these cover."""
    x = x[np.lexsort((x["s"], x["doc"], x["g"], x["k"]))]
    again = np.concatenate(([False], (x["k"][1:] == x["k"][:-1]) & (x["g"][1:] == x["g"][:-1])))[: len(x)]
    # records of one place (the same id twice) are no repeats
    own = np.flatnonzero(again)
    if len(own):
        lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(x))))[own]
        again[own[(x["doc"][lead] == x["doc"][own]) & (x["s"][lead] == x["s"][own])]] = False
    gone = x[again]
    s = gone["s"].astype(np.int64)
    return x[~again], merged(gone["doc"], s, s + gone["n"] - 1 + width)


def ranked(doc: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (doc, tie)'s place among them from 0, equal ones sharing it, and doc and tie by place."""
    o = np.lexsort((tie, doc))
    d, t = doc[o], tie[o]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])))[: len(o)]
    out = np.empty(len(o), np.int64)
    out[o] = np.cumsum(new) - 1
    return out, d[new], t[new]


def multikey_sort(words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts strings (rows of big-endian words) within groups, word by word.

    Only strings that are still tied are looked at for the next word. Returns the order and,
    for each place in it, whether it equals the one before.
    """
    order = np.argsort(group, kind="stable")
    g = group[order]
    tie = np.concatenate(([False], g[1:] == g[:-1]))
    for j in range(words.shape[1]):
        block = tie.copy()
        block[:-1] |= tie[1:]
        idx = np.flatnonzero(block)
        if not len(idx):
            break
        run = np.cumsum(~tie[idx])
        w = words[order[idx], j]
        o = np.lexsort((w, run))
        order[idx], w, run = order[idx][o], w[o], run[o]
        tie[idx] = np.concatenate(([False], (run[1:] == run[:-1]) & (w[1:] == w[:-1])))
    return order, tie


def window_repeats(k: np.ndarray, doc: np.ndarray, s: np.ndarray, r: np.ndarray, n: np.ndarray, seg: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """Bytes covered by windows of the records that start earlier in another record."""
    parts = []
    order = np.argsort(k, kind="stable")
    total = np.cumsum(n[order])
    at = 0
    while at < len(order):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + WINDOWS)))
        while stop < len(order) and k[order[stop]] == k[order[stop - 1]]:
            stop += 1
        own = order[at:stop]
        at = stop
        _, kid = np.unique(k[own], return_inverse=True)
        spread = int(n[own].astype(np.int64).sum())
        turns = max(1, spread // (4 * WINDOWS))  # a large group goes by the anchor's place in the window
        for turn in range(turns):
            rows, docs, pos, grp = [], [], [], []
            for i, c in zip(own, kid, strict=True):
                m = np.arange(n[i])
                m = m[(r[i] - m) % turns == turn]
                if len(m):
                    b = np.frombuffer(seg[i], np.uint8)
                    rows.append(np.lib.stride_tricks.sliding_window_view(b, width)[m])
                    docs.append(np.full(len(m), doc[i]))
                    pos.append(s[i] + m)
                    grp.append(c * 256 + (r[i] - m))
            if not rows:
                continue
            win = np.concatenate(rows)
            pad = -width % 8
            words = np.ascontiguousarray(np.pad(win, ((0, 0), (0, pad)))).view(">u8").astype(U64)
            d, p = np.concatenate(docs), np.concatenate(pos).astype(np.int64)
            o, tie = multikey_sort(words, np.concatenate(grp))
            run = np.cumsum(~tie)
            d, p = d[o], p[o]
            by = np.lexsort((p, d, run))
            d, p, run = d[by], p[by], run[by]
            first = np.concatenate(([True], run[1:] != run[:-1]))
            lead = np.maximum.accumulate(np.where(first, np.arange(len(d)), 0))
            dup = (d[lead] != d) | (p[lead] != p)
            parts.append((d[dup], p[dup], p[dup] + width))
    return merged(*[np.concatenate(c) for c in zip(*parts, strict=True)]) if parts else (np.empty(0, np.int64),) * 3


def repeated_spans(rows: DataFrame, width: int) -> DataFrame:
    """(doc, tie, s, e): bytes of rows(doc long, tie long, t binary) covered by width-byte strings seen earlier."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    buckets = max(8 * parts, -(-size // BUCKET))  # one is held at a time

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        ids, ties = np.empty(0, np.int64), np.empty(0, np.int64)  # of the rows that held counts

        def flush() -> Iterator[pa.RecordBatch]:
            x = np.concatenate(held)
            x["doc"], by_doc, by_tie = ranked(ids[x["doc"]], ties[x["doc"]])
            x, (doc, s, e) = split_repeats(x, width)
            held.clear()
            to = (x["k"] % U64(buckets)).astype(np.int32)
            o = np.argsort(to, kind="stable")
            x, to = x[o], to[o]
            cut = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))) if len(x) else []
            own = [by_doc[x["doc"]] if f == "doc" else x[f] for f, _ in _ANCHOR] + [by_tie[x["doc"]]]
            blobs = [b"".join(c[a:b].tobytes() for c in own) for a, b in zip(cut, [*cut[1:], len(x)], strict=True)]
            none = lambda t, m: pa.nulls(m, t)
            m, z = len(blobs), len(doc)
            yield pa.RecordBatch.from_arrays([pa.array([to[i] for i in cut], pa.int32()), pa.array(blobs, pa.binary()), *[none(pa.int64(), m)] * 4], names)
            doc, tie = by_doc[doc], by_tie[doc]
            yield pa.RecordBatch.from_arrays([pa.array(((doc ^ tie) % buckets).astype(np.int32)), none(pa.binary(), z), pa.array(doc), pa.array(tie), pa.array(s, pa.int64()), pa.array(e, pa.int64())], names)

        names = ["bucket", "blob", "doc", "tie", "s", "e"]
        for b in batches:
            first = len(ids)
            ids, ties = np.concatenate((ids, b.column(0).to_numpy())), np.concatenate((ties, b.column(1).to_numpy()))
            for x in doc_anchors(list(range(first, len(ids))), [t or b"" for t in b.column(2).to_pylist()], width):
                held.append(x)
                if sum(map(len, held)) > FLUSH:
                    yield from flush()
        if held:
            yield from flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "tie", "s", "e", "r", "n", "k"]
        held: list[np.ndarray] = []
        ties: list[np.ndarray] = []
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            x = np.concatenate(held)
            x["doc"], by_doc, by_tie = ranked(x["doc"], np.concatenate(ties))
            held.clear()
            ties.clear()
            x, (doc, s, e) = split_repeats(x, width)
            yield pa.RecordBatch.from_arrays([pa.array(by_doc[doc]), pa.array(by_tie[doc]), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.nulls(len(doc), pa.int32()), pa.nulls(len(doc), pa.int32()), pa.nulls(len(doc), pa.int64())], names)
            same = x["k"][1:] == x["k"][:-1]
            x = x[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(x) > 1 else x[:0]
            yield pa.RecordBatch.from_arrays([pa.array(by_doc[x["doc"]]), pa.array(by_tie[x["doc"]]), pa.array(x["s"].astype(np.int64)), pa.nulls(len(x), pa.int64()), pa.array(x["r"].astype(np.int32)), pa.array(x["n"].astype(np.int32)), pa.array(x["k"].view(np.int64))], names)

        for b in batches:
            known = b.filter(pa.compute.is_valid(b.column(2)))
            if len(known):
                yield pa.RecordBatch.from_arrays([known.column(2), known.column(3), known.column(4), known.column(5), pa.nulls(len(known), pa.int32()), pa.nulls(len(known), pa.int32()), pa.nulls(len(known), pa.int64())], names)
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not blob.is_valid:
                    continue
                if bucket != now and held:
                    yield from flush()
                now = bucket
                raw = blob.as_buffer()
                m = len(raw) // (np.dtype(_ANCHOR).itemsize + 8)
                x, at = np.empty(m, _ANCHOR), 0
                for f, t in _ANCHOR:
                    x[f] = np.frombuffer(raw, t, m, at)
                    at += m * np.dtype(t).itemsize
                held.append(x)
                ties.append(np.frombuffer(raw, np.int64, m, at))
        if held:
            yield from flush()

    dealt = rows.mapInArrow(scan, "bucket int, blob binary, doc long, tie long, s long, e long").repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = stored(dealt.mapInArrow(gather, "doc long, tie long, s long, e long, r int, n int, k long"), "anchors")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lead, seg, doc, tie, s, r, n, k = [], [], [], [], [], [], [], []
            for d, h, t, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for p in places:
                    lead.append(t[p["s"] + p["r"] : p["s"] + p["r"] + LEAD])
                    seg.append(t[p["s"] : p["s"] + p["n"] - 1 + width])
                    doc.append(d)
                    tie.append(h)
                    s.append(p["s"])
                    r.append(p["r"])
                    n.append(p["n"])
                    k.append(p["k"])
            yield pa.RecordBatch.from_arrays([pa.array(lead, pa.binary()), pa.array(seg, pa.binary()), pa.array(doc, pa.int64()), pa.array(tie, pa.int64()), pa.array(s, pa.int64()), pa.array(r, pa.int32()), pa.array(n, pa.int32()), pa.array(k, pa.int64())], ["lead", "seg", "doc", "tie", "s", "r", "n", "k"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors come sorted, so those of a bucket's next WINDOWS places are held, up to the end of an anchor."""

        def flush(t: pa.Table) -> pa.RecordBatch:
            col = lambda c: t.column(c).to_numpy()
            own, by_doc, by_tie = ranked(col("doc"), col("tie"))
            doc, s, e = window_repeats(col("k"), own, col("s"), col("r"), col("n"), t.column("seg").to_pylist(), width)
            return pa.RecordBatch.from_arrays([pa.array(by_doc[doc]), pa.array(by_tie[doc]), pa.array(s, pa.int64()), pa.array(e, pa.int64())], ["doc", "tie", "s", "e"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            k = b.column("k").to_numpy()
            cut = np.flatnonzero(k[1:] != k[:-1])
            if held and sum(map(len, held)) >= WINDOWS:
                last = held[-1].column("k")[-1].as_py()
                end = 0 if len(k) and k[0] != last else int(cut[0]) + 1 if len(cut) else len(b)
                held.append(b.slice(0, end))
                if end < len(b):
                    yield flush(pa.Table.from_batches(held))
                    held = []
                b = b.slice(end)
            if len(b):
                held.append(b)
        if held:
            yield flush(pa.Table.from_batches(held))

    open_ = found.where("k is not null").groupBy("doc", "tie").agg(F.collect_list(F.struct("s", "r", "n", "k")).alias("places"))
    suffixes = rows.join(open_, ["doc", "tie"]).select("doc", "tie", "t", "places").mapInArrow(cut, "lead binary, seg binary, doc long, tie long, s long, r int, n int, k long")
    late = suffixes.repartitionByRange(parts, "lead").sortWithinPartitions("lead", "k").mapInArrow(compare, "doc long, tie long, s long, e long")
    return found.where("k is null").select("doc", "tie", "s", "e").unionByName(late)


def cut_out(text: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """The bytes outside the spans, and the number of runs that went."""
    if not spans:
        return text, 0
    s, e = np.array([x["s"] for x in spans]), np.array([x["e"] for x in spans])
    inside = s < len(text)
    _, s, e = merged(np.zeros(inside.sum(), np.int64), s[inside], np.minimum(e[inside], len(text)))
    edges = [0, *np.stack((s, e), 1).ravel().tolist(), len(text)]
    return b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)), len(s)


def _key(id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    """doc, tie and t: the id, a null one the smallest, the checksum of the text, and its bytes."""
    t = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("doc"), F.xxhash64(t).alias("tie"), t.alias("t")


def _spans(rows: DataFrame, width: int) -> DataFrame:
    """(doc, tie, spans) of the rows that lose bytes; all else that was stored to find them goes."""
    with scratch(rows.sparkSession) as keep:
        return keep(repeated_spans(rows, width).groupBy("doc", "tie").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")


def remove_repeats(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: (doc_id, n_bytes, n_removed, n_spans, kept binary, kept_sha256).

    Every byte covered by a width-byte string that also starts earlier (smaller id, or the same
    document, earlier start) goes; strings are judged on the input and never cross documents.

    Of all suffixes, those at anchors are sorted: an anchor is the GRAM-byte string of least hash
    in a width-byte window, about one in (width - GRAM) / 2 bytes, so equal windows share an
    anchor at the same place. Runs of windows that repeat whole are found by hash before and in
    one shuffle of anchor records. What is left where passages begin and end is cut out of the
    texts as suffixes, range-partitioned at sampled splitters by the bytes that lead them, sorted
    by a multikey sort in each bucket and compared byte by byte. Equal leading bytes meet in one
    bucket, so nothing is to compare across boundaries.

    Null and empty texts keep nothing and lose nothing. A null id is the smallest. Rows of one id,
    or of none, are documents of their own in the order of their texts' checksums; only those of
    equal texts too count as one document, and keep what neither repeats from another.
    Other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(*_key(id_col, text_col))
    spans = _spans(rows, width)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for d, t, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                kept, n = cut_out(t, spans)
                out.append((None if d == LEAST else d, len(t), len(t) - len(kept), n, kept, hashlib.sha256(kept).hexdigest()))
            cols = zip(*out, strict=True) if out else [[]] * 6
            types = [pa.int64()] * 4 + [pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return rows.join(spans, ["doc", "tie"], "left").select("doc", "t", "spans").mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def without_repeats(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """docs with the repeats out of their texts, and count_col, where there is one, counted anew.

    Bytes of a character that is cut in the middle are dropped with it. A text of which nothing
    is left is empty; a null text stays null. Rows of one id, or of none, are told apart by their
    texts (see remove_repeats); an empty table stays empty; other columns may have any name.
    """
    names = docs.columns
    rows = docs.select(*_key(id_col, text_col))
    spans = _spans(rows, width)
    own = docs.select(F.struct(*names).alias("row"), *_key(id_col, text_col)[:2])
    joined = own.join(spans, ["doc", "tie"], "left").select("row", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = dict(zip(names, b.column(0).flatten(), strict=True))
            texts = []
            for t, spans in zip(cols[text_col].to_pylist(), b.column(1).to_pylist(), strict=True):
                if spans and t is not None:
                    raw = t.encode()
                    t = cut_out(raw, spans)[0].decode(errors="ignore")
                texts.append(t)
            cols[text_col] = pa.array(texts, cols[text_col].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names)

    out = joined.mapInArrow(run, docs.schema)
    if count_col in names:
        kind = docs.schema[count_col].dataType
        out = out.withColumn(count_col, F.when(F.col(text_col).isNull(), F.col(count_col)).otherwise(F.char_length(text_col).cast(kind)))
    return out
