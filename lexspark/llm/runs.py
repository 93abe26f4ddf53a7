"""Periodic runs of words, enumerated from the Lempel-Ziv blocks of each text."""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: A run is at least so many times as long as its period, and at least so many words.
LEAST_EXPONENT, LEAST_WORDS = 4, 6
#: Texts are taken together up to about so many words.
BATCH_WORDS = 400_000


class Factors:
    """Names of the substrings of 1, 2, 4, ... words of texts laid end to end.

    x holds the words as numbers, doc the text of each. names[k][i] is the rank of the 2**k words
    from i on (fewer where the text ends) among those of all places; so the last are the ranks of
    the suffixes, text by text, and two places agree on 2**k words if their names do.
    """

    def __init__(self, x: np.ndarray, doc: np.ndarray) -> None:
        n = len(x)
        self.end = np.searchsorted(doc, doc, side="right")
        self.begin = np.searchsorted(doc, doc, side="left")
        key = doc.astype(np.int64) * (int(x.max(initial=0)) + 1) + x
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([True], np.diff(key[order]) != 0))[:n]
        name = np.empty(n, np.int32)
        name[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        self.names = [name]
        # from here on only places that share their name are looked at: `order` is by name
        tied = ~(new & np.concatenate((new[1:], [True])))
        at, step = np.flatnonzero(tied), 1
        self.order = order
        while len(at):
            own = order[at]
            name = self.names[-1]
            after = np.where(own + step < self.end[own], name[np.minimum(own + step, n - 1)].astype(np.int64) + 1, 0)
            by = np.lexsort((after, name[own]))  # `at` is by name already, so names keep their places
            own, after = own[by], after[by]
            order[at] = own
            old = name[own]
            new = np.concatenate(([True], (old[1:] != old[:-1]) | (after[1:] != after[:-1])))
            name = name.copy()
            name[own] = np.maximum.accumulate(np.where(new, at, 0))
            self.names.append(name)
            at = at[~(new & np.concatenate((new[1:], [True])))]
            step *= 2

    def _extend(self, i: np.ndarray, j: np.ndarray, same: Callable) -> np.ndarray:
        """How far pairs agree; same(k, i, j, length) tells whether 2**k words beyond length do."""
        length = np.zeros(len(i), np.int64)
        live, tops = np.arange(len(i)), []
        for k in range(len(self.names)):  # the highest names that still agree, by fewer and fewer pairs
            live = live[same(k, i[live], j[live], 0)]
            if not len(live):
                break
            tops.append(live)
        for k in range(len(tops) - 1, -1, -1):
            own = tops[k]
            ok = own[same(k, i[own], j[own], length[own])]
            length[ok] += 1 << k
        return length

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The number of words on which the suffixes at i and j (one text, i <> j) agree."""

        def same(k: int, i: np.ndarray, j: np.ndarray, n: np.ndarray | int) -> np.ndarray:
            i, j = i + n, j + n
            name, last = self.names[k], len(self.end) - 1
            return (np.maximum(i, j) < self.end[np.minimum(i, j) - n]) & (name[np.minimum(i, last)] == name[np.minimum(j, last)])

        return self._extend(i, j, same)

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The number of words on which the texts up to and with i and j agree; i < j, i may be before the text."""

        def same(k: int, i: np.ndarray, j: np.ndarray, n: np.ndarray | int) -> np.ndarray:
            a, b = i - n - (1 << k) + 1, j - n - (1 << k) + 1
            name = self.names[k]
            return (a >= self.begin[j]) & (name[np.maximum(a, 0)] == name[np.maximum(b, 0)])

        return self._extend(i, j, same)


def previous_factors(f: Factors) -> tuple[np.ndarray, np.ndarray]:
    """For each place the length of the longest earlier equal substring of its text (LPF), and where that starts.

    The candidates are the nearest suffixes before and after in sorted order that start earlier;
    they are found for all places at once, by jumps over those that start later.
    """
    sa = f.order
    n = len(sa)
    length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    place = np.arange(n)
    for step in (-1, 1):
        near = place + step
        live = place
        while len(live):
            inside = (near[live] >= 0) & (near[live] < n)
            live = live[inside]
            live = live[sa[near[live]] > sa[live]]
            near[live] = near[near[live]]
        ok = (near >= 0) & (near < n)
        i, j = sa[ok], sa[near[ok]]
        one = f.names[0][i] == f.names[0][j]
        i, j = i[one], j[one]
        got = f.forward(j, i)
        better = got > length[i]
        length[i[better]], source[i[better]] = got[better], j[better]
    return length, source


def blocks(length: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks of all texts: a block is a longest previous factor, or one new word."""
    step = np.maximum(length, 1).tolist()
    out: list[int] = []
    for at, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        while at < end:
            out.append(at)
            at += step[at]
    return np.array(out, np.int64)


def runs(x: np.ndarray, doc: np.ndarray, exponent: int = LEAST_EXPONENT, words: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs (start, end, period) of the texts in x, by start and period; exponent is 3 or more.

    A run of `exponent` periods that does not lie inside one block touches the start of a block (or
    the end of its text), and its period is at most (a + b) / (exponent - 1) for the blocks of a
    and b words that meet there: only its first period can hold several block starts, since a block
    that starts in a later one reaches to the run's end. So each boundary is extended both ways
    for these periods. A run inside a block is a copy of one that started earlier.
    """
    none = (np.empty(0, np.int64),) * 3
    if not len(x):
        return none
    f = Factors(x, doc)
    length, source = previous_factors(f)
    bounds = np.concatenate((np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))), [len(x)]))
    start = blocks(length, bounds)
    if not len(start):
        return none
    size = np.diff(np.concatenate((start, [len(x)])))
    own = doc[start]
    first = np.concatenate(([True], own[1:] != own[:-1]))
    last = np.concatenate((first[1:], [True]))
    # boundaries inside texts, and the ends of texts
    inner = np.flatnonzero(~first)
    at = np.concatenate((start[inner], start[last] + size[last]))
    most = np.concatenate((size[inner - 1] + size[inner], size[last])) // (exponent - 1)
    left = f.begin[np.concatenate((start[inner], start[last]))]
    b = np.repeat(at, most)
    p = np.arange(len(b)) - np.repeat(np.cumsum(most) - most, most) + 1
    lo, hi = np.repeat(left, most), f.end[np.maximum(b - 1, 0)]
    name = f.names[0]
    found = []
    for i in (b - p, b):  # the pair of words a period apart that starts a period before, or at, the boundary
        j = i + p
        ahead = (i >= lo) & (j < hi)
        ahead[ahead] = name[i[ahead]] == name[j[ahead]]
        behind = (i - 1 >= lo) & (j <= hi)
        behind[behind] = name[i[behind] - 1] == name[j[behind] - 1]
        fwd, back = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        fwd[ahead] = f.forward(i[ahead], j[ahead])
        back[behind] = f.backward(i[behind] - 1, j[behind] - 1)
        whole = back + fwd + p
        ok = (whole >= exponent * p) & (whole >= words) & (back + fwd > 0)
        found.append(np.stack((i[ok] - back[ok], j[ok] + fwd[ok], p[ok])))
    s, e, p = np.concatenate(found, axis=1)
    if not len(s):
        return none
    o = np.lexsort((p, e, s))
    s, e, p = s[o], e[o], p[o]
    least = np.concatenate(([True], (s[1:] != s[:-1]) | (e[1:] != e[:-1])))  # multiples of a period give the same stretch
    s, e, p = s[least], e[least], p[least]
    return copied(s, e, p, start, start + size, source[start])


def copied(s: np.ndarray, e: np.ndarray, p: np.ndarray, start: np.ndarray, end: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, ...]:
    """The runs with their copies inside blocks: runs are kept in buckets by start, blocks go from left to right."""
    buckets: dict[int, set[tuple[int, int]]] = {}
    for a, z, q in zip(s.tolist(), e.tolist(), p.tolist(), strict=True):
        buckets.setdefault(a, set()).add((z, q))
    starts = sorted(buckets)
    # only blocks whose source holds a whole run can copy one; a copy gives later blocks no shorter run
    shortest = int((e - s).min())
    for a, z, src in zip(*(c[(end - start > shortest) & (source >= 0)].tolist() for c in (start, end, source)), strict=True):
        d = a - src
        i = bisect_left(starts, src + 1)
        while i < len(starts) and starts[i] + d < z:
            to = starts[i] + d
            for stop, q in list(buckets[starts[i]]):
                if stop + d < z and (stop + d, q) not in buckets.get(to, ()):
                    if to not in buckets:
                        starts.insert(bisect_left(starts, to), to)
                    buckets.setdefault(to, set()).add((stop + d, q))
            i += 1
    out = np.array([(a, z, q) for a in starts for z, q in sorted(buckets[a], key=lambda r: r[1])], np.int64)
    return out[:, 0], out[:, 1], out[:, 2]


def dropped(s: np.ndarray, e: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """Whether a run holds each of n words after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, s + p, 1)
    np.add.at(edge, e, -1)
    return np.cumsum(edge)[:n] > 0


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Where each word of an id's text comes from if a period is planted in it: one id in ten, by checksum."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % period
    return at


def _of(texts: list[list[bytes]]) -> Iterator[tuple]:
    """n_runs, the longest run, the digest of the runs and that of the words kept, for each text."""
    lens = np.array([len(t) for t in texts], np.int64)
    words = pa.array([w for t in texts for w in t], pa.large_binary()).dictionary_encode()
    x = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), lens)
    s, e, p = runs(x, doc)
    base = np.cumsum(lens) - lens
    cut = np.searchsorted(doc[s], np.arange(len(texts) + 1)) if len(s) else np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        a, z, q = (c[cut[i] : cut[i + 1]] for c in (s, e, p))
        a, z = a - base[i], z - base[i]
        longest: tuple = (None,) * 4
        kept = t
        if len(a):
            k = np.lexsort((q, a, a - z))[0]
            longest = (int(a[k]), int(z[k] - a[k]), int(q[k]), int(1000 * (z[k] - a[k]) // q[k]))
            kept = [t[j] for j in np.flatnonzero(~dropped(a, z, q, len(t)))]
        listed = "".join(f"{b},{c - b},{r}\n" for b, c, r in zip(a.tolist(), z.tolist(), q.tolist(), strict=True))
        yield len(a), *longest, hashlib.sha256(listed.encode()).hexdigest(), b" ".join(kept)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, digests: bool = False) -> DataFrame:
    """One row a document: doc_id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256, collapsed.

    Words are runs of characters other than space and \\t-\\r. A run is a stretch of words with
    smallest period q, at least LEAST_EXPONENT periods and LEAST_WORDS words long, that no
    neighbouring word extends. The longest is the first by start, then period, where lengths tie;
    without a run its columns are null. runs_sha256 digests the lines `start,length,period`;
    collapsed is the text without what repeats a run's first period, words joined by one space,
    and with digests its SHA-256 as collapsed_sha256. With plant, one text in ten (by the checksum
    of the id) gets a period planted before, for tests at scale.

    A null or empty text has no words, so no runs, and an empty collapsed text. Repeated rows and
    null ids are rows like others; an empty table gives an empty result; no other column is read.
    A narrow map over the table without a shuffle: a text is held whole, texts together up to
    BATCH_WORDS words.
    """
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256"]
    types = [*[pa.int64()] * 5, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids: list = []
            held: list[list[bytes]] = []
            size = 0
            for k, t in zip(b.column(0), b.column(1), strict=True):
                k, own = k.as_py(), t.as_buffer().to_pybytes().split() if t.is_valid else []
                at = planted(k, len(own)) if plant else None
                if at is not None:
                    own = [own[i] for i in at]
                if held and size + len(own) > BATCH_WORDS:
                    yield batch(ids, held)
                    ids, held, size = [], [], 0
                ids.append(k)
                held.append(own)
                size += len(own)
            if held:
                yield batch(ids, held)

    def batch(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        out = [(*r[:-1], hashlib.sha256(r[-1]).hexdigest() if digests else r[-1].decode()) for r in _of(texts)]
        cols = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, kinds), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [id_col, *names, last])

    kinds = to_arrow_type(rows.schema["k"].dataType)
    last = "collapsed_sha256" if digests else "collapsed"
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, {last} string")
