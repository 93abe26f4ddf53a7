"""Shared pieces: byte kernels over whole texts, and tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexspark.operators.store import drop_stored, remove, scratch, shared_path, stored

__all__ = ["drop_stored", "remove", "scratch", "shared_path", "stored"]

U64 = np.uint64
#: Odd multipliers of the polynomial hashes.
R1, R2 = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
#: Texts are processed in chunks of about this many bytes.
CHUNK = 1 << 20

#: The white space between words: space and \t \n \v \f \r.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(r: np.uint64, n: int, cache: dict = {}) -> np.ndarray:  # noqa: B006
    """r**0 .. r**(n-1) modulo 2**64."""
    key = int(r)
    if len(cache.get(key, ())) < n:
        a = np.full(max(n, 4096), r, dtype=U64)
        a[0] = 1
        cache[key] = np.multiply.accumulate(a)
    return cache[key][:n]


def _word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words in buf (A-Z lowered)."""
    ws = SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], ws, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, U64), starts
    lens = ends - starts
    body = LOWER[buf][~ws].astype(U64)
    first = np.cumsum(lens) - lens
    body += U64(1)
    body *= powers(R1, int(lens.max()))[np.arange(len(body)) - np.repeat(first, lens)]
    return mix(np.add.reduceat(body, first) + lens.astype(U64) * R2), starts


def chunked(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of about CHUNK bytes each."""
    run: list[bytes] = []
    size = 0
    for t in texts:
        if run and size + len(t) > CHUNK:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t) + 1
    if run:
        yield run


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text cut at white space, so that no word is cut."""
    at = 0
    while len(text) - at > CHUNK:
        cut = max(text.rfind(s, at + 1, at + CHUNK) for s in (b" ", b"\n", b"\t", b"\v", b"\f", b"\r"))
        if cut <= at:  # one word longer than a chunk
            found = [p for s in (b" ", b"\n", b"\t", b"\v", b"\f", b"\r") if (p := text.find(s, at + CHUNK)) >= 0]
            cut = min(found, default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts one after the other, and each text's number of words.

    Words are runs of bytes other than space and \\t-\\r; A-Z count as a-z. A null text has none.
    """
    hashes, counts = [], []
    for run in chunked([t or b"" for t in texts]):
        if len(run) == 1 and len(run[0]) > CHUNK:
            parts = [_word_hashes(np.frombuffer(p, np.uint8))[0] for p in _pieces(run[0])]
            hashes += parts
            counts.append(np.array([sum(map(len, parts))]))
            continue
        h, starts = _word_hashes(np.frombuffer(b"\n".join(run) + b"\n", np.uint8))
        bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in run])))
        hashes.append(h)
        counts.append(np.diff(np.searchsorted(starts, bounds)))
    return (np.concatenate(hashes), np.concatenate(counts)) if hashes else (np.empty(0, U64), np.empty(0, np.int64))


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
