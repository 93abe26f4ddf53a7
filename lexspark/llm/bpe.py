"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts longer than this many characters are cut before they reach the encoder's regex.
LONG_TEXT = 200_000
_SAFE = re.compile(r"(?<=\S)\s")


def load(rank_file: str, pattern: str, cache: dict = {}) -> tiktoken.Encoding:  # noqa: B006
    """The encoding of a rank file (base64 token, space, rank a line), once a process."""
    key = (rank_file, pattern)
    if key not in cache:
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        cache[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return cache[key]


def cuts(text: str, limit: int = LONG_TEXT) -> Iterator[str]:
    """Parts of a text that encode on their own to the same ids.

    No match of the pattern runs from a non-space character on into white space, so each part
    but the first starts at white space that follows a non-space. A text with no such place
    within reach stays in one part.
    """
    at = 0
    while len(text) - at > limit:
        found = _SAFE.search(text, at + limit)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def encode(enc: tiktoken.Encoding, text: str | None) -> list[int]:
    """Ids of a whole text; null counts as empty."""
    if not text:
        return []
    if len(text) <= LONG_TEXT:
        return enc.encode_ordinary(text)
    return [i for part in cuts(text) for i in enc.encode_ordinary(part)]


def encode_column(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Ids and decoded bytes of each text: (id, ids array<int>, decoded binary).

    With digests: (id, n_tokens, ids_sha256, decoded_sha256) instead; ids are hashed as
    little-endian unsigned 32-bit integers. Null and empty texts give no ids. A narrow map over
    the table: no shuffle; each Python worker loads the rank file once.
    """
    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(rank_file, pattern)
        for b in batches:
            out: list[tuple] = []
            for t in b.column(1):
                ids = encode(enc, t.as_py())
                raw = enc.decode_bytes(ids)
                out.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()) if digests else (ids, raw))
            cols = [list(c) for c in zip(*out, strict=True)] or [[]] * (3 if digests else 2)
            types = [pa.int64(), pa.string(), pa.string()] if digests else [pa.list_(pa.int32()), pa.binary()]
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [id_col, *names])

    tail = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    return rows.mapInArrow(run, f"`{id_col}` {kind}, {tail}")
