"""Scoring texts with a weighted backoff automaton learned from the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm._common import R1, R2, U64, mix, stored, tokens

END, START = U64(0x5BD1E9955BD1E995), U64(0xC6A4A7935BD1E995)
#: Weight of the failure arc against the times that a state was left: of states of one word, and of two.
BACK = (256.0, 64.0)
#: Bytes of text in a block, the unit that gathers its share of the automaton.
BLOCK = 12 << 20
#: Bytes of text for each bucket of n-grams; a bucket is what one task holds at a time.
BUCKET = 16 << 20
#: Low bits of a hash that pairs and triples do without.
CUT = 6
_Z = pa.Codec("zstd", 1)


class Writer:
    """Sorted hashes and counts, packed: of differences the low 4 bytes as they are, what is above compressed."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []

    def squeezed(self, a: np.ndarray) -> None:
        raw = a.tobytes()
        z = _Z.compress(raw, asbytes=True)
        self.parts += [np.array([len(raw), len(z)], "<u4").tobytes(), z]

    def hashes(self, h: np.ndarray, shift: int) -> None:
        d = np.diff(h >> U64(shift), prepend=U64(0))
        self.parts += [np.array([len(d)], "<u4").tobytes(), d.astype("<u4").tobytes()]
        self.squeezed(np.ascontiguousarray((d >> U64(32)).astype("<u4").view(np.uint8).reshape(-1, 4).T))

    def bytes(self) -> bytes:
        return b"".join(self.parts)


class Reader:
    def __init__(self, raw: bytes) -> None:
        self.raw, self.at = memoryview(raw), 0

    def plain(self, dtype: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.raw, dtype, n, self.at)
        self.at += out.nbytes
        return out

    def squeezed(self, dtype: str) -> np.ndarray:
        full, n = (int(x) for x in self.plain("<u4", 2))
        out = np.frombuffer(_Z.decompress(self.raw[self.at : self.at + n], full, asbytes=True), dtype)
        self.at += n
        return out

    def hashes(self, shift: int) -> np.ndarray:
        n = int(self.plain("<u4", 1)[0])
        low = self.plain("<u4", n).astype(U64)
        high = np.ascontiguousarray(self.squeezed("u1").reshape(4, n).T).view("<u4").ravel().astype(U64)
        return np.cumsum(low | high << U64(32), dtype=U64) << U64(shift)


class Block:
    """Tokens of some texts, and the words, pairs and triples that occur in them, by hash."""

    def __init__(self, texts: list[bytes | None], train: np.ndarray) -> None:
        hashes, counts = tokens(texts)
        self.n = counts + 1
        ends = np.cumsum(self.n) - 1
        t = np.empty(int(self.n.sum()), U64)
        is_end = np.zeros(len(t), bool)
        is_end[ends] = True
        t[is_end], t[~is_end] = END, hashes
        self.starts = ends - self.n + 1
        self.first = np.zeros(len(t), bool)
        self.first[self.starts] = True
        before = np.concatenate(([START], t[:-1]))[: len(t)]
        before[self.first] = START
        two = np.concatenate(([START], before[:-1]))[: len(t)]
        low = ~U64((1 << CUT) - 1)
        pairs = mix(before * R1 + t) & low
        triples = mix(two * R2 + pairs) & low
        tr = np.repeat(train, self.n)
        #: by order: the distinct n-grams, which one each token ends, and how often in training texts
        self.grams, self.ending, self.count = [], [], []
        for k, where in ((t, None), (pairs, None), (triples, ~self.first)):  # no text's first token ends a triple
            own, at, of = (k, tr, slice(None)) if where is None else (k[where], tr[where], where)
            u, i = np.unique(own, return_inverse=True)
            ending = np.full(len(t), -1, np.int32)
            ending[of] = i
            self.grams.append(u)
            self.ending.append(ending)
            self.count.append(np.bincount(i[at], minlength=len(u)).astype("<u4"))
        self.train_texts = int(np.count_nonzero(train))

    def parts(self, buckets: int) -> Iterator[tuple[int, list[slice]]]:
        """(bucket, its words, pairs and triples); buckets are ranges of hashes, a power of two of them."""
        edges = np.arange(1, buckets, dtype=U64) << U64(64 - buckets.bit_length() + 1) if buckets > 1 else np.empty(0, U64)
        cuts = [np.concatenate(([0], np.searchsorted(g, edges), [len(g)])) for g in self.grams]
        for b in range(buckets):
            own = [slice(int(c[b]), int(c[b + 1])) for c in cuts]
            if any(s.stop > s.start for s in own):
                yield b, own

    def request(self, own: list[slice]) -> bytes:
        """What a bucket must know of the block: its n-grams and how often they occur here."""
        w = Writer()
        for g, c, s, shift in zip(self.grams, self.count, own, (0, CUT, CUT), strict=True):
            w.hashes(g[s], shift)
            w.squeezed(c[s])
        return w.bytes()


def answers(blobs: list[bytes]) -> tuple[list[bytes], int, int]:
    """Replies to the requests of one bucket, in order; the training tokens and distinct words in it."""
    out = [Writer() for _ in blobs]
    readers = [Reader(x) for x in blobs]
    n = v = 0
    for order, shift in enumerate((0, CUT, CUT)):
        asked = []
        for r in readers:
            asked.append((r.hashes(shift), r.squeezed("<u4")))
        every = np.concatenate([h for h, _ in asked])
        u, i = np.unique(every, return_inverse=True)
        total = np.bincount(i, np.concatenate([c for _, c in asked]), len(u)).astype(np.int64)
        if order == 0:
            n, v = int(total.sum()), int(np.count_nonzero(total))
        cut = np.cumsum([0, *(len(h) for h, _ in asked)])
        for w, a, b in zip(out, cut[:-1], cut[1:], strict=True):
            w.squeezed(np.minimum(total[i[a:b]], 2**32 - 1).astype("<u4"))
    return [w.bytes() for w in out], n, v


class Automaton:
    """The part of the automaton that a block's texts can reach.

    States are the words and pairs seen in training, a start and the state without history. An
    arc by a token was seen so often from its state (`arcs`, by order) and leads to the state of
    the longest seen end of what was read. A state of history h, left n times, has a failure arc
    of weight BACK / (n + BACK) to the state of h without its first word, and an arc seen c times
    has (c + BACK * p) / (n + BACK), where p is the probability behind the failure arc. The state
    without history has the add-one unigrams, with one class for all unknown words. So the arcs
    of a state and what its failure arc leads to sum to 1 over all words.
    """

    def __init__(self, block: Block, arcs: list[np.ndarray], n: int, v: int, texts: int) -> None:
        self.block, self.arcs, self.texts = block, arcs, texts
        self.unigram = (arcs[0] + 1.0) / (n + v + 1.0)

    def walk(self) -> np.ndarray:
        """log10 probability of each token, read from left to right.

        The state at a place follows from the two tokens before it, so the steps of all texts of
        the block are taken together, one order at a time: where an arc leaves the state its
        weight counts, else the failure arc is added and the step is tried from the state it
        leads to.
        """
        b = self.block
        p = self.unigram[b.ending[0]]
        for order, back in ((1, BACK[0]), (2, BACK[1])):
            # how often the state was left: its own n-gram's count, as each text ends with an end token
            seen = self.arcs[order - 1][b.ending[order - 1]]
            left = np.concatenate(([0], seen[:-1]))[: len(p)].astype(np.float64)
            if order == 1:
                left[b.first] = self.texts
                taken = self.arcs[1][b.ending[1]]
            else:
                left[b.first] = 0  # the start has no longer history
                taken = np.where(b.first, 0, np.append(self.arcs[2], 0)[b.ending[2]])
            p = (taken + back * p) / (left + back)
        return np.log10(p)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list, list]]:
    """(block, ids, texts, train) over a partition's rows in order, cut by bytes alone."""
    part = TaskContext.get().partitionId()
    ids, texts, train, size, k = [], [], [], 0, 0
    for b in batches:
        for i, t, tr in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if texts and size + len(t or b"") > BLOCK:
                yield part << 24 | k, ids, texts, train
                ids, texts, train, size, k = [], [], [], 0, k + 1
            ids.append(i)
            texts.append(t)
            train.append(bool(tr))
            size += len(t or b"") + 1
    if texts:
        yield part << 24 | k, ids, texts, train


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Tokens are a text's words, A-Z lowered, and one end; a null text counts as empty. base_score
    is the add-one unigram model's log10 probability, score that of the automaton (see Automaton)
    of words, pairs and triples. A text is traversed once from left to right; the sum of its
    steps is the score.

    The automaton is as large as the corpus asks for and never in one place. A block of texts
    sends the n-grams it holds, with their counts in training texts, to buckets by hash; each
    bucket adds up its own and answers every block on just these, so a block gets its part of the
    automaton and walks its texts on it. An n-gram goes to its bucket by its own hash, so no
    common word or pair gathers in one. Buckets follow the bytes of the texts, and a task holds
    one at a time. Hashes are of 64 bits, of 58 for pairs and triples; equal ones count as one.

    docs must give the same rows in the same partitions when read twice, as files do (else store
    it first); a block checks that and fails rather than score wrongly. Repeated rows, equal ids
    and null ids are rows like others; an empty table gives an empty result; no training rows
    make every word unknown. Columns besides id, text and those of train are not read.
    """
    spark = docs.sparkSession
    # ids travel as text: pandas would make doubles of long ones beside a null
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.col(text_col).cast("binary").alias("t"), F.coalesce(train, F.lit(False)).alias("tr"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 1 << max(1, int(np.ceil(np.log2(max(2 * parts, size / BUCKET)))))
    names = ["bucket", "block", "data", "texts"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, texts, tr in _blocks(batches):
            x = Block(texts, np.array(tr))
            n = x.train_texts
            for b, own in x.parts(buckets):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([block], pa.int64()), pa.array([x.request(own)], pa.binary()), pa.array([n], pa.int64())], names)
                n = 0

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            replies, n, v = answers([x[1] for x in held])
            first = [i == 0 for i in range(len(held))]
            return pa.RecordBatch.from_arrays([pa.array([now] * len(held), pa.int32()), pa.array([x[0] for x in held], pa.int64()), pa.array(replies, pa.binary()), pa.array([x[2] for x in held], pa.int64()), pa.array([n * f for f in first], pa.int64()), pa.array([v * f for f in first], pa.int64())], [*names, "n", "v"])

        now, held = None, []
        for batch in batches:
            for bucket, block, data, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now and held:
                    yield flush()
                    held = []
                now = bucket
                held.append((block, data, texts))
        if held:
            yield flush()

    asked = rows.mapInArrow(ask, "bucket int, block long, data binary, texts long").repartition(parts, "bucket").sortWithinPartitions("bucket")
    answered = stored(asked.mapInArrow(answer, "bucket int, block long, data binary, texts long, n long, v long"), "answers")
    total = answered.agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("texts").alias("texts")).first()
    n_train, v_train, n_texts = total.n or 0, total.v or 0, total.texts or 0

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts, tr in _blocks(batches):
            for i in range(0, len(ids), 4096):
                m = len(ids[i : i + 4096])
                yield pa.RecordBatch.from_arrays([pa.array([block] * m, pa.int64()), pa.array(range(i, i + m), pa.int32()), pa.array(ids[i : i + 4096], pa.string()), pa.array(texts[i : i + 4096], pa.binary()), pa.array(tr[i : i + 4096], pa.bool_())], ["block", "at", "id", "t", "tr"])

    def traverse(own: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        changed = "the documents changed between two reads; store them first"
        own = own.sort_values("at")
        tr = own.tr.to_numpy(bool)
        x = Block(own.t.tolist(), tr)
        arcs = [np.zeros(len(g)) for g in x.grams]
        got = dict(zip(replies.bucket, replies.data, strict=True))
        for b, part in x.parts(buckets):
            if b not in got:
                raise RuntimeError(changed)
            r = Reader(got.pop(b))
            for a, s in zip(arcs, part, strict=True):
                c = r.squeezed("<u4")
                if len(c) != s.stop - s.start:
                    raise RuntimeError(changed)
                a[s] = c
        if got or any((a < c).any() for a, c in zip(arcs, x.count, strict=True)):
            raise RuntimeError(changed)
        m = Automaton(x, arcs, n_train, v_train, n_texts)
        sums = lambda v: np.add.reduceat(v, x.starts)
        word = x.ending[0]
        return pd.DataFrame({"doc_id": own.id.to_numpy(), "held_out": ~tr, "n_tokens": x.n, "n_known": sums((arcs[0] > 0)[word].astype(np.int64)), "train_tokens": n_train, "base_score": sums(np.log10(m.unigram)[word]), "score": sums(m.walk())})

    texts = rows.mapInArrow(tag, "block long, at int, id string, t binary, tr boolean")
    replies = answered.select("block", "bucket", "data")
    out = texts.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(traverse, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
