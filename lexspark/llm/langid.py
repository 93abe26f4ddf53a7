"""Language identification with Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm._common import R1, U64, mix

ORDER = 4
DISCOUNT = 0.75
#: Characters of training text a language, about: the bound of the labelled sample.
SAMPLE_CHARS = 1_000_000
#: Characters that a language has not seen share this many places.
ALPHABET = 65_536
#: A text is rejected if its cross-entropy is so many deviations over its language's.
REJECT = 8.0
#: Texts of a language are taken to differ by so many bits a character at least.
LEAST_SPREAD = 0.25
#: Characters that are looked up at a time; longer texts go in parts of so many.
PART = 1 << 16
START = 2
UND = "und"


def characters(text: str) -> np.ndarray:
    """Code points of a text, lower-cased, white space as one kind."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(U64)
    c[(c == 9) | (c == 10) | (c == 13) | (c == 160)] = 32
    return c


def keys(chars: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n characters up to each place; places before the text count as START."""
    h = np.zeros(len(chars), U64)
    for j in range(n):
        back = n - 1 - j
        c = chars if not back else np.concatenate((np.full(min(back, len(chars)), START, U64), chars[:-back]))
        h = h * R1 + c + U64(1)
    return mix(h + U64(n))


@dataclass
class Table:
    """Rows by hash: sorted hashes, their rows, and where each run of leading bits begins."""

    hashes: np.ndarray
    rows: np.ndarray
    begin: np.ndarray
    shift: int

    @classmethod
    def of(cls, hashes: np.ndarray, rows: np.ndarray) -> Table:
        bits = max(4, int(np.ceil(np.log2(len(hashes) + 1))) + 1)
        begin = np.searchsorted(hashes, np.arange(2**bits, dtype=U64) << U64(64 - bits))
        return cls(hashes, rows, np.append(begin, len(hashes)).astype(np.int32), 64 - bits)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row numbers of the hashes, -1 where there is none."""
        top = (h >> U64(self.shift)).astype(np.int64)
        at, end = self.begin[top], self.begin[top + 1]
        out = np.full(len(h), -1, np.int32)
        live = np.flatnonzero(at < end)
        while len(live):
            p = at[live]
            hit = self.hashes[p] == h[live]
            out[live[hit]] = p[hit]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out


@dataclass
class Model:
    """For every order, log2 probabilities by n-gram and language, and back-off costs by context."""

    langs: list[str]
    grams: list[Table]
    backs: list[Table]
    mean: np.ndarray
    spread: np.ndarray
    step: np.ndarray

    def log2(self, chars: np.ndarray, order: int = 0) -> np.ndarray:
        """log2 probability of each character of a text for each language."""
        return self._log2({n: keys(chars, n) for n in range(1, ORDER + 1)}, ORDER)

    def _log2(self, k: dict[int, np.ndarray], n: int) -> np.ndarray:
        if n == 0:
            return np.full((len(k[1]), len(self.langs)), -np.log2(ALPHABET), np.float32)
        t = self.grams[n - 1]
        at = t.find(k[n])
        out = t.rows[at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            low = self._log2({i: v[miss] for i, v in k.items()}, n - 1)
            b = self.backs[n - 1]
            ctx = b.find(k[-n][miss]) if -n in k else b.find(np.full(len(miss), _ROOT))
            out[miss] = low + np.where((ctx >= 0)[:, None], b.rows[ctx], 0)
        return out

    def entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in bits a character by text and language, and the texts' lengths."""
        sums, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        run: list[tuple[int, np.ndarray, int]] = []  # text, characters, how many of them are history
        size = 0

        def flush() -> None:
            nonlocal size
            if run:
                k = {m: np.concatenate([keys(c, m)[h:] for _, c, h in run]) for m in range(1, ORDER + 1)}
                for m in range(2, ORDER + 1):
                    k[-m] = np.concatenate([np.concatenate((mix(_start(m - 1)), keys(c, m - 1)[:-1]))[h:] for _, c, h in run])
                lens = np.array([len(c) - h for _, c, h in run])
                v = np.add.reduceat(self._log2(k, ORDER), np.cumsum(lens) - lens, axis=0, dtype=np.float64)
                np.add.at(sums, [i for i, _, _ in run], v)
                np.add.at(n, [i for i, _, _ in run], lens)
            run.clear()
            size = 0

        for i, t in enumerate(texts):
            # a long text goes in parts; each has the last characters of the one before as history
            before = np.empty(0, U64)
            for at in range(0, len(t), PART):
                c = np.concatenate((before, characters(t[at : at + PART])))
                run.append((i, c, len(before)))
                size += len(c)
                before = c[1 - ORDER :]
                if size > PART:
                    flush()
        flush()
        return -sums / np.maximum(n, 1)[:, None], n

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, share of the evidence (0 to 1) and rejection of each text."""
        lang, score, out = [UND] * len(texts), [0.0] * len(texts), [True] * len(texts)
        live = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.langs else []
        h, n = self.entropy([texts[i] for i in live])
        for j, i in enumerate(live):
            best = int(np.argmin(h[j]))
            lang[i] = self.langs[best]
            score[i] = float(1 / np.exp2((h[j, best] - h[j]) * min(n[j], 200)).sum())
            limit = self.mean[best] + REJECT * np.sqrt(self.spread[best] ** 2 + self.step[best] ** 2 / n[j])
            out[i] = bool(h[j, best] > limit)
        return lang, score, out


_ROOT = U64(0)


def _start(n: int) -> np.ndarray:
    h = np.zeros(1, U64)
    for _ in range(n):
        h = h * R1 + U64(START + 1)
    return h + U64(n)


def fit(sample: dict[str, list[str]]) -> Model:
    """Interpolated Kneser-Ney models of the languages; lower orders count histories."""
    langs = sorted(sample)
    chars = {lang: [c for t in sample[lang] if len(c := characters(t))] for lang in langs}
    langs = [x for x in langs if chars[x]]
    probs: list[list[tuple]] = [[] for _ in range(ORDER)]
    for lang in langs:
        own = {n: np.concatenate([keys(c, n) for c in chars[lang]]) for n in range(1, ORDER + 1)}
        ctx = {n: np.concatenate([np.concatenate((mix(_start(n - 1)), keys(c, n - 1)[:-1])) for c in chars[lang]]) for n in range(2, ORDER + 1)}
        ctx[1] = np.full(len(own[1]), _ROOT)
        top, first, count = np.unique(own[ORDER], return_index=True, return_counts=True)
        places = first  # of each n-gram, one place where it occurs
        for n in range(ORDER, 0, -1):
            probs[n - 1].append((own[n][places], ctx[n][places], count, own[n - 1][places] if n > 1 else None))
            if n > 1:
                _, i, count = np.unique(own[n - 1][places], return_index=True, return_counts=True)
                places = places[i]
    grams: list[Table] = []
    backs: list[Table] = []
    for n in range(1, ORDER + 1):
        all_g = np.unique(np.concatenate([p[0] for p in probs[n - 1]])) if langs else np.empty(0, U64)
        all_c = np.unique(np.concatenate([p[1] for p in probs[n - 1]])) if langs else np.empty(0, U64)
        back = np.zeros((len(all_c), len(langs)), np.float32)
        direct = np.zeros((len(all_g), len(langs)))
        gctx, low_key = np.zeros(len(all_g), U64), np.zeros(len(all_g), U64)
        for j, (g, c, count, low) in enumerate(probs[n - 1]):
            u, i = np.unique(c, return_inverse=True)
            total, types = np.bincount(i, count), np.bincount(i)
            back[np.searchsorted(all_c, u), j] = np.log2(DISCOUNT * types / total)
            at = np.searchsorted(all_g, g)
            direct[at, j] = (count - DISCOUNT) / total[i]
            gctx[at] = c
            if low is not None:
                low_key[at] = low
        if n == 1:
            low = np.full((len(all_g), len(langs)), 1 / ALPHABET)
        else:
            low = np.exp2(grams[-1].rows[grams[-1].find(low_key)])
        p = direct + np.exp2(back[np.searchsorted(all_c, gctx)]) * low if len(all_g) else direct
        grams.append(Table.of(all_g, np.log2(np.maximum(p, 1e-30)).astype(np.float32)))
        backs.append(Table.of(all_c, back))
    m = Model(langs, grams, backs, np.zeros(len(langs)), np.zeros(len(langs)), np.zeros(len(langs)))
    for j, lang in enumerate(langs):
        h, n = m.entropy(sample[lang])
        h, n = h[n > 0, j], n[n > 0]
        m.mean[j] = np.average(h, weights=np.minimum(n, 1000))
        off = h - m.mean[j]
        long = n >= 200
        m.spread[j] = max(LEAST_SPREAD, off[long].std() if long.any() else 0.0)
        m.step[j] = max(2.0, np.sqrt(np.mean(off**2 * n)))
    return m


def sample_of(docs: DataFrame, train: Column, text_col: str, lang_col: str, id_col: str, chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """Training texts by language, about chars characters each: those of the least hash of the id.

    The share that makes that size is computed first, so the driver gets no more than that, give
    or take a text, for each language. Every language gives one text at least, that of the least
    hash; no text gives more than its first chars characters to the sample.
    """
    d = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("l"), F.col(text_col).alias("t"), F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)).alias("h"))
    sizes = d.groupBy("l").agg(F.sum(F.least(F.char_length("t"), F.lit(chars))).alias("n"), F.min("h").alias("least"))
    share = sizes.select(F.col("l").alias("of"), (F.lit(float(chars)) / F.greatest("n", F.lit(1)) * (1 << 30)).alias("cut"), "least")
    out: dict[str, list[str]] = {}
    for r in d.join(F.broadcast(share), F.col("l") == F.col("of")).where("h < cut or h = least").select("l", F.substring("t", 1, chars).alias("t")).toLocalIterator():
        out.setdefault(r.l, []).append(r.t)
    return out


def train_model(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Models of the languages of docs, learned where train holds.

    Rows whose text or language is null teach nothing; repeated rows are drawn together; no rows
    give a model without languages. Texts and languages alone are read, and the id for its hash.
    """
    return fit(sample_of(docs, train, text_col, lang_col, id_col))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected added, in a map without a shuffle.

    lang_pred is the learned language of least cross-entropy a character over the whole text;
    `und` (score 0, rejected) if the text is null or has no letter, or nothing was learned. score
    is the language's share of the evidence of up to 200 characters; ties go to the first name.
    rejected says that the text is REJECT deviations, as calibrated on the training sample for its
    length, above its language. Names added must not occur in docs; repeated rows are predicted
    each; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 512) for i in range(0, len(b), 512)):
                lang, score, out = shared.value.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], [*names, "lang_pred", "score", "rejected"])

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

    schema = StructType(list(docs.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType()).add("rejected", BooleanType())
    return docs.mapInArrow(run, schema)


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language is recognised, columns as they are; the models learn from docs.

    Texts that are null or have no letter go; so do all if no row has a language. Repeated rows
    share one verdict, names of other columns may be any, an empty table stays empty.
    """
    model = train_model(docs, F.lit(True), id_col, text_col, lang_col)
    tagged = identify(docs.select(F.struct(*docs.columns).alias("doc"), F.col(text_col).alias("t")), model, "t")
    return tagged.where(~F.col("rejected")).select("doc.*")
