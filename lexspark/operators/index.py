"""Segmentation of documents and the prefix-partitioned occurrence index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexspark.functions import text as X


#: Characters of the blocks that a text is cut into first; of the chunks that a block is cut into, characters (in_context) or tokens (segments).
BLOCK, CHUNK = 4_000, 60


def _before(lengths: Column) -> Column:
    """For each of a few lengths the sum of those before it."""
    return F.transform(lengths, lambda x, i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0).cast("long"), lambda a, b: a + b))


def _long(x: Column) -> Column:
    return x.cast("long")


def segments(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep, at, no, forms, ends, then): a row for each chunk of a text that has tokens.

    forms are its tokens, ends the bytes from the chunk's start to the end of each, and then the
    next tokens of the text, two at most; at and no count the bytes and tokens before the chunk. A
    text is cut where no token is, into blocks (a row each), with the bytes and tokens before each
    as sums over the cuts; the blocks' tokens are dealt to chunks an Arrow batch at a time. So the
    work on a text grows with its length, a row is never more than a block, and nothing is
    shuffled. Null and empty texts have no tokens.
    """
    own = ["doc_id", *keep]
    b = docs.select(*own, X.cuts(F.col("text"), BLOCK).alias("b"))
    heads = F.transform("b", lambda x: F.filter(F.array(*[F.regexp_extract(x, X.HEAD, i) for i in (1, 2)]), lambda t: t != ""))
    b = b.withColumns({"at": F.transform("b", lambda x: _long(F.octet_length(x))), "no": F.when(F.size("b") > 1, F.transform("b", lambda x: _long(F.regexp_count(x, F.lit(X.PIECE))))).otherwise(F.transform("b", lambda _: _long(F.lit(0)))), "h": heads})
    b = b.withColumns({"at": _before(F.col("at")), "no": _before(F.col("no")), "h": F.transform("h", lambda _, i: F.slice(F.flatten(F.slice("h", i + 2, F.size("h"))), 1, 2))})
    b = b.select(*own, F.explode(F.arrays_zip("b", "at", "no", "h")).alias("x")).select(*own, F.col("x.at").alias("at"), F.col("x.no").alias("no"), F.col("x.h").alias("h"), X.pieces(F.col("x.b")).alias("p"))
    made = StructType.fromDDL("at long, no long, forms array<string>, ends array<int>, then array<string>")
    return b.mapInArrow(_dealt(own, CHUNK), StructType([docs.schema[c] for c in own] + made.fields))


def _dealt(own: list[str], most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks (own, at, no, h, p), p being their pieces and h what follows, as the chunks of segments() of up to most tokens."""

    def lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            p, h, at, no = (x.column(c) for c in ("p", "h", "at", "no"))
            pieces, heads = p.flatten(), h.flatten()
            forms = pc.utf8_ltrim(pieces, characters=" \t\n\x0b\f\r")
            n, m = (pc.list_value_length(c).to_numpy().astype(np.int64) for c in (p, h))
            last, h_last = np.cumsum(n), np.cumsum(m)
            bytes_to = np.concatenate(([0], np.cumsum(pc.binary_length(pieces).to_numpy(), dtype=np.int64)))
            chunks = -(-n // most)
            row = np.repeat(np.arange(len(n)), chunks)
            before = most * (np.arange(len(row)) - np.repeat(np.cumsum(chunks) - chunks, chunks))
            first, last = (last - n)[row], last[row]
            start = first + before
            end = np.minimum(start + most, last)
            ends = bytes_to[1:] - np.repeat(bytes_to[start], end - start)
            then = end[:, None] + np.arange(2)
            beyond = then - last[:, None]  # of the block: these are looked up in h
            there = beyond < m[row][:, None]
            then = np.where(beyond < 0, then, len(forms) + (h_last - m)[row][:, None] + beyond)[there]
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [x.column(c).take(rows) for c in own] + [pa.array(at.to_numpy()[row] + bytes_to[start] - bytes_to[first]), pa.array(no.to_numpy()[row] + before), lists(forms, end - start), lists(pa.array(ends, pa.int32()), end - start), lists(pa.concat_arrays([forms, heads]).take(pa.array(then)), there.sum(1))],
                [*own, "at", "no", "forms", "ends", "then"],
            )

    return run


def tokens_of(parts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, pos, form, byte_offset, keep): the tokens of segments()."""
    t = parts.select("doc_id", *keep, "at", "no", F.posexplode(F.arrays_zip("forms", "ends")).alias("i", "x"))
    return t.select("doc_id", (F.col("no") + F.col("i")).cast("int").alias("pos"), F.col("x.forms").alias("form"), (F.col("at") + F.col("x.ends") - F.octet_length("x.forms")).alias("byte_offset"), *keep)


def followed(parts: DataFrame) -> DataFrame:
    """(doc_id, byte_offset, form, w2, w3): the tokens of segments() with the next two of their document, without a shuffle."""
    every, n = F.concat("forms", "then"), F.size("forms")
    t = parts.select("doc_id", "at", F.explode(F.arrays_zip(F.col("forms").alias("f"), F.col("ends").alias("e"), F.slice(every, F.lit(2), n).alias("w2"), F.slice(every, F.lit(3), n).alias("w3"))).alias("x"))
    return t.select("doc_id", (F.col("at") + F.col("x.e") - F.octet_length("x.f")).alias("byte_offset"), F.col("x.f").alias("form"), F.col("x.w2").alias("w2"), F.col("x.w3").alias("w3"))


def tokenize(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, form, byte_offset): tokens with their place in the UTF-8 text; see segments()."""
    return tokens_of(segments(docs))


def _sides(cut: Column, first: Column, last: Column, around: int) -> Column:
    """Structs (own, left, right) of the parts of a cut text: each with the text before and after it, first and last being what is beside the whole.

    Two neighbouring parts have more characters than a part may have (see X.cuts), or the text ends
    there; so a few of them are looked at, if around is no more than that.
    """

    def of(ext: Column) -> Column:
        left = lambda i: F.right(F.array_join(F.slice(ext, F.greatest(i - 1, F.lit(0)) + 1, F.least(i + 1, F.lit(2))), ""), F.lit(around))
        right = lambda i: F.left(F.array_join(F.slice(ext, i + 3, F.lit(3)), ""), F.lit(around))
        return F.transform(cut, lambda x, i: F.struct(x.alias("own"), left(i).alias("left"), right(i).alias("right")))

    return X.let(F.concat(F.array(first), cut, F.array(last)), of)


def in_context(docs: DataFrame, around: int, only: DataFrame | None = None) -> DataFrame:
    """(doc_id, form, byte_offset, left, right): all tokens with the text around them.

    Cut like segments(), each chunk with the text beside it; so no text meets all of its tokens, and
    nothing is shuffled. With only(form, doc_id, byte_offset) just these: they are dealt to their
    documents, blocks and chunks, and parts without any are not looked at.
    """
    block, chunk = max(BLOCK, around), max(CHUNK, around)
    own = ["doc_id"]
    if only is not None:
        docs, own = docs.join(only.groupBy("doc_id").agg(F.collect_set(F.struct("byte_offset", "form")).alias("o")), "doc_id"), ["doc_id", "o"]

    def parts(x: DataFrame) -> DataFrame:
        """A row for each part w of a cut text, with its tokens of only."""
        x = x.select(*[c for c in x.columns if c not in ("w", "at")], F.explode(F.arrays_zip("w", "at")).alias("x")).select(*own, "base", F.col("x.w.own").alias("own"), F.col("x.w.left").alias("l"), F.col("x.w.right").alias("r"), (F.col("base") + F.col("x.at")).alias("at"))
        if only is not None:
            x = x.withColumn("o", F.filter("o", lambda o: (o.byte_offset >= F.col("at")) & (o.byte_offset < F.col("at") + F.octet_length("own")))).where(F.size("o") > 0)
        return x

    def cut(x: DataFrame, text: str, most: int) -> DataFrame:
        x = x.withColumn("c", X.cuts(F.col(text), most))
        return x.withColumns({"at": _before(F.transform("c", lambda y: _long(F.octet_length(y)))), "w": _sides(F.col("c"), F.col("l"), F.col("r"), around)}).drop("c", text, "l", "r")

    x = docs.select(*own, "text", F.lit(0).cast("long").alias("base"), F.lit("").alias("l"), F.lit("").alias("r"))
    x = parts(cut(x, "text", block)).drop("base").withColumnRenamed("at", "base")
    c = parts(cut(x, "own", chunk)).withColumn("p", X.pieces(F.col("own")))
    t = c.select("*", F.posexplode("p").alias("i", "piece")).withColumns({"form": X.strip_left(F.col("piece")), "head": F.array_join(F.slice("p", F.lit(1), F.col("i") + 1), "")})
    t = t.withColumn("byte_offset", F.col("at") + F.octet_length("head") - F.octet_length("form"))
    if only is not None:
        t = t.where(F.exists("o", lambda o: (o.byte_offset == F.col("byte_offset")) & (o.form == F.col("form"))))
    end = F.char_length("head")
    left = F.right(F.concat("l", F.left("head", end - F.char_length("form"))), F.lit(around))
    right = F.left(F.concat(F.substring("own", end + 1, F.char_length("own")), "r"), F.lit(around))
    return t.select("doc_id", "form", "byte_offset", left.alias("left"), right.alias("right"))


def astray(rows: DataFrame, docs: DataFrame, claim: str) -> DataFrame:
    """rows(doc_id, byte_offset, the column claim, more) at whose place in the text stands something else.

    The rows of a document meet its text as one array, so a text is read once and not once a row.
    """
    rest = [c for c in rows.columns if c != "doc_id"]
    own = rows.groupBy("doc_id").agg(F.collect_list(F.struct(*rest)).alias("o"))
    there = lambda o: F.substring("raw", o.byte_offset.cast("int") + 1, F.octet_length(o[claim]))
    x = own.join(docs.select("doc_id", F.encode("text", "UTF-8").alias("raw")), "doc_id").select("doc_id", F.filter("o", lambda o: there(o) != F.encode(o[claim], "UTF-8")).alias("o"))
    return x.select("doc_id", F.explode("o").alias("o")).select("doc_id", "o.*").select(*rows.columns)


def write_index(tokens: DataFrame, path: str, mode: str = "append") -> None:
    """The index by prefix of the form, sorted within files; append merges, overwrite replaces."""
    t = tokens.select("form", "doc_id", "byte_offset", X.prefix_of(F.col("form")).alias("prefix"), F.lower("form").alias("form_lower"))
    t = t.repartition("prefix", F.pmod(F.xxhash64("form"), F.lit(16))).sortWithinPartitions("prefix", "form", "doc_id", "byte_offset")
    t.write.mode(mode).partitionBy("prefix").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("form string, doc_id long, byte_offset long, form_lower string, prefix string").parquet(path)


def occurrences(index: DataFrame, form: str) -> DataFrame:
    """Occurrences of a form in any case, from its partition alone."""
    first = form[:1].lower()
    prefix = first if "a" <= first <= "z" else "other"
    return index.where((F.col("prefix") == prefix) & (F.col("form_lower") == form.lower()))


def unsegmented(docs: DataFrame, index: DataFrame) -> DataFrame:
    """Documents that the index does not have yet."""
    return docs.join(index.select("doc_id").distinct(), "doc_id", "left_anti")


def form_counts(docs: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(form, total) over the tokens of documents, which need no places for it; from their segments() where these are at hand."""
    every = docs.select(F.explode(X.cuts(F.col("text"), BLOCK)).alias("b")).select(X.forms(F.col("b")).alias("forms")) if parts is None else parts
    return every.select(F.explode("forms").alias("form")).groupBy("form").agg(F.count("*").alias("total"))


def counts_ci(counts: DataFrame) -> DataFrame:
    """counts(form, total) added up by lower-cased form."""
    return counts.groupBy(F.lower("form").alias("form")).agg(F.sum("total").alias("total"))


def shards(docs: DataFrame, size: int) -> DataFrame:
    """Logical shard numbers: contiguous runs of size rows by id, ranked without a global sort.

    Counts by range of ids go to the driver as one row a range.
    """
    span = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    if span.lo is None:
        return docs.select("doc_id").withColumn("shard", F.lit(0).cast("long"))
    step = max(1, (span.hi - span.lo + 1) // 256 + 1)
    cell = F.floor((F.col("doc_id") - span.lo) / step).cast("int")
    counts = {r.c: r.n for r in docs.groupBy(cell.alias("c")).agg(F.count("*").alias("n")).collect()}
    before, starts = 0, []
    for c in sorted(counts):
        starts.append((c, before))
        before += counts[c]
    own = docs.select("doc_id", cell.alias("c")).withColumn("rn", F.row_number().over(Window.partitionBy("c").orderBy("doc_id")) - 1)
    start = docs.sparkSession.createDataFrame(starts, "c int, start long")
    return own.join(F.broadcast(start), "c").select("doc_id", F.floor((F.col("start") + F.col("rn")) / size).alias("shard"))  # at most 257 rows
