"""Benchmark decontamination by winnowed word k-grams, in DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm._common import stored

#: Words of a window, and of the k-grams that stand for it. Every window holds WINDOW - GRAM + 1 of them.
WINDOW, GRAM = 10, 5
#: Up to so many rows (of a digest, or two numbers) the benchmark's side of a join is broadcast; beyond, both are shuffled.
BROADCAST_ROWS = 500_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z lowered: runs of digits, letters and characters beyond ASCII; none for null."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.array_remove(F.split(low, BETWEEN), "")


def _hash(k: int, at: str) -> str:
    """SQL: the hash of the k words of w from `at` on."""
    return f"xxhash64({', '.join(f'w[{at} + {j}]' for j in range(k))})"


def _keys(k: int) -> str:
    """SQL: for each k-gram of w a long, 33 bits of its hash above its place; so the least has the least hash."""
    return f"transform(sequence(0, n - {k}), i -> shiftleft(shiftright({_hash(k, 'i')}, 31), 31) | cast(i as bigint))"


def _least(span: int) -> str:
    """SQL: the least of `span` keys side by side, for every place, each named once."""
    each = ", ".join(f"keys[i + {j}]" for j in range(span))
    return f"array_distinct(transform(sequence(0, n - {{n}}), i -> {f'least({each})' if span > 1 else 'keys[i]'}))"


def prints(w: DataFrame, size: int, k: int) -> DataFrame:
    """w(w, n, more) with `marks`: the places of the k-grams that stand for the windows of `size` words.

    Of the size - k + 1 k-grams of a window the one with the least hash does, the first if some
    are equal; so equal windows are stood for by the same one, wherever they are. Windows side by
    side mostly share theirs. Null where there is no window.
    """
    w = w.withColumn("keys", F.when(F.col("n") >= size, F.expr(_keys(k))))
    return w.withColumn("marks", F.when(F.col("n") >= size, F.expr(f"transform({_least(size - k + 1).format(n=size)}, x -> cast(x & 2147483647L as int))"))).drop("keys")


def bounded(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= most else df


def windows(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(item_id, size, win, id): the windows of items, their words joined by a space, and its digest; an item of fewer words is one window."""
    w = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    at = F.expr(f"transform(sequence(0, greatest(n - {size}, 0)), i -> array_join(slice(w, i + 1, {size}), ' '))")
    return w.select("item_id", F.least("n", F.lit(size)).alias("size"), F.explode(at).alias("win")).distinct().withColumn("id", F.sha2("win", 256))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", size: int = WINDOW, gram: int = GRAM, most: int = BROADCAST_ROWS) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, item_ids array<string>, contaminated.

    A document's word is hit if it lies in an occurrence of a window of any item: `size` words on
    end, or all of an item that has fewer. item_ids are the items with a window that occurs, sorted
    as strings.

    A k-gram out of each window is kept for either side, so every shared span of `size` words is
    met at one at least. The places kept for the documents are joined with the benchmark's k-grams,
    one row each, so a frequent passage makes no pairs; a hit is then extended over the windows
    that its k-gram stands for in the benchmark, and the words are compared. Items of fewer than
    `size` words are looked for by all their words at once, a pass for each such length. Documents
    that hit the same windows look their items up once. Texts are read once and not shuffled.

    Null and empty texts have no words. Rows of one id and the same text count as one where
    their hits are gathered, and each gets the result; null ids are ids like others. An empty
    table, or benchmark, gives no hit. Items of one id are one, and one without an id is hit but not
    named. Other columns are not read.
    """
    wins = stored(windows(items, item_col, text_col, size), "windows")
    sizes = [r[0] for r in wins.select("size").distinct().orderBy("size").collect()]  # at most `size`

    text = F.col(text_col)
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("key"), words(text).alias("w")).withColumn("n", F.size("w"))
    place = "struct<size:int,h:bigint,p:int,off:int,near:string>"
    grams, each = [], [F.array(F.lit(None).cast(place))]
    for z in sizes:
        k = min(gram, z) if z == size else z
        mine = prints(wins.where(F.col("size") == z).select("size", "win").distinct().withColumn("w", F.split("win", " ")).withColumn("n", F.lit(z)), z, k)
        grams.append(mine.select("size", F.expr(_hash(k, "marks[0]")).alias("h"), F.expr("shiftleft(1, marks[0])").alias("bit")))
        d = prints(d, z, k).withColumnRenamed("marks", f"marks{z}")
        # with each place go the words of all windows that the k-gram there can stand for
        first = f"greatest(p - {z - k}, 0)"
        near = f"array_join(slice(w, {first} + 1, p + {z} - {first}), ' ')"
        each.append(F.coalesce(F.expr(f"transform(marks{z}, p -> struct({z} as size, {_hash(k, 'p')} as h, p as p, p - {first} as off, {near} as near))"), F.array().cast(f"array<{place}>")))
    rows = d.select("doc_id", "key", "n", F.explode(F.concat(*each)).alias("x")).select("doc_id", "key", "n", "x.*")
    if not sizes:
        return rows.select("doc_id", F.col("n").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.array().cast("array<string>").alias("item_ids"), F.lit(False).alias("contaminated"))

    table = grams[0]
    for g in grams[1:]:
        table = table.unionByName(g)
    table = stored(table.groupBy("size", "h").agg(F.bit_or("bit").alias("bits")), "grams")
    met = rows.join(bounded(table, most), ["size", "h"], "left").where("size is null or bits is not null")
    # one row a document (size null), and one for every place met
    met = stored(met.select("doc_id", "key", "n", "size", "p", "off", "near", "bits"), "met")

    # the window of each offset that the benchmark's k-gram has, if the document has all its words
    spread = met.where("size is not null").select("doc_id", "key", "size", "p", "off", F.split("near", " ").alias("near"), F.explode(F.expr("filter(sequence(0, size - 1), o -> (shiftright(bits, o) & 1) = 1)")).alias("o"))
    spread = spread.where("o <= off and off - o + size <= size(near)")
    hits = spread.select("doc_id", "key", "size", (F.col("p") - F.col("o")).alias("start"), F.sha2(F.expr("array_join(slice(near, off - o + 1, size), ' ')"), 256).alias("id"))
    hits = hits.join(bounded(stored(wins.select("id").distinct(), "known"), most), "id")
    found = hits.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("spans"), F.array_sort(F.collect_set("id")).alias("wins"))
    cover = "aggregate(spans, named_struct('to', 0, 'sum', 0L), (s, x) -> named_struct('to', greatest(s.to, x.start + x.size), 'sum', s.sum + greatest(0, x.start + x.size - greatest(s.to, x.start))), s -> s.sum)"
    found = stored(found.select("doc_id", "key", F.expr(cover).alias("n_hit"), "wins", F.sha2(F.array_join("wins", ""), 256).alias("sig")), "found")

    # what the documents with the same windows share
    sets = found.groupBy("sig").agg(F.first("wins").alias("wins")).select("sig", F.explode("wins").alias("id"))
    named = wins.where("item_id is not null").select("id", F.col("item_id").cast("string").alias("item_id"))
    lists = sets.join(named, "id").groupBy("sig").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    found = found.join(lists, "sig", "left").select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "n_hit", "item_ids")

    out = met.where("size is null").select("doc_id", "key", "n").join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("key").eqNullSafe(F.col("_k")), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", F.col("n").cast("long").alias("n_words"), hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (hit > 0).alias("contaminated"))
