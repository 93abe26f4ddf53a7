"""Variable-capacity best-fit packing of token sequences into training rows."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm._common import stored, words_of

#: Permitted sequence lengths in tokens.
CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Fixed cost of a row besides its capacity, in tokens.
ROW_COST = 16
CELLS = 16


def plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, row_cost: int = ROW_COST) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths; whole runs of equal items move at once.

    Returns placements (length, first, last, bin, per_bin, used): of the items of that length,
    those ranked first <= r < last go to bin + (r - first) // per_bin, at offset
    used + ((r - first) % per_bin) * length. An item goes to the open bin with the least room
    that holds it; else the capacity with the least cost per token, if filled with such items,
    opens. Open bins of one kind are kept as ranges, so the work grows with the number of
    distinct lengths, at most capacities[-1], and not with the items.
    """
    rooms: list[int] = []
    open_bins: dict[int, list[tuple[int, int, int]]] = {}  # room -> (first bin, bins, used)
    placements = []
    next_bin = 0

    def put(room: int, first: int, n: int, used: int) -> None:
        if n and room > 0:
            if room not in open_bins:
                bisect.insort(rooms, room)
                open_bins[room] = []
            open_bins[room].append((first, n, used))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, n, used = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[i]
            else:
                fit = [c for c in capacities if c >= length]
                room = min(fit, key=lambda c: ((c + row_cost) / (c // length * length), c))
                n, used = -(-left // (room // length)), 0
                first, next_bin = next_bin, next_bin + n
            per = room // length
            take = min(left, n * per)
            placements.append((length, rank, rank + take, first, per, used))
            full, rest = divmod(take, per)
            put(room - per * length, first, full, used + per * length)
            if rest:
                put(room - rest * length, first + full, 1, used + rest * length)
            put(room, first + full + bool(rest), n - full - bool(rest), used)
            left -= take
            rank += take
    return placements


def pack_lengths(pieces: DataFrame, capacities: tuple[int, ...] = CAPACITIES, row_cost: int = ROW_COST) -> DataFrame:
    """Adds bin_id, bin_offset, bin_used and bin_capacity to rows with a length of 1 to capacities[-1].

    The histogram by length and cell is all that reaches the driver: at most
    capacities[-1] x CELLS rows. Ranks within a length are counted by cell, so a length that
    most rows share does not meet in one task. Each bin finally takes the least capacity that
    holds its contents.
    """
    spark = pieces.sparkSession
    pieces = stored(pieces.withColumn("_cell", F.pmod(F.spark_partition_id() * 31 + F.pmod(F.xxhash64(*pieces.columns), F.lit(CELLS)), F.lit(CELLS)).cast("int")), "pieces")
    counts = pieces.groupBy("length", "_cell").count().collect()
    total: dict[int, int] = {}
    starts = []
    for r in sorted(counts, key=lambda r: (r.length, r._cell)):
        starts.append((r.length, r._cell, total.get(r.length, 0)))
        total[r.length] = total.get(r.length, 0) + r["count"]
    placed = spark.createDataFrame(plan(total, capacities, row_cost), "length int, r0 long, r1 long, bin long, per long, used long")
    starts_df = spark.createDataFrame(starts, "length int, _cell int, _start long")
    keys = [c for c in pieces.columns if c not in ("length", "_cell")]
    w = Window.partitionBy("length", "_cell").orderBy(*keys)
    ranked = pieces.withColumn("_rn", F.row_number().over(w) - 1).join(starts_df, ["length", "_cell"]).withColumn("_rank", F.col("_start") + F.col("_rn"))
    at = F.col("_rank") - F.col("r0")
    out = ranked.join(placed, "length").where("_rank >= r0 and _rank < r1").select(
        *keys, "length", (F.col("bin") + F.floor(at / F.col("per"))).cast("long").alias("bin_id"), (F.col("used") + at % F.col("per") * F.col("length")).cast("long").alias("bin_offset")
    )
    out = out.withColumn("bin_used", F.sum("length").over(Window.partitionBy("bin_id")))
    size = F.lit(capacities[-1])
    for c in reversed(capacities[:-1]):
        size = F.when(F.col("bin_used") <= c, F.lit(c)).otherwise(size)
    return out.withColumn("bin_capacity", size.cast("int"))


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, row_cost: int = ROW_COST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every document: (doc_id, piece, start, length, bin_id, bin_offset, bin_used, bin_capacity).

    A document's tokens are its words and one end token, so a null or empty text has length 1.
    Documents longer than the largest capacity are cut into pieces of that capacity and a rest;
    start is a piece's first token. Repeated rows and null ids are packed as rows of their own;
    an empty table gives an empty result; other columns are not read.
    """
    top = capacities[-1]
    n = F.size(words_of(F.col(text_col))) + 1
    rows = docs.select(F.col(id_col).alias("doc_id"), n.alias("n"))
    pieces = rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / top).cast("int"))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * top).cast("long").alias("start"), F.least(F.lit(top), F.col("n") - F.col("piece") * top).cast("int").alias("length"))
    return pack_lengths(pieces, capacities, row_cost)
