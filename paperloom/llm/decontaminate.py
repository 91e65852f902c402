"""Benchmark decontamination: SimHash windows of item size, Hamming blocks, exact check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import cut

SHINGLE = 5
SIMILARITY = 0.75
#: Fingerprints within this Hamming distance are candidates.  At the least
#: similarity wanted, shingle vectors are 31 degrees apart: 11 of 64 bits on
#: average, so a radius of 24 lies nearly four standard deviations above.
RADIUS = 24
BITS = 64
#: Shingles of benchmark items (three numbers each) that are broadcast; more meet the corpus in a shuffled join.
BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    """Letters and digits of the lower-cased text, as words."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _shingled(df: DataFrame) -> DataFrame:
    """Turn the column ws (words) into hs: hashes of all runs of five words, in order; of
    fewer words, one hash of them all."""
    run = "transform(sequence(0, size(ws) - 5), i -> xxhash64(ws[i], ws[i+1], ws[i+2], ws[i+3], ws[i+4]))"
    return df.withColumn("hs", F.expr(f"case when size(ws) >= 5 then {run} when size(ws) > 0 then array(xxhash64(ws)) else array() end")).drop("ws")


def simhash(hashes: str) -> Column:
    """64-bit SimHash of an array of hashes; a shingle weighs as often as it occurs."""
    bit = f"aggregate({hashes}, 0, (s, x) -> s + if((shiftrightunsigned(x, b) & 1) = 1, 1, -1))"
    return F.expr(f"aggregate(sequence(0, {BITS - 1}), 0L, (f, b) -> f | if({bit} > 0, shiftleft(1L, b), 0L))")


def _edges(radius: int) -> list[tuple[int, int]]:
    """Bits of the radius + 1 blocks: two fingerprints within the radius share one at least."""
    cuts = [round(k * BITS / (radius + 1)) for k in range(radius + 2)]
    return list(zip(cuts, cuts[1:]))


def _blocks(fingerprint: str, radius: int) -> Column:
    """(number, bits) of each block."""
    return F.array(*[F.struct(F.lit(k).alias("number"), F.shiftrightunsigned(F.shiftleft(F.col(fingerprint), BITS - b), BITS - b + a).alias("bits")) for k, (a, b) in enumerate(_edges(radius))])


def _first_shared(differ: Column, radius: int) -> Column:
    """Number of the first block without a differing bit."""
    out = F.lit(None).cast("int")
    for k, (a, b) in reversed(list(enumerate(_edges(radius)))):
        out = F.when(F.shiftleft(F.shiftrightunsigned(differ, a), BITS - b + a) == 0, F.lit(k)).otherwise(out)
    return out


def weighted_similarity(a: str, b: str) -> Column:
    """Sum of the lesser over sum of the greater weights of all shingles of two arrays.

    Both are sorted together and run through once: of each shingle the lesser
    count is common, and all other occurrences are added to it below the line.
    """
    sides = ", ".join(f"transform({x}, x -> named_struct('x', x, 'b', {k}))" for k, x in enumerate((a, b)))
    step = "named_struct('x', e.x, 'a', if(e.x = s.x, s.a, 0) + 1 - e.b, 'b', if(e.x = s.x, s.b, 0) + e.b, 'c', s.c + if(e.x = s.x, 0, least(s.a, s.b)))"
    common = f"aggregate(array_sort(concat({sides})), named_struct('x', 0L, 'a', 0, 'b', 0, 'c', 0), (s, e) -> {step}, s -> s.c + least(s.a, s.b))"
    return F.when(F.col(a) == F.col(b), 1.0).otherwise(F.expr(f"transform(array({common}), c -> c / (size({a}) + size({b}) - c))[0]"))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity, start: documents that hold a benchmark item.

    A window is as many shingles long as an item.  Window and item fingerprints
    of one size meet in one of ``radius`` + 1 Hamming blocks, which finds all
    pairs within the radius (each in the first block it shares); the exact
    weighted similarity of the shingles decides.  The best window of a pair is
    returned (``start``: its first word, from 0).

    Not every window is fingerprinted, only one that no other outdoes: it starts
    at a shingle of an item of its size, and the one before it is not of the item
    or is in the window again.  Else moving the window left gains a shingle of
    the item and loses one at most; a window that starts at another shingle is
    no better than the next one.

    Documents and items without words or id match nothing.  An item of fewer
    than five words is one shingle and matches only a document of the same
    words.  Repeated rows give one row; rows of one doc_id count as one document,
    which holds what any of them holds.  Other columns are ignored.
    """
    items = _shingled(benchmark.where("item_id is not null").select("item_id", words(F.col("text")).alias("ws"))).dropDuplicates()
    items = cut(items.select("item_id", F.col("hs").alias("item"), F.size("hs").alias("n"), simhash("hs").alias("print")), "items").where("n > 0")
    seeds = items.select("item_id", "n", F.explode(F.array_distinct("item")).alias("h"))
    shingled = _shingled(docs.where("doc_id is not null").select("doc_id", words(F.col("text")).alias("ws")))
    # the outer form, as the plain one adds a filter that computes hs once more
    placed = shingled.select("doc_id", "hs", F.posexplode_outer("hs").alias("at", "h"))
    if seeds.count() <= BROADCAST_ROWS:  # three numbers a row
        hit = placed.join(F.broadcast(seeds), "h")
    else:
        # the corpus is shingled twice, whatever the number of items; texts are not exchanged unless they hold a shingle
        found = cut(placed.select("doc_id", "at", "h").join(seeds, "h").select("doc_id", "at", "item_id", "n"), "hits")
        hit = shingled.join(found, "doc_id")
    hit = hit.select("doc_id", "item_id", "n", F.col("at").alias("start"), F.expr("get(hs, at - 1)").alias("before"), F.expr("slice(hs, at + 1, n)").alias("win")).where("size(win) > 0")  # rows of one doc_id may be of different lengths
    # the items' shingles come from a file whose size the planner knows
    hit = hit.join(items.select("item_id", "n", "item"), ["item_id", "n"])
    best = F.col("before").isNull() | ~F.expr("array_contains(item, before)") | F.expr("array_contains(win, before)")
    windows = hit.where(best).select("doc_id", "start", "n", "win").distinct()
    windows = cut(windows.withColumn("win_print", simhash("win")), "windows")
    left = windows.select("doc_id", "start", "n", "win_print", F.explode(_blocks("win_print", radius)).alias("block"))
    right = items.select("item_id", "n", "print", F.explode(_blocks("print", radius)).alias("block"))
    differ = F.col("win_print").bitwiseXOR(F.col("print"))
    near = left.join(right, ["n", "block"]).where((F.bit_count(differ) <= radius) & (_first_shared(differ, radius) == F.col("block.number")))
    pairs = near.select("doc_id", "start", "n", "win_print", "item_id").distinct()
    pairs = pairs.join(windows, ["doc_id", "start", "n", "win_print"]).join(items.select("item_id", "n", "item"), ["item_id", "n"])
    scored = pairs.withColumn("similarity", weighted_similarity("win", "item")).where(F.col("similarity") >= similarity)
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    return best.select("doc_id", "item_id", F.round("best.similarity", 6).alias("similarity"), (-F.col("best.back")).cast("int").alias("start"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item.

    Rows without doc_id, null, empty and blank texts and repeated rows of clean
    documents stay as they are; without items all rows stay.
    """
    gone = cut(contaminated(docs, benchmark).select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
