"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

A window of a document is compared with a benchmark item of its own length in words. Windows slide
over a document a word at a time wherever enough of an item's floor(n / 5) + 1 seed shingles stand in
them, in any order and place: two sets of n with a similarity of 0.8 miss at most n / 9 of each other,
a document shorter than the item n / 5, and a window with fewer seeds misses more, so the seeds, which
stand before SimHash, lose no window.
Each window's SimHash, weighted by the occurrences of its five-word shingles, is cut into
radius + 1 blocks; windows and items of a length meet on any equal block, which finds every pair
within the radius, and the Hamming distance confirms it. What is left is verified by the exact
weighted Jaccard similarity of the shingles. DataFrame functions only.

The radius: a similarity of 0.8 leaves fingerprints about 10 of 64 bits apart; the radius is more
than three standard deviations beyond that.

Defined cases: words are runs of non-space characters, lower-cased; items of fewer than five words
(null ones too) have no shingle and match nothing; a document shorter than an item is one window;
null and empty texts match nothing; rows that repeat an id are judged one by one and items that
repeat a text all match; ties between windows go to the first; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, spool

SHINGLE, SIMILAR = 5, 0.8

#: Bits in which fingerprints may differ; the blocks are one more.
RADIUS = 21

#: Copies of each seed where the benchmark is too large to broadcast, so that no shingle is a hot key.
SALTS = 32


def split_words(text: Column) -> Column:
    """The lower-cased words of a text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_at(words: Column, at: Column) -> Column:
    """The hash of the five words from a place on."""
    return F.xxhash64(*[F.get(words, at + j) for j in range(SHINGLE)])


def shingles(words: Column) -> Column:
    """The hashes of all shingles of words, in order."""
    places = F.sequence(F.lit(0), F.size(words) - SHINGLE)
    return F.when(F.size(words) >= SHINGLE, F.transform(places, lambda i: shingle_at(words, i)))


def counted(hashes: Column) -> Column:
    """The multiset of hashes as a set: the n-th occurrence of a hash is an element of its own."""
    ordered = F.array_sort(hashes)
    return F.transform(ordered, lambda h, i: F.xxhash64(h, i - F.array_position(ordered, h)))


def simhash(hashes: Column) -> Column:
    """The 64-bit SimHash of a multiset of hashes."""
    votes = lambda b: F.aggregate(hashes, F.lit(0), lambda n, h: n + F.getbit(h, b).cast("int") * 2 - 1)
    bits = F.sequence(F.lit(0), F.lit(63))
    one = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: F.when(votes(b) > 0, acc.bitwiseOR(one(b))).otherwise(acc))


def blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """The fingerprint's bits in radius + 1 runs, each with its number."""
    n = radius + 1
    edges = [64 * i // n for i in range(n + 1)]
    runs = [
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("bits"))
        for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))
    ]
    return F.array(*runs)


def prepared(benchmark: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """item, item_id, length, set, print, seeds of every item of five or more words."""
    words = benchmark.select("item_id", split_words(F.col("text")).alias("words")).where(F.size("words") >= SHINGLE)
    hashes = words.select(
        F.monotonically_increasing_id().alias("item"), "item_id", F.size("words").alias("length"), shingles(F.col("words")).alias("hashes")
    )
    # the seeds: more distinct shingles than a similar window can miss, those of the smallest hashes
    missed = F.floor((1 - similar) * F.size("hashes") + 1e-9).cast("int") + 1
    chosen = F.slice(F.array_sort(F.array_distinct("hashes")), F.lit(1), missed)
    return hashes.select("item", "item_id", "length", counted(F.col("hashes")).alias("set"), simhash(F.col("hashes")).alias("print"), chosen.alias("seeds"))


def stretches(rows: DataFrame, items: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """row, length, first, last: the starts of all windows that hold enough seeds of an item of their length."""
    placed = rows.select("row", F.size("words").alias("size"), "words", F.explode(F.sequence(F.lit(0), F.size("words") - SHINGLE)).alias("at"))
    placed = placed.select("row", "size", "at", shingle_at(F.col("words"), F.col("at")).alias("hash"))
    missed = F.floor((1 - similar) / (1 + similar) * F.size("set") + 1e-9)
    enough = F.greatest(F.lit(1), F.size("seeds") - missed).cast("int")
    seeds = items.select("item", "length", enough.alias("enough"), F.explode("seeds").alias("hash"))
    if small(seeds):
        hits = placed.join(F.broadcast(seeds), "hash")
    else:
        seeds = seeds.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        hits = placed.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(seeds, ["hash", "salt"])
    hits = hits.select("row", "size", "at", "hash", "item", "length", "enough").distinct()  # those of equal texts are equal
    n = F.least(F.col("length"), F.col("size"))
    hits = hits.withColumn("enough", F.when(F.col("size") >= F.col("length"), F.col("enough")).otherwise(1))
    # the starts whose windows hold a seed; where it occurs again, only those that the place before has not
    before = F.lag("at").over(Window.partitionBy("row", "item", "hash").orderBy("at"))
    first = F.greatest(F.lit(0), F.col("at") - (n - SHINGLE), F.coalesce(before + 1, F.lit(0)))
    held = hits.select("row", "item", "length", "enough", first.alias("first"), F.least(F.col("at"), F.col("size") - n).alias("last")).where("first <= last")
    ends = F.array(F.struct(F.col("first").alias("at"), F.lit(1).alias("more")), F.struct((F.col("last") + 1).alias("at"), F.lit(-1).alias("more")))
    steps = held.select("row", "item", "length", "enough", F.explode(ends).alias("e")).groupBy("row", "item", "length", "enough", "e.at").agg(F.sum("e.more").alias("more"))
    order = Window.partitionBy("row", "item").orderBy("at")
    steps = steps.select("row", "length", "enough", "at", F.sum("more").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("seeds"), F.lead("at").over(order).alias("next"))
    return steps.where("seeds >= enough and next is not null").select("row", "length", F.col("at").alias("first"), (F.col("next") - 1).alias("last"))


def named(text: Column) -> Column:
    """The number of a text: equal texts are judged once, and any reading of the documents gives the same numbers."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.lit("text"))


def windows(documents: DataFrame, items: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """row, length, start, words of every window of a text that may be similar to an item; once for each length and start."""
    rows = documents.select(named(F.col("text")).alias("row"), split_words(F.col("text")).alias("words"))
    rows = rows.where(F.size("words") >= SHINGLE)
    found = stretches(rows, items, similar).groupBy("row").agg(F.collect_set(F.struct("length", "first", "last")).alias("found"))
    found = spool(found, "stretches")
    rows = rows.join(F.broadcast(found) if small(found) else found, "row").groupBy("row").agg(F.any_value("words").alias("words"), F.any_value("found").alias("found"))
    starts = lambda f: F.transform(F.sequence(f["first"], f["last"]), lambda i: F.struct(f["length"].alias("length"), i.alias("start")))
    rows = rows.select("row", "words", F.explode(F.array_distinct(F.flatten(F.transform("found", starts)))).alias("w"))
    return rows.select("row", "w.length", "w.start", F.slice("words", F.col("w.start") + 1, F.least(F.col("w.length"), F.size("words"))).alias("words"))


def contaminated(documents: DataFrame, benchmark: DataFrame, similar: float = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """row, item_id, similarity, start, length: the best window of each text for each item that it holds."""
    items = spool(prepared(benchmark, similar), "items")
    hashed = shingles(F.col("words"))
    seen = windows(documents, items, similar).select("row", "length", "start", hashed.alias("hashes"))
    seen = seen.select("row", "length", "start", counted(F.col("hashes")).alias("seen"), simhash(F.col("hashes")).alias("mark"))
    seen = spool(seen, "windows")
    left = seen.select("*", F.explode(blocks(F.col("mark"), radius)).alias("b"))
    right = items.select("item", "length", "print", F.explode(blocks(F.col("print"), radius)).alias("b"))
    right = F.broadcast(right) if small(right) else right
    left = left.select("row", "length", "start", "mark", "b.*")
    near = left.join(right.select("item", "length", "print", "b.*"), ["length", "block", "bits"])
    near = near.where(F.bit_count(F.col("mark").bitwiseXOR(F.col("print"))) <= radius).select("row", "length", "start", "item").distinct()
    pairs = near.join(seen, ["row", "length", "start"])
    held = items.select("item", "item_id", "set")
    pairs = pairs.join(F.broadcast(held) if small(held) else held, "item")
    both = F.size(F.array_intersect("seen", "set"))
    pairs = pairs.withColumn("similarity", both / (F.size("seen") + F.size("set") - both)).where(F.col("similarity") >= similar)
    best = F.max_by(F.struct("similarity", "start"), F.struct("similarity", -F.col("start"))).alias("best")
    return pairs.groupBy("row", "item", "item_id", "length").agg(best).select("row", "item_id", "best.*", "length")


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start, length of every passage of the benchmark in a document."""
    found = spool(contaminated(documents, benchmark), "leaks")
    rows = documents.select("doc_id", named(F.col("text")).alias("row"))
    return rows.join(F.broadcast(found) if small(found) else found, "row").select("doc_id", "item_id", "similarity", "start", "length")


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no passage of the benchmark."""
    found = spool(contaminated(documents, benchmark).select(F.col("row").alias("leaking")).distinct(), "leaking")
    found = F.broadcast(found) if small(found) else found
    return documents.join(found, named(documents["text"]) == found["leaking"], "left_anti")
