"""Benchmark passages in documents, in DataFrame functions only.

Texts are words in lower case without punctuation; five words in a row are a shingle. Where a document
shares a shingle with an item, a window of the item's size is laid over the document so that the two
shingles meet. Each window has a 64-bit SimHash of its shingles, and so has each item. Fingerprints are cut into
RADIUS + 1 blocks: two of them that differ in at most RADIUS bits agree in one block at least, so a join on
(item, block, value) finds all of them. What is within the radius is verified by the exact weighted Jaccard
similarity of the two bags of shingles.

A similarity above 0 needs a shared shingle, so no window that could verify is left out by laying windows
only there. Shingles thus find the places, and fingerprints the windows that are worth an exact comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, id_and_text

SHINGLE, SIMILARITY = 5, 0.8
#: Bits by which fingerprints may differ. Of 16 million drawn pairs of similarity 0.8 or a little more each, the hardest
#: (four of five shingles) had a mean of 12 and a greatest distance of 31; from nine shingles on the greatest was 26.
RADIUS = 31
#: Item shingles and windows up to which a side of a join is broadcast (about 40 bytes each); beyond it Spark shuffles.
BROADCAST_ROWS = 500_000


def row_key(id_col: Column, text: Column) -> Column:
    """Digest of a row's id and text; rows without an id are told by their texts."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(id_col.cast("long").cast("string"), F.lit("null")), F.coalesce(text.cast("string"), F.lit("")))))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", -1), lambda w: w != "")


def shingles(of: Column) -> Column:
    """Hashes of each SHINGLE words in a row, in order; none for fewer words."""
    none = F.array().cast("array<bigint>")
    return F.when(F.size(of) >= SHINGLE, F.transform(F.sequence(F.lit(1), F.size(of) - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(of, i, SHINGLE)))).otherwise(none)


def simhash(hashes: Column) -> Column:
    """64-bit fingerprint: a bit is set if most shingles, each as often as it occurs, have it set."""
    places = F.sequence(F.lit(0), F.lit(63))
    sign = lambda h, bit: F.when(F.call_function("bit_get", h, bit) == 1, 1).otherwise(-1)
    votes = F.aggregate(hashes, F.array_repeat(F.lit(0), 64), lambda acc, h: F.zip_with(acc, places, lambda n, bit: n + sign(h, bit)))
    set_bits = F.transform(votes, lambda n, bit: F.when(n > 0, F.call_function("shiftleft", F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(set_bits, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """array<struct<block, value>>: RADIUS + 1 stretches of the fingerprint's bits, together all of them."""

    def one(i: Column) -> Column:
        first, stop = F.call_function("div", i * 64, F.lit(radius + 1)), F.call_function("div", (i + 1) * 64, F.lit(radius + 1))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), (stop - first).cast("int")) - 1
        return F.struct(i.alias("block"), F.call_function("shiftrightunsigned", fingerprint, first.cast("int")).bitwiseAND(mask).alias("value"))

    return F.transform(F.sequence(F.lit(0), F.lit(radius)), one)


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two bags: the sum of the lesser multiplicities over that of the greater ones."""
    times = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))
    shared = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))
    return F.when(F.size(a) + F.size(b) > 0, shared / (F.size(a) + F.size(b) - shared)).otherwise(F.lit(0.0))


def matches(
    documents: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least: float = SIMILARITY,
    radius: int = RADIUS,
    checkpoint: bool = True,
) -> DataFrame:
    """(id, item, word_start, n_words, distance, similarity, row_key) of each document and item that it contains: the best window.

    Null texts are empty. Texts and items of fewer than five words have no shingle and match nothing. Items of
    equal shingles are searched once and all reported. Rows of documents with one id and one text count as one
    document, also those without an id; ``row_key`` is row_key() of them. Of several windows that verify, the most
    similar counts, then the first.

    The benchmark's side is broadcast up to BROADCAST_ROWS shingles, counted first, and so are the windows. Beyond
    that documents are shuffled once, for the windows; nothing that grows with the corpus is collected.
    """
    attach(documents.sparkSession)
    docs = id_and_text(documents, id_col, text_col).withColumnsRenamed({id_col: "number", text_col: "text"}).withColumn("id", row_key(F.col("number"), F.col("text")))
    bench = id_and_text(items, item_col, item_text_col).select(F.col(item_col).alias("item"), words(F.col(item_text_col)).alias("w"))
    bench = bench.where(F.size("w") >= SHINGLE).select("item", F.size("w").alias("n_words"), shingles(F.col("w")).alias("bag"))
    # items of the same shingles in the same order are one
    bench = bench.groupBy("bag").agg(F.max("n_words").alias("n_words"), F.collect_set("item").alias("items"), F.min("item").alias("item"))
    bench = bench.where("item is not null").select("item", "items", "n_words", "bag", simhash(F.col("bag")).alias("print"))
    if checkpoint:
        bench = bench.checkpoint()
    small = bench.agg(F.sum(F.size("bag"))).first()[0] or 0
    sent = F.broadcast if small <= BROADCAST_ROWS else (lambda df: df)
    anchors = bench.select("item", "n_words", F.posexplode("bag").alias("place", "shingle"))

    in_words = docs.select("id", words(F.col("text")).alias("w")).where(F.size("w") >= SHINGLE)
    hits = in_words.select("id", F.posexplode(shingles(F.col("w"))).alias("at", "shingle")).join(sent(anchors), "shingle")
    starts = hits.select("id", "item", "n_words", (F.col("at") - F.col("place")).alias("start")).distinct()
    found = starts.groupBy("id").agg(F.collect_list(F.struct("item", "n_words", "start")).alias("windows"))
    if checkpoint:
        found = found.checkpoint()
        if (found.agg(F.sum(F.size("windows"))).first()[0] or 0) <= BROADCAST_ROWS:
            found = F.broadcast(found)

    of_docs = docs.join(found, "id").select("number", "id", words(F.col("text")).alias("w"), "windows")
    windows = of_docs.select("number", "id", "w", F.explode("windows").alias("x")).select(
        "number",
        "id",
        F.col("x.item").alias("item"),
        F.greatest(F.col("x.start"), F.lit(0)).alias("word_start"),
        F.slice("w", F.greatest(F.col("x.start"), F.lit(0)) + 1, F.least(F.col("x.start"), F.lit(0)) + F.col("x.n_words")).alias("w"),
    )
    windows = windows.select("number", "id", "item", "word_start", F.size("w").alias("n_words"), shingles(F.col("w")).alias("window_bag"))
    windows = windows.select("*", simhash(F.col("window_bag")).alias("window_print"))
    windows = windows.select("*", blocks(F.col("window_print"), radius).alias("window_blocks"))
    keyed = windows.select("*", F.explode("window_blocks").alias("key"))
    sides = bench.select("item", "print", F.explode(blocks(F.col("print"), radius)).alias("key"))
    near = keyed.join(sent(sides), ["item", "key"]).withColumn("distance", F.bit_count(F.col("print").bitwiseXOR(F.col("window_print"))))
    # a pair meets in every block in which it agrees; it is verified in the first of them
    near = near.where(F.col("distance") <= radius).where(F.col("key.block") == F.array_min(F.array_intersect(blocks(F.col("print"), radius), F.col("window_blocks")))["block"])
    verified = near.join(sent(bench.select("item", "items", "bag")), "item")
    verified = verified.select("number", "id", "items", "word_start", "n_words", "distance", similarity(F.col("window_bag"), F.col("bag")).alias("similarity")).where(F.col("similarity") >= least)
    best = verified.select("number", "id", F.explode("items").alias("item"), "word_start", "n_words", "distance", "similarity").groupBy("id", "item").agg(
        F.max_by(F.struct("word_start", "n_words", "distance", "similarity"), F.struct("similarity", -F.col("word_start"))).alias("best"), F.min("number").alias("number")
    )
    return best.select(F.col("number").alias(id_col), F.col("item").alias(item_col), "best.*", F.col("id").alias("row_key"))


def clean(documents: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those in ``found``, told by id and text; rows without an id and repeated rows are no exceptions."""
    keyed = documents.withColumn("_row_key", row_key(F.col(id_col), F.col(text_col)))
    bad = found.select(F.col("row_key").alias("_row_key")).distinct()
    return keyed.join(bad, "_row_key", "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])
