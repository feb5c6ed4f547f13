"""Near-duplicate texts by DartMinHash signatures, banded joining and exact verification.

A text is the bag of its shingles of five words (blanks and line ends separate words, case is ignored); a
shingle's weight is how often it occurs. Darts are a Poisson process over the plane of weight and rank that is fixed
for each shingle: the weight axis is cut into cells (0, 1], (1, 2], (2, 4] ..., and each cell's darts come from
hashes of the shingle, the cell and the dart's number, by rising rank. A text takes the darts that lie within
its weights, up to a rank that yields enough of them, and keeps the earliest of each coordinate; a text with
an empty coordinate throws on to twice the rank. Two texts agree in a coordinate with a probability that is their weighted
Jaccard similarity.

Bands of ROWS coordinates are join keys; a text with repeated shingles has bands of its distinct shingles too, each of
weight 1, so that pairs of high plain similarity meet whatever their weighted one is. Texts are linked if their weighted or their plain Jaccard similarity,
computed exactly, is SIMILARITY or more; a class is a connected component of links. Large groups are linked by few
comparisons first: each member of a bucket with its pivot, the one that has the most company. Then every two members
of a bucket that are in different classes still are compared, unless the shingles counted by lane (see lanes()) prove that
they can't be similar. That proof is exact: it bounds the similarity from above, so no link is lost to it. So
no bucket is capped, and the copies of a text cost about one comparison each, not one a pair.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, id_and_text, map_batches, slices

SHINGLE, SIMILARITY = 5, 0.8
#: At similarity 0.8 a pair shares no band with probability 1e-5; at 0.35 it shares one with probability 0.03.
BANDS, ROWS = 48, 7
#: Darts to throw for K coordinates: K ln K + SPARE K leave one empty in 2 % of texts, which throw again.
SPARE = 4
_U = np.uint64
#: Lanes of shingles, and how many shingles of a lane are counted one by one; see lanes().
LANES, DEPTH = 1024, 2
WORDS = LANES * DEPTH // 64
#: Longs in the set of wanted digests, 4 MB as a broadcast.
SLOTS = 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles by text, sorted within each text, repeated as they occur; number of each text).

    A text of one to four words has one shingle, all its words; one without words has none.
    """
    from pandas.util import hash_array

    lower = pc.utf8_lower(texts.cast(pa.large_string()))
    for mark in "\n\t\r":
        lower = pc.replace_substring(lower, mark, " ")
    parts = pc.split_pattern(lower, " ")
    bounds = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False)
    index = coded.indices.to_numpy()
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    full = (words != "")[index] if len(words) else np.zeros(0, bool)
    index, owner = index[full], owner[full]
    hashes = hash_array(words, categorize=False)[index] if len(words) else np.zeros(0, np.uint64)
    counts = np.bincount(owner, minlength=len(texts))
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(len(hashes))  # words from here to the text's end
    out = np.zeros(len(hashes), np.uint64)
    for k in range(SHINGLE):
        moved = np.zeros_like(hashes)
        moved[: len(hashes) - k] = hashes[k:]
        out = np.where(left > k, _mix(out ^ (moved + _U(k))), out)
    short = counts < SHINGLE
    first = np.zeros(len(hashes), bool)
    first[(ends - counts)[counts > 0]] = True
    good = (left >= SHINGLE) | (first & np.repeat(short, counts))
    out, owner = out[good], owner[good]
    return out[np.lexsort((out, owner))], np.bincount(owner, minlength=len(texts))


def weighted(bags: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, weight, text) of bags as shingle_bags() gives them."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    if not len(bags):
        return bags, np.zeros(0, np.int64), owner
    at = np.flatnonzero(np.r_[True, (bags[1:] != bags[:-1]) | (owner[1:] != owner[:-1])])
    return bags[at], np.diff(np.r_[at, len(bags)]), owner[at]


def dart_signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, texts: int, k: int) -> np.ndarray:
    """Earliest rank of each coordinate, (texts, k); inf throughout for a text without elements.

    A rank belongs to one dart, so equal ranks are equal darts. What a text keeps doesn't depend on how many
    darts were thrown, as long as every coordinate has one.
    """
    best = np.full(texts * k, np.inf)
    total = np.bincount(owner, weights=weights, minlength=texts)
    reach = np.divide(k * (math.log(k) + SPARE), total, out=np.zeros(texts), where=total > 0)
    # a row for each element and cell of the weight axis that its weight reaches into
    cells = np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64) + 1
    row = np.repeat(np.arange(len(elements)), cells)
    cell = np.arange(len(row)) - np.repeat(np.cumsum(cells) - cells, cells)
    low = np.where(cell > 0, 2.0 ** (cell - 1), 0.0)
    width = np.where(cell > 0, low, 1.0)
    seed = _mix(elements[row] + _U(0x9E3779B97F4A7C15) * (cell + 1).astype(np.uint64))
    rank = np.zeros(len(row))
    own, weight = owner[row], weights[row]
    todo = np.ones(texts, bool)
    todo[total == 0] = False
    while todo.any():
        live = np.flatnonzero(todo[own])
        rank[live] = 0
        s, r, number = seed[live], rank[live], 0
        o, w, lo, wd = own[live], weight[live], low[live], width[live]
        while len(s):
            number += 1
            s = _mix(s + _U(0x9E3779B97F4A7C15))
            r = r - np.log(((s >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / wd
            within = r <= reach[o]
            s, r, o, w, lo, wd = s[within], r[within], o[within], w[within], lo[within], wd[within]
            aim = _mix(s ^ _U(0xD1B54A32D192ED03))
            spot = (aim % _U(k)).astype(np.int64) + o * k
            if (wd > 1).any() or (lo > 0).any():
                height = lo + wd * (((_mix(aim) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)
                hit = height <= w
                np.minimum.at(best, spot[hit], r[hit])
            else:
                np.minimum.at(best, spot, r)
        empty = np.isinf(best.reshape(texts, k)).any(axis=1)
        todo &= empty
        reach[todo] *= 2
    return best.reshape(texts, k)


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(texts, bands) join keys."""
    values = signatures.view(np.uint64).reshape(len(signatures), bands, rows)
    out = np.broadcast_to(_mix(np.arange(1, bands + 1, dtype=np.uint64)), values.shape[:2]).copy()
    for i in range(rows):
        out = _mix(out ^ values[:, :, i])
    return out.view(np.int64)


def lanes(elements: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """((texts, WORDS) of bits, surplus of each text) of distinct shingles.

    A shingle's hash puts it into one of LANES lanes; bit d of a lane is set if it holds more than d shingles, and
    shingles beyond DEPTH in a lane are the surplus. Two texts share at most as many shingles as bits, by lane, and
    the lesser surplus: min(x, y) = min(x, d) + ... holds for each lane, and sums of minima are at most minima of sums.
    """
    counts = np.bincount(owner * LANES + (elements % _U(LANES)).astype(np.int64), minlength=texts * LANES).reshape(texts, LANES)
    bits = np.concatenate([np.packbits(counts > d, axis=1) for d in range(DEPTH)], axis=1)
    return np.ascontiguousarray(bits).view(np.int64), np.maximum(counts - DEPTH, 0).sum(axis=1)


def most_shared(a: list, b: list, surplus: str, other: str):
    """The number of distinct shingles that two texts share at most, by lanes(), as a Column."""
    out = F.least(surplus, other)
    for x, y in zip(a, b, strict=True):
        out = out + F.bit_count(F.col(x).bitwiseAND(F.col(y)))
    return out


def similarities(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(weighted, plain) Jaccard similarity of two bags."""
    if not len(a) or not len(b):
        return 0.0, 0.0
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = int(np.minimum(n[i], m[j]).sum())
    return shared / (len(a) + len(b) - shared), len(i) / (len(x) + len(y) - len(i))


def few(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """``df`` of about so many rows in no more partitions than these rows are worth; small tables make few shuffle files."""
    return df.coalesce(max(1, -(-rows // each)))


def components(edges: DataFrame, rows: int) -> DataFrame:
    """(node, root) of an undirected graph of longs (a, b) with at most so many edges: each node's least node.

    Alternating large and small stars: a node's greater neighbours move to its least neighbour, then its
    smaller ones do, until nothing moves.
    """
    rows *= 2
    edges = few(few(edges, rows).where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), rows)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = few(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), rows)
        large = few(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), rows)
        least = few(large.groupBy("u").agg(F.min("v").alias("m")), rows)
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = few(few(small, rows).distinct(), rows).checkpoint()
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(few(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct(), rows))
        state = now


def plain_keys(elements: np.ndarray, owner: np.ndarray, repeated: np.ndarray, keys: np.ndarray, bands: int, rows: int) -> pa.ListArray:
    """Band keys of the distinct shingles, of texts in which some occur repeatedly; null where they equal ``keys``.

    Without repeats the two signatures are the same, so plain keys meet the keys of such texts too.
    """
    which = np.flatnonzero(repeated)
    mine = repeated[owner]
    own = np.searchsorted(which, owner[mine])
    signatures = dart_signatures(elements[mine], np.ones(len(own), np.int64), own, len(which), bands * rows)
    found = band_keys(signatures, bands, rows)
    ends = np.r_[0, np.cumsum(repeated * bands)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel(), mask=(found == keys[which]).ravel()))


def signed(df: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """(id, digest of the text, numbers of shingles and of distinct ones, band keys, those of the distinct shingles)."""

    def run(batch: pa.RecordBatch):
        for part in slices(batch, text_col, 2 << 20):
            texts = part.column(text_col)
            bags, sizes = shingle_bags(texts)
            elements, weights, owner = weighted(bags, sizes)
            keys = band_keys(dart_signatures(elements, weights, owner, len(sizes), bands * rows), bands, rows)
            kinds = np.bincount(owner, minlength=len(sizes))
            plain = plain_keys(elements, owner, kinds < sizes, keys, bands, rows)
            digests = [hashlib.md5(t).digest() for t in texts.cast(pa.binary()).to_pylist()]
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
            yield pa.record_batch([part.column(id_col), pa.array(digests, pa.binary()), pa.array(sizes), pa.array(kinds), listed, plain], names=[id_col, "digest", "n", "kinds", "bands", "plain"])

    return map_batches(id_and_text(df, id_col, text_col), run, f"`{id_col}` long, digest binary, n long, kinds long, bands array<long>, plain array<long>")


def _bags(texts: DataFrame) -> DataFrame:
    """(t, bag, lanes, surplus): sorted shingle hashes as bytes, and lanes() of the distinct ones. Repeated rows of a batch give one."""

    def run(batch: pa.RecordBatch):
        _, first = np.unique(batch.column("t").to_numpy(), return_index=True)
        for part in slices(batch.take(pa.array(first)), "text"):
            bags, sizes = shingle_bags(part.column("text"))
            elements, _, owner = weighted(bags, sizes)
            bits, surplus = lanes(elements, owner, len(sizes))
            ends = np.cumsum(sizes)
            each = pa.array([bags[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary())
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * WORDS), pa.array(bits.ravel()))
            yield pa.record_batch([part.column("t"), each, listed, pa.array(surplus.astype(np.int32))], names=["t", "bag", "lanes", "surplus"])

    return map_batches(texts.select("t", "text"), run, "t long, bag binary, lanes array<long>, surplus int")


def _compared(pairs: DataFrame) -> DataFrame:
    """(a, b, similarity): the greater one of the two similarities."""

    def run(batch: pa.RecordBatch):
        read = lambda x: np.frombuffer(x, np.uint64)
        found = [max(similarities(read(x), read(y))) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
        return pa.record_batch([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], names=["a", "b", "similarity"])

    return map_batches(pairs.select("a", "b", "x", "y"), run, "a long, b long, similarity double")


def _may_be_among(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose digest may be in ``wanted``, by a set of SLOTS * 64 bits that is broadcast; so few others are shuffled.

    Its size doesn't depend on the data. A set that is full lets all rows pass.
    """
    h = F.xxhash64("digest")
    slot, bit = F.pmod(h, F.lit(SLOTS)).cast("int"), F.call_function("shiftrightunsigned", h, F.lit(58)).cast("int")
    bits = wanted.select(slot.alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("one")).groupBy("slot").agg(F.bit_or("one").alias("bits"))
    told = rows.withColumn("slot", slot).join(F.broadcast(bits), "slot")
    return told.where(F.call_function("bit_get", F.col("bits"), bit) == 1).select(*rows.columns)


def _linked(root: DataFrame, nodes: int, pairs: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """(t, root) after the pairs (t, pt) of texts have been compared; roots of texts that are linked become one."""
    pairs = pairs.select(F.least("t", "pt").alias("a"), F.greatest("t", "pt").alias("b")).distinct()
    left, right = bags.select(F.col("t").alias("a"), F.col("bag").alias("x")), bags.select(F.col("t").alias("b"), F.col("bag").alias("y"))
    links = _compared(pairs.join(left, "a").join(right, "b")).where(F.col("similarity") >= least).select("a", "b").checkpoint()
    n_links = links.count()
    if not n_links:
        return root
    links = few(links, n_links)
    ends = links.join(root.withColumnsRenamed({"t": "a", "root": "ra"}), "a").join(root.withColumnsRenamed({"t": "b", "root": "rb"}), "b")
    merged = components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")), n_links)
    root = root.join(merged.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("t", F.coalesce("to", "root").alias("root"))
    return few(root, nodes).checkpoint()


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, class_id, class_size, keep, class_key, digest) of each row: class_id is the least id of the row's class.

    ``keep`` is true for the row with that id. Exact copies are in one class. A null text is empty; texts without
    words are alike only if they are equal. A row with a null id belongs to the class of its text and isn't kept,
    unless no row of the class has an id; its class is null then. Rows with one id and one text are one document.
    ``class_key`` numbers the classes, also those without an id; ``digest`` is the text's MD5.

    Nothing of the corpus goes to the driver but counts. Copies of a text are one node of the graph, found by a
    partial aggregation. Buckets are joined with their pivots, then only members in different classes with one another.
    """
    attach(df.sparkSession)
    docs = id_and_text(df, id_col, text_col).withColumnsRenamed({id_col: "id", text_col: "text"})
    texts = signed(docs, "id", "text", bands, rows).groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("kinds").alias("kinds"), F.first("bands").alias("bands"), F.first("plain").alias("plain"))
    texts = texts.withColumn("t", F.monotonically_increasing_id()).checkpoint()

    keyed = texts.where("n > 0").select("t", F.col("n").cast("int").alias("n"), F.col("kinds").cast("int").alias("kinds"), F.explode(F.concat("bands", "plain")).alias("key")).where("key is not null")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = keyed.join(sizes, "key").select("key", "t", "n", "kinds", "size").checkpoint()
    company = members.groupBy("t").agg(F.sum("size").alias("company")).checkpoint()
    nodes = company.count()
    root = few(company.select("t", F.col("t").alias("root")), nodes)
    if nodes:
        wanted = company.select("t").join(texts, "t").select("t", "digest", F.col("first_id").alias("id"))
        with_id = _may_be_among(docs.select(F.unhex(F.md5("text")).alias("digest"), "id", "text"), wanted.select("digest"))
        found = with_id.where("id is not null").join(wanted.where("id is not null"), ["digest", "id"]).select("t", "text")
        no_id = with_id.where("id is null").join(wanted.where("id is null").drop("id"), "digest").select("t", "text")
        bags = _bags(found.unionByName(no_id)).dropDuplicates(["t"]).checkpoint()
        # sizes that differ more can't have the similarity, neither as bags nor as sets
        enough = lambda shared, x, y: shared * (1 + least) >= F.lit(least) * (x + y) - 1e-6
        sized = enough(F.least("n", "pn"), F.col("n"), F.col("pn")) | enough(F.least("kinds", "pkinds"), F.col("kinds"), F.col("pkinds"))

        # every member with the one of its bucket that has the most company
        ranked = members.join(company, "t")
        pivots = ranked.groupBy("key").agg(F.max(F.struct("company", (-F.col("t")).alias("least"), "n", "kinds")).alias("p")).select("key", (-F.col("p.least")).alias("pt"), F.col("p.n").alias("pn"), F.col("p.kinds").alias("pkinds"))
        pairs = members.join(pivots, "key").where("t <> pt").where(sized)
        root = _linked(root, nodes, pairs, bags, least)

        # all that are in different classes still and may have the similarity
        now = members.join(root, "t")
        split = now.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        mine, theirs = ([f"{x}{i}" for i in range(WORDS)] for x in ("v", "w"))
        # columns that can't be null: with checks for nulls the join's code would be too long to be compiled, and ten times slower
        sure = lambda x, c: F.coalesce(c, F.lit(0)).alias(x)
        told = bags.select("t", sure("surplus", F.col("surplus")), *[sure(x, F.get("lanes", F.lit(i))) for i, x in enumerate(mine)])
        now = now.join(split, "key").select("key", "t", *[sure(x, F.col(x)) for x in ("n", "kinds", "root")]).join(told, "t").checkpoint()
        other = now.select("key", F.col("t").alias("pt"), F.col("n").alias("pn"), F.col("kinds").alias("pkinds"), F.col("root").alias("proot"), F.col("surplus").alias("psurplus"), *[F.col(x).alias(y) for x, y in zip(mine, theirs, strict=True)])
        shared = most_shared(mine, theirs, "surplus", "psurplus")
        repeats = F.least(F.col("n") - F.col("kinds"), F.col("pn") - F.col("pkinds"))
        pairs = now.join(other, "key").where("root < proot").where(sized)
        pairs = pairs.where(enough(shared, F.col("kinds"), F.col("pkinds")) | enough(shared + repeats, F.col("n"), F.col("pn")))
        root = _linked(root, nodes, pairs, bags, least)

    of_text = texts.join(root, "t", "left").select("digest", "first_id", "copies", F.coalesce("root", "t").alias("root"))
    of_class = of_text.groupBy("root").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size"))
    known = of_text.join(of_class, "root").select("digest", "root", "class_id", "class_size")
    out = docs.select("id", F.unhex(F.md5("text")).alias("digest")).join(known, "digest")
    keep = F.coalesce(F.col("id") == F.col("class_id"), F.col("class_id").isNull())
    return out.select(F.col("id").alias(id_col), "class_id", "class_size", keep.alias("keep"), F.col("root").alias("class_key"), "digest")


def one_of_each(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` for each class of classes(): of the rows it keeps, one with the least digest of the text.

    Rows are told by id and text, so null ids, repeated rows and texts that share an id are no exceptions.
    """
    one = found.where("keep").groupBy("class_key").agg(F.min("digest").alias("_kept_digest"), F.first("class_id").alias("_kept_id")).select("_kept_digest", "_kept_id")
    digest = F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    same = F.col("_one_digest").eqNullSafe(F.col("_kept_digest")) & F.col(id_col).cast("long").eqNullSafe(F.col("_kept_id"))
    # by text and id: the copies of a text, which may be many, spread by their ids
    return df.withColumn("_one_digest", digest).join(one, same).dropDuplicates(["_kept_digest", "_kept_id"]).select(*[F.col(f"`{c}`") for c in df.columns])
