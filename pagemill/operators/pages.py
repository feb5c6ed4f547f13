"""Page analysis as DataFrame operators over rows of page operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bounding_boxes(points: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(keys, llx, lly, urx, ury) of points; least and greatest are summed up before the shuffle."""
    return points.groupBy(*keys).agg(F.min(x).alias("llx"), F.min(y).alias("lly"), F.max(x).alias("urx"), F.max(y).alias("ury"))


def relative_positions(steps: DataFrame, keys: list[str], order: list[str], dx: str, dy: str) -> DataFrame:
    """Absolute positions of relative steps: running sums along each path."""
    along = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return steps.withColumns({"x": F.sum(dx).over(along), "y": F.sum(dy).over(along)})


def changed_only(states: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The rows at which ``value`` differs from the row before, the first one included."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(*order))
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) == 1
    marked = states.select("*", (first | ~F.col(value).eqNullSafe(before)).alias("__changed"))
    return marked.where("__changed").drop("__changed")


def nesting_depth(ops: DataFrame, keys: list[str], order: list[str], opens: Column, closes: Column) -> DataFrame:
    """``depth`` after each row: brackets open less brackets closed."""
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    return ops.withColumn("depth", F.sum(step).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)).cast("bigint"))


def state_at(events: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The last value that was set up to each row, as ``name``."""
    return events.withColumn(name, F.last(value, ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def page_numbers(ops: DataFrame, keys: list[str], order: list[str], shows: Column) -> DataFrame:
    """``page_no`` from 0: pages shown before each row."""
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return ops.withColumn("page_no", F.coalesce(F.sum(F.when(shows, 1).otherwise(0)).over(before), F.lit(0)).cast("bigint"))


def interned(uses: DataFrame, value: str, order: list[str]) -> DataFrame:
    """(value, number) of the distinct values in the order of their first use, from 0.

    First uses come from a partial aggregate. The distinct values get their numbers by ranges: a range
    partition's numbers start at the count of all values before it, so no task sees all of them.
    """
    first = uses.groupBy(value).agg(F.min(F.struct(*order)).alias("first"))
    sorted_ = first.repartitionByRange("first").sortWithinPartitions("first")
    placed = sorted_.select(value, "first", F.spark_partition_id().alias("part"))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("least"))
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("least").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("part").orderBy("first"))
    return placed.select(value, "part", within.alias("place")).join(offsets, "part").select(value, (F.col("before") + F.col("place") - 1).alias("number"))


def used_codes(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, code) of the distinct characters of each font's texts."""
    each = F.explode(F.array_distinct(F.split(F.col(text), "")))
    return texts.select(*keys, each.alias("code")).where("code <> ''").distinct()


def runs(numbers: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(keys, first, last, n) of maximal runs of consecutive distinct numbers."""
    distinct = numbers.select(*keys, number).distinct()
    spaced = distinct.withColumn("island", F.col(number) - F.row_number().over((W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(number)))
    return spaced.groupBy(*keys, "island").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count(F.lit(1)).alias("n")).drop("island")


def runs_by_ends(numbers: DataFrame, number: str) -> DataFrame:
    """(first, last, n) of runs of one long list, without one window over all of it: a run begins where no predecessor is, and ends where no successor is.

    Beginnings and ends are matched by place in blocks of 2^16 numbers; only blocks' counts are summed up in one task.
    """
    distinct = numbers.select(F.col(number).cast("bigint").alias("x")).distinct()
    near = distinct.select(F.explode(F.array(F.struct((F.col("x") + 1).alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c")), F.struct(F.col("x"), F.lit(0).alias("a"), F.lit(1).alias("b"), F.lit(0).alias("c")), F.struct((F.col("x") - 1).alias("x"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(1).alias("c")))).alias("e")).select("e.*")
    seen = near.groupBy("x").agg(F.max("a").alias("has_before"), F.max("b").alias("there"), F.max("c").alias("has_after")).where("there = 1")
    ends = seen.select("x", (F.col("has_before") == 0).alias("starts"), (F.col("has_after") == 0).alias("stops")).where("starts or stops").withColumn("block", F.shiftright("x", 16))
    blocks = ends.groupBy("block").agg(F.count_if("starts").alias("s"), F.count_if("stops").alias("t"))
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"))
    inner = W.partitionBy("block").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    placed = ends.join(blocks, "block").select("x", "starts", "stops", (F.col("s0") + F.sum(F.col("starts").cast("int")).over(inner)).alias("s"), (F.col("t0") + F.sum(F.col("stops").cast("int")).over(inner)).alias("t"))
    first, last = placed.where("starts").select("s", F.col("x").alias("first")), placed.where("stops").select("t", F.col("x").alias("last"))
    return first.join(last, F.col("s") == F.col("t")).select("first", "last", (F.col("last") - F.col("first") + 1).alias("n"))


def mapped_codes(codes: DataFrame, ranges: DataFrame, code: str = "code", width: int = 256) -> DataFrame:
    """Codes with ``cid``: by the narrowest depth first, exact mappings before ranges before notdef ranges, 0 if nothing maps.

    ``ranges`` has low, high, cid, kind ('exact', 'range', 'notdef') and depth. Ranges are cut at blocks of ``width``
    codes, so that the join is on a block's number and not on an inequality.
    """
    cut = ranges.select("*", F.explode(F.sequence(F.call_function("div", "low", F.lit(width)), F.call_function("div", "high", F.lit(width)))).alias("block"))
    rank = F.when(F.col("kind") == "exact", 0).when(F.col("kind") == "range", 1).otherwise(2)
    asked = codes.select(F.col(code)).distinct().withColumn("block", F.call_function("div", code, F.lit(width)))
    hit = asked.join(cut, "block").where(F.col(code).between(F.col("low"), F.col("high")))
    to = F.when(F.col("kind") == "notdef", F.col("cid")).otherwise(F.col("cid") + F.col(code) - F.col("low"))
    best = hit.groupBy(code).agg(F.min_by(to, F.struct("depth", rank, "low")).alias("cid"))
    return codes.join(best, code, "left").withColumn("cid", F.coalesce("cid", F.lit(0)))


def block_means(pixels: DataFrame, keys: list[str], x: str, y: str, value: str, factor: int) -> DataFrame:
    """(keys, bx, by, mean): rounded means of blocks of factor by factor samples."""
    total, n = F.sum(value), F.count(F.lit(1))
    return pixels.groupBy(*keys, F.call_function("div", x, F.lit(factor)).alias("bx"), F.call_function("div", y, F.lit(factor)).alias("by")).agg(F.call_function("div", total + F.call_function("div", n, F.lit(2)), n).alias("mean"))


def reduction_factor(width: Column, height: Column, a: Column, b: Column, c: Column, d: Column, target: Column) -> Column:
    """By how much an image painted under a matrix may be reduced to come no lower than a resolution."""
    rx, ry = width / F.hypot(a, b) * 72.0, height / F.hypot(c, d) * 72.0
    return F.greatest(F.lit(1), F.floor(F.least(rx, ry) / target).cast("int"))


def reached(roots: DataFrame, references: DataFrame) -> DataFrame:
    """(root, node) of all that roots reach over references (from, to), roots themselves included; to a fixpoint."""
    known = roots.select(F.col("root"), F.col("root").alias("node")).distinct()
    front = known
    while True:
        step = front.join(references, front["node"] == references["from"]).select("root", F.col("to").alias("node")).distinct()
        front = step.join(known, ["root", "node"], "left_anti").checkpoint()
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known


def compared(expected: DataFrame, actual: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """(keys, verdict, differing): pass, fail, missing or unexpected, and which channels differ."""
    left = expected.select(*keys, *[F.col(c).alias(f"want_{c}") for c in channels], F.lit(True).alias("wanted"))
    right = actual.select(*keys, *[F.col(c).alias(f"got_{c}") for c in channels], F.lit(True).alias("got"))
    both = left.join(right, keys, "full_outer")
    differ = F.filter(F.array(*[F.when(~F.col(f"want_{c}").eqNullSafe(F.col(f"got_{c}")), F.lit(c)) for c in channels]), lambda x: x.isNotNull())
    verdict = F.when(F.col("got").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.size(differ) == 0, "pass").otherwise("fail")
    return both.select(*keys, verdict.alias("verdict"), F.concat_ws(",", F.when(F.col("wanted") & F.col("got"), differ)).alias("differing"))
