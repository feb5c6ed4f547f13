"""Definitions in nested scopes, and parameters that merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def looked_up(asked: DataFrame, scopes: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """The asked rows with ``value`` and ``depth`` from the first scope that has their key, null if none has.

    A scope is (rows of its own columns, key, value and depth; names of the columns that choose among its
    dictionaries). Keys are unique in a dictionary.
    """
    names = asked.columns
    values, depths = [], []
    for k, (scope, own) in enumerate(scopes):
        part = scope.select(*own, "key", F.col("value").alias(f"value_{k}"), F.col("depth").alias(f"depth_{k}"))
        asked = asked.join(part, [*own, "key"], "left")
        values.append(F.col(f"value_{k}"))
        depths.append(F.col(f"depth_{k}"))
    return asked.select(*names, F.coalesce(*values).alias("value"), F.coalesce(*depths).alias("depth"))


def merged_parameters(requests: DataFrame, locked: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """(scope, key, value, refused): the last request of each key wins; requests for locked keys are refused and counted.

    ``requests`` has the scope's columns, key, value and the columns of ``order``; ``locked`` has key.
    """
    marked = requests.join(locked.select("key").distinct().withColumn("is_locked", F.lit(True)), "key", "left")
    free = F.col("is_locked").isNull()
    last = F.max_by(F.when(free, F.col("value")), F.when(free, F.struct(*order)))
    return marked.groupBy(*scope, "key").agg(last.alias("value"), F.count_if(~free).alias("refused"))
