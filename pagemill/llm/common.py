"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROOT = str(Path(__file__).resolve().parents[2])


#: Rows of an Arrow batch: Spark's own number and the one taken here. Texts are long, and a batch is held by the JVM and the worker alike.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2500")}


def attach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and make sure that a checkpoint folder is set.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as it is. Only where it
    is unset and all runs in one process (local tests) a temporary folder is taken; elsewhere that is an error.
    """
    context = spark.sparkContext
    paths = context.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        context.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    for key, (usual, value) in BATCHES.items():
        if spark.conf.get(key, None) in (None, usual):
            spark.conf.set(key, value)
    if not context.getCheckpointDir():
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark."""
    attach(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id as long, text as string, null text as the empty text); every other column is left out."""
    return df.select(
        F.col(id_col).cast("long").alias(id_col),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text_col),
    )


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the checkpoint folder, read again; cuts the lineage."""
    spark = attach(df.sparkSession)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def give_back() -> None:
    """Returns freed memory to the system; several workers of an executor wait for work at a time, each with what it once took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch], schema: str | StructType
) -> DataFrame:
    """mapInArrow for a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out
            del batch, out
            give_back()

    return df.mapInArrow(run, schema)


#: Bytes of text that are worked on at once; bounds the memory of a worker, never what is read.
SLICE_BYTES = 3 << 20


def slices(batch: pa.RecordBatch, text_col: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most ``limit`` bytes of text each, but one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(first, last - first)
        first = last


def dictionary_of_chunks(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Chunks between blanks and line feeds, as (index into the distinct chunks, distinct chunks, bounds by text)."""
    spaced = pc.replace_substring(texts.cast(pa.large_string()), "\n", " ")
    parts = pc.split_pattern(spaced, " ")
    bounds = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist(), bounds - bounds[0]


def total_by_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds; equal stretches of values have equal sums."""
    if values.dtype.kind == "f":
        return np.bincount(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), weights=values, minlength=len(bounds) - 1)
    running = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return running[bounds[1:]] - running[bounds[:-1]]


def ragged_take(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenation of flat[s : s + n] over (starts, sizes)."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    shift = np.repeat(starts - (ends - sizes), sizes)
    return flat[shift + np.arange(total, dtype=np.int64)]
