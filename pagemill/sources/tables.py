"""Input tables and collections of programs."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def attach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def give_back() -> None:
    """Returns freed memory of a worker to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def checkpoint_folder(spark: SparkSession) -> None:
    """Takes the shared folder that ``spark.checkpoint.dir`` names; one of this machine serves only where all runs in one process."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    attach(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def program_files(spark: SparkSession, path: str, pattern: str = "*.ps") -> DataFrame:
    """(program_id, bytes) of every program file below a folder."""
    attach(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("program_id"), F.col("content").alias("bytes"))
