"""A job server as a stream: pieces of jobs come in, and finished jobs go out.

State is keyed by job. Pieces are kept by number, so they may come late or twice; a job runs when all pieces up
to its last one are there, from its first byte, which gives the same result however the job was split. Pieces after
that are refused. A job whose pieces stop coming can be abandoned after a time without one.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.programs import Config, one_run
from ..sources.tables import attach

OUT = "job_id string, status string, outcome string, error_name string, steps bigint, pages int, reply binary, pieces int"
STATE = "held binary"


def _row(key: str, status: str, run: dict | None, pieces: int) -> pd.DataFrame:
    run = run or {"outcome": None, "error_name": None, "steps": 0, "pages": [], "stdout": b""}
    return pd.DataFrame({"job_id": [key], "status": [status], "outcome": [run["outcome"]], "error_name": [run["error_name"]], "steps": [run["steps"]], "pages": [len(run["pages"])], "reply": [run["stdout"]], "pieces": [pieces]})


def finished_jobs(pieces: DataFrame, config: Config = Config(), timeout: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows of OUT from a stream of (job_id, chunk_no, bytes, eof): finished, refused, too large or abandoned.

    ``limit`` bounds the bytes that an unfinished job may hold, for servers that must; none is set unless asked for.

    ``timeout`` ("10 minutes") is the time without a piece after which a job is abandoned. It is for streams that
    run on, as Spark starts batches without data to look for timeouts; without it jobs wait.
    """
    attach(pieces.sparkSession)
    milliseconds = timeout and int(float(timeout.split()[0]) * {"s": 1000, "m": 60_000, "h": 3_600_000}[timeout.split()[1][0]])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job = key[0]
        if state.hasTimedOut:
            held = pickle.loads(state.get[0])
            state.remove()
            if not held["done"]:
                yield _row(job, "abandoned", None, len(held["pieces"]))
            return
        held = pickle.loads(state.get[0]) if state.exists else {"pieces": {}, "last": None, "done": False}
        refused = 0
        for batch in batches:
            for number, data, eof in zip(batch["chunk_no"], batch["bytes"], batch["eof"], strict=True):
                if held["done"]:
                    refused += 1
                    continue
                held["pieces"].setdefault(int(number), bytes(data) if data is not None else b"")
                if eof:
                    held["last"] = int(number)
        if not held["done"]:
            if limit is not None and sum(map(len, held["pieces"].values())) > limit:
                yield _row(job, "too large", None, len(held["pieces"]))
                held = {"pieces": {}, "last": None, "done": True}
            elif held["last"] is not None and all(n in held["pieces"] for n in range(held["last"] + 1)):
                whole = b"".join(held["pieces"][n] for n in range(held["last"] + 1))
                yield _row(job, "finished", one_run(whole, config), held["last"] + 1)
                held = {"pieces": {}, "last": None, "done": True}
        if refused:
            yield _row(job, "refused", None, refused)
        state.update((pickle.dumps(held),))
        if milliseconds:
            state.setTimeoutDuration(milliseconds)

    rows = pieces.select(F.col("job_id").cast("string").alias("job_id"), F.col("chunk_no").cast("int").alias("chunk_no"), F.col("bytes").cast("binary").alias("bytes"), F.col("eof").cast("boolean").alias("eof"))
    return rows.groupBy("job_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if timeout else GroupStateTimeout.NoTimeout)


def whole_jobs(pieces: DataFrame) -> DataFrame:
    """(program_id, bytes) of a table of pieces: the batch form, for programs.run_programs()."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", "bytes")))
    joined = F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p["bytes"])), ""))  # one pass, however many pieces
    return pieces.groupBy(F.col("job_id").cast("string").alias("program_id")).agg(joined.alias("bytes"))
