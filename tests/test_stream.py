"""Jobs that come in pieces."""

import random

from pagemill.operators.programs import Config, one_run, programs, run_programs
from pagemill.streaming.jobs import finished_jobs, whole_jobs

JOBS = {"a": b"1 2 add = (two words) = 0 0 9 9 rectfill showpage", "b": b"/x 3 def x x mul = foo", "c": b"{ } loop"}


def cut(data: bytes, rng: random.Random) -> list[bytes]:
    at = sorted(rng.sample(range(1, len(data)), 3))
    return [data[a:b] for a, b in zip([0, *at], [*at, len(data)])]


def test_any_split_gives_the_same(spark, tmp_path):
    rng = random.Random(3)
    pieces = [(job, n, bytearray(part), n == 3) for job, data in JOBS.items() for n, part in enumerate(cut(data, rng))]
    schema = "job_id string, chunk_no int, bytes binary, eof boolean"
    batch = run_programs(whole_jobs(spark.createDataFrame(pieces, schema)), Config(budget=5000)).collect()
    assert {r.program_id: (r.outcome, bytes(r.stdout)) for r in batch} == {k: (one_run(v, Config(budget=5000))["outcome"], one_run(v, Config(budget=5000))["stdout"]) for k, v in JOBS.items()}

    rng.shuffle(pieces)
    source = str(tmp_path / "in")
    for i in range(0, len(pieces), 5):
        spark.createDataFrame(pieces[i : i + 5], schema).coalesce(1).write.mode("append").parquet(source)
    late = [("a", 9, bytearray(b"late"), False)]
    out = str(tmp_path / "out")

    def advance():
        stream = finished_jobs(spark.readStream.schema(schema).parquet(source), Config(budget=5000))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(100)

    advance()
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(source)
    advance()
    rows = spark.read.parquet(out).collect()
    done = {r.job_id: r for r in rows if r.status == "finished"}
    assert {k: (r.outcome, bytes(r.reply)) for k, r in done.items()} == {"a": ("ok", b"3\ntwo words\n"), "b": ("error", b"9\n"), "c": ("budget", b"")}
    assert done["a"].pages == 1 and [r.job_id for r in rows if r.status == "refused"] == ["a"]


def test_rows_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (None, "1 =")], "k long, program string")
    got = {r.program_id: (r.outcome, bytes(r.stdout)) for r in run_programs(programs(df, "k", "program")).collect()}
    assert got == {"1": ("ok", b""), None: ("ok", b"1\n")}
