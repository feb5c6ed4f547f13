"""Collections of programs: scanned, run, and turned into documents, one program a row.

A program runs inside an Arrow map task, bounded by a budget of executed objects, so a runaway program ends
with outcome ``budget`` and never holds up a task. A program's error is a value in its row; no row fails a job.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import attach, give_back

#: Programs of a batch; each batch's results leave the worker before the next one begins.
BATCH = 256
TOKENS = "program_id string, seq int, kind string, text string, int_v int, real_v float, depth int, span_start int, span_end int"
RUN = (
    "program_id string, outcome string, error_name string, offending string, steps bigint, stdout binary, stderr binary, stack array<string>, "
    "pages array<struct<page_no:int,llx:float,lly:float,urx:float,ury:float,ir:string>>, "
    "ops array<struct<page_no:int,seq:int,op:string,nums array<float>,ref:int,path:array<struct<kind:string,x1:float,y1:float,x2:float,y2:float,x3:float,y3:float>>>>, "
    "marks array<struct<seq:int,after_pages:int,kind:string,text:string>>"
).replace("nums array", "nums:array")


@dataclass(frozen=True)
class Config:
    """How programs are run: budget of executed objects, files they may read, a program run before each, the clock."""

    budget: int | None = 100_000_000  # the reference's
    files: dict = field(default_factory=dict)
    prelude: bytes = b""
    graphics: bool = True
    clock: int | None = 0
    compress: bool = True


def programs(df: DataFrame, id_col: str, bytes_col: str) -> DataFrame:
    """(program_id, bytes) of any table with a text or binary column; a null program is empty."""
    attach(df.sparkSession)
    return df.select(F.col(id_col).cast("string").alias("program_id"), F.coalesce(F.col(bytes_col).cast("binary"), F.lit(b"")).alias("bytes"))


def spread(df: DataFrame) -> DataFrame:
    """A scanned table in as many partitions as the cluster works on at once, at least; to run a program costs far more than to move it."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def _rows(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for a in range(0, batch.num_rows, BATCH):
            part = batch.slice(a, BATCH)
            yield list(zip(part.column("program_id").to_pylist(), part.column("bytes").to_pylist(), strict=True))


def tokens(df: DataFrame) -> DataFrame:
    """A row for each token of (program_id, bytes); what can't be scanned ends in a token of kind error."""
    schema = pa.schema([("program_id", pa.string()), ("seq", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("int_v", pa.int32()), ("real_v", pa.float32()), ("depth", pa.int32()), ("span_start", pa.int32()), ("span_end", pa.int32())])

    def run(batches):
        from ..vm import scanner

        for rows in _rows(batches):
            out = []
            for key, data in rows:
                for seq, (kind, value, start, end, depth) in enumerate(scanner.tokens(data)):
                    text = value.decode("latin-1") if isinstance(value, bytes) else value if isinstance(value, str) else data[start:end].strip().decode("latin-1")
                    whole = value if kind == "number" and isinstance(value, int) else None
                    part = value if kind == "number" and isinstance(value, float) else None
                    out.append((key, seq, kind, text, whole, part, depth, start, end))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema, strict=True)], schema=schema)

    return df.mapInArrow(run, TOKENS)


@lru_cache(maxsize=1)
def _language():
    """(graphics, interp, dump) with all operators registered."""
    from ..vm import dump, fonts, graphics, interp, ops_data, ops_graphics, ops_io

    del fonts, ops_data, ops_graphics, ops_io
    return graphics, interp, dump


@lru_cache(maxsize=1)
def _settled() -> None:
    """Keeps what a worker has loaded from being looked through at each collection; each program leaves cycles behind."""
    _language()
    gc.collect()
    gc.freeze()


def interpreter(config: Config):
    graphics, interp, _ = _language()
    gfx = graphics.Graphics() if config.graphics else None
    vm = interp.Interp(budget=config.budget, files=dict(config.files), graphics=gfx, clock=config.clock)
    if config.prelude:
        vm.job(config.prelude)
        vm.steps = 0
    return vm


def _segments(path) -> list[dict]:
    names = ("x1", "y1", "x2", "y2", "x3", "y3")
    return [{"kind": s[0]} | {n: s[1 + i] if len(s) > 1 + i else None for i, n in enumerate(names)} for s in path]


def flat_op(op: tuple) -> tuple[str, list[float] | None, int | None, Sequence | None]:
    """(operation, numbers, resource, path) of a recorded operation."""
    kind = op[0]
    if kind in ("W", "W*", "f", "f*"):
        return kind, None, None, op[1]
    if kind == "S":
        return kind, list(op[2]), None, op[1]
    if kind in ("cs", "pattern"):
        return kind, list(op[2]) if len(op) > 2 else None, op[1], None
    if kind in ("form", "sh", "Do"):
        return kind, list(op[2]), op[1], None
    if kind == "text":
        return kind, [*op[2], *[v for d in op[4] for v in d]], op[1], None
    if kind == "sc":
        return kind, list(op[1]), None, None
    if kind == "d":
        return kind, [*op[1], op[2]], None, None
    if len(op) > 1:
        return kind, [float(op[1])], None, None
    return kind, None, None, None


def _pages(vm) -> list[dict]:
    dump = _language()[2]
    boxes = [(page, *page.media) for page in (vm.graphics.pages if vm.graphics else [])]
    return [{"page_no": n, "llx": x0, "lly": y0, "urx": x1, "ury": y1, "ir": dump.page_text(page)} for n, (page, x0, y0, x1, y1) in enumerate(boxes)]


def _ops(vm) -> list[tuple]:
    """(page, number there, operation, numbers, resource, path) of all operations."""
    return [(n, seq, *flat_op(op)) for n, page in enumerate(vm.graphics.pages if vm.graphics else []) for seq, op in enumerate(page.content.ops)]


def _marks(vm) -> list[dict]:
    return [{"seq": i, "after_pages": e[1] if isinstance(e[1], int) else 0, "kind": e[2] if len(e) == 4 else e[0], "text": repr(e[3]) if len(e) == 4 else f"/{e[1]} {e[2]}"} for i, e in enumerate(vm.events)]


def _stack(vm) -> list[str]:
    from ..vm.objects import syntax

    return [syntax(x) for x in vm.ostack]


#: What there is to know of a program that has run, from the interpreter and its (outcome, error, offending command).
MADE: dict[str, Callable] = {
    "outcome": lambda vm, end: end[0], "error_name": lambda vm, end: end[1], "offending": lambda vm, end: end[2], "steps": lambda vm, end: vm.steps, "stdout": lambda vm, end: bytes(vm.out),
    "stderr": lambda vm, end: bytes(vm.err), "stack": lambda vm, end: _stack(vm), "pages": lambda vm, end: _pages(vm), "ops": lambda vm, end: _ops(vm), "marks": lambda vm, end: _marks(vm),
}


def one_run(program: bytes, config: Config) -> dict:
    """Everything that a program made, as plain values."""
    vm = interpreter(config)
    end = vm.job(program)
    out = {what: get(vm, end) for what, get in MADE.items()}
    return out | {"ops": [{"page_no": n, "seq": seq, "op": kind, "nums": nums, "ref": ref, "path": None if path is None else _segments(path)} for n, seq, kind, nums, ref, path in out["ops"]]}


def _lists(values: list, inner: Callable, kind: pa.DataType) -> pa.Array:
    """An Arrow list for each of the values, or null; inner makes an array of the items of all of them."""
    ends, n = [], 0
    for v in values:
        ends.append(None if v is None else n)
        n += 0 if v is None else len(v)
    return pa.ListArray.from_arrays(pa.array([*ends, n], pa.int32()), inner([x for v in values if v is not None for x in v], kind.value_type), type=kind)


def _structs(rows: list, kind: pa.DataType) -> pa.Array:
    columns = list(zip(*rows, strict=True)) if rows else [()] * kind.num_fields
    made = [_lists(c, pa.array if f.name == "nums" else _points, f.type) if pa.types.is_list(f.type) else pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)]
    return pa.StructArray.from_arrays(made, fields=list(kind))


_ABSENT = (None,) * 6


def _points(segments: list, kind: pa.DataType) -> pa.Array:
    return _structs([(*s, *_ABSENT[len(s) - 1 :]) for s in segments], kind)


def run_programs(df: DataFrame, config: Config = Config(), only: Sequence[str] | None = None) -> DataFrame:
    """One row for each row of (program_id, bytes): outcome, output, pages and document marks. No shuffle.

    ``only`` names the columns that are wanted beside program_id; what others would hold isn't made.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    wanted = tuple(MADE) if only is None else tuple(only)
    whole = _parse_datatype_string(RUN)
    columns = StructType([whole[x] for x in ("program_id", *wanted)])
    schema = to_arrow_schema(columns)

    def run(batches):
        _settled()
        get = [MADE[x] for x in wanted]
        for rows in _rows(batches):
            made = []
            for _, data in rows:
                vm = interpreter(config)
                end = vm.job(data)
                made.append([g(vm, end) for g in get])
            arrays = [pa.array([key for key, _ in rows], pa.string())]
            for x, values in zip(wanted, zip(*made, strict=True), strict=True):
                kind = schema.field(x).type
                arrays.append(_lists(values, _structs, kind) if x == "ops" else pa.array(values, kind))
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return df.mapInArrow(run, columns)


def outcomes(runs: DataFrame) -> DataFrame:
    return runs.select("program_id", "outcome", "error_name", "offending", "steps", F.size("pages").alias("pages"))


def output_lines(runs: DataFrame) -> DataFrame:
    """(program_id, seq, line) of what programs wrote."""
    lines = F.split(F.regexp_replace(F.decode("stdout", "ISO-8859-1"), "\n$", ""), "\n")
    return runs.where(F.octet_length("stdout") > 0).select("program_id", F.posexplode(lines).alias("seq", "line"))


def ir_ops(runs: DataFrame) -> DataFrame:
    return runs.select("program_id", F.explode("ops").alias("o")).select("program_id", "o.*")


def page_rows(runs: DataFrame) -> DataFrame:
    return runs.select("program_id", F.explode("pages").alias("p")).select("program_id", "p.*")


def page_resources(runs: DataFrame) -> DataFrame:
    """(program_id, page_no, kind, ref, text) of what pages use: colour spaces, images, fonts, patterns, forms and shadings.

    ``text`` is the canonical description after the kind and the number; a body in braces keeps its lines.
    """
    listed = F.split(F.regexp_extract("p.ir", r"(?s)\nresources:\n(.*?)\n?ops:\n", 1), r"\n(?=[a-z]+ \d)", -1)
    rows = runs.select("program_id", F.explode("pages").alias("p")).select("program_id", "p.page_no", F.explode(listed).alias("line")).where("line <> ''")
    part = lambda n: F.regexp_extract("line", r"(?s)^([a-z]+) (\d+) ?(.*)$", n)
    return rows.select("program_id", "page_no", part(1).alias("kind"), part(2).cast("int").alias("ref"), part(3).alias("text"))


def doc_marks(runs: DataFrame) -> DataFrame:
    return runs.select("program_id", F.explode("marks").alias("m")).select("program_id", "m.*")


def path_points(ops: DataFrame) -> DataFrame:
    """(program_id, page_no, seq, x, y) of all points and control points of painted paths."""
    segment = F.explode("path").alias("s")
    points = F.explode(F.array(*[F.struct(F.col(f"s.x{i}").alias("x"), F.col(f"s.y{i}").alias("y")) for i in (1, 2, 3)])).alias("p")
    return ops.where("path is not null").select("program_id", "page_no", "seq", segment).select("program_id", "page_no", "seq", points).select("program_id", "page_no", "seq", "p.*").where("x is not null")


def distill(df: DataFrame, config: Config = Config()) -> DataFrame:
    """(program_id, outcome, error_name, pages, document) of (program_id, bytes); a failed program's finished pages are kept."""
    schema = "program_id string, outcome string, error_name string, pages int, document binary"

    def run(batches):
        from ..vm import pdf

        _settled()
        for rows in _rows(batches):
            out = []
            for key, data in rows:
                vm = interpreter(config)
                outcome, error, _ = vm.job(data)
                done = vm.graphics.pages if vm.graphics else []
                out.append((key, outcome, error, len(done), pdf.write(done, vm.events, config.compress)))
            columns = list(zip(*out, strict=True))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["program_id", "outcome", "error_name", "pages", "document"])

    return df.mapInArrow(run, schema)


#: Bytes that are worked on at once in a column's codec; bounds the memory of a worker, never what is read.
PART_BYTES = 1 << 20


#: Rows of an Arrow batch where values may be long: the setting, Spark's own number and the one taken here.
ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000")


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch (id, bytes) of at most PART_BYTES each, but of one row at least; one if the batch is empty."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
    first = held = 0
    for i, n in enumerate(sizes):
        if i > first and held + n > PART_BYTES:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    yield batch.slice(first)


CODECS = ("ascii_hex", "ascii85", "run_length", "flate", "lzw")


def encode_column(df: DataFrame, id_col: str, bytes_col: str, codec: str, decode: bool = False) -> DataFrame:
    """(id, bytes) of a binary column through one of CODECS; what can't be decoded, or is null, is null."""
    if codec not in CODECS:
        raise ValueError(f"one of {CODECS}")
    spark = attach(df.sparkSession)
    if spark.conf.get(ROWS[0], None) in (None, ROWS[1]):
        spark.conf.set(ROWS[0], ROWS[2])
    kept = df.select(F.col(id_col), F.col(bytes_col).cast("binary").alias("bytes"))

    def run(batches):
        from ..functions import codecs

        change = getattr(codecs, f"{codec}_{'decode' if decode else 'encode'}")

        def safe(data):
            if data is None:
                return None
            try:
                return change(data)[0] if decode else change(data)
            except (codecs.BadData, ValueError):
                return None

        for batch in batches:
            for part in _parts(batch):
                yield pa.record_batch([part.column(0), pa.array([safe(x.as_py()) for x in part.column(1)], pa.binary())], names=[id_col, "bytes"])
            del batch, part
            give_back()

    return kept.mapInArrow(run, f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, bytes binary")
