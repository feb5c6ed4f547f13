"""Secrets in texts, by patterns and by two Markov models of characters, in DataFrame functions only.

Long unbroken strings are scored by the log-likelihood ratio of their character pairs under a model of
random strings and one of ordinary identifiers, both trained from labelled samples that are made here.
What scores above a threshold is a span of kind ``random``, beside those of the fixed patterns, which stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, id_and_text

# The base patterns, and what is asked of a match.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "random")
#: What the models look at: unbroken strings with a digit and a letter.
LONG = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Labelled samples of each class that the models are trained on, and nats a character pair above which a string counts.
SAMPLES, THRESHOLD = 6000, 0.6
# Parts of ordinary identifiers.
PARTS = (
    "get set user name file path data list item index count value type key map node list text line page table column row "
    "config option result error message request response handler service client server session manager factory builder "
    "image video audio document article section header footer content title description update delete create insert "
    "the and with from that this have will para con las los und der die das les des une pour avec"
).split()
_FIRST, _CHARS = 33, 94
#: Spans that are gathered in one array.
CHUNK = 256


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<start, kind, stop, found>> of a pattern's matches, in code points; text between matches is measured, so none is searched for twice."""
    kinds = "array<struct<start:int,kind:int,stop:int,found:string>>"
    parts = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, found: F.struct(F.length(gap).alias("gap"), found.alias("found")),
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        stop = start + F.coalesce(F.length(x["found"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), x["found"].alias("found"))).cast(kinds)
        none = x["found"].isNull()
        room = F.size(acc["last"]) < CHUNK
        last = F.when(none, acc["last"]).when(room, F.concat(acc["last"], one)).otherwise(one)
        full = F.when(none | room, acc["full"]).otherwise(F.concat(acc["full"], F.array(acc["last"])))
        return F.struct(stop.alias("at"), last.alias("last"), full.alias("full"))

    # spans are gathered in chunks; an array of all of them would be copied for each match
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kinds).alias("last"), F.array().cast(f"array<{kinds}>").alias("full"))
    return F.aggregate(parts, start, step, lambda acc: F.concat(F.flatten(acc["full"]), acc["last"]))


def _where(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast("array<struct<start:int,kind:int,stop:int,found:string>>"))


def samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(text, random) labelled strings: digests in several alphabets, and identifiers of ordinary parts."""
    drawn = spark.range(0, n, 1, 4).select("id", F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256).alias("hash"))
    packed = F.base64(F.unhex("hash"))
    random = drawn.select(F.array(F.substring("hash", 1, 40), packed, F.translate(packed, "+/=", "-_"), F.upper(F.substring(F.translate(packed, "+/=", ""), 1, 24))).alias("texts"), F.lit(True).alias("random"))
    words = F.array(*map(F.lit, PARTS))
    part = lambda i: F.element_at(words, (F.pmod(F.xxhash64(F.col("hash"), F.lit(i)), F.lit(len(PARTS))) + 1).cast("int"))
    year, number = (F.lit(1990) + F.col("id") % 40).cast("string"), (F.col("id") % 100).cast("string")
    plain = drawn.select(
        F.array(
            F.concat_ws("_", part(1), part(2), part(3), number),
            F.concat(part(1), F.initcap(part(2)), F.initcap(part(3)), F.initcap(part(4)), number),
            F.concat_ws("-", part(1), part(2), year, F.lpad(number, 2, "0"), part(5)),
            F.concat_ws("/", part(1), part(2), year, part(4), part(3)),
            F.concat(part(1), part(2), part(3), part(4), part(5)),
            F.upper(F.concat_ws("_", part(1), part(2), part(3))),
        ).alias("texts"),
        F.lit(False).alias("random"),
    )
    return random.unionByName(plain).select(F.explode("texts").alias("text"), "random")


def train(labelled: DataFrame, text_col: str = "text", random_col: str = "random") -> list[float]:
    """Log-likelihood ratio of each pair of printable characters, random over ordinary, add-one smoothed.

    The table's size is that of the alphabet squared whatever the sample, so it may go to the driver.
    """
    text = F.col(text_col)
    pairs = labelled.select(F.col(random_col).alias("r"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, 2))).alias("p"))
    pairs = pairs.where(F.length("p") == 2).groupBy("p").agg(F.count_if("r").alias("random"), F.count_if(~F.col("r")).alias("plain"))
    counts = {r["p"]: (r["random"], r["plain"]) for r in pairs.where(F.col("p").rlike("^[!-~]{2}$")).collect()}
    import math

    out = []
    for a in range(_CHARS):
        row = [counts.get(chr(_FIRST + a) + chr(_FIRST + b), (0, 0)) for b in range(_CHARS)]
        random, plain = (sum(x) + 64 * 0.5 for x in zip(*row, strict=True))
        out += [math.log((r + 0.5) / random) - math.log((p + 0.5) / plain) for r, p in row]
    return out


def _score(text: Column, ratios: list[float]) -> Column:
    """Mean ratio of the string's character pairs."""
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in ratios)), ",").cast("array<double>")  # folded to one literal
    code = lambda i: F.ascii(F.substring(text, i, 1)) - _FIRST
    total = F.aggregate(F.sequence(F.lit(1), F.length(text) - 1), F.lit(0.0), lambda acc, i: acc + F.element_at(table, code(i) * _CHARS + code(i + 1) + 1))
    return total / (F.length(text) - 1)


def _scanned(rows: DataFrame, ratios: list[float] | None, threshold: float) -> DataFrame:
    """``rows`` (row, text) with spans; ``row`` is whatever travels along, so its names can't clash."""
    ratios = train(samples(rows.sparkSession)) if ratios is None else ratios
    text = F.col("text")
    found = rows.select(
        "row",
        "text",
        F.filter(_where(text.rlike(ASSIGN), _spans(text, ASSIGN, 0)), lambda x: F.length(F.regexp_extract(x["found"], ASSIGN, 2)) >= ASSIGN_LEAST).alias("assign"),
        F.filter(_where(text.contains("AKIA"), _spans(text, ACCESS, 1)), lambda x: x["stop"] - x["start"] >= ACCESS_LEAST).alias("access"),
        # a run of hex digits is a whole match of HEX; those too short are not listed in the first place
        _where(text.rlike(f"[0-9a-f]{{{HEX_LEAST}}}"), _spans(text, f"[0-9a-f]{{{HEX_LEAST},}}+", 2)).alias("hex"),
        F.filter(_where(text.rlike(LONG), _spans(text, LONG, 3)), lambda x: x["found"].rlike("[0-9]") & x["found"].rlike("[A-Za-z]")).alias("long"),
    )
    base = found.select("row", "text", F.concat("assign", "access", "hex").alias("base"), "long")
    fresh = F.filter(
        "long",
        lambda x: ~F.exists("base", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])) & (_score(x["found"], ratios) > threshold),
    )
    return base.select("row", "text", F.array_sort(F.concat("base", fresh)).alias("spans"))


def scan(df: DataFrame, ratios: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, text, spans): spans array<struct<start, kind, stop, found>>, sorted, of every whole text.

    ``start`` and ``stop`` count code points, ``stop`` exclusive; ``kind`` is a place in KINDS. A null text is
    empty and has no spans; null ids and repeated rows are passed on. A random string that overlaps a base span
    is left to that span. No shuffle and no Python in the rows' way.
    """
    attach(df.sparkSession)
    own = id_and_text(df, id_col, text_col).select(F.col(id_col).alias("row"), F.col(text_col).alias("text"))
    return _scanned(own, ratios, threshold).select(F.col("row").alias(id_col), F.col("text").alias(text_col), "spans")


def redact(df: DataFrame, ratios: list[float] | None = None, text_col: str = "text", length_col: str | None = "n_chars", threshold: float = THRESHOLD, mask: str = "[SECRET]") -> DataFrame:
    """``df`` with every secret in ``text_col`` replaced by ``mask``; a changed row's ``length_col``, if there is one, is counted anew.

    Rows, their order of columns and all other values stay; a text without a secret stays as it is, null too.
    """
    attach(df.sparkSession)
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    masked = _scanned(own, ratios, threshold).select("row", F.when(F.size("spans") > 0, redacted(F.col("text"), F.col("spans"), mask)).alias("masked"))
    new = {text_col: F.col("masked")}
    if length_col in df.columns:
        new[length_col] = F.length("masked").cast(df.schema[length_col].dataType)
    value = lambda c: F.coalesce(new[c], F.col(f"row.`{c}`")) if c in new else F.col(f"row.`{c}`")
    return masked.select(*[value(c).alias(c) for c in df.columns])


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_random) of what scan() returns."""
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"], x["stop"])))
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return scanned.select(
        id_col,
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(listed(F.filter("spans", lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        n(3).alias("n_random"),
    )


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every stretch that spans cover replaced by ``mask``; spans sorted by start, overlaps are one stretch."""

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(done)
