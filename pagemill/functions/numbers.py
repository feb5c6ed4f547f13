"""Numbers of the page language as Column expressions.

A number is a struct<i:int, r:float, error:string>: an integer, a real of single precision, or the name of the
error that computing it raised. Nothing throws: an error travels in the row, and an operand's error wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW, HIGH = -(1 << 31), (1 << 31) - 1
KIND = "struct<i:int,r:float,error:string>"


def _make(i: Column | None = None, r: Column | None = None, error: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct((none if i is None else i).cast("int").alias("i"), (none if r is None else r).cast("float").alias("r"), (none if error is None else error).cast("string").alias("error"))


def integer(c: Column) -> Column:
    """An integer, or a real where the value is beyond 32 bits."""
    wide = c.cast("bigint")
    return F.when(wide.between(LOW, HIGH), _make(i=wide)).otherwise(_make(r=wide.cast("float")))


def real(c: Column) -> Column:
    """A real; what isn't finite is an undefinedresult."""
    x = c.cast("float")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), failed("undefinedresult")).otherwise(_make(r=x))


def failed(name: str) -> Column:
    return _make(error=F.lit(name))


def is_int(n: Column) -> Column:
    return n["i"].isNotNull()


def value(n: Column) -> Column:
    """The number as a double, null for an error."""
    return F.coalesce(n["i"].cast("double"), n["r"].cast("double"))


def single(n: Column) -> Column:
    """The number in single precision."""
    return F.coalesce(n["i"].cast("float"), n["r"])


def _checked(out: Column, *operands: Column) -> Column:
    for n in reversed(operands):
        out = F.when(n["error"].isNotNull(), _make(error=n["error"])).otherwise(out)
    return out


def _both(a: Column, b: Column, whole, parted) -> Column:
    ints = integer(whole(a["i"].cast("bigint"), b["i"].cast("bigint")))
    return _checked(F.when(is_int(a) & is_int(b), ints).otherwise(real(parted(single(a), single(b)))), a, b)


def add(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: x + y, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: x - y, lambda x, y: x - y)


def mul(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: x * y, lambda x, y: x * y)


def div(a: Column, b: Column) -> Column:
    out = F.when(value(b) == 0, failed("undefinedresult")).otherwise(real(F.try_divide(single(a), single(b))))
    return _checked(out, a, b)


def _ints(a: Column, b: Column, out: Column) -> Column:
    return _checked(F.when(is_int(a) & is_int(b), out).otherwise(failed("typecheck")), a, b)


def idiv(a: Column, b: Column) -> Column:
    x, y = a["i"].cast("bigint"), b["i"].cast("bigint")
    bad = (y == 0) | ((x == LOW) & (y == -1))
    return _ints(a, b, F.when(bad, failed("undefinedresult")).otherwise(_make(i=F.call_function("div", x, F.when(y == 0, 1).otherwise(y)))))


def mod(a: Column, b: Column) -> Column:
    x, y = a["i"].cast("bigint"), b["i"].cast("bigint")
    return _ints(a, b, F.when(y == 0, failed("undefinedresult")).otherwise(_make(i=F.try_mod(x, y))))


def _one(n: Column, whole: Column, parted: Column) -> Column:
    return _checked(F.when(is_int(n), whole).otherwise(parted), n)


def neg(n: Column) -> Column:
    return _one(n, integer(-n["i"].cast("bigint")), real(-n["r"]))


def absolute(n: Column) -> Column:
    return _one(n, integer(F.abs(n["i"].cast("bigint"))), real(F.abs(n["r"])))


def ceiling(n: Column) -> Column:
    return _one(n, n, real(F.ceil(n["r"].cast("double")).cast("double")))


def floor(n: Column) -> Column:
    return _one(n, n, real(F.floor(n["r"].cast("double")).cast("double")))


def rounded(n: Column) -> Column:
    """Half goes to the greater neighbour."""
    return _one(n, n, real(F.floor((n["r"] + F.lit(0.5).cast("float")).cast("double")).cast("double")))


def truncate(n: Column) -> Column:
    x = n["r"].cast("double")
    return _one(n, n, real(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")))


def sqrt(n: Column) -> Column:
    return _checked(F.when(value(n) < 0, failed("rangecheck")).otherwise(real(F.sqrt(value(n)))), n)


def ln(n: Column) -> Column:
    return _checked(F.when(value(n) <= 0, failed("rangecheck")).otherwise(real(F.ln(value(n)))), n)


def log(n: Column) -> Column:
    return _checked(F.when(value(n) <= 0, failed("rangecheck")).otherwise(real(F.log10(value(n)))), n)


def exp(base: Column, power: Column) -> Column:
    return _checked(real(F.pow(value(base), value(power))), base, power)


def atan(num: Column, den: Column) -> Column:
    """Degrees in [0, 360)."""
    turn = F.degrees(F.atan2(value(num), value(den)))
    out = F.when((value(num) == 0) & (value(den) == 0), failed("undefinedresult")).otherwise(real(F.when(turn < 0, turn + 360).otherwise(turn)))
    return _checked(out, num, den)


def _turned(n: Column, function, exact: tuple[float, float, float, float]) -> Column:
    rest = F.pmod(value(n), F.lit(360.0))
    out = function(F.radians(rest))
    for angle, known in zip((0.0, 90.0, 180.0, 270.0), exact, strict=True):
        out = F.when(rest == angle, F.lit(known)).otherwise(out)
    return _checked(real(out), n)


def sin(n: Column) -> Column:
    return _turned(n, F.sin, (0.0, 1.0, 0.0, -1.0))


def cos(n: Column) -> Column:
    return _turned(n, F.cos, (1.0, 0.0, -1.0, 0.0))


def bit_and(a: Column, b: Column) -> Column:
    return _ints(a, b, _make(i=a["i"].bitwiseAND(b["i"])))


def bit_or(a: Column, b: Column) -> Column:
    return _ints(a, b, _make(i=a["i"].bitwiseOR(b["i"])))


def bit_xor(a: Column, b: Column) -> Column:
    return _ints(a, b, _make(i=a["i"].bitwiseXOR(b["i"])))


def bit_not(n: Column) -> Column:
    return _checked(F.when(is_int(n), _make(i=F.bitwise_not(n["i"]))).otherwise(failed("typecheck")), n)


def signed32(bits: Column) -> Column:
    """The low 32 bits of a bigint read as a signed number."""
    low = bits.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(low > HIGH, low - (1 << 32)).otherwise(low)


def bitshift(n: Column, shift: Column) -> Column:
    """Zeros come in from either side; a shift of 32 places or more leaves nothing."""
    bits, by = n["i"].cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)), shift["i"]
    left = F.call_function("shiftleft", bits, F.least(F.greatest(by, F.lit(0)), F.lit(31)))
    right = F.call_function("shiftrightunsigned", bits, F.least(F.greatest(-by, F.lit(0)), F.lit(31)))
    moved = F.when(by >= 0, left).otherwise(right)
    return _ints(n, shift, _make(i=F.when(F.abs(by) >= 32, F.lit(0)).otherwise(signed32(moved))))


def to_integer(n: Column) -> Column:
    """cvi: toward zero; beyond 32 bits is a rangecheck."""
    x = n["r"].cast("double")
    cut = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    return _one(n, n, F.when(cut.between(LOW, HIGH), _make(i=cut)).otherwise(failed("rangecheck")))


def to_real(n: Column) -> Column:
    return _checked(_make(r=single(n)), n)


def in_radix(n: Column, radix: int) -> Column:
    """cvrs for a radix other than 10: the 32-bit pattern, in upper case."""
    if not 2 <= radix <= 36 or radix == 10:
        raise ValueError("radix from 2 to 36, not 10")
    whole = to_integer(n)["i"].cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.conv(whole.cast("string"), 10, radix)


def compare(a: Column, b: Column, how: str) -> Column:
    x, y = value(a), value(b)
    return {"eq": x == y, "ne": x != y, "lt": x < y, "le": x <= y, "gt": x > y, "ge": x >= y}[how]


# Multiplier and increment of the generator's linear congruence.
MULTIPLIER, INCREMENT, MASK = 0x3A470C25, 0x1B4F2C63, 0x7FFFFFFF


def next_state(state: Column) -> Column:
    return (state.cast("bigint").bitwiseAND(F.lit(MASK)) * MULTIPLIER + INCREMENT).bitwiseAND(F.lit(MASK))


def drawn(state: Column) -> Column:
    """What rand gives for a state."""
    return state.bitwiseXOR(F.call_function("shiftrightunsigned", state, F.lit(15)))


def rand_sequence(seed: Column, n: int) -> Column:
    """The first n numbers after srand."""
    start = F.struct(seed.cast("bigint").bitwiseAND(F.lit(MASK)).alias("s"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        s = next_state(acc["s"])
        return F.struct(s.alias("s"), F.concat(acc["out"], F.array(drawn(s))).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, step, lambda acc: acc["out"])

