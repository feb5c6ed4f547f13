"""Matrices, path pieces and colours as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ("a", "b", "c", "d", "tx", "ty")


def matrix(*values) -> Column:
    """struct<a, b, c, d, tx, ty> of doubles."""
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("double").alias(n) for n, v in zip(NAMES, values, strict=True)])


IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def translation(x, y) -> Column:
    return matrix(1.0, 0.0, 0.0, 1.0, x, y)


def scaling(x, y) -> Column:
    return matrix(x, 0.0, 0.0, y, 0.0, 0.0)


def rotation(degrees: Column) -> Column:
    from .numbers import cos, real, sin, value

    s, c = value(sin(real(degrees))), value(cos(real(degrees)))
    return matrix(c, s, -s, c, 0.0, 0.0)


def then(m: Column, n: Column) -> Column:
    """The matrix that applies m first and n after it."""
    return matrix(
        m["a"] * n["a"] + m["b"] * n["c"],
        m["a"] * n["b"] + m["b"] * n["d"],
        m["c"] * n["a"] + m["d"] * n["c"],
        m["c"] * n["b"] + m["d"] * n["d"],
        m["tx"] * n["a"] + m["ty"] * n["c"] + n["tx"],
        m["tx"] * n["b"] + m["ty"] * n["d"] + n["ty"],
    )


def determinant(m: Column) -> Column:
    return m["a"] * m["d"] - m["b"] * m["c"]


def inverse(m: Column) -> Column:
    """Null for a singular matrix."""
    d = F.nullif(determinant(m), F.lit(0.0))
    out = matrix(m["d"] / d, -m["b"] / d, -m["c"] / d, m["a"] / d, (m["c"] * m["ty"] - m["d"] * m["tx"]) / d, (m["b"] * m["tx"] - m["a"] * m["ty"]) / d)
    return F.when(d.isNotNull(), out)


def applied(m: Column, x: Column, y: Column, delta: bool = False) -> Column:
    """struct<x, y>; ``delta`` leaves the translation out."""
    move = (F.lit(0.0), F.lit(0.0)) if delta else (m["tx"], m["ty"])
    return F.struct((x * m["a"] + y * m["c"] + move[0]).alias("x"), (x * m["b"] + y * m["d"] + move[1]).alias("y"))


def product(matrices: Column) -> Column:
    """The product of an array of matrices: the last one is applied first, as successive concats do."""
    return F.aggregate(matrices, matrix(*IDENTITY), lambda acc, m: then(m, acc))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


# Weights of red, green and blue in a gray.
LUMINANCE = (0.3, 0.59, 0.11)


def rgb_to_gray(r: Column, g: Column, b: Column) -> Column:
    return LUMINANCE[0] * clamp(r) + LUMINANCE[1] * clamp(g) + LUMINANCE[2] * clamp(b)


def cmyk_to_gray(c: Column, m: Column, y: Column, k: Column) -> Column:
    ink = LUMINANCE[0] * clamp(c) + LUMINANCE[1] * clamp(m) + LUMINANCE[2] * clamp(y) + clamp(k)
    return 1.0 - F.least(F.lit(1.0), ink)


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    return F.struct(*[(1.0 - F.least(F.lit(1.0), clamp(x) + clamp(k))).alias(n) for n, x in zip("rgb", (c, m, y), strict=True)])


def rgb_to_cmyk(r: Column, g: Column, b: Column) -> Column:
    return F.struct(*[(1.0 - clamp(x)).alias(n) for n, x in zip("cmy", (r, g, b), strict=True)], F.lit(0.0).alias("k"))


def rgb_to_hsb(r: Column, g: Column, b: Column) -> Column:
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    spread = high - low
    sector = F.when(high == r, F.pmod((g - b) / spread, F.lit(6.0))).when(high == g, (b - r) / spread + 2.0).otherwise((r - g) / spread + 4.0)
    flat = spread == 0
    return F.struct(
        F.when(flat, F.lit(0.0)).otherwise(sector / 6.0).alias("h"),
        F.when(high == 0, F.lit(0.0)).otherwise(F.try_divide(spread, high)).alias("s"),
        high.alias("b"),
    )


def hsb_to_rgb(h: Column, s: Column, b: Column) -> Column:
    turn = F.pmod(clamp(h) * 6.0, F.lit(6.0))
    sector = F.floor(turn)
    part = turn - sector
    p, q, t = b * (1.0 - s), b * (1.0 - s * part), b * (1.0 - s * (1.0 - part))
    rows = {"r": (b, q, p, p, t, b), "g": (t, b, b, q, p, p), "b": (p, p, t, b, b, q)}
    pick = lambda values: F.element_at(F.array(*values), (sector + 1).cast("int"))
    return F.struct(*[pick(v).alias(n) for n, v in rows.items()])


def xyz_to_lab(x: Column, y: Column, z: Column, white: tuple[float, float, float]) -> Column:
    """struct<l, a, b> relative to a white point."""
    edge = 6.0 / 29.0

    def f(v: Column, w: float) -> Column:
        q = v / w
        return F.when(q > edge**3, F.cbrt(q)).otherwise(q / (3 * edge**2) + 4.0 / 29.0)

    fx, fy, fz = f(x, white[0]), f(y, white[1]), f(z, white[2])
    return F.struct(clamp(116.0 * fy - 16.0, 0.0, 100.0).alias("l"), clamp(500.0 * (fx - fy), -128.0, 127.0).alias("a"), clamp(200.0 * (fy - fz), -128.0, 127.0).alias("b"))


def arc_pieces(radius: Column, start: Column, stop: Column) -> Column:
    """array<struct<x0, y0, x1, y1, x2, y2, x3, y3>>: Béziers of at most a quarter turn each, counter-clockwise around the origin."""
    sweep = F.when(stop < start, stop + 360.0 * F.ceil((start - stop) / 360.0)).otherwise(stop) - start
    n = F.greatest(F.ceil(F.abs(sweep) / 90.0 - 1e-9), F.lit(1)).cast("int")
    step = F.radians(sweep / n)
    k = F.lit(4.0 / 3.0) * F.tan(step / 4.0)

    def piece(i: Column) -> Column:
        a0 = F.radians(start) + step * i
        a1 = a0 + step
        c0, s0, c1, s1 = F.cos(a0), F.sin(a0), F.cos(a1), F.sin(a1)
        values = (c0, s0, c0 - k * s0, s0 + k * c0, c1 + k * s1, s1 - k * c1, c1, s1)
        return F.struct(*[(radius * v).alias(name) for name, v in zip(("x0", "y0", "x1", "y1", "x2", "y2", "x3", "y3"), values, strict=True)])

    none = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double,x2:double,y2:double,x3:double,y3:double>>")
    return F.when(sweep == 0, none).otherwise(F.transform(F.sequence(F.lit(0), n - 1), piece))
