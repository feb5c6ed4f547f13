"""Operand stacks, arrays, strings and dictionaries as Column expressions over arrays.

A stack is an array whose last element is on top. A dictionary is an array of struct<k, v> in the order of
insertion. Positions count from 0, as in the page language. An index out of range gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def pop(stack: Column) -> Column:
    return F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))


def dup(stack: Column) -> Column:
    return F.concat(stack, F.slice(stack, F.lit(-1), F.lit(1)))


def exch(stack: Column) -> Column:
    return roll(stack, 2, 1)


def index(stack: Column, n) -> Column:
    return F.get(stack, F.size(stack) - 1 - _lit(n))


def copy(stack: Column, n) -> Column:
    return F.concat(stack, top(stack, n))


def top(stack: Column, n) -> Column:
    """The n topmost elements, all of them if there are fewer."""
    n = F.least(_lit(n), F.size(stack))
    return F.slice(stack, F.size(stack) - n + 1, n)


def below(stack: Column, n) -> Column:
    """What lies under the n topmost elements."""
    return F.slice(stack, F.lit(1), F.greatest(F.size(stack) - _lit(n), F.lit(0)))


def roll(stack: Column, n: int, j) -> Column:
    """The n topmost elements turned by j places upward; the stack itself if it has fewer."""
    group = top(stack, n)
    by = F.pmod(_lit(j), F.lit(n))
    turned = F.concat(F.slice(group, F.lit(n) - by + 1, by), F.slice(group, F.lit(1), F.lit(n) - by))
    return F.when(F.size(stack) < n, stack).otherwise(F.concat(below(stack, n), turned))


def count_to_mark(stack: Column, mark) -> Column:
    """Elements above the topmost mark, null without one."""
    at = F.array_position(F.reverse(stack), _lit(mark))
    return F.when(at > 0, (at - 1).cast("int"))


def clear_to_mark(stack: Column, mark) -> Column:
    return below(stack, count_to_mark(stack, mark) + 1)


def get_interval(array: Column, start, n) -> Column:
    """n elements from ``start``, null if the interval leaves the array."""
    start, n = _lit(start), _lit(n)
    inside = (start >= 0) & (n >= 0) & (start + n <= F.size(array))
    return F.when(inside, F.slice(array, F.greatest(start, F.lit(0)) + 1, F.greatest(n, F.lit(0))))


def put_interval(array: Column, start, part: Column) -> Column:
    start = _lit(start)
    inside = (start >= 0) & (start + F.size(part) <= F.size(array))
    after = F.slice(array, F.greatest(start, F.lit(0)) + F.size(part) + 1, F.size(array))
    return F.when(inside, F.concat(F.slice(array, F.lit(1), F.greatest(start, F.lit(0))), part, after))


def string_interval(text: Column, start, n) -> Column:
    start, n = _lit(start), _lit(n)
    inside = (start >= 0) & (n >= 0) & (start + n <= F.length(text))
    return F.when(inside, F.substring(text, start + 1, n))


def search(text: Column, seek) -> Column:
    """struct<found, pre, match, post>; without a hit pre is the whole text."""
    seek = _lit(seek)
    at = F.call_function("instr", text, seek)
    hit = at > 0
    return F.struct(
        hit.alias("found"),
        F.when(hit, F.substring(text, F.lit(1), at - 1)).otherwise(text).alias("pre"),
        F.when(hit, seek).alias("match"),
        F.when(hit, F.substring(text, at + F.length(seek), F.length(text))).alias("post"),
    )


def anchor_search(text: Column, seek) -> Column:
    """struct<found, match, post>; without a hit post is the whole text."""
    seek = _lit(seek)
    hit = F.startswith(text, seek)
    return F.struct(hit.alias("found"), F.when(hit, seek).alias("match"), F.when(hit, F.substring(text, F.length(seek) + 1, F.length(text))).otherwise(text).alias("post"))


def put(entries: Column, key, value) -> Column:
    """The dictionary with key set: in its place if it is there, else at the end."""
    key, value = _lit(key), _lit(value)
    entry = F.struct(key.alias("k"), value.alias("v"))
    there = F.exists(entries, lambda e: e["k"] == key)
    return F.when(there, F.transform(entries, lambda e: F.when(e["k"] == key, entry).otherwise(e))).otherwise(F.concat(entries, F.array(entry)))


def known(entries: Column, key) -> Column:
    return F.exists(entries, lambda e: e["k"] == _lit(key))


def get(entries: Column, key) -> Column:
    return F.get(F.filter(entries, lambda e: e["k"] == _lit(key)), F.lit(0))["v"]


def undef(entries: Column, key) -> Column:
    return F.filter(entries, lambda e: e["k"] != _lit(key))


def from_pairs(entries: Column) -> Column:
    """Entries in order of first insertion with the last value of each key."""
    empty = F.slice(entries, F.lit(1), F.lit(0))
    return F.aggregate(entries, empty, lambda acc, e: put(acc, e["k"], e["v"]))
