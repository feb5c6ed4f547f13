"""Objects of the page language and their text forms.

Integers, reals (floats held at single precision), booleans and null are Python values. Composite objects
refer to a Store, which sub-intervals share. A store remembers the save level at which it was last copied,
so that restore can bring its contents back.
"""

from __future__ import annotations

import math
import struct
from functools import lru_cache

import numpy as np

_SINGLE = struct.Struct("<f")
_pack, _unpack, _finite = _SINGLE.pack, _SINGLE.unpack, math.isfinite
UNLIMITED, READ_ONLY, EXECUTE_ONLY, NO_ACCESS = range(4)


class PSError(Exception):
    """A named error of the page language."""

    def __init__(self, name: str, command: object = None) -> None:
        super().__init__(name)
        self.name, self.command = name, command


def single(x: float) -> float:
    """x at single precision; what isn't finite is an undefinedresult."""
    try:
        y = _unpack(_pack(x))[0]
    except OverflowError:
        raise PSError("undefinedresult") from None
    if not _finite(y):
        raise PSError("undefinedresult")
    return y


class Mark:
    __slots__ = ()


MARK = Mark()


class Name:
    __slots__ = ("text", "x")

    def __init__(self, text: str, x: bool) -> None:
        self.text, self.x = text, x

    def __repr__(self) -> str:
        return self.text if self.x else "/" + self.text


@lru_cache(maxsize=65536)
def name(text: str, x: bool = False) -> Name:
    if len(text) > 127:
        raise PSError("limitcheck")
    return Name(text, x)


class Operator:
    __slots__ = ("text", "kinds", "run")

    def __init__(self, text: str, kinds: str | None, run) -> None:
        self.text, self.kinds, self.run = text, kinds, run


class Store:
    __slots__ = ("data", "shared", "born", "stamp", "access", "capacity")

    def __init__(self, data, shared: bool, serial: int, capacity: int = 0) -> None:
        self.data, self.shared, self.born, self.stamp, self.access, self.capacity = data, shared, serial, serial, UNLIMITED, capacity


class Composite:
    """An interval of a store."""

    __slots__ = ("store", "at", "n", "access", "x")

    def __init__(self, store: Store, at: int, n: int, access: int = UNLIMITED, x: bool = False) -> None:
        self.store, self.at, self.n, self.access, self.x = store, at, n, access, x

    def changed(self, **to):
        out = object.__new__(type(self))
        for k in type(self).__mro__[0].__slots__ or ():
            setattr(out, k, getattr(self, k))
        for k in ("store", "at", "n", "access", "x"):
            setattr(out, k, to.get(k, getattr(self, k)))
        return out

    def same(self, other) -> bool:
        return self.store is other.store and self.at == other.at and self.n == other.n


class Str(Composite):
    __slots__ = ()

    def bytes(self) -> bytes:
        return bytes(self.store.data[self.at : self.at + self.n])

    @property
    def text(self) -> str:
        return self.bytes().decode("latin-1")


class Arr(Composite):
    __slots__ = ("packed",)

    def __init__(self, store: Store, at: int, n: int, access: int = UNLIMITED, x: bool = False, packed: bool = False) -> None:
        super().__init__(store, at, n, access, x)
        self.packed = packed

    def items(self) -> list:
        return self.store.data[self.at : self.at + self.n]


class Dic(Composite):
    """A dictionary: key → (key as given, value), in order of insertion."""

    __slots__ = ()

    def get(self, key, default=None):
        hit = self.store.data.get(key_of(key))
        return default if hit is None else hit[1]

    def items(self):
        return list(self.store.data.values())


class File:
    """A byte stream: read from ``data``, or written to ``sink``. ``lazy`` makes the data when they are first asked for."""

    __slots__ = ("_data", "lazy", "at", "sink", "open", "label", "positions", "x", "access", "closing", "buffer")

    def __init__(self, data: bytes | None, sink=None, label: str = "", positions: bool = False, lazy=None) -> None:
        self._data, self.lazy, self.at, self.sink, self.open, self.label, self.positions = data, lazy, 0, sink, True, label, positions
        self.x, self.access, self.closing, self.buffer = False, UNLIMITED, None, bytearray()


    @property
    def data(self) -> bytes | None:
        if self.lazy is not None:
            make, self.lazy = self.lazy, None
            self._data = make()
        return self._data

    @property
    def reads(self) -> bool:
        return self.sink is None


class FileRef:
    """A file object with its own executable bit."""

    __slots__ = ("file", "x", "access")

    def __init__(self, file: File, x: bool = False, access: int = UNLIMITED) -> None:
        self.file, self.x, self.access = file, x, access


class Save:
    __slots__ = ("serial", "valid")

    def __init__(self, serial: int) -> None:
        self.serial, self.valid = serial, True


class FontID:
    __slots__ = ("number",)

    def __init__(self, number: int) -> None:
        self.number = number


def is_number(x) -> bool:
    return type(x) is int or type(x) is float


def key_of(x):
    """What a dictionary finds x by: strings are names, whole reals are integers."""
    kind = type(x)
    if kind is Name:
        return x.text
    if kind is int:
        return x
    if kind is float:
        return int(x) if x.is_integer() else x
    if kind is Str:
        return x.text
    if kind is bool:
        return ("bool", x)
    if x is None:
        raise PSError("typecheck")
    if isinstance(x, Composite):
        return (id(x.store), x.at, x.n)
    return ("object", x.text) if kind is Operator else ("object", id(x))


def equal(a, b) -> bool:
    if isinstance(a, (Name, Str)) and isinstance(b, (Name, Str)):
        return a.text == b.text
    if is_number(a) and is_number(b):
        return a == b
    if isinstance(a, Composite):
        return type(a) is type(b) and a.same(b)
    if type(a) is FileRef and type(b) is FileRef:
        return a.file is b.file
    return type(a) is type(b) and (a is b or type(a) is bool and a == b)


TYPES = {int: "integertype", float: "realtype", bool: "booleantype", type(None): "nulltype", Mark: "marktype", Name: "nametype", Operator: "operatortype", Str: "stringtype", Dic: "dicttype", FileRef: "filetype", Save: "savetype", FontID: "fonttype"}


def type_name(x) -> str:
    return ("packedarraytype" if x.packed else "arraytype") if type(x) is Arr else TYPES[type(x)]


def executable(x) -> bool:
    kind = type(x)
    return kind is Operator or kind in (Name, Str, Arr, FileRef) and x.x or kind is Dic and x.x


# -- text forms -----------------------------------------------------------------------------------


def _positional(x: float) -> str:
    """The shortest decimal that reads back as the same single, without an exponent."""
    return np.format_float_positional(np.float32(x), unique=True, trim="-")


def real_text(x: float) -> str:
    if x.is_integer() and abs(x) < 1e15:
        return f"{x:.1f}"
    return _positional(x)


@lru_cache(maxsize=1 << 16)
def canonical(x: float) -> str:
    """Number text of pages and documents: at most six significant digits, the seventh rounded half up, no exponent."""
    x = float(x)
    if x != x or x == 0:
        return "0"
    sign, digits = ("-" if x < 0 else ""), np.format_float_positional(np.float32(abs(x)), unique=True, trim="-")
    whole, _, part = digits.partition(".")
    all_ = (whole + part).lstrip("0")
    point = len(whole.lstrip("0")) if whole.strip("0") else -(len(part) - len(part.lstrip("0")))
    if len(all_) > 6:
        kept = str(int(all_[:6]) + (all_[6] >= "5"))
        point += len(kept) - 6
        all_ = kept
    all_ = all_.rstrip("0") or "0"
    if point <= 0:
        out = "0." + "0" * -point + all_
    elif len(all_) <= point:
        out = all_ + "0" * (point - len(all_))
    else:
        out = all_[:point] + "." + all_[point:]
    return "0" if out == "0" else sign + out


def plain_text(x) -> str:
    """The text that ``=`` writes and ``cvs`` gives."""
    kind = type(x)
    if kind is int:
        return str(x)
    if kind is float:
        return real_text(x)
    if kind is bool:
        return "true" if x else "false"
    if kind in (Name, Str, Operator):
        return x.text
    return "--nostringval--"


# Escapes of string syntax.
ESCAPES = {"(": "\\(", ")": "\\)", "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def escaped(text: str) -> str:
    return "".join(ESCAPES.get(c) or (c if " " <= c <= "~" else f"\\{ord(c):03o}") for c in text)


def syntax(x, depth: int = 0) -> str:
    """The text that ``==`` writes."""
    kind = type(x)
    if kind is Str:
        return "(" + escaped(x.text) + ")" if x.access < EXECUTE_ONLY else "-string-"
    if kind is Name:
        return repr(x)
    if kind is Operator:
        return f"--{x.text}--"
    if kind is Arr:
        if x.access >= EXECUTE_ONLY or depth >= 64:
            return "-packedarray-" if x.packed else "-array-"
        inner = " ".join(syntax(y, depth + 1) for y in x.items())
        return "{" + inner + "}" if x.x else "[" + inner + "]"
    if x is None:
        return "null"
    if kind in (int, float, bool):
        return plain_text(x)
    return {Mark: "-mark-", Dic: "-dict-", FileRef: "-file-", Save: "-save-", FontID: "-fontid-"}[kind]
