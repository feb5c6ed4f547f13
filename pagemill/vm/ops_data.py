"""Operators on the operand stack, numbers, arrays, strings, types, dictionaries, control, memory and random numbers."""

from __future__ import annotations

import math

from ..functions.numbers import INCREMENT, MASK, MULTIPLIER
from . import scanner
from .interp import DICTIONARIES, OPERANDS, OPERATORS, Exit, Interp, Quit, Stop, operator
from .objects import EXECUTE_ONLY, MARK, NO_ACCESS, READ_ONLY, TYPES, UNLIMITED, Arr, Composite, Dic, File, FileRef, Name, Operator, PSError, Save, Str, equal, executable, is_number, key_of, name, plain_text, single, type_name

LOW, HIGH = -(1 << 31), (1 << 31) - 1


# -- operand stack --------------------------------------------------------------------------------


@operator("pop", "x")
def _(vm, a):
    pass


@operator("dup", "x")
def _(vm, a):
    vm.push(a, a)


@operator("exch", "xx")
def _(vm, a, b):
    vm.push(b, a)


@operator("copy", "x")
def _(vm, n):
    if type(n) is int:
        if n < 0:
            raise PSError("rangecheck")
        if n > len(vm.ostack):
            raise PSError("stackunderflow")
        vm.push(*vm.ostack[len(vm.ostack) - n :])
        return
    src = vm.pop()
    if type(src) is not type(n) or not isinstance(n, Composite):
        raise PSError("typecheck")
    _readable(src)
    _writable(n)
    if type(n) is Dic:
        for key, value in src.items():
            vm.define(n, key, value)
        vm.push(n)
        return
    if src.n > n.n:
        raise PSError("rangecheck")
    items = src.store.data[src.at : src.at + src.n]
    if type(n) is Arr:
        for y in items:
            vm.may_hold(n.store.shared, y)
    vm.touch(n.store)
    n.store.data[n.at : n.at + src.n] = items
    vm.push(n.changed(n=src.n))


@operator("index", "i")
def _(vm, n):
    if n < 0:
        raise PSError("rangecheck")
    if n >= len(vm.ostack):
        raise PSError("stackunderflow")
    vm.push(vm.ostack[-1 - n])


@operator("roll", "ii")
def _(vm, n, j):
    if n < 0:
        raise PSError("rangecheck")
    if n > len(vm.ostack):
        raise PSError("stackunderflow")
    if n:
        j %= n
        top = vm.ostack[-n:]
        vm.ostack[-n:] = top[n - j :] + top[: n - j]


@operator("clear")
def _(vm):
    vm.ostack.clear()


@operator("count")
def _(vm):
    vm.push(len(vm.ostack))


for _text in ("mark", "[", "<<"):
    operator(_text)(lambda vm: vm.push(MARK))


@operator("cleartomark")
def _(vm):
    vm.to_mark()


@operator("counttomark")
def _(vm):
    for i, x in enumerate(reversed(vm.ostack)):
        if x is MARK:
            vm.push(i)
            return
    raise PSError("unmatchedmark")


# -- arithmetic -----------------------------------------------------------------------------------


def whole(x: int):
    return x if LOW <= x <= HIGH else single(float(x))


def _two(text: str, ints, reals) -> None:
    @operator(text, "nn")
    def run(vm, a, b):
        vm.push(whole(ints(a, b)) if type(a) is int and type(b) is int else single(reals(single(a), single(b))))


_two("add", lambda a, b: a + b, lambda a, b: a + b)
_two("sub", lambda a, b: a - b, lambda a, b: a - b)
_two("mul", lambda a, b: a * b, lambda a, b: a * b)


@operator("div", "nn")
def _(vm, a, b):
    if b == 0:
        raise PSError("undefinedresult")
    vm.push(single(single(a) / single(b)))


@operator("idiv", "ii")
def _(vm, a, b):
    if b == 0 or a == LOW and b == -1:
        raise PSError("undefinedresult")
    q = abs(a) // abs(b)
    vm.push(q if (a < 0) == (b < 0) else -q)


@operator("mod", "ii")
def _(vm, a, b):
    if b == 0:
        raise PSError("undefinedresult")
    vm.push(int(math.fmod(a, b)))


def _one(text: str, ints, reals) -> None:
    @operator(text, "n")
    def run(vm, a):
        vm.push(whole(ints(a)) if type(a) is int else single(reals(a)))


_one("neg", lambda a: -a, lambda a: -a)
_one("abs", abs, abs)
_one("ceiling", lambda a: a, lambda a: float(math.ceil(a)))
_one("floor", lambda a: a, lambda a: float(math.floor(a)))
_one("round", lambda a: a, lambda a: float(math.floor(single(a + 0.5))))
_one("truncate", lambda a: a, lambda a: float(math.trunc(a)))


@operator("sqrt", "n")
def _(vm, a):
    if a < 0:
        raise PSError("rangecheck")
    vm.push(single(math.sqrt(a)))


@operator("atan", "nn")
def _(vm, a, b):
    if a == 0 and b == 0:
        raise PSError("undefinedresult")
    turn = math.degrees(math.atan2(a, b))
    turn = single(turn + 360 if turn < 0 else turn)
    vm.push(0.0 if turn == 360 else turn)


def turned(degrees: float) -> tuple[float, float]:
    """(sine, cosine), exact at quarter turns."""
    rest = math.fmod(degrees, 360.0)
    rest += 360.0 if rest < 0 else 0.0
    quarter = {0.0: (0.0, 1.0), 90.0: (1.0, 0.0), 180.0: (0.0, -1.0), 270.0: (-1.0, 0.0)}.get(rest)
    return quarter or (math.sin(math.radians(rest)), math.cos(math.radians(rest)))


operator("sin", "n")(lambda vm, a: vm.push(single(turned(a)[0])))
operator("cos", "n")(lambda vm, a: vm.push(single(turned(a)[1])))


@operator("exp", "nn")
def _(vm, a, b):
    try:
        out = math.pow(a, b)
    except (ValueError, OverflowError, ZeroDivisionError):
        raise PSError("undefinedresult") from None
    vm.push(single(out))


def _log(text: str, function) -> None:
    @operator(text, "n")
    def run(vm, a):
        if a <= 0:
            raise PSError("rangecheck")
        vm.push(single(function(a)))


_log("ln", math.log)
_log("log", math.log10)

operator("eq", "xx")(lambda vm, a, b: vm.push(_same(a, b)))
operator("ne", "xx")(lambda vm, a, b: vm.push(not _same(a, b)))


def _same(a, b) -> bool:
    for x in (a, b):
        if type(x) is Str and x.access >= EXECUTE_ONLY:
            raise PSError("invalidaccess")
    return equal(a, b)


def _order(text: str, function) -> None:
    @operator(text, "xx")
    def run(vm, a, b):
        if is_number(a) and is_number(b):
            vm.push(function(a, b))
        elif type(a) is Str and type(b) is Str:
            _readable(a)
            _readable(b)
            vm.push(function(a.bytes(), b.bytes()))
        else:
            raise PSError("typecheck")


_order("gt", lambda a, b: a > b)
_order("ge", lambda a, b: a >= b)
_order("lt", lambda a, b: a < b)
_order("le", lambda a, b: a <= b)


def _logic(text: str, function) -> None:
    @operator(text, "xx")
    def run(vm, a, b):
        if type(a) is not type(b) or type(a) not in (bool, int):
            raise PSError("typecheck")
        vm.push(function(a, b))


_logic("and", lambda a, b: a & b)
_logic("or", lambda a, b: a | b)
_logic("xor", lambda a, b: a ^ b)


@operator("not", "x")
def _(vm, a):
    if type(a) not in (bool, int):
        raise PSError("typecheck")
    vm.push(not a if type(a) is bool else ~a)


@operator("bitshift", "ii")
def _(vm, a, n):
    bits = a & 0xFFFFFFFF
    bits = 0 if abs(n) >= 32 else (bits << n if n >= 0 else bits >> -n) & 0xFFFFFFFF
    vm.push(bits - (1 << 32) if bits >> 31 else bits)


# -- arrays and strings ---------------------------------------------------------------------------


def _readable(x) -> None:
    if (x.store.access if type(x) is Dic else x.access) > READ_ONLY:
        raise PSError("invalidaccess")


def _writable(x) -> None:
    if (x.store.access if type(x) is Dic else x.access) != UNLIMITED:
        raise PSError("invalidaccess")


@operator("array", "i")
def _(vm, n):
    if n < 0:
        raise PSError("rangecheck")
    if n > 1 << 20:
        raise PSError("limitcheck")
    vm.push(vm.array([None] * n))


@operator("]")
def _(vm):
    vm.push(vm.array(vm.to_mark()))


@operator("astore", "a")
def _(vm, a):
    _writable(a)
    if len(vm.ostack) < a.n:
        raise PSError("stackunderflow")
    items = vm.ostack[len(vm.ostack) - a.n :]
    for y in items:
        vm.may_hold(a.store.shared, y)
    vm.touch(a.store)
    a.store.data[a.at : a.at + a.n] = items
    del vm.ostack[len(vm.ostack) - a.n :]
    vm.push(a)


@operator("aload", "a")
def _(vm, a):
    _readable(a)
    vm.push(*a.items(), a)


@operator("getinterval", "xii")
def _(vm, a, i, n):
    if type(a) not in (Arr, Str):
        raise PSError("typecheck")
    _readable(a)
    if i < 0 or n < 0 or i + n > a.n:
        raise PSError("rangecheck")
    vm.push(a.changed(at=a.at + i, n=n))


@operator("putinterval", "xix")
def _(vm, a, i, b):
    if type(a) not in (Arr, Str) or type(b) is not type(a):
        raise PSError("typecheck")
    _writable(a)
    _readable(b)
    if i < 0 or i + b.n > a.n:
        raise PSError("rangecheck")
    items = b.store.data[b.at : b.at + b.n]
    if type(a) is Arr:
        for y in items:
            vm.may_hold(a.store.shared, y)
    vm.touch(a.store)
    a.store.data[a.at + i : a.at + i + b.n] = items


@operator("forall", "xa")
def _(vm, a, proc):
    if not isinstance(a, Composite):
        raise PSError("typecheck")
    _readable(a)

    def body():
        if type(a) is Dic:
            for k in list(a.store.data):
                if k in a.store.data:
                    vm.push(*a.store.data[k])
                    vm.run(proc)
        else:
            for i in range(a.n):
                vm.push(a.store.data[a.at + i])
                vm.run(proc)

    vm.loop(body)


@operator("string", "i")
def _(vm, n):
    if n < 0:
        raise PSError("rangecheck")
    if n > 65535:
        raise PSError("limitcheck")
    vm.push(vm.string(bytes(n)))


def _found(vm, text: Str, at: int, n: int, with_pre: bool) -> None:
    vm.push(text.changed(at=text.at + at + n, n=text.n - at - n), text.changed(at=text.at + at, n=n))
    if with_pre:
        vm.push(text.changed(n=at))
    vm.push(True)


@operator("search", "ss")
def _(vm, text, seek):
    _readable(text)
    _readable(seek)
    at = text.bytes().find(seek.bytes())
    if at < 0:
        vm.push(text, False)
    else:
        _found(vm, text, at, seek.n, True)


@operator("anchorsearch", "ss")
def _(vm, text, seek):
    _readable(text)
    _readable(seek)
    if text.bytes().startswith(seek.bytes()):
        _found(vm, text, 0, seek.n, False)
    else:
        vm.push(text, False)


@operator("packedarray", "i")
def _(vm, n):
    if n < 0:
        raise PSError("rangecheck")
    if n > len(vm.ostack):
        raise PSError("stackunderflow")
    items = vm.ostack[len(vm.ostack) - n :]
    del vm.ostack[len(vm.ostack) - n :]
    vm.push(vm.array(items, packed=True))


@operator("setpacking", "b")
def _(vm, on):
    vm.packing = on


operator("currentpacking")(lambda vm: vm.push(vm.packing))


# -- types and conversion -------------------------------------------------------------------------

operator("type", "x")(lambda vm, a: vm.push(name(type_name(a), True)))


def _with_x(a, x: bool):
    if type(a) is Name:
        return name(a.text, x)
    if isinstance(a, Composite):
        return a.changed(x=x)
    if type(a) is FileRef:
        return FileRef(a.file, x, a.access)
    return a


operator("cvlit", "x")(lambda vm, a: vm.push(_with_x(a, False)))
operator("cvx", "x")(lambda vm, a: vm.push(_with_x(a, True)))
operator("xcheck", "x")(lambda vm, a: vm.push(executable(a) or type(a) is Operator))


def _limit(text: str, level: int) -> None:
    @operator(text, "x")
    def run(vm, a):
        if type(a) is Dic:
            if level == EXECUTE_ONLY:
                raise PSError("typecheck")
            vm.touch(a.store)
            a.store.access = max(a.store.access, level)
            vm.push(a)
        elif isinstance(a, Composite):
            vm.push(a.changed(access=max(a.access, level)))
        elif type(a) is FileRef:
            vm.push(FileRef(a.file, a.x, max(a.access, level)))
        else:
            raise PSError("typecheck")


_limit("executeonly", EXECUTE_ONLY)
_limit("readonly", READ_ONLY)
_limit("noaccess", NO_ACCESS)


def _access(a) -> int:
    if type(a) is Dic:
        return a.store.access
    if isinstance(a, Composite) or type(a) is FileRef:
        return a.access
    raise PSError("typecheck")


operator("rcheck", "x")(lambda vm, a: vm.push(_access(a) <= READ_ONLY))
operator("wcheck", "x")(lambda vm, a: vm.push(_access(a) == UNLIMITED))


def _number(a):
    if is_number(a):
        return a
    if type(a) is not Str:
        raise PSError("typecheck")
    _readable(a)
    found, _ = scanner.token(a.bytes(), 0)
    if found is scanner.END or found[0] != "number":
        raise PSError("syntaxerror" if found is scanner.END else "typecheck")
    return found[1]


@operator("cvi", "x")
def _(vm, a):
    n = _number(a)
    n = math.trunc(n)
    if not LOW <= n <= HIGH:
        raise PSError("rangecheck")
    vm.push(n)


operator("cvr", "x")(lambda vm, a: vm.push(single(float(_number(a)))))


@operator("cvn", "s")
def _(vm, s):
    _readable(s)
    vm.push(name(s.text, s.x))


def fill(vm, into: Str, data: bytes) -> Str:
    """The start of a string, overwritten with data."""
    _writable(into)
    if len(data) > into.n:
        raise PSError("rangecheck")
    vm.touch(into.store)
    into.store.data[into.at : into.at + len(data)] = data
    return into.changed(n=len(data))


operator("cvs", "xs")(lambda vm, a, s: vm.push(fill(vm, s, plain_text(a).encode("latin-1", "replace"))))
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@operator("cvrs", "nis")
def _(vm, a, radix, s):
    if not 2 <= radix <= 36:
        raise PSError("rangecheck")
    if radix == 10:
        text = plain_text(a)
    else:
        n = math.trunc(a)
        if not LOW <= n <= HIGH:
            raise PSError("rangecheck")
        n &= 0xFFFFFFFF
        text = "" if n else "0"
        while n:
            n, rest = divmod(n, radix)
            text = _DIGITS[rest] + text
    vm.push(fill(vm, s, text.encode()))


# -- dictionaries ---------------------------------------------------------------------------------


@operator("dict", "i")
def _(vm, n):
    if n < 0:
        raise PSError("rangecheck")
    vm.push(vm.dictionary(n))


@operator("begin", "d")
def _(vm, d):
    if len(vm.dstack) >= DICTIONARIES:
        raise PSError("dictstackoverflow")
    _readable(d)
    vm.dstack.append(d)


@operator("end")
def _(vm):
    if len(vm.dstack) <= vm.floor:
        raise PSError("dictstackunderflow")
    vm.dstack.pop()


@operator("def", "xx")
def _(vm, k, v):
    _writable(vm.dstack[-1])
    vm.define(vm.dstack[-1], k, v)


operator("load", "x")(lambda vm, k: vm.push(vm.lookup(k)))


@operator("store", "xx")
def _(vm, k, v):
    into = vm.where(k) or vm.dstack[-1]
    _writable(into)
    vm.define(into, k, v)


@operator("known", "dx")
def _(vm, d, k):
    _readable(d)
    vm.push(key_of(k) in d.store.data)


@operator("where", "x")
def _(vm, k):
    d = vm.where(k)
    if d is None:
        vm.push(False)
    else:
        vm.push(d, True)


@operator("get", "xx")
def _(vm, a, k):
    if not isinstance(a, Composite):
        raise PSError("typecheck")
    _readable(a)
    if type(a) is Dic:
        hit = a.store.data.get(key_of(k))
        if hit is None:
            raise PSError("undefined")
        vm.push(hit[1])
        return
    if type(k) is not int:
        raise PSError("typecheck")
    if not 0 <= k < a.n:
        raise PSError("rangecheck")
    vm.push(a.store.data[a.at + k])


@operator("put", "xxx")
def _(vm, a, k, v):
    if not isinstance(a, Composite):
        raise PSError("typecheck")
    _writable(a)
    if type(a) is Dic:
        vm.define(a, k, v)
        return
    if type(k) is not int or type(a) is Str and type(v) is not int:
        raise PSError("typecheck")
    if not 0 <= k < a.n or type(a) is Str and not 0 <= v <= 255:
        raise PSError("rangecheck")
    vm.may_hold(a.store.shared, v)
    vm.touch(a.store)
    a.store.data[a.at + k] = v


@operator("undef", "dx")
def _(vm, d, k):
    _writable(d)
    vm.touch(d.store)
    d.store.data.pop(key_of(k), None)


@operator("length", "x")
def _(vm, a):
    if type(a) is Name:
        vm.push(len(a.text))
    elif type(a) is Dic:
        _readable(a)
        vm.push(len(a.store.data))
    elif isinstance(a, Composite):
        _readable(a)
        vm.push(a.n)
    else:
        raise PSError("typecheck")


operator("maxlength", "d")(lambda vm, d: vm.push(max(d.store.capacity, len(d.store.data))))
operator("currentdict")(lambda vm: vm.push(vm.dstack[-1]))
operator("countdictstack")(lambda vm: vm.push(len(vm.dstack)))


def _listed(vm, a: Arr, items: list) -> None:
    _writable(a)
    if len(items) > a.n:
        raise PSError("rangecheck")
    vm.touch(a.store)
    a.store.data[a.at : a.at + len(items)] = items
    vm.push(a.changed(n=len(items)))


operator("dictstack", "a")(lambda vm, a: _listed(vm, a, list(vm.dstack)))


@operator("cleardictstack")
def _(vm):
    del vm.dstack[vm.floor :]


@operator(">>")
def _(vm):
    items = vm.to_mark()
    if len(items) % 2:
        raise PSError("rangecheck")
    d = vm.dictionary(len(items) // 2)
    for k, v in zip(items[::2], items[1::2], strict=True):
        vm.define(d, k, v)
    vm.push(d)


@operator("bind", "a")
def _(vm, a):
    seen = set()

    def bound(p: Arr) -> None:
        if p.access != UNLIMITED and not p.packed or id(p.store) in seen:
            return
        seen.add(id(p.store))
        vm.touch(p.store)
        for i in range(p.at, p.at + p.n):
            x = p.store.data[i]
            if type(x) is Name and x.x:
                try:
                    value = vm.lookup(x)
                except PSError:
                    continue
                if type(value) is Operator:
                    p.store.data[i] = value
            elif type(x) is Arr and x.x:
                bound(x)

    bound(a)
    vm.push(a)


# -- control --------------------------------------------------------------------------------------

operator("exec", "x")(lambda vm, a: vm.run(a))


@operator("if", "ba")
def _(vm, test, proc):
    if test:
        vm.run(proc)


@operator("ifelse", "baa")
def _(vm, test, yes, no):
    vm.run(yes if test else no)


@operator("for", "nnna")
def _(vm, x, step, limit, proc):
    ints = type(x) is int and type(step) is int and type(limit) is int
    if not ints:
        x, step, limit = single(float(x)), single(float(step)), single(float(limit))

    def body(x=x):
        while x <= limit if step >= 0 else x >= limit:
            vm.push(x)
            vm.run(proc)
            vm.step()
            x = x + step
            if ints:
                if not LOW <= x <= HIGH:
                    return
            else:
                try:
                    x = single(x)
                except PSError:
                    return

    vm.loop(body)


#: Rounds of a loop that are run before it is looked at; the number doubles each time.
LOOK = 16


def _round(vm, items):
    """What a round does to the operands, if it is linear: (deepest operand used, operands after it, conditions, most operands at once).

    A value is (operand or None, number): the operand that lies there before the round, counted from the top, plus a number.
    A condition (value, at most) has to hold for the round to go as said. None if the round may do anything else.
    """
    known = {id(OPERATORS[x]): x for x in ("add", "sub", "dup", "pop", "exch", "eq", "ge", "gt", "le", "lt", "if")}
    stack, deepest, most, conditions = [], 0, 0, []

    def pop():
        nonlocal deepest
        if stack:
            return stack.pop()
        deepest += 1
        return (deepest, 0)

    def number(v):
        return type(v) is tuple and v[0] != "test" and (v[0] is None or v[0] <= len(vm.ostack) and type(vm.ostack[-v[0]]) is int)

    for i, x in enumerate(items):
        if type(x) is int:
            stack.append((None, x))
        elif type(x) is Arr and x.x and x.n == 1 and i + 1 < len(items):
            stack.append(x)
        elif type(x) is Name and x.x or type(x) is Operator:
            try:
                text = known.get(id(x if type(x) is Operator else vm.lookup(x)))
            except PSError:
                return None
            if text is None:
                return None
            a = pop()
            if text == "pop":
                pass
            elif text == "dup":
                stack += [a, a]
            elif text == "if":
                test = pop()
                if type(a) is not Arr or type(test) is not tuple or test[0] != "test":
                    return None
                conditions += test[1]
            else:
                b = pop()
                if text == "exch":
                    stack += [a, b]
                elif not number(a) or not number(b):
                    return None
                elif text in ("add", "sub"):
                    sign = 1 if text == "add" else -1
                    if a[0] is not None and (sign < 0 or b[0] is not None):
                        return None
                    value = (b[0] if a[0] is None else a[0], b[1] + sign * a[1])
                    conditions += [(value, 1, HIGH), (value, -1, -LOW)]
                    stack.append(value)
                else:
                    # b test a is false; differences of two operands that move alike would do as well, but aren't looked for
                    if a[0] is not None and b[0] is not None:
                        return None
                    value, sign, other = (b, 1, a[1]) if a[0] is None else (a, -1, b[1])
                    if text == "eq":  # while it is on the side where it is now
                        now = value[1] + (0 if value[0] is None else vm.ostack[-value[0]])
                        if now == other:
                            return None
                        below = now < other
                        stack.append(("test", [(value, 1, other - 1) if below else (value, -1, -other - 1)]))
                    else:
                        less = (text in ("ge", "gt")) == (sign > 0)  # what keeps it false: value less than the other, or more
                        strict = text in ("ge", "le")
                        stack.append(("test", [(value, 1, other - strict) if less else (value, -1, -other - strict)]))
        else:
            return None
        most = max(most, len(stack) - deepest)
    return deepest, stack, conditions, most


def ahead(vm, proc, rounds: int | None = None) -> int:
    """Goes through as many rounds of a loop at once as are sure to do the same thing: numbers that grow by as much in each round.

    Steps are counted as if each round had been run. Gives the number of rounds, at most ``rounds`` and what the budget allows; the rest is to be run.
    """
    if type(proc) is not Arr or not proc.x:
        return 0
    items = proc.items()
    cost = 1 + len(items)
    if vm.budget is not None:
        left = (vm.budget - vm.steps) // cost
        rounds = left if rounds is None else min(rounds, left)
    found = _round(vm, items) if rounds is not None and rounds > 0 else None
    if found is None:
        return 0
    deepest, after, conditions, most = found
    operands = vm.ostack
    if len(after) != deepest or deepest > len(operands) or len(operands) + most > OPERANDS:
        return 0
    grows = {}
    for i, v in enumerate(after):
        k = deepest - i
        if type(v) is not tuple or v[0] != k:
            return 0
        grows[k] = v[1]
    for (k, plus), sign, limit in conditions:
        value, grow = (sign * plus, 0) if k is None else (sign * (operands[-k] + plus), sign * grows[k])
        if value > limit:
            return 0
        if grow > 0:
            rounds = min(rounds, (limit - value) // grow + 1)
    for k, grow in grows.items():
        if grow:
            operands[-k] += grow * rounds
    vm.steps += cost * rounds
    return rounds


@operator("repeat", "ia")
def _(vm, n, proc):
    if n < 0:
        raise PSError("rangecheck")

    def body():
        done, look = 0, LOOK
        while done < n:
            vm.run(proc)
            done += 1
            if done >= look:
                look *= 2
                done += ahead(vm, proc, n - done)

    vm.loop(body)


@operator("loop", "a")
def _(vm, proc):
    def body():
        done, look = 0, LOOK
        while True:
            vm.run(proc)
            done += 1
            if done >= look:
                look *= 2
                ahead(vm, proc)

    vm.loop(body)


@operator("exit")
def _(vm):
    if not vm.loops:
        raise PSError("invalidexit")
    raise Exit


@operator("stop")
def _(vm):
    raise Stop


@operator("stopped", "x")
def _(vm, a):
    loops, vm.loops = vm.loops, 0
    vm.hidden = getattr(vm, "hidden", 0) + loops
    try:
        done = vm.stopped(a)
    finally:
        vm.loops = loops
        vm.hidden -= loops
    vm.push(done)


operator("countexecstack")(lambda vm: vm.push(len(vm.estack)))
operator("execstack", "a")(lambda vm, a: _listed(vm, a, list(vm.estack)))


@operator("quit")
def _(vm):
    raise Quit


@operator("handleerror")
def _(vm):
    handler = vm.errors.get(name("handleerror"))
    if handler is not None:
        vm.run(handler)


# -- memory and the job server --------------------------------------------------------------------

operator("save")(lambda vm: vm.push(vm.save()))


@operator("restore", "x")
def _(vm, s):
    if type(s) is not Save:
        raise PSError("typecheck")
    vm.restore(s)


@operator("setglobal", "b")
def _(vm, on):
    vm.shared = on


operator("currentglobal")(lambda vm: vm.push(vm.shared))
operator("vmstatus")(lambda vm: vm.push(len(vm.saves), 0, 1 << 30))
operator("gcheck", "x")(lambda vm, a: vm.push(not isinstance(a, Composite) or a.store.shared))


@operator("startjob", "bx")
def _(vm, lasting, password):
    vm.push(bool(_password(password)) and not vm.saves)


def _password(x) -> bool:
    if type(x) not in (int, Str):
        raise PSError("typecheck")
    return x == 0 if type(x) is int else x.text in ("", "0")


@operator("exitserver", "x")
def _(vm, password):
    if not _password(password):
        raise PSError("invalidaccess")
    vm.ostack.clear()
    del vm.dstack[vm.floor :]


operator("framedevice", "aiia")(lambda vm, *_: None)


# -- random numbers and clocks --------------------------------------------------------------------


@operator("rand")
def _(vm):
    vm.seed = (vm.seed * MULTIPLIER + INCREMENT) & MASK
    vm.push(vm.seed ^ vm.seed >> 15)


@operator("srand", "i")
def _(vm, n):
    vm.seed = n & MASK


operator("rrand")(lambda vm: vm.push(vm.seed))
#: Fixed value: objects executed in a millisecond of the clock that usertime reads.
OBJECTS_A_MS = 10_000
operator("usertime")(lambda vm: vm.push(vm.steps // OBJECTS_A_MS))
operator("realtime")(lambda vm: vm.push(vm.steps // OBJECTS_A_MS if vm.clock is None else vm.clock))

__all__ = ["File", "Interp", "TYPES", "fill"]
