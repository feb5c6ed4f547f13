"""Operators on the graphics state, paths, painting, colours, images, patterns, forms, shadings, user paths and document marks."""

from __future__ import annotations

import math

from ..functions import codecs
from . import geometry as g
from .graphics import CMYK, GRAY, RGB, Graphics, clamped, colour_space, components, fill_matrix, initial, matrix_of, numbers
from .interp import GRAPHICS, Interp, operator
from .objects import MARK, READ_ONLY, Arr, Dic, Name, PSError, Str, executable, is_number, name, plain_text, single, syntax
from .ops_data import turned
from .ops_io import acquired


def op(text: str, kinds: str | None = ""):
    return operator(text, kinds, GRAPHICS)


def gfx(vm: Interp) -> Graphics:
    return vm.graphics


# -- state ----------------------------------------------------------------------------------------

op("gsave")(lambda vm: gfx(vm).gsave())
op("grestore")(lambda vm: gfx(vm).grestore())
op("grestoreall")(lambda vm: gfx(vm).grestoreall())
op("initgraphics")(lambda vm: gfx(vm).initgraphics())


def _value(set_name: str, get_name: str, field: str, kinds: str, check) -> None:
    @op(set_name, kinds)
    def _(vm, x):
        setattr(gfx(vm).state, field, check(x))

    op(get_name)(lambda vm: vm.push(getattr(gfx(vm).state, field)))


def _between(low, high):
    def check(x):
        if not low <= x <= high:
            raise PSError("rangecheck")
        return x

    return check


_value("setlinewidth", "currentlinewidth", "width", "n", lambda x: abs(single(float(x))))
_value("setlinecap", "currentlinecap", "cap", "i", _between(0, 2))
_value("setlinejoin", "currentlinejoin", "join", "i", _between(0, 2))
_value("setmiterlimit", "currentmiterlimit", "miter", "n", lambda x: single(float(_between(1, math.inf)(x))))
_value("setflat", "currentflat", "flat", "n", lambda x: single(min(100.0, max(0.2, float(x)))))
_value("setstrokeadjust", "currentstrokeadjust", "adjust", "b", bool)
_value("setoverprint", "currentoverprint", "overprint", "b", bool)
_value("setsmoothness", "currentsmoothness", "smooth", "n", lambda x: single(min(1.0, max(0.0, float(x)))))


@op("setdash", "an")
def _(vm, a, phase):
    values = numbers(a)
    if any(v < 0 for v in values) or values and not any(values):
        raise PSError("rangecheck")
    s = gfx(vm).state
    s.dash, s.phase = tuple(map(single, values)), single(float(phase))


@op("currentdash")
def _(vm):
    s = gfx(vm).state
    vm.push(vm.array(list(s.dash)), s.phase)


# -- matrices -------------------------------------------------------------------------------------

op("matrix")(lambda vm: vm.push(vm.array(list(g.IDENTITY))))
op("identmatrix", "a")(lambda vm, a: vm.push(fill_matrix(vm, a, g.IDENTITY)))
op("defaultmatrix", "a")(lambda vm, a: vm.push(fill_matrix(vm, a, g.IDENTITY)))
op("currentmatrix", "a")(lambda vm, a: vm.push(fill_matrix(vm, a, gfx(vm).state.ctm)))


@op("initmatrix")
def _(vm):
    gfx(vm).state.ctm = g.IDENTITY


@op("setmatrix", "a")
def _(vm, a):
    gfx(vm).state.ctm = matrix_of(a)


@op("concat", "a")
def _(vm, a):
    s = gfx(vm).state
    s.ctm = g.then(matrix_of(a), s.ctm)


def _moves(text: str, n: int, make) -> None:
    @op(text, None)
    def _(vm):
        into = vm.pop() if vm.ostack and type(vm.ostack[-1]) is Arr else None
        values = [vm.pop() for _ in range(n)][::-1]
        if not all(map(is_number, values)):
            raise PSError("typecheck")
        m = make(*map(float, values))
        if into is not None:
            vm.push(fill_matrix(vm, into, m))
        else:
            s = gfx(vm).state
            s.ctm = g.then(m, s.ctm)


def rotation(degrees: float) -> tuple:
    s, c = turned(degrees)
    return (c, s, -s, c, 0.0, 0.0)


_moves("translate", 2, lambda x, y: (1.0, 0.0, 0.0, 1.0, x, y))
_moves("scale", 2, lambda x, y: (x, 0.0, 0.0, y, 0.0, 0.0))
_moves("rotate", 1, rotation)


@op("concatmatrix", "aaa")
def _(vm, a, b, c):
    vm.push(fill_matrix(vm, c, g.then(matrix_of(a), matrix_of(b))))


@op("invertmatrix", "aa")
def _(vm, a, b):
    m = g.inverse(matrix_of(a))
    if m is None:
        raise PSError("undefinedresult")
    vm.push(fill_matrix(vm, b, m))


def _maps(text: str, back: bool, delta: bool) -> None:
    @op(text, None)
    def _(vm):
        m = matrix_of(vm.pop()) if vm.ostack and type(vm.ostack[-1]) is Arr else gfx(vm).state.ctm
        y, x = vm.pop(), vm.pop()
        if not is_number(x) or not is_number(y):
            raise PSError("typecheck")
        if back:
            m = g.inverse(m)
            if m is None:
                raise PSError("undefinedresult")
        vm.push(*map(single, (g.delta if delta else g.apply)(m, float(x), float(y))))


_maps("transform", False, False)
_maps("itransform", True, False)
_maps("dtransform", False, True)
_maps("idtransform", True, True)


# -- paths ----------------------------------------------------------------------------------------

op("newpath")(lambda vm: gfx(vm).new_path())
op("closepath")(lambda vm: gfx(vm).close_path())
op("moveto", "nn")(lambda vm, x, y: gfx(vm).move_to(float(x), float(y)))
op("lineto", "nn")(lambda vm, x, y: gfx(vm).line_to(float(x), float(y)))
op("curveto", "nnnnnn")(lambda vm, *v: gfx(vm).curve_to(*map(float, v)))


def _here(vm) -> tuple[float, float]:
    return gfx(vm).user_point(*gfx(vm).need_point())


@op("rmoveto", "nn")
def _(vm, dx, dy):
    x, y = _here(vm)
    gfx(vm).move_to(x + dx, y + dy)


@op("rlineto", "nn")
def _(vm, dx, dy):
    x, y = _here(vm)
    gfx(vm).line_to(x + dx, y + dy)


@op("rcurveto", "nnnnnn")
def _(vm, *v):
    x, y = _here(vm)
    gfx(vm).curve_to(*[float(d) + (y if i % 2 else x) for i, d in enumerate(v)])


op("arc", "nnnnn")(lambda vm, *v: gfx(vm).arc(*map(float, v), False))
op("arcn", "nnnnn")(lambda vm, *v: gfx(vm).arc(*map(float, v), True))
op("arcto", "nnnnn")(lambda vm, *v: vm.push(*map(single, gfx(vm).arc_to(*map(float, v)))))


@op("arct", "nnnnn")
def _(vm, *v):
    gfx(vm).arc_to(*map(float, v))


op("currentpoint")(lambda vm: vm.push(*map(single, _here(vm))))


@op("pathbbox")
def _(vm):
    s = gfx(vm).state
    box = s.declared[:4] if s.declared else g.box(s.path)
    if box is None:
        raise PSError("nocurrentpoint")
    corners = [gfx(vm).user_point(x, y) for x in (box[0], box[2]) for y in (box[1], box[3])]
    xs, ys = zip(*corners, strict=True)
    vm.push(single(min(xs)), single(min(ys)), single(max(xs)), single(max(ys)))


@op("reversepath")
def _(vm):
    s = gfx(vm).state
    s.path = g.reversed_path(s.path)
    last = next((p for p in reversed(s.path) if p[0] == "m"), None)
    if last:
        s.start = last[1:3]
        s.point = s.start if s.path[-1][0] == "h" else s.path[-1][-2:]


@op("strokepath")
def _(vm):
    s = gfx(vm).state
    s.path = gfx(vm).stroked(s.path, s.ctm)
    s.point = s.start = s.path[-2][1:3] if s.path else None


@op("pathforall", "aaaa")
def _(vm, move, line, curve, close):
    back = g.inverse(gfx(vm).state.ctm)
    if back is None:
        raise PSError("undefinedresult")
    procs = {"m": move, "l": line, "c": curve, "h": close}
    path = list(gfx(vm).state.path)

    def body():
        for s in path:
            for i in range(1, len(s), 2):
                vm.push(*map(single, g.apply(back, s[i], s[i + 1])))
            vm.run(procs[s[0]])

    vm.loop(body)


# -- painting -------------------------------------------------------------------------------------

op("fill")(lambda vm: gfx(vm).fill("f"))
op("eofill")(lambda vm: gfx(vm).fill("f*"))
op("stroke")(lambda vm: gfx(vm).stroke())
op("clip")(lambda vm: gfx(vm).clip("W"))
op("eoclip")(lambda vm: gfx(vm).clip("W*"))
op("clippath")(lambda vm: gfx(vm).clip_path())


@op("initclip")
def _(vm):
    gfx(vm).state.clips = ()


def _rectangles(vm) -> list[tuple]:
    x = vm.pop()
    if type(x) is Arr:
        values = numbers(x)
        if len(values) % 4:
            raise PSError("rangecheck")
    else:
        values = [x, *[vm.pop() for _ in range(3)]][::-1]
        if not all(map(is_number, values)):
            raise PSError("typecheck")
    out: list = []
    for i in range(0, len(values), 4):
        out += gfx(vm).rectangle(*map(float, values[i : i + 4]))
    return out


op("rectfill", None)(lambda vm: gfx(vm).fill("f", _rectangles(vm)))
op("rectstroke", None)(lambda vm: gfx(vm).stroke(_rectangles(vm)))


@op("rectclip", None)
def _(vm):
    gfx(vm).clip("W", _rectangles(vm))
    gfx(vm).new_path()


op("showpage")(lambda vm: gfx(vm).show_page())
op("copypage")(lambda vm: gfx(vm).show_page(keep=True))
op("erasepage")(lambda vm: gfx(vm).erase())


@op("nulldevice")
def _(vm):
    gfx(vm).null = True
    gfx(vm).state.ctm = g.IDENTITY
    gfx(vm).state.clips = ()


# -- colours --------------------------------------------------------------------------------------


def _set_colour(vm, space: tuple, values: list) -> None:
    s = gfx(vm).state
    s.space, s.color, s.pattern = space, tuple(map(single, clamped(space, values))), None


op("setgray", "n")(lambda vm, *v: _set_colour(vm, GRAY, v))
op("setrgbcolor", "nnn")(lambda vm, *v: _set_colour(vm, RGB, v))
op("setcmykcolor", "nnnn")(lambda vm, *v: _set_colour(vm, CMYK, v))


def hsb_to_rgb(h: float, s: float, b: float) -> tuple:
    turn = h * 6 % 6
    k, part = int(turn), turn - int(turn)
    p, q, t = b * (1 - s), b * (1 - s * part), b * (1 - s * (1 - part))
    return ((b, t, p), (q, b, p), (p, b, t), (p, q, b), (t, p, b), (b, p, q))[k]


@op("sethsbcolor", "nnn")
def _(vm, *v):
    _set_colour(vm, RGB, list(hsb_to_rgb(*(max(0.0, min(1.0, float(x))) for x in v))))


def as_rgb(s) -> tuple:
    kind = s.space[0]
    if kind == "DeviceGray":
        return s.color * 3
    if kind == "DeviceRGB":
        return s.color
    if kind == "DeviceCMYK":
        return tuple(1 - min(1.0, x + s.color[3]) for x in s.color[:3])
    return (0.0, 0.0, 0.0)


@op("currentgray")
def _(vm):
    s = gfx(vm).state
    if s.space == CMYK:
        c, m, y, k = s.color
        vm.push(single(1 - min(1.0, 0.3 * c + 0.59 * m + 0.11 * y + k)))
    else:
        r, gr, b = as_rgb(s)
        vm.push(single(0.3 * r + 0.59 * gr + 0.11 * b) if s.space != GRAY else s.color[0])


op("currentrgbcolor")(lambda vm: vm.push(*map(single, as_rgb(gfx(vm).state))))


@op("currenthsbcolor")
def _(vm):
    r, gr, b = as_rgb(gfx(vm).state)
    high, low = max(r, gr, b), min(r, gr, b)
    spread = high - low
    h = 0.0 if not spread else ((gr - b) / spread % 6 if high == r else (b - r) / spread + 2 if high == gr else (r - gr) / spread + 4) / 6
    vm.push(single(h), single(spread / high if high else 0.0), single(high))


@op("currentcmykcolor")
def _(vm):
    s = gfx(vm).state
    if s.space == CMYK:
        vm.push(*s.color)
    elif s.space == GRAY:
        vm.push(0.0, 0.0, 0.0, single(1 - s.color[0]))
    else:
        vm.push(*[single(1 - x) for x in as_rgb(s)], 0.0)


@op("setcolorspace", "x")
def _(vm, x):
    s = gfx(vm).state
    s.space = colour_space(vm, x)
    s.color, s.pattern = initial(s.space), None


@op("currentcolorspace")
def _(vm):
    space = gfx(vm).state.space
    vm.push(vm.array([name(space[0])]))


@op("setcolor", None)
def _(vm):
    s = gfx(vm).state
    if s.space[0] == "Pattern":
        _set_pattern(vm, vm.pop())
        return
    n = components(s.space)
    if len(vm.ostack) < n:
        raise PSError("stackunderflow")
    values = vm.ostack[len(vm.ostack) - n :]
    if not all(map(is_number, values)):
        raise PSError("typecheck")
    del vm.ostack[len(vm.ostack) - n :]
    out = clamped(s.space, values)
    s.color = out if s.space[0] == "Indexed" else tuple(map(single, out))


@op("currentcolor")
def _(vm):
    s = gfx(vm).state
    vm.push(*s.color)


# -- images ---------------------------------------------------------------------------------------


def _int_of(d: Dic, key: str, default=None) -> int:
    value = d.get(name(key), default)
    if value is None:
        raise PSError("undefined")
    if type(value) is not int:
        if type(value) is float and value.is_integer():
            return int(value)
        raise PSError("typecheck")
    return value


def _image(vm, w, h, bits, matrix, source, space, decode, interpolate=False, mask=False, multi=None, extra=None) -> None:
    if w < 0 or h < 0 or bits not in (1, 2, 4, 8, 12):
        raise PSError("rangecheck")
    n = 1 if mask else components(space)
    row = (w * n * bits + 7) // 8
    if multi:
        per = (w * bits + 7) // 8
        planes = [acquired(vm, x, per * h) for x in multi]
        for (data, file) in planes:
            if file is not None:
                file.at += min(len(data), per * h)
        rows = min(len(d) // per if per else 0 for d, _ in planes)
        data = b"".join(bytes(v for t in zip(*(d[k * per : (k + 1) * per] for d, _ in planes), strict=True) for v in t) for k in range(min(rows, h))) if bits == 8 else b"".join(d[: per * h] for d, _ in planes)
    else:
        data, file = acquired(vm, source, row * h)
        if file is not None:
            file.at += min(len(data), row * h)
        data = data[: row * h]
        if row:
            data = data[: len(data) // row * row]
    if space is not None and decode is None:
        decode = [0, (1 << bits) - 1] if space[0] == "Indexed" else [0, 100, *space[3]] if space[0] == "Lab" else [0, 1] * n
    image = {"w": w, "h": h, "bits": bits, "space": space, "decode": decode, "data": data, "interpolate": interpolate, "mask": mask}
    gfx(vm).image(image | (extra or {}), matrix)


@op("image", "x")
def _(vm, x):
    if type(x) is not Dic:
        m, bits, h, w = vm.pop(), vm.pop(), vm.pop(), vm.pop()
        if type(w) is not int or type(h) is not int or type(bits) is not int:
            raise PSError("typecheck")
        _image(vm, w, h, bits, matrix_of(m), x, GRAY, [0, 1])
        return
    space = gfx(vm).state.space
    kind = _int_of(x, "ImageType")
    extra = {}
    if kind == 3:
        data, mask = x.get(name("DataDict")), x.get(name("MaskDict"))
        if type(data) is not Dic or type(mask) is not Dic:
            raise PSError("typecheck")
        held, _ = acquired(vm, mask.get(name("DataSource"))) if mask.get(name("DataSource")) is not None else (b"", None)
        extra["stencil"] = (_int_of(mask, "Width"), _int_of(mask, "Height"), tuple(numbers(mask.get(name("Decode")))) if mask.get(name("Decode")) is not None else (0.0, 1.0), held)
        x = data
    elif kind == 4:
        extra["key"] = tuple(numbers(x.get(name("MaskColor"))))
        n = components(space)
        if len(extra["key"]) not in (n, 2 * n):
            raise PSError("rangecheck")
    elif kind != 1:
        raise PSError("rangecheck")
    decode = x.get(name("Decode"))
    source = x.get(name("DataSource"))
    if source is None or x.get(name("ImageMatrix")) is None:
        raise PSError("undefined")
    multi = source.items() if x.get(name("MultipleDataSources")) is True and type(source) is Arr else None
    _image(vm, _int_of(x, "Width"), _int_of(x, "Height"), _int_of(x, "BitsPerComponent"), matrix_of(x.get(name("ImageMatrix"))), source, space, numbers(decode) if decode is not None else None, x.get(name("Interpolate")) is True, multi=multi, extra=extra)


@op("imagemask", "x")
def _(vm, x):
    if type(x) is Dic:
        decode = numbers(x.get(name("Decode"))) if x.get(name("Decode")) is not None else [0.0, 1.0]
        if x.get(name("DataSource")) is None or x.get(name("ImageMatrix")) is None:
            raise PSError("undefined")
        _image(vm, _int_of(x, "Width"), _int_of(x, "Height"), 1, matrix_of(x.get(name("ImageMatrix"))), x.get(name("DataSource")), None, decode, x.get(name("Interpolate")) is True, True)
        return
    m, polarity, h, w = vm.pop(), vm.pop(), vm.pop(), vm.pop()
    if type(polarity) is not bool or type(w) is not int or type(h) is not int:
        raise PSError("typecheck")
    _image(vm, w, h, 1, matrix_of(m), x, None, [1, 0] if polarity else [0, 1], mask=True)


@op("colorimage", "bi")
def _(vm, multi, n):
    if n not in (1, 3, 4):
        raise PSError("rangecheck")
    sources = [vm.pop() for _ in range(n if multi else 1)][::-1]
    m, bits, h, w = vm.pop(), vm.pop(), vm.pop(), vm.pop()
    if type(w) is not int or type(h) is not int or type(bits) is not int:
        raise PSError("typecheck")
    space = {1: GRAY, 3: RGB, 4: CMYK}[n]
    _image(vm, w, h, bits, matrix_of(m), sources[0], space, [0, 1] * n, multi=sources if multi and n > 1 else None)


# -- patterns, forms, shadings --------------------------------------------------------------------


@operator("makepattern", "da")
def _(vm, d, m):
    kind = d.get(name("PatternType"))
    if kind is None:
        raise PSError("undefined")
    if kind not in (1, 2):
        raise PSError("rangecheck")
    for key in ("PaintType", "TilingType", "BBox", "XStep", "YStep", "PaintProc") if kind == 1 else ("Shading",):
        if d.get(name(key)) is None:
            raise PSError("undefined")
    matrix = matrix_of(m)
    if kind == 1:
        numbers(d.get(name("BBox")), 4)
        if not d.get(name("XStep")) or not d.get(name("YStep")):
            raise PSError("rangecheck")
    out = vm.dictionary(len(d.store.data) + 1)
    for key, value in d.items():
        vm.define(out, key, value)
    vm.patterns = getattr(vm, "patterns", 0) + 1
    vm.define(out, "Implementation", vm.patterns)
    out.store.access = READ_ONLY
    base = gfx(vm).state.ctm if vm.graphics is not None else g.IDENTITY
    vm.instances = getattr(vm, "instances", {}) | {vm.patterns: (out, g.then(matrix, base))}
    vm.push(out)


def _set_pattern(vm, p) -> None:
    s = gfx(vm).state
    if type(p) is not Dic:
        raise PSError("typecheck")
    held = getattr(vm, "instances", {}).get(p.get(name("Implementation")))
    if held is None or held[0].store is not p.store:
        raise PSError("typecheck")
    colour: tuple = ()
    if p.get(name("PatternType")) == 1 and p.get(name("PaintType")) == 2:
        base = s.space[1] if s.space[0] == "Pattern" and len(s.space) > 1 else s.space
        if base[0] == "Pattern":
            raise PSError("rangecheck")
        n = components(base)
        values = [vm.pop() for _ in range(n)][::-1]
        if not all(map(is_number, values)):
            raise PSError("typecheck")
        colour = tuple(map(single, clamped(base, values)))
    s.color = colour
    s.pattern = _pattern_number(vm, p, held[1])


def _pattern_number(vm, p: Dic, matrix: tuple) -> int:
    resources = gfx(vm).resources
    key = ("pattern", p.get(name("Implementation")))
    if key in resources.numbers:
        return resources.numbers[key]
    if p.get(name("PatternType")) == 2:
        n = _shading_number(vm, p.get(name("Shading")))
        return resources.number("pattern", key[1], {"shading": n, "matrix": matrix})
    box = numbers(p.get(name("BBox")), 4)
    number = resources.number("pattern", key[1], {})

    def run():
        gfx(vm).clip("W", gfx(vm).rectangle(box[0], box[1], box[2] - box[0], box[3] - box[1]))
        vm.push(p)
        vm.run(p.get(name("PaintProc")))

    content = gfx(vm).captured(g.IDENTITY, run)
    resources.items["pattern"][number] = {"matrix": matrix, "box": box, "step": (float(p.get(name("XStep"))), float(p.get(name("YStep")))), "paint": p.get(name("PaintType")), "tiling": p.get(name("TilingType")), "ops": content.ops}
    return number


@op("setpattern", "x")
def _(vm, p):
    s = gfx(vm).state
    if s.space[0] != "Pattern":
        s.space = ("Pattern", s.space)
    _set_pattern(vm, p)


@op("execform", "d")
def _(vm, d):
    proc, box, m = d.get(name("PaintProc")), d.get(name("BBox")), d.get(name("Matrix"))
    if proc is None or box is None or m is None:
        raise PSError("undefined")
    box, m = numbers(box, 4), matrix_of(m)
    if gfx(vm).null:
        return
    resources, key = gfx(vm).resources, id(d.store)
    if ("form", key) not in resources.numbers:
        number = resources.number("form", key, {})

        def run():
            gfx(vm).clip("W", gfx(vm).rectangle(box[0], box[1], box[2] - box[0], box[3] - box[1]))
            vm.push(d)
            vm.run(proc)

        resources.items["form"][number] = {"box": box, "ops": gfx(vm).captured(g.IDENTITY, run).ops, "keep": d}
    gfx(vm).content.paint(gfx(vm).state, False, colour=False)
    gfx(vm).content.ops.append(("form", resources.numbers["form", key], g.then(m, gfx(vm).state.ctm)))


def function(vm, f) -> dict:
    """A function dictionary as data; it is never evaluated."""
    if type(f) is not Dic:
        raise PSError("typecheck")
    kind = _int_of(f, "FunctionType")
    domain = f.get(name("Domain"))
    if domain is None:
        raise PSError("undefined")
    out = {"type": kind, "domain": numbers(domain), "range": numbers(f.get(name("Range"))) if f.get(name("Range")) is not None else None}
    get = lambda key, default: numbers(f.get(name(key))) if f.get(name(key)) is not None else default
    if kind == 0:
        source = f.get(name("DataSource"))
        size = get("Size", None)
        if source is None or size is None or out["range"] is None:
            raise PSError("undefined")
        bits = _int_of(f, "BitsPerSample")
        outputs = len(out["range"]) // 2
        need = (math.prod(map(int, size)) * outputs * bits + 7) // 8
        data, _ = acquired(vm, source, need)
        if len(data) < need:
            raise PSError("rangecheck")
        out |= {"size": size, "bits": bits, "order": _int_of(f, "Order", 1), "encode": get("Encode", [v for s in size for v in (0, s - 1)]), "decode": get("Decode", out["range"]), "samples": data[:need]}
    elif kind == 2:
        out |= {"c0": get("C0", [0.0]), "c1": get("C1", [1.0]), "n": float(f.get(name("N"), 1))}
        if len(out["c0"]) != len(out["c1"]):
            raise PSError("rangecheck")
    elif kind == 3:
        parts = f.get(name("Functions"))
        if type(parts) is not Arr:
            raise PSError("typecheck")
        out |= {"parts": [function(vm, p) for p in parts.items()], "bounds": get("Bounds", []), "encode": get("Encode", [])}
        if len(out["bounds"]) != len(out["parts"]) - 1 or len(out["encode"]) != 2 * len(out["parts"]):
            raise PSError("rangecheck")
    else:
        raise PSError("rangecheck")
    return out


def shading(vm, d: Dic) -> dict:
    kind = _int_of(d, "ShadingType")
    held = d.get(name("ColorSpace"))
    if held is None:
        raise PSError("undefined")
    get = lambda key, default=None: numbers(d.get(name(key))) if d.get(name(key)) is not None else default
    space = colour_space(vm, held)
    if space[0] == "Pattern":
        raise PSError("rangecheck")
    f = d.get(name("Function"))
    out = {"type": kind, "space": space, "background": get("Background"), "box": get("BBox"), "antialias": d.get(name("AntiAlias")) is True}
    out["functions"] = [] if f is None else [function(vm, x) for x in (f.items() if type(f) is Arr else [f])]
    if kind == 1:
        out |= {"domain": get("Domain", [0, 1, 0, 1]), "matrix": get("Matrix", list(g.IDENTITY))}
    elif kind in (2, 3):
        coords, extend = get("Coords"), d.get(name("Extend"))
        if coords is None or f is None:
            raise PSError("undefined")
        if len(coords) != (4, 6)[kind - 2] or kind == 3 and (coords[2] < 0 or coords[5] < 0):
            raise PSError("rangecheck")
        out |= {"coords": coords, "domain": get("Domain", [0, 1]), "extend": [x is True for x in extend.items()] if type(extend) is Arr else [False, False]}
    elif kind in (4, 5, 6, 7):
        source = d.get(name("DataSource"))
        if source is None:
            raise PSError("undefined")
        if type(source) is Arr and not executable(source):
            values = numbers(source)
            data = b"".join(int(v).to_bytes(4, "big", signed=True) for v in values)
            out["numbers"] = values
        else:
            data, _ = acquired(vm, source)
        out |= {"data": data, "decode": get("Decode", []), "coordinate": _int_of(d, "BitsPerCoordinate", 32), "component": _int_of(d, "BitsPerComponent", 8)}
        if kind == 5:
            out["row"] = _int_of(d, "VerticesPerRow")
            if out["row"] < 2:
                raise PSError("rangecheck")
        else:
            out["flag"] = _int_of(d, "BitsPerFlag", 8)
    else:
        raise PSError("rangecheck")
    return out


def _shading_number(vm, d) -> int:
    if type(d) is not Dic:
        raise PSError("typecheck")
    made = shading(vm, d)
    return gfx(vm).resources.number("shading", repr(made), made)


@op("shfill", "d")
def _(vm, d):
    n = _shading_number(vm, d)
    if not gfx(vm).null:
        gfx(vm).content.paint(gfx(vm).state, False, colour=False)
        gfx(vm).content.ops.append(("sh", n, gfx(vm).state.ctm))


# -- user paths -----------------------------------------------------------------------------------

# Path operators by their code in an encoded user path, with their numbers of operands.
STEPS = ("setbbox", "moveto", "rmoveto", "lineto", "rlineto", "curveto", "rcurveto", "arc", "arcn", "arct", "closepath", "ucache")
TAKES = dict(zip(STEPS, (4, 2, 2, 2, 2, 6, 6, 5, 5, 5, 0, 0), strict=True))
REPEAT = 32


def _steps(vm, path) -> list[tuple[str, list[float]]]:
    if type(path) is not Arr:
        raise PSError("typecheck")
    items = path.items()
    out: list = []
    if len(items) == 2 and type(items[1]) is Str:
        held = items[0]
        values = codecs.encoded_numbers(held.bytes()) if type(held) is Str else numbers(held)
        if values is None:
            raise PSError("typecheck")
        at, times = 0, 1
        for code in items[1].bytes():
            if code > REPEAT:
                times = code - REPEAT
                continue
            if code >= len(STEPS):
                raise PSError("typecheck")
            for _ in range(times):
                n = TAKES[STEPS[code]]
                if at + n > len(values):
                    raise PSError("rangecheck")
                out.append((STEPS[code], values[at : at + n]))
                at += n
            times = 1
        return out
    waiting: list = []
    for x in items:
        if is_number(x):
            waiting.append(float(x))
            continue
        text = getattr(x, "text", None)
        if text not in TAKES or len(waiting) != TAKES[text]:
            raise PSError("typecheck")
        out.append((text, waiting))
        waiting = []
    if waiting:
        raise PSError("typecheck")
    return out


def _set_box(vm, values, strict: bool) -> None:
    x0, y0, x1, y1 = map(float, values)
    if x1 < x0 or y1 < y0:
        raise PSError("rangecheck")
    corners = [gfx(vm).device_point(x, y) for x in (x0, x1) for y in (y0, y1)]
    xs, ys = zip(*corners, strict=True)
    gfx(vm).state.declared = (min(xs), min(ys), max(xs), max(ys), strict)


op("setbbox", "nnnn")(lambda vm, *v: _set_box(vm, v, False))


def _append(vm, path) -> None:
    steps = _steps(vm, path)
    if not any(s == "setbbox" for s, _ in steps[:2]):
        raise PSError("typecheck")
    for text, values in steps:
        if text == "setbbox":
            _set_box(vm, values, True)
        elif text != "ucache":
            GRAPHICS[text].run(vm, *values)


def _with_path(vm, path, use) -> None:
    s = gfx(vm).state
    kept = s.path, s.point, s.start, s.declared
    s.path, s.point, s.start, s.declared = [], None, None, None
    try:
        _append(vm, path)
        use()
    finally:
        s.path, s.point, s.start, s.declared = kept


@op("uappend", "x")
def _(vm, path):
    _append(vm, path)


op("ufill", "x")(lambda vm, p: _with_path(vm, p, lambda: gfx(vm).fill("f", list(gfx(vm).state.path))))
op("ueofill", "x")(lambda vm, p: _with_path(vm, p, lambda: gfx(vm).fill("f*", list(gfx(vm).state.path))))


def _matrix_form(vm, x) -> tuple:
    """(user path, matrix) where a matrix may lie on top."""
    if type(x) is Arr and x.n == 6 and all(map(is_number, x.items())) and vm.ostack and type(vm.ostack[-1]) is Arr:
        return vm.pop(), matrix_of(x)
    return x, g.IDENTITY


@op("ustroke", "x")
def _(vm, x):
    path, m = _matrix_form(vm, x)
    _with_path(vm, path, lambda: gfx(vm).stroke(list(gfx(vm).state.path), g.then(m, gfx(vm).state.ctm)))


@op("ustrokepath", "x")
def _(vm, x):
    path, m = _matrix_form(vm, x)
    made: list = []
    _with_path(vm, path, lambda: made.extend(gfx(vm).stroked(gfx(vm).state.path, g.then(m, gfx(vm).state.ctm))))
    s = gfx(vm).state
    s.path = made
    s.point = s.start = made[-2][1:3] if made else None


@op("upath", "b")
def _(vm, cached):
    s = gfx(vm).state
    back = g.inverse(s.ctm)
    box = s.declared[:4] if s.declared else g.box(s.path)
    if box is None or back is None:
        raise PSError("nocurrentpoint")
    corners = [g.apply(back, x, y) for x in (box[0], box[2]) for y in (box[1], box[3])]
    xs, ys = zip(*corners, strict=True)
    out: list = [name("ucache", True)] if cached else []
    out += [single(min(xs)), single(min(ys)), single(max(xs)), single(max(ys)), name("setbbox", True)]
    for p in s.path:
        for i in range(1, len(p), 2):
            out += map(single, g.apply(back, p[i], p[i + 1]))
        out.append(name({"m": "moveto", "l": "lineto", "c": "curveto", "h": "closepath"}[p[0]], True))
    vm.push(vm.array(out, x=True))


op("ucache")(lambda vm: None)


@op("ucachestatus")
def _(vm):
    vm.push(MARK, 0, 0, 0, 0, 0)


@op("setucacheparams")
def _(vm):
    if any(type(x) is not int for x in vm.to_mark()):
        raise PSError("typecheck")


# -- page device ----------------------------------------------------------------------------------


@operator("setpagedevice", "d")
def _(vm, d):
    held = vm.parameters.setdefault("device", {})
    media = None
    for key, value in d.items():
        if plain_text(key) == "PageSize":
            size = numbers(value, 2)
            if min(size) <= 0:
                raise PSError("rangecheck")
            media = (0.0, 0.0, *size)
        if plain_text(key) in ("NumCopies",) and value is not None and type(value) is not int:
            raise PSError("typecheck")
    for key, value in d.items():
        held[plain_text(key)] = value
    if vm.graphics is not None:
        if media:
            gfx(vm).media = media
            gfx(vm).page.media = media
        gfx(vm).erase()
        gfx(vm).initgraphics()


@operator("currentpagedevice")
def _(vm):
    d = vm.dictionary()
    if vm.graphics is not None:
        vm.define(d, "PageSize", vm.array([single(v) for v in gfx(vm).media[2:]]))
    for key, value in vm.parameters.get("device", {}).items():
        vm.define(d, key, value)
    vm.push(d)


# -- screens, transfers and renderings, which are recorded only -----------------------------------


def _kept(vm, key: str, value=None, *, read: bool = False):
    held = vm.parameters.setdefault("rendering", {})
    if read:
        return held.get(key)
    held[key] = value
    return None


@operator("setscreen", "nnx")
def _(vm, *v):
    _kept(vm, "screen", [v] * 4)


def _screen(vm) -> list:
    return _kept(vm, "screen", read=True) or [(60, 45, vm.array([], x=True))] * 4


operator("currentscreen")(lambda vm: vm.push(*_screen(vm)[3]))
operator("currentcolorscreen")(lambda vm: vm.push(*[x for s in _screen(vm) for x in s]))


@operator("setcolorscreen", "nnxnnxnnxnnx")
def _(vm, *v):
    _kept(vm, "screen", [v[i : i + 3] for i in range(0, 12, 3)])


@operator("settransfer", "x")
def _(vm, p):
    _kept(vm, "transfer", [p] * 4)


def _transfer(vm) -> list:
    return _kept(vm, "transfer", read=True) or [vm.array([], x=True)] * 4


operator("currenttransfer")(lambda vm: vm.push(_transfer(vm)[3]))
operator("currentcolortransfer")(lambda vm: vm.push(*_transfer(vm)))


@operator("setcolortransfer", "xxxx")
def _(vm, *v):
    _kept(vm, "transfer", list(v))


@operator("setcolorrendering", "x")
def _(vm, d):
    if type(d) is not Dic:
        raise PSError("typecheck")
    _kept(vm, "crd", d)


@operator("currentcolorrendering")
def _(vm):
    d = _kept(vm, "crd", read=True)
    if d is None:
        d = vm.dictionary()
        vm.define(d, "ColorRenderingType", 1)
    vm.push(d)


@operator("findcolorrendering", "x")
def _(vm, intent):
    if type(intent) not in (Name, Str):
        raise PSError("typecheck")
    key = f"{intent.text}.device.none"
    there = any(key in vm.category("ColorRendering", s).store.data for s in (True, False))
    vm.push(name(key if there else "DefaultColorRendering"), there)


@operator("sethalftone", "d")
def _(vm, d):
    if d.get(name("HalftoneType")) is None:
        raise PSError("undefined")
    _kept(vm, "halftone", d)


@operator("currenthalftone")
def _(vm):
    d = _kept(vm, "halftone", read=True)
    if d is None:
        d = vm.dictionary()
        vm.define(d, "HalftoneType", 1)
    vm.push(d)


# -- document marks -------------------------------------------------------------------------------


@op("pdfmark", None)
def _(vm):
    kind = vm.pop()
    if type(kind) is not Name:
        raise PSError("typecheck")
    items = vm.to_mark()
    if len(items) % 2:
        raise PSError("rangecheck")
    entries: dict[str, object] = {}
    for k, v in zip(items[::2], items[1::2], strict=True):
        if type(k) is not Name:
            raise PSError("typecheck")
        entries[k.text] = v
    page = len(gfx(vm).pages)
    if kind.text == "ANN":
        _annotation(vm, entries)
    elif kind.text in ("OUT", "DEST", "DOCINFO", "DOCVIEW", "PAGES", "PAGE"):
        vm.events.append(("mark", page, kind.text, {k: mark_value(v) for k, v in entries.items()}))
    else:
        vm.events.append(("ignored", page, kind.text, {}))


def mark_value(x):
    if type(x) is Name:
        return "/" + x.text
    if type(x) is Str:
        return "(" + x.text + ")"
    if type(x) is Arr:
        return [mark_value(y) for y in x.items()]
    if type(x) is Dic:
        return {plain_text(k): mark_value(v) for k, v in x.items()}
    return x if is_number(x) or type(x) is bool else None if x is None else syntax(x)


def _annotation(vm, entries: dict) -> None:
    subtype = entries.get("Subtype")
    kind = subtype.text if type(subtype) is Name else "Text"
    page = len(gfx(vm).pages)
    if kind != "Link":
        vm.events.append(("ignored", page, f"ANN/{kind}", {}))
        return
    box = numbers(entries.get("Rect"), 4) if "Rect" in entries else None
    if box is None:
        raise PSError("rangecheck")
    points = [gfx(vm).device_point(x, y) for x, y in ((box[0], box[1]), (box[2], box[3]))]
    plain = {k: mark_value(v) for k, v in entries.items()}
    gfx(vm).page.annotations.append({"box": (min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points)), "entries": plain})
