"""Fonts, text and CMaps. Resident faces have metrics and no outlines."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from . import geometry as g
from .graphics import matrix_of, numbers
from .interp import GRAPHICS, PROCSETS, Interp, operator
from .objects import READ_ONLY, Arr, Dic, FontID, Name, PSError, Str, is_number, key_of, name, single
from .ops_io import found

# The standard faces, and the glyphs of ASCII in order.
RESIDENT = (
    "Courier Courier-Bold Courier-Oblique Courier-BoldOblique Helvetica Helvetica-Bold Helvetica-Oblique Helvetica-BoldOblique "
    "Times-Roman Times-Bold Times-Italic Times-BoldItalic Symbol ZapfDingbats"
).split()
MARK_NAMES = (
    "space exclam quotedbl numbersign dollar percent ampersand quoteright parenleft parenright asterisk plus comma hyphen period slash "
    "zero one two three four five six seven eight nine colon semicolon less equal greater question at"
).split()
TAIL_NAMES = "bracketleft backslash bracketright asciicircum underscore quoteleft".split()
BRACE_NAMES = "braceleft bar braceright asciitilde".split()
ACCENTS = {"GRAVE": "grave", "ACUTE": "acute", "CIRCUMFLEX": "circumflex", "TILDE": "tilde", "DIAERESIS": "dieresis", "RING ABOVE": "ring", "CEDILLA": "cedilla", "STROKE": "slash", "CARON": "caron"}


@lru_cache(maxsize=1)
def _ascii() -> list[str]:
    letters = [chr(c) for c in range(65, 91)]
    return MARK_NAMES + letters + TAIL_NAMES + [x.lower() for x in letters] + BRACE_NAMES


@lru_cache(maxsize=1)
def glyph_names() -> dict[str, str]:
    """Character of each glyph name: ASCII by list, accented letters by the names of their characters."""
    out = dict(zip(_ascii(), map(chr, range(32, 127)), strict=True))
    for code in range(0xC0, 0x180):
        parts = unicodedata.name(chr(code), "").split(" WITH ")
        if len(parts) == 2 and parts[0].startswith("LATIN ") and parts[1] in ACCENTS:
            letter = parts[0].split()[-1]
            if len(letter) == 1:
                out[(letter if "CAPITAL" in parts[0] else letter.lower()) + ACCENTS[parts[1]]] = chr(code)
    return out


def standard_encoding() -> list[str]:
    return [".notdef"] * 32 + _ascii() + [".notdef"] * 129


def latin1_encoding() -> list[str]:
    by_char = {c: n for n, c in glyph_names().items()}
    return [by_char.get(chr(c), ".notdef") for c in range(256)]


ENCODINGS = {"StandardEncoding": standard_encoding, "ISOLatin1Encoding": latin1_encoding}


# Widths of the ASCII glyphs, from space to asciitilde, in the public metrics of two standard faces.
HELVETICA = (
    "278 278 355 556 556 889 667 222 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 1015 "
    "667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 222 "
    "556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584"
)
TIMES = (
    "250 333 408 500 500 833 778 333 333 333 500 564 250 333 250 278 500 500 500 500 500 500 500 500 500 500 278 278 564 564 564 444 921 "
    "722 667 667 722 611 556 722 722 333 389 722 611 889 722 722 556 722 667 556 611 722 722 944 722 722 611 333 278 333 469 500 333 "
    "444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500 722 500 500 444 480 200 480 541"
)


HELVETICA_BOLD = (
    "278 333 474 556 556 889 722 278 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 333 333 584 584 584 611 975 "
    "722 722 722 722 667 611 778 722 278 556 722 611 833 722 778 667 778 722 667 611 722 667 944 667 667 611 333 278 333 584 556 278 "
    "556 611 556 611 556 333 611 611 278 278 556 278 889 611 611 611 611 389 556 333 611 556 778 556 556 500 389 280 389 584"
)
TIMES_BOLD = (
    "250 333 555 500 500 1000 833 333 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500 930 "
    "722 667 722 722 667 611 778 778 389 500 778 667 944 722 778 611 778 722 556 667 722 722 1000 722 722 667 333 278 333 581 500 333 "
    "500 556 444 556 444 333 500 556 278 333 556 278 833 556 500 556 556 444 389 333 556 500 722 500 500 444 394 220 394 520"
)
TIMES_ITALIC = (
    "250 333 420 500 500 833 778 333 333 333 500 675 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 675 675 675 500 920 "
    "611 611 667 722 611 611 722 722 333 444 667 556 833 667 722 611 722 611 500 556 722 611 833 611 556 556 389 278 389 422 500 333 "
    "500 500 444 500 444 278 500 500 278 278 444 278 722 500 500 500 500 389 389 278 500 444 667 444 444 389 400 275 400 541"
)
TIMES_BOLD_ITALIC = (
    "250 389 555 500 500 833 778 333 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500 832 "
    "667 667 667 722 667 667 722 778 389 500 667 611 889 722 722 611 722 667 556 611 722 667 889 667 611 611 333 278 333 570 500 333 "
    "500 500 444 500 444 333 500 556 278 278 500 278 778 556 500 500 500 389 389 278 556 444 667 500 444 389 348 220 348 570"
)
SYMBOL = (
    "space 250 Alpha 722 Beta 667 Chi 722 Delta 612 Epsilon 611 Phi 763 Gamma 603 Eta 722 Iota 333 theta1 631 Kappa 722 Lambda 686 Mu 889 Nu 722 Omicron 722 Pi 768 Theta 741 Rho 556 "
    "Sigma 592 Tau 611 Upsilon 690 sigma1 439 Omega 768 Xi 645 Psi 795 Zeta 611 alpha 631 beta 549 chi 549 delta 494 epsilon 439 phi 521 gamma 411 eta 603 iota 329 phi1 603 kappa 549 "
    "lambda 549 mu 576 nu 521 omicron 549 pi 549 theta 521 rho 549 sigma 603 tau 439 upsilon 576 omega1 713 omega 686 xi 493 psi 686 zeta 494"
)
FACES = {"Helvetica": HELVETICA, "Helvetica-Oblique": HELVETICA, "Helvetica-Bold": HELVETICA_BOLD, "Helvetica-BoldOblique": HELVETICA_BOLD, "Times-Roman": TIMES, "Times-Bold": TIMES_BOLD, "Times-Italic": TIMES_ITALIC, "Times-BoldItalic": TIMES_BOLD_ITALIC}


@lru_cache(maxsize=1)
def _symbol_widths() -> dict[str, int]:
    parts = SYMBOL.split()
    return dict(zip(parts[::2], map(int, parts[1::2]), strict=True))


@lru_cache(maxsize=8)
def _widths(held: str) -> dict[str, int]:
    return dict(zip(_ascii(), map(int, held.split()), strict=True))


@lru_cache(maxsize=1 << 14)
def rule_width(face: str, glyph: str) -> int:
    """Width in thousandths of an em: 600 throughout for the monospaced face; an accented letter's is the letter's.

    The faces of Helvetica and Times have their public metrics, as have the letters of Symbol. What else Symbol and the
    faces of pictures hold goes by a rule of this package.
    """
    if face.startswith("Courier"):
        return 600
    if face == "Symbol" and glyph in _symbol_widths():
        return _symbol_widths()[glyph]
    held = _widths(FACES.get(face, HELVETICA))
    if glyph in held:
        return held[glyph]
    c = glyph_names().get(glyph)
    if c is None:
        return 0 if glyph == ".notdef" else 500
    return held.get(unicodedata.normalize("NFD", c)[0], 500)


# Families to substitute by parts of a name.
FAMILIES = (("cour", "Courier"), ("mono", "Courier"), ("typewriter", "Courier"), ("times", "Times"), ("roman", "Times"), ("serif", "Times"), ("garamond", "Times"), ("helv", "Helvetica"), ("arial", "Helvetica"), ("sans", "Helvetica"), ("univers", "Helvetica"))


def substitute(face: str) -> str | None:
    low = face.lower()
    family = next((f for part, f in FAMILIES if part in low), None)
    if family is None:
        return None
    bold, slant = "bold" in low or "black" in low, "italic" in low or "oblique" in low
    if family == "Times":
        return {(0, 0): "Times-Roman", (1, 0): "Times-Bold", (0, 1): "Times-Italic", (1, 1): "Times-BoldItalic"}[bold, slant]
    style = ("Bold" if bold else "") + ("Oblique" if slant else "")
    return family + ("-" + style if style else "")


@lru_cache(maxsize=1)
def _standard_names() -> list[Name]:
    return [name(x) for x in standard_encoding()]


def resident(vm: Interp, face: str) -> Dic:
    was, vm.shared = vm.shared, True
    d = vm.dictionary()
    encoding = Arr(vm.store(list(_standard_names())), 0, len(_standard_names()), READ_ONLY)
    for key, value in (("FontType", 1), ("FontName", name(face)), ("FontMatrix", vm.array([0.001, 0, 0, 0.001, 0, 0])), ("FontBBox", vm.array([0, -250, 1000, 1000])), ("Encoding", encoding), ("PaintType", 0)):
        vm.define(d, key, value)
    vm.define(d, "FID", _fid(vm))
    d.store.access = READ_ONLY
    vm.shared = was
    return d


def _fid(vm: Interp) -> FontID:
    vm.fonts += 1
    return FontID(vm.fonts)


# -- the font directory ---------------------------------------------------------------------------


@operator("definefont", "xd")
def _(vm, key, d):
    kind = d.get(name("FontType"))
    if kind not in (0, 1, 2, 3, 9, 11, 42):
        raise PSError("invalidfont")
    if kind < 9 and d.get(name("FontMatrix")) is None or kind in (1, 3, 42) and d.get(name("Encoding")) is None:
        raise PSError("invalidfont")
    if d.get(name("FID")) is None and d.store.access == 0:
        vm.define(d, "FID", _fid(vm))
    vm.touch(d.store)
    d.store.access = max(d.store.access, READ_ONLY)
    vm.define(vm.category("Font", vm.shared), key, d)
    vm.push(d)


@operator("undefinefont", "x")
def _(vm, key):
    d = vm.category("Font", vm.shared)
    vm.touch(d.store)
    d.store.data.pop(key_of(key), None)


def find_font(vm, key) -> Dic:
    value, _ = found(vm, "Font", key)
    if value is not None:
        held = vm.category("Font", True)
        if key_of(key) not in held.store.data and key_of(key) not in vm.category("Font", False).store.data:
            held.store.data[key_of(key)] = (key, value)
        return value
    text = key.text if isinstance(key, (Name, Str)) else None
    other = substitute(text) if text else None
    if other is None:
        raise PSError("invalidfont")
    vm.events.append(("substitution", 0, text, {"by": other}))
    return find_font(vm, name(other))


operator("findfont", "x")(lambda vm, key: vm.push(find_font(vm, key)))


def _derived(vm, d: Dic, m: tuple) -> Dic:
    held = d.get(name("FontMatrix"))
    if held is None:
        raise PSError("invalidfont")
    out = vm.dictionary(len(d.store.data))
    was, vm.shared = vm.shared, out.store.shared
    for key, value in d.items():
        if key.text != "FontMatrix":
            out.store.data[key_of(key)] = (key, value)
    vm.define(out, "FontMatrix", vm.array([single(v) for v in g.then(matrix_of(held), m)]))
    out.store.access = READ_ONLY
    vm.shared = was
    return out


operator("scalefont", "dn")(lambda vm, d, s: vm.push(_derived(vm, d, (float(s), 0.0, 0.0, float(s), 0.0, 0.0))))
operator("makefont", "da")(lambda vm, d, m: vm.push(_derived(vm, d, matrix_of(m))))


def _set(vm, d: Dic) -> None:
    if d.get(name("FontType")) is None or d.get(name("FontMatrix")) is None:
        raise PSError("invalidfont")
    vm.font = d
    if vm.graphics is not None:
        vm.graphics.state.font = d


def current(vm) -> Dic:
    d = vm.graphics.state.font if vm.graphics is not None else getattr(vm, "font", None)
    if d is None:
        raise PSError("invalidfont")
    return d


operator("setfont", "d")(_set)
operator("currentfont")(lambda vm: vm.push(current(vm)))


@operator("selectfont", "xx")
def _(vm, key, size):
    d = find_font(vm, key)
    if is_number(size):
        _set(vm, _derived(vm, d, (float(size), 0.0, 0.0, float(size), 0.0, 0.0)))
    elif type(size) is Arr:
        _set(vm, _derived(vm, d, matrix_of(size)))
    else:
        raise PSError("typecheck")


@operator("composefont", "xxa")
def _(vm, key, cmap, fonts):
    if type(cmap) is Name:
        cmap, status = found(vm, "CMap", cmap)
        if status is None:
            raise PSError("undefined")
    if type(cmap) is not Dic:
        raise PSError("typecheck")
    parts = []
    for f in fonts.items():
        if type(f) is not Dic:
            value, status = found(vm, "CIDFont", f)
            if status is None:
                value, status = found(vm, "Font", f)
            if status is None:
                raise PSError("invalidfont")
            f = value
        parts.append(f)
    d = vm.dictionary()
    for k, v in (("FontType", 0), ("FMapType", 9), ("FontName", key), ("FontMatrix", vm.array([1, 0, 0, 1, 0, 0])), ("CMap", cmap), ("FDepVector", vm.array(parts)), ("Encoding", vm.array([0])), ("WMode", cmap.get(name("WMode"), 0)), ("FID", _fid(vm))):
        vm.define(d, k, v)
    d.store.access = READ_ONLY
    vm.define_font = vm.category("Font", vm.shared)
    vm.define_font.store.data[key_of(key)] = (key, d)
    vm.push(d)


# -- glyphs ---------------------------------------------------------------------------------------


class Glyph:
    """A character of a shown string: its code, length of the code, glyph or CID, and its width in glyph space."""

    __slots__ = ("code", "length", "glyph", "width")

    def __init__(self, code: int, length: int, glyph, width: tuple[float, float]) -> None:
        self.code, self.length, self.glyph, self.width = code, length, glyph, width


def glyphs(vm, font: Dic, text: bytes) -> list[Glyph]:
    kind = font.get(name("FontType"))
    if kind == 0:
        return _composite(vm, font, text)
    encoding = font.get(name("Encoding"))
    names = encoding.items() if type(encoding) is Arr else []
    out = []
    face = font.get(name("FontName"))
    usual = kind != 3 and font.get(name("Metrics")) is None and font.get(name("CharStrings")) is None  # all widths go by the face
    face = face.text if isinstance(face, (Name, Str)) else ""
    for c in text:
        glyph = names[c].text if c < len(names) and type(names[c]) is Name else ".notdef"
        out.append(Glyph(c, 1, glyph, (float(rule_width(face, glyph)), 0.0) if usual else width(vm, font, glyph, c)))
    return out


def width(vm, font: Dic, glyph: str, code: int) -> tuple[float, float]:
    metrics = font.get(name("Metrics"))
    if type(metrics) is Dic and metrics.get(name(glyph)) is not None:
        held = metrics.get(name(glyph))
        return (float(held), 0.0) if is_number(held) else (numbers(held)[1 if held.n == 2 else 0 if held.n < 2 else 2], 0.0)
    if font.get(name("FontType")) == 3:
        return captured(vm, font, glyph, code)["width"]
    face = font.get(name("FontName"))
    shapes = font.get(name("CharStrings"))
    if type(shapes) is Dic and shapes.get(name(glyph)) is None:
        glyph = ".notdef"
    return float(rule_width(face.text if isinstance(face, (Name, Str)) else "", glyph)), 0.0


def captured(vm, font: Dic, glyph: str, code: int) -> dict:
    """What a Type 3 glyph's procedure paints, and its metrics; run once for each glyph."""
    store = font.get(name("CharProcs"))
    key = (id(store.store) if type(store) is Dic else id(font.get(name("BuildChar"))), glyph, code if font.get(name("BuildGlyph")) is None else -1)
    vm.type3 = getattr(vm, "type3", {})
    if key in vm.type3:
        return vm.type3[key]
    build, args = font.get(name("BuildGlyph")), (font, name(glyph))
    if build is None:
        build, args = font.get(name("BuildChar")), (font, code)
    if build is None:
        raise PSError("invalidfont")
    outer, vm.metrics = getattr(vm, "metrics", None), {"width": (0.0, 0.0), "box": None}

    def run():
        vm.push(*args)
        vm.run(build)

    try:
        if vm.graphics is not None:
            content = vm.graphics.captured(g.IDENTITY, run)
            vm.metrics["ops"] = content.ops
        else:
            run()
            vm.metrics["ops"] = []
        made = vm.metrics
    finally:
        vm.metrics = outer
    vm.type3[key] = made
    return made


def _metrics(vm) -> dict:
    if getattr(vm, "metrics", None) is None:
        raise PSError("undefined")
    return vm.metrics


@operator("setcachedevice", "nnnnnn")
def _(vm, *v):
    m = _metrics(vm)
    m["width"], m["box"] = (float(v[0]), float(v[1])), tuple(map(float, v[2:]))


@operator("setcachedevice2", "nnnnnnnnnn")
def _(vm, *v):
    m = _metrics(vm)
    m["width"], m["box"] = (float(v[0]), float(v[1])), tuple(map(float, v[2:6]))


@operator("setcharwidth", "nn")
def _(vm, x, y):
    _metrics(vm)["width"] = (float(x), float(y))


def _font_number(vm, font: Dic, run: list[Glyph]) -> int:
    """The resource of a font; scaled copies of one font are one resource."""
    resources = vm.graphics.resources
    kind = font.get(name("FontType"))
    fid = font.get(name("FID"))
    face = font.get(name("FontName"))
    text = face.text if isinstance(face, (Name, Str)) else "Font"
    encoding = font.get(name("Encoding"))
    key = (kind, fid.number if type(fid) is FontID and kind in (0, 3) else text, id(encoding.store) if type(encoding) is Arr and kind == 3 else "")
    if kind == 3:
        box = font.get(name("FontBBox"))
        n = resources.number("font", key, {"kind": "type3", "matrix": (1, 0, 0, 1, 0, 0), "box": numbers(box) if box is not None else [0, 0, 0, 0], "used": {}, "glyphs": {}})
        made = resources.items["font"][n]
        base = vm.graphics.state.font
        made["matrix"] = _base_matrix(vm, base)
        for c in run:
            made["used"][c.code] = c.glyph
            made["glyphs"][c.glyph] = captured(vm, font, c.glyph, c.code)
        return n
    if kind == 0:
        cmap = font.get(name("CMap"))
        label = cmap.get(name("CMapName")) if type(cmap) is Dic else None
        parts = font.get(name("FDepVector")).items()
        inner = parts[0].get(name("CIDFontName")) or parts[0].get(name("FontName"))
        return resources.number("font", key, {"kind": "composite", "cmap": getattr(label, "text", "Custom"), "wmode": font.get(name("WMode"), 0), "program": "cidtype1", "name": getattr(inner, "text", "Font"), "count": parts[0].get(name("CIDCount"), 0)})
    held = encoding.items() if type(encoding) is Arr else []
    if held == _standard_names() and font.get(name("CharStrings")) is None:
        return resources.number("font", (key, ()), {"kind": "resident", "name": text, "diff": {}})
    names = [x.text if type(x) is Name else ".notdef" for x in held]
    diff = {c: n for c, (n, m) in enumerate(zip(names, standard_encoding(), strict=False)) if n != m}
    if font.get(name("CharStrings")) is not None:
        used = {c: n for c, n in enumerate(names) if n != ".notdef"}
        return resources.number("font", (key, tuple(used.items())), {"kind": "embedded", "program": "type1", "name": text, "count": len(font.get(name("CharStrings")).store.data), "encoding": used})
    return resources.number("font", (key, tuple(diff.items())), {"kind": "resident", "name": text, "diff": diff})


def _base_matrix(vm, font: Dic) -> tuple:
    """A Type 3 font's own matrix, whatever scalefont has made of it."""
    for shared in (True, False):
        for _, d in vm.category("Font", shared).items():
            if type(d) is Dic and d.get(name("FID")) is font.get(name("FID")):
                return matrix_of(d.get(name("FontMatrix")))
    return matrix_of(font.get(name("FontMatrix")))


# -- showing --------------------------------------------------------------------------------------


def show(vm, text: Str, added=None, widths: list | None = None, between=None, paint: bool = True) -> tuple[float, float]:
    """Shows a string; gives the sum of the displacements in user space.

    ``added`` gives what is added to a glyph's displacement in user space, ``widths`` replaces the displacements,
    ``between`` runs between two glyphs.
    """
    font = current(vm)
    if text.access > READ_ONLY:
        raise PSError("invalidaccess")
    run = glyphs(vm, font, text.bytes())
    m = matrix_of(font.get(name("FontMatrix")))
    if font.get(name("FontType")) == 0:
        m = g.then(matrix_of(font.get(name("FDepVector")).items()[0].get(name("FontMatrix"))), m)
    back = g.inverse(m)
    wmode = font.get(name("WMode"), 0) if font.get(name("FontType")) == 0 else 0
    if widths is not None and len(widths) < len(run):
        raise PSError("rangecheck")
    total = (0.0, 0.0)
    steps = []
    for i, c in enumerate(run):
        w = (0.0, -1000.0 if abs(m[0]) < 0.1 else -1.0) if wmode else c.width
        user = widths[i] if widths is not None else g.delta(m, *w)
        if added is not None:
            ax, ay = added(c.code)
            user = (user[0] + ax, user[1] + ay)
        # a displacement is kept in glyph space
        steps.append((w if widths is None and added is None else g.delta(back, *user) if back else (0.0, 0.0), user))
        total = total[0] + user[0], total[1] + user[1]
    if not paint:
        return total
    gfx = vm.graphics
    gfx.need_point()
    pending: list[int] = []

    def flush() -> None:
        if pending and not gfx.null and any(run[i].width != (0, 0) or run[i].glyph != ".notdef" for i in pending):
            at = gfx.state.point
            part = [run[i] for i in pending]
            n = _font_number(vm, font, part)
            mm = g.then(m, gfx.state.ctm)
            gfx.content.paint(gfx.state, False)
            gfx.content.ops.append(("text", n, (*mm[:4], *at), b"".join(c.code.to_bytes(c.length, "big") for c in part), tuple(tuple(map(single, steps[i][0])) for i in pending), max(c.length for c in part), wmode))
        for i in pending:
            dx, dy = g.delta(gfx.state.ctm, *steps[i][1])
            x, y = gfx.state.point
            gfx.state.point = (x + dx, y + dy)
        if pending:
            x, y = gfx.user_point(*gfx.state.point)
            gfx.move_to(x, y)
        pending.clear()

    for i in range(len(run)):
        pending.append(i)
        if between is not None and i + 1 < len(run):
            flush()
            vm.push(run[i].code, run[i + 1].code)
            vm.run(between)
    flush()
    return total


def op(text: str, kinds: str):
    return operator(text, kinds, GRAPHICS)


@op("show", "s")
def _(vm, s):
    show(vm, s)


@op("ashow", "nns")
def _(vm, ax, ay, s):
    show(vm, s, added=lambda c: (ax, ay))


@op("widthshow", "nnis")
def _(vm, cx, cy, char, s):
    show(vm, s, added=lambda c: (cx, cy) if c == char else (0, 0))


@op("awidthshow", "nninns")
def _(vm, cx, cy, char, ax, ay, s):
    show(vm, s, added=lambda c: (ax + cx, ay + cy) if c == char else (ax, ay))


@op("kshow", "as")
def _(vm, proc, s):
    show(vm, s, between=proc)


def _explicit(text: str, make) -> None:
    @op(text, "sx")
    def _(vm, s, values):
        from ..functions.codecs import encoded_numbers

        held = encoded_numbers(values.bytes()) if type(values) is Str else numbers(values)
        if held is None:
            raise PSError("typecheck")
        show(vm, s, widths=make(list(map(float, held))))


_explicit("xshow", lambda v: [(x, 0.0) for x in v])
_explicit("yshow", lambda v: [(0.0, y) for y in v])
_explicit("xyshow", lambda v: list(zip(v[::2], v[1::2], strict=False)))


@operator("stringwidth", "s")
def _(vm, s):
    x, y = show(vm, s, paint=False)
    vm.push(single(x), single(y))


@op("glyphshow", "m")
def _(vm, glyph):
    font = current(vm)
    if font.get(name("FontType")) == 0:
        raise PSError("invalidfont")
    m = matrix_of(font.get(name("FontMatrix")))
    gfx = vm.graphics
    at = gfx.need_point()
    w = width(vm, font, glyph.text, 0)
    if not gfx.null:
        c = Glyph(0, 1, glyph.text, w)
        n = _font_number(vm, font, [c])
        mm = g.then(m, gfx.state.ctm)
        gfx.content.paint(gfx.state, False)
        gfx.content.ops.append(("text", n, (*mm[:4], *at), glyph.text.encode("latin-1", "replace"), (tuple(map(single, w)),), 1, 0))
    x, y = gfx.user_point(*at)
    dx, dy = g.delta(m, *w)
    gfx.move_to(x + dx, y + dy)


@op("charpath", "sb")
def _(vm, s, stroked):
    """The boxes of the glyphs: resident faces have metrics but no outlines."""
    font = current(vm)
    m = matrix_of(font.get(name("FontMatrix")))
    gfx = vm.graphics
    x, y = gfx.user_point(*gfx.need_point())
    for c in glyphs(vm, font, s.bytes()):
        if c.glyph not in (".notdef", "space") and c.width[0]:
            corners = [g.delta(m, *p) for p in ((0, 0), (c.width[0], 0), (c.width[0], 700), (0, 700))]
            gfx.move_to(x + corners[0][0], y + corners[0][1])
            for px, py in corners[1:]:
                gfx.line_to(x + px, y + py)
            gfx.close_path()
        dx, dy = g.delta(m, *c.width)
        x, y = x + dx, y + dy
        gfx.move_to(x, y)


# -- CMaps ----------------------------------------------------------------------------------------


class CMap:
    """Code spaces and mappings; what isn't found here may be found in the parent."""

    def __init__(self) -> None:
        self.spaces: list[tuple[bytes, bytes]] = []
        self.ranges: list[tuple[str, bytes, bytes, int, int]] = []
        self.unicode: list[tuple[bytes, bytes, object]] = []
        self.parent: CMap | None = None
        self.font = 0

    def chain(self):
        c = self
        while c is not None:
            yield c
            c = c.parent

    def next_code(self, data: bytes, at: int) -> bytes:
        inside = lambda code, low, high: len(code) == len(low) and all(a <= x <= b for x, a, b in zip(code, low, high, strict=True))
        for c in self.chain():
            for n in range(1, 5):
                code = data[at : at + n]
                if any(inside(code, low, high) for low, high in c.spaces):
                    return code
        partial = [len(low) for c in self.chain() for low, high in c.spaces if at < len(data) and low[0] <= data[at] <= high[0]]
        return data[at : at + (min(partial) if partial else 1)]

    def cid(self, code: bytes) -> int:
        for kinds in (("exact",), ("range",)):
            for c in self.chain():
                for kind, low, high, cid, _ in c.ranges:
                    if kind in kinds and len(code) == len(low) and low <= code <= high:
                        return cid + int.from_bytes(code, "big") - int.from_bytes(low, "big")
        for c in self.chain():
            for kind, low, high, cid, _ in c.ranges:
                if kind == "notdef" and len(code) == len(low) and low <= code <= high:
                    return cid
        return 0


def identity_cmap(vm: Interp, text: str) -> Dic:
    d = vm.dictionary()
    made = CMap()
    made.spaces = [(b"\0\0", b"\xff\xff")]
    made.ranges = [("range", b"\0\0", b"\xff\xff", 0, 0)]
    _publish(vm, d, made)
    vm.define(d, "CMapName", name(text))
    vm.define(d, "WMode", int(text.endswith("V")))
    return d


def _publish(vm: Interp, d: Dic, made: CMap) -> None:
    vm.cmaps = [*getattr(vm, "cmaps", []), made]
    vm.define(d, "CodeMap", len(vm.cmaps) - 1)


def _cmap_of(vm, d: Dic) -> CMap:
    n = d.get(name("CodeMap"))
    if type(n) is not int:
        raise PSError("invalidfont")
    return vm.cmaps[n]


def _composite(vm, font: Dic, text: bytes) -> list[Glyph]:
    cmap = _cmap_of(vm, font.get(name("CMap")))
    inner = font.get(name("FDepVector")).items()[0]
    widths, default = _cid_widths(inner)
    out, at = [], 0
    while at < len(text):
        code = cmap.next_code(text, at)
        at += len(code)
        cid = cmap.cid(code)
        out.append(Glyph(int.from_bytes(code, "big"), len(code), cid, (widths.get(cid, default), 0.0)))
    return out


def _cid_widths(d: Dic) -> tuple[dict[int, float], float]:
    default, held = d.get(name("DW"), 1000), d.get(name("W"))
    out: dict[int, float] = {}
    items = held.items() if type(held) is Arr else []
    i = 0
    while i + 1 < len(items):
        if type(items[i + 1]) is Arr:
            out |= {items[i] + k: float(w) for k, w in enumerate(items[i + 1].items())}
            i += 2
        elif i + 2 < len(items):
            out |= {c: float(items[i + 2]) for c in range(items[i], min(items[i + 1], items[i] + 65536) + 1)}
            i += 3
        else:
            break
    return out, float(default)


CID = PROCSETS.setdefault("CIDInit", {})


def cid_op(text: str, kinds: str = ""):
    return operator(text, kinds, CID)


def _building(vm) -> CMap:
    made = getattr(vm, "building", None)
    if made is None:
        raise PSError("undefined")
    return made


@cid_op("begincmap")
def _(vm):
    vm.building, vm.block = CMap(), None


@cid_op("endcmap")
def _(vm):
    _publish(vm, vm.dstack[-1], _building(vm))
    vm.building = None


def _bytes(x) -> bytes:
    if type(x) is not Str:
        raise PSError("typecheck")
    return x.bytes()


def _block(kind: str, width: int, take) -> None:
    """beginKIND with a count, endKIND that takes the count times ``width`` operands."""

    @cid_op("begin" + kind, "i")
    def _(vm, n):
        _building(vm)
        if n < 0:
            raise PSError("rangecheck")
        vm.block = (kind, n)

    @cid_op("end" + kind)
    def _(vm):
        made = _building(vm)
        if getattr(vm, "block", None) is None or vm.block[0] != kind:
            raise PSError("undefined")
        n = vm.block[1] * width
        if len(vm.ostack) < n:
            raise PSError("stackunderflow")
        items = vm.ostack[len(vm.ostack) - n :]
        del vm.ostack[len(vm.ostack) - n :]
        vm.block = None
        for i in range(0, n, width):
            take(made, *items[i : i + width])


def _number_range(kind: str):
    def take(made: CMap, low, high, cid) -> None:
        if type(cid) is not int:
            raise PSError("typecheck")
        low, high = _bytes(low), _bytes(high)
        if len(low) != len(high) or low > high:
            raise PSError("rangecheck")
        made.ranges.append((kind, low, high, cid, made.font))

    return take


def _exact(made: CMap, code, cid) -> None:
    if type(cid) is not int:
        raise PSError("typecheck")
    made.ranges.append(("exact", _bytes(code), _bytes(code), cid, made.font))


def _space(made: CMap, low, high) -> None:
    low, high = _bytes(low), _bytes(high)
    if len(low) != len(high) or not 1 <= len(low) <= 4:
        raise PSError("rangecheck")
    made.spaces.append((low, high))


def unicode_range(low: bytes, high: bytes, to: bytes):
    """(code, Unicode bytes) of a range, the last byte carrying into those before it."""
    first, start = int.from_bytes(low, "big"), int.from_bytes(to, "big")
    for k in range(int.from_bytes(high, "big") - first + 1):
        yield (first + k).to_bytes(len(low), "big"), (start + k).to_bytes(max(len(to), ((start + k).bit_length() + 7) // 8), "big")


def _bf_range(made: CMap, low, high, to) -> None:
    low, high = _bytes(low), _bytes(high)
    if type(to) is Arr:
        codes = [c for c, _ in unicode_range(low, high, b"\0\0")]
        made.unicode += [(c, c, t.bytes() if type(t) is Str else t) for c, t in zip(codes, to.items(), strict=False)]
    else:
        made.unicode.append((low, high, _bytes(to)))


_block("codespacerange", 2, _space)
_block("cidrange", 3, _number_range("range"))
_block("cidchar", 2, _exact)
_block("notdefrange", 3, _number_range("notdef"))
_block("notdefchar", 2, lambda made, code, cid: made.ranges.append(("notdef", _bytes(code), _bytes(code), cid, made.font)))
_block("bfchar", 2, lambda made, code, to: made.unicode.append((_bytes(code), _bytes(code), to.bytes() if type(to) is Str else to.text)))
_block("bfrange", 3, _bf_range)


@cid_op("beginusematrix", "i")
def _(vm, n):
    _building(vm)
    vm.block = ("usematrix", len(vm.ostack))


@cid_op("endusematrix")
def _(vm):
    """The block's matrix is accepted and not used."""
    _building(vm)
    if getattr(vm, "block", None) is None or vm.block[0] != "usematrix":
        raise PSError("undefined")
    del vm.ostack[min(vm.block[1], len(vm.ostack)) :]
    vm.block = None


@cid_op("usecmap", "m")
def _(vm, key):
    value, status = found(vm, "CMap", key)
    if status is None:
        raise PSError("undefined")
    _building(vm).parent = _cmap_of(vm, value)


@cid_op("usefont", "i")
def _(vm, n):
    _building(vm).font = n


SETS = PROCSETS.setdefault("FontSetInit", {})


@operator("StartData", "xi", SETS)
def _(vm, key, n):
    """Takes the bytes of a font set from the current file; their outlines are not read."""
    from .objects import FileRef

    ref = next((x for x in reversed(vm.estack) if type(x) is FileRef), None)
    if ref is not None:
        ref.file.at = min(len(ref.file.data), ref.file.at + 1 + n)


CID["StartData"] = SETS["StartData"]
