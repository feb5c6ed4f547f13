"""Operators on files, filters, text output, resources and parameters."""

from __future__ import annotations

import re

from ..functions import codecs
from . import scanner
from .interp import PROCSETS, Interp, operator
from .objects import MARK, READ_ONLY, UNLIMITED, Arr, Composite, Dic, File, FileRef, Name, PSError, Str, key_of, name, plain_text, syntax
from .ops_data import _password, _readable, _writable, fill

SPACE = b"\0\t\n\f\r "
LIMIT = 1 << 28


def write(vm: Interp, data: bytes) -> None:
    vm.out += data


# -- files ----------------------------------------------------------------------------------------


@operator("file", "ss")
def _(vm, path, mode):
    text, how = path.text, mode.text[:1]
    if how not in ("r", "w", "a"):
        raise PSError("invalidfileaccess")
    if text == "%stdin":
        vm.push(FileRef(vm.stdin))
    elif text in ("%stdout", "%stderr"):
        vm.push(FileRef(File(None, vm.out if text == "%stdout" else vm.err, text)))
    elif text in vm.files:
        if how != "r":
            raise PSError("invalidfileaccess")
        vm.push(FileRef(File(vm.files[text], label=text, positions=True)))
    else:
        raise PSError("undefinedfilename" if how == "r" else "invalidfileaccess")


def _input(ref) -> File:
    if type(ref) is not FileRef:
        raise PSError("typecheck")
    if not ref.file.reads:
        raise PSError("invalidaccess")
    return ref.file


def _output(ref) -> File:
    if type(ref) is not FileRef:
        raise PSError("typecheck")
    if ref.file.sink is None:
        raise PSError("invalidaccess")
    if not ref.file.open:
        raise PSError("ioerror")
    return ref.file


@operator("closefile", "f")
def _(vm, ref):
    file = ref.file
    if file.open:
        if file.reads and file.lazy is not None:
            _ = file.data  # what a decoder would have read is taken from its source
        file.open = False
        if file.closing:
            file.closing(vm, bytes(file.buffer))


@operator("read", "f")
def _(vm, ref):
    file = _input(ref)
    if not file.open or file.at >= len(file.data):
        file.open = False
        vm.push(False)
        return
    file.at += 1
    vm.push(file.data[file.at - 1], True)


def _put(vm, file: File, data: bytes) -> None:
    if file.closing:
        file.buffer += data
    else:
        file.sink += data


@operator("write", "fi")
def _(vm, ref, c):
    if not 0 <= c <= 255:
        raise PSError("rangecheck")
    _put(vm, _output(ref), bytes([c]))


@operator("writestring", "fs")
def _(vm, ref, s):
    _readable(s)
    _put(vm, _output(ref), s.bytes())


@operator("writehexstring", "fs")
def _(vm, ref, s):
    _put(vm, _output(ref), s.bytes().hex().encode())


@operator("readline", "fs")
def _(vm, ref, s):
    file = _input(ref)
    _writable(s)
    data, at = file.data, file.at
    hit = re.compile(rb"\r\n|\r|\n").search(data, at)
    end = hit.start() if hit else len(data)
    if end - at > s.n:
        raise PSError("rangecheck")
    file.at = hit.end() if hit else len(data)
    vm.push(fill(vm, s, data[at:end]), hit is not None)


@operator("readstring", "fs")
def _(vm, ref, s):
    file = _input(ref)
    _writable(s)
    if not s.n:
        raise PSError("rangecheck")
    data = file.data[file.at : file.at + s.n] if file.open else b""
    file.at += len(data)
    vm.push(fill(vm, s, data), len(data) == s.n)


@operator("readhexstring", "fs")
def _(vm, ref, s):
    file = _input(ref)
    _writable(s)
    if not s.n:
        raise PSError("rangecheck")
    digits = bytearray()
    while len(digits) < 2 * s.n and file.at < len(file.data):
        c = file.data[file.at]
        file.at += 1
        if c in b"0123456789abcdefABCDEF":
            digits.append(c)
    whole = len(digits) == 2 * s.n
    if len(digits) % 2:
        digits += b"0"
    vm.push(fill(vm, s, bytes.fromhex(digits.decode())), whole)


@operator("token", "x")
def _(vm, source):
    if type(source) is Str:
        _readable(source)
        file = File(source.bytes())
    else:
        file = _input(source)
        if not file.open:
            vm.push(False)
            return
    x = vm.scan(file)
    if x is scanner.END:
        vm.push(False)
    elif type(source) is Str:
        vm.push(source.changed(at=source.at + file.at, n=source.n - file.at), x, True)
    else:
        vm.push(x, True)


@operator("currentfile")
def _(vm):
    ref = next((x for x in reversed(vm.estack) if type(x) is FileRef), None)
    vm.push(FileRef(ref.file) if ref else FileRef(File(b"")))


operator("flush")(lambda vm: None)


@operator("flushfile", "f")
def _(vm, ref):
    if ref.file.reads:
        ref.file.at = len(ref.file.data)


def _positioned(ref) -> File:
    file = _input(ref)
    if not file.positions or not file.open:
        raise PSError("ioerror")
    return file


operator("fileposition", "f")(lambda vm, ref: vm.push(_positioned(ref).at))


@operator("setfileposition", "fi")
def _(vm, ref, at):
    file = _positioned(ref)
    if not 0 <= at <= len(file.data):
        raise PSError("rangecheck")
    file.at = at


@operator("resetfile", "f")
def _(vm, ref):
    if ref.file.positions:
        ref.file.at = 0


@operator("bytesavailable", "f")
def _(vm, ref):
    file = ref.file
    vm.push(len(file.data) - file.at if file.positions and file.open else -1)


@operator("status", "x")
def _(vm, x):
    if type(x) is FileRef:
        vm.push(x.file.open)
    elif type(x) is Str:
        data = vm.files.get(x.text)
        if data is None:
            vm.push(False)
        else:
            vm.push((len(data) + 1023) // 1024, len(data), 0, 0, True)
    else:
        raise PSError("typecheck")


@operator("=", "x")
def _(vm, x):
    write(vm, plain_text(x).encode("latin-1", "replace") + b"\n")


@operator("==", "x")
def _(vm, x):
    write(vm, syntax(x).encode("latin-1", "replace") + b"\n")


@operator("print", "s")
def _(vm, s):
    _readable(s)
    write(vm, s.bytes())


@operator("=only", "x")
def _(vm, x):
    write(vm, plain_text(x).encode("latin-1", "replace"))


@operator("==only", "x")
def _(vm, x):
    write(vm, syntax(x).encode("latin-1", "replace"))


@operator("stack")
def _(vm):
    for x in reversed(vm.ostack):
        write(vm, plain_text(x).encode("latin-1", "replace") + b"\n")


@operator("pstack")
def _(vm):
    for x in reversed(vm.ostack):
        write(vm, syntax(x).encode("latin-1", "replace") + b"\n")


@operator("echo", "b")
def _(vm, on):
    pass


@operator("run", "s")
def _(vm, path):
    data = vm.files.get(path.text)
    if data is None:
        raise PSError("undefinedfilename")
    vm.run(FileRef(File(data, label=path.text), True))


@operator("deletefile", "s")
def _(vm, path):
    raise PSError("undefinedfilename" if path.text not in vm.files else "invalidfileaccess")


@operator("renamefile", "ss")
def _(vm, old, new):
    raise PSError("undefinedfilename" if old.text not in vm.files else "invalidfileaccess")


@operator("filenameforall", "sas")
def _(vm, template, proc, scratch):
    fits = pattern(template.text)
    names = sorted(f for f in vm.files if fits.match(f))

    def body():
        for f in names:
            vm.push(fill(vm, scratch, f.encode("latin-1", "replace")))
            vm.run(proc)

    vm.loop(body)


@operator("eexec", "x")
def _(vm, source):
    if type(source) is Str:
        file, data = None, source.bytes()
    else:
        file = _input(source)
        data = file.data[file.at :]
    body = data.lstrip(b" \t\r\n")
    if re.match(rb"[0-9a-fA-F\s]{8}", body):
        digits = re.match(rb"[0-9a-fA-F\s]*", body)[0]
        clean = bytes(c for c in digits if c not in SPACE)
        body = bytes.fromhex(clean[: len(clean) // 2 * 2].decode())
    plain = codecs.cipher_decode(body, codecs.EEXEC_KEY)
    end = plain.find(b"closefile")
    inner = File(plain[: end + 9] if end >= 0 else plain)
    if file is not None:
        file.at = len(file.data) if end < 0 else min(len(file.data), file.at + (len(data) - len(data.lstrip(b" \t\r\n"))) + (2 * (end + 13) if re.match(rb"[0-9a-fA-F\s]{8}", data.lstrip(b" \t\r\n")) else end + 13))
    vm.dstack.append(vm.system)
    depth = len(vm.dstack)
    try:
        vm.run(FileRef(inner, True))
    finally:
        if len(vm.dstack) >= depth:
            del vm.dstack[depth - 1 :]


# -- filters --------------------------------------------------------------------------------------

# Names of the filters.
DECODERS = ("ASCIIHexDecode", "ASCII85Decode", "RunLengthDecode", "FlateDecode", "LZWDecode", "SubFileDecode", "DCTDecode", "ReusableStreamDecode", "CCITTFaxDecode")
ENCODERS = ("ASCIIHexEncode", "ASCII85Encode", "RunLengthEncode", "FlateEncode", "LZWEncode", "NullEncode")


def _int(d: Dic | None, key: str, default: int) -> int:
    value = d.get(name(key), default) if d is not None else default
    if type(value) is not int:
        raise PSError("typecheck")
    return value


def decoded(kind: str, data: bytes, d: Dic | None, count: int = 0, bound: bytes = b"") -> tuple[bytes, int]:
    """(what a filter makes of data, bytes it took)."""
    try:
        if kind == "ASCIIHexDecode":
            return codecs.ascii_hex_decode(data)
        if kind == "ASCII85Decode":
            return codecs.ascii85_decode(data)
        if kind == "RunLengthDecode":
            return codecs.run_length_decode(data)
        if kind == "SubFileDecode":
            return codecs.sub_file_decode(data, count, bound)
        if kind == "DCTDecode":
            n = codecs.jpeg_length(data)
            return data[:n], n
        if kind == "ReusableStreamDecode":
            return data, len(data)
        if kind in ("FlateDecode", "LZWDecode"):
            out, used = codecs.flate_decode(data) if kind == "FlateDecode" else codecs.lzw_decode(data, _int(d, "EarlyChange", 1))
            return codecs.unpredicted(out, _int(d, "Predictor", 1), _int(d, "Colors", 1), _int(d, "BitsPerComponent", 8), _int(d, "Columns", 1)), used
    except codecs.BadData:
        raise PSError("ioerror") from None
    raise PSError("undefined")


def encoded(kind: str, data: bytes, d: Dic | None, record: int = 0) -> bytes:
    if kind == "NullEncode":
        return data
    if kind == "RunLengthEncode":
        return codecs.run_length_encode(data, record)
    if kind in ("FlateEncode", "LZWEncode"):
        data = codecs.predicted(data, _int(d, "Predictor", 1), _int(d, "Colors", 1), _int(d, "BitsPerComponent", 8), _int(d, "Columns", 1))
        return codecs.flate_encode(data) if kind == "FlateEncode" else codecs.lzw_encode(data, _int(d, "EarlyChange", 1))
    return codecs.ascii_hex_encode(data) if kind == "ASCIIHexEncode" else codecs.ascii85_encode(data)


def acquired(vm: Interp, source, need: int | None = None) -> tuple[bytes, File | None]:
    """The bytes that a string, file or procedure has: all, or the first ``need`` of them at least."""
    if type(source) is Str:
        _readable(source)
        return source.bytes(), None
    if type(source) is FileRef:
        file = _input(source)
        return file.data[file.at :] if file.open else b"", file
    if type(source) is Arr and source.x:
        out = bytearray()
        while need is None or len(out) < need:
            vm.run(source)
            part = vm.pop()
            if type(part) is not Str:
                raise PSError("typecheck")
            if not part.n:
                break
            out += part.bytes()
            if len(out) > LIMIT:
                raise PSError("limitcheck")
            if need is not None and source.n == 1 and source.items()[0] is part:
                # nothing but a string: the next calls give the same, two steps each
                times = min(-(-(need - len(out)) // part.n), (LIMIT - len(out)) // part.n)
                times = max(0, times if vm.budget is None else min(times, (vm.budget - vm.steps) // 2))
                out += part.bytes() * times
                vm.steps += 2 * times
        return bytes(out), None
    raise PSError("typecheck")


@operator("filter", "m")
def _(vm, kind):
    kind = kind.text
    if kind not in DECODERS and kind not in ENCODERS:
        raise PSError("undefined")
    d, record, count, bound = None, 0, 0, b""
    if kind == "RunLengthEncode":
        record = vm.pop()
        if type(record) is not int:
            raise PSError("typecheck")
        if record < 0:
            raise PSError("rangecheck")
    if kind == "SubFileDecode" and vm.ostack and type(vm.ostack[-1]) is Str:
        bound = vm.pop().bytes()
        count = vm.pop()
        if type(count) is not int:
            raise PSError("typecheck")
        if count < 0:
            raise PSError("rangecheck")
    if vm.ostack and type(vm.ostack[-1]) is Dic:
        d = vm.pop()
        if kind == "SubFileDecode":
            count = _int(d, "EODCount", count)
            held = d.get(name("EODString"))
            bound = held.bytes() if type(held) is Str else bound
    source = vm.pop()
    if kind in DECODERS:
        if type(source) not in (FileRef, Str, Arr):
            raise PSError("typecheck")
        if type(source) is FileRef:
            _input(source)

        def make() -> bytes:
            data, file = acquired(vm, source)
            filters, parms = d.get(name("Filter")) if d is not None and kind == "ReusableStreamDecode" else None, None
            if filters is not None:
                parms = d.get(name("DecodeParms"))
                filters = filters.items() if type(filters) is Arr else [filters]
                parms = parms.items() if type(parms) is Arr else [parms] * len(filters)
                out, used = data, len(data)
                for k, (f, p) in enumerate(zip(filters, parms, strict=False)):
                    out, n = decoded(f.text, out, p if type(p) is Dic else None)
                    used = n if k == 0 else used
            else:
                out, used = decoded(kind, data, d, count, bound)
            if file is not None:
                file.at += used
            return out

        made = File(None, label=kind, positions=kind == "ReusableStreamDecode", lazy=make)
        if made.positions:
            _ = made.data  # a reusable stream is read whole when it is made
        vm.push(FileRef(made))
        return
    made = File(None, bytearray(), kind)

    def close(vm: Interp, data: bytes) -> None:
        out = encoded(kind, data, d, record)
        if type(source) is FileRef:
            _put(vm, _output(source), out)
        elif type(source) is Arr:
            vm.push(vm.string(out), False)
            vm.run(source)
            vm.pop()
        elif type(source) is Str:
            fill(vm, source, out)

    if type(source) not in (FileRef, Arr, Str):
        raise PSError("typecheck")
    made.closing = close
    vm.push(FileRef(made))


# -- resources ------------------------------------------------------------------------------------

# Resource categories, and the built-in instances of some of them.
CATEGORIES = "Font CIDFont CMap Encoding ProcSet ColorSpace ColorRendering Pattern Form Halftone Filter ColorSpaceFamily IdiomSet FontType Category Generic".split()
BUILT_IN = {
    "Filter": [*DECODERS[:-1], *ENCODERS],
    "ColorSpaceFamily": "DeviceGray DeviceRGB DeviceCMYK CIEBasedA CIEBasedABC CIEBasedDEF CIEBasedDEFG Indexed Pattern Separation DeviceN".split(),
    "FontType": [0, 1, 2, 3, 9, 11, 42],
    "Category": CATEGORIES,
    "ProcSet": ["CIDInit", "FontSetInit"],
}


def built_in(vm: Interp, category: str, key):
    """A built-in instance, None if there is none."""
    held = BUILT_IN.get(category, ())
    k = key_of(key)
    if category == "ProcSet" and k in PROCSETS:
        d = vm.dictionary()
        for text, op in PROCSETS[k].items():
            vm.define(d, text, op)
        return d
    if category == "Font":
        from .fonts import RESIDENT, resident

        return resident(vm, k) if k in RESIDENT else None
    if category == "Encoding":
        from .fonts import ENCODINGS

        return vm.array([name(g) for g in ENCODINGS[k]()]) if k in ENCODINGS else None
    if category == "CMap" and k in ("Identity-H", "Identity-V"):
        from .fonts import identity_cmap

        return identity_cmap(vm, k)
    return key if k in held else None


def found(vm: Interp, category: str, key):
    for shared in (False, True) if not vm.shared else (True,):
        d = vm.category(category, shared)
        if key_of(key) in d.store.data:
            return d.get(key), 0
    value = built_in(vm, category, key)
    return (value, 2) if value is not None else (None, None)


def _category(vm: Interp, category: Name) -> str:
    text = category.text
    if text not in CATEGORIES and not any(text in vm.category("Category", s).store.data for s in (True, False)):
        raise PSError("undefined")
    return text


@operator("findresource", "xm")
def _(vm, key, category):
    text = _category(vm, category)
    if text == "Font":
        vm.push(key)
        vm.call(vm.system.get(name("findfont")))
        return
    value, status = found(vm, text, key)
    if status is None:
        raise PSError("undefined")
    vm.push(value)


@operator("resourcestatus", "xm")
def _(vm, key, category):
    value, status = found(vm, _category(vm, category), key)
    if status is None:
        vm.push(False)
    else:
        vm.push(status, 0, True)


SHAPES = {"Font": Dic, "CIDFont": Dic, "CMap": Dic, "ProcSet": Dic, "ColorRendering": Dic, "Pattern": Dic, "Form": Dic, "Halftone": Dic, "Encoding": Arr}


@operator("defineresource", "xxm")
def _(vm, key, value, category):
    text = _category(vm, category)
    shape = SHAPES.get(text)
    if shape and type(value) is not shape or text == "ColorSpace" and type(value) not in (Arr, Name):
        raise PSError("typecheck")
    if text == "Encoding" and value.n != 256:
        raise PSError("rangecheck")
    if text == "Font":
        vm.push(key, value)
        vm.call(vm.system.get(name("definefont")))
        return
    if isinstance(value, Composite) and type(value) is not Dic and value.access == UNLIMITED:
        value = value.changed(access=READ_ONLY)
    vm.define(vm.category(text, vm.shared), key, value)
    vm.push(value)


@operator("undefineresource", "xm")
def _(vm, key, category):
    d = vm.category(_category(vm, category), vm.shared)
    vm.touch(d.store)
    d.store.data.pop(key_of(key), None)


def pattern(template: str) -> re.Pattern:
    """A template with * and ? as a pattern; a backslash quotes."""
    out, at = "", 0
    while at < len(template):
        c = template[at]
        if c == "\\" and at + 1 < len(template):
            at += 1
            out += re.escape(template[at])
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        at += 1
    return re.compile(out + r"\Z", re.S)


@operator("resourceforall", "sasm")
def _(vm, template, proc, scratch, category):
    text = _category(vm, category)
    names: dict[str, None] = {}
    for shared in (False, True):
        for key, _ in vm.category(text, shared).items():
            names.setdefault(plain_text(key))
    for key in BUILT_IN.get(text, ()):
        names.setdefault(str(key))
    fits = pattern(template.text)

    def body():
        for key in names:
            if fits.match(key):
                vm.push(fill(vm, scratch, key.encode("latin-1", "replace")))
                vm.run(proc)

    vm.loop(body)


# -- parameters -----------------------------------------------------------------------------------

# Parameters and their defaults.
USER = {"AccurateScreens": False, "HalftoneMode": 0, "IdiomRecognition": False, "JobName": "", "MaxDictStack": 20, "MaxExecStack": 250, "MaxFontItem": 12500, "MaxFormItem": 100000, "MaxLocalVM": 1 << 30, "MaxOpStack": 500, "MaxPatternItem": 20000, "MaxScreenItem": 65536, "MaxSuperScreen": 1016, "MaxUPathItem": 5000, "MinFontCompress": 100, "VMReclaim": 0, "VMThreshold": 40000}
FIXED_USER = ("IdiomRecognition", "MaxDictStack", "MaxExecStack", "MaxLocalVM", "MaxOpStack")
RANGES = {"HalftoneMode": (0, 2), "VMReclaim": (-2, 0)}
JOB_NAME = 100
LIMITS = {"MaxDisplayAndSourceList": 1000000, "MaxDisplayList": 500000, "MaxFontCache": 400000, "MaxFormCache": 200000, "MaxImageBuffer": 500000, "MaxOutlineCache": 100000, "MaxPatternCache": 100000, "MaxScreenStorage": 100000, "MaxSourceList": 500000, "MaxStoredScreenCache": 0, "MaxUPathCache": 100000}
COUNTERS = dict.fromkeys(("CurDisplayList", "CurFontCache", "CurFormCache", "CurOutlineCache", "CurPatternCache", "CurScreenStorage", "CurSourceList", "CurStoredScreenCache", "CurUPathCache"), 0)
ABOUT = {"ByteOrder": False, "BuildTime": 0, "RealFormat": "IEEE", "Revision": 1}
SYSTEM = LIMITS | COUNTERS | ABOUT | {"FactoryDefaults": False, "StartupMode": 0, "PrinterName": "pagemill", "FontResourceDir": "%null", "GenericResourceDir": "%null", "GenericResourcePathSep": "/"}
FIXED_SYSTEM = (*COUNTERS, *ABOUT)
CACHED_MATRICES, CACHED_GLYPHS = 100, 800


def _as_object(vm: Interp, value):
    return vm.string(value.encode()) if isinstance(value, str) else value


def _table(vm: Interp, kind: str, defaults: dict) -> dict:
    return vm.parameters.setdefault(kind, dict(defaults))


def _set_parameters(vm: Interp, kind: str, defaults: dict, d: Dic, fixed: tuple) -> None:
    """All entries are checked before any is stored; a fixed one keeps its value, a number out of range goes to the nearest end."""
    held = _table(vm, kind, defaults)
    new = {}
    for key, value in d.items():
        text = key.text if isinstance(key, (Name, Str)) else None
        if text not in defaults or text in fixed:
            continue
        plain = value.text if type(value) is Str else value
        if type(plain) is not type(defaults[text]):
            raise PSError("typecheck")
        if type(plain) is int:
            low, high = RANGES.get(text, (0, plain))
            plain = max(low, min(plain, high))
        new[text] = plain[:JOB_NAME] if text == "JobName" else plain
    held.update(new)


def _parameters(vm: Interp, kind: str, defaults: dict) -> Dic:
    d = vm.dictionary(len(defaults))
    for key, value in _table(vm, kind, defaults).items():
        vm.define(d, key, _as_object(vm, value))
    return d


operator("setuserparams", "d")(lambda vm, d: _set_parameters(vm, "user", USER, d, FIXED_USER))
operator("currentuserparams")(lambda vm: vm.push(_parameters(vm, "user", USER)))


@operator("setsystemparams", "d")
def _(vm, d):
    password = d.get(name("Password"), 0)
    if not _password(password):
        raise PSError("invalidaccess")
    _set_parameters(vm, "system", SYSTEM, d, FIXED_SYSTEM)


operator("currentsystemparams")(lambda vm: vm.push(_parameters(vm, "system", SYSTEM)))


@operator("setdevparams", "sd")
def _(vm, device, d):
    raise PSError("undefined")


@operator("currentdevparams", "s")
def _(vm, device):
    raise PSError("undefined")


@operator("cachestatus")
def _(vm):
    vm.push(0, _table(vm, "system", SYSTEM)["MaxFontCache"], 0, CACHED_MATRICES, 0, CACHED_GLYPHS, _table(vm, "user", USER)["MaxFontItem"])


def _limit(vm: Interp, key: str, n: int) -> None:
    if n < 0:
        raise PSError("rangecheck")
    _table(vm, "user", USER)[key] = n


operator("setcachelimit", "i")(lambda vm, n: _limit(vm, "MaxFontItem", n))


@operator("setcacheparams")
def _(vm):
    items = vm.to_mark()
    if any(type(x) is not int for x in items):
        raise PSError("typecheck")
    for key, n in zip(("MaxFontItem", "MinFontCompress"), reversed(items), strict=False):
        _limit(vm, key, n)


@operator("currentcacheparams")
def _(vm):
    held = _table(vm, "user", USER)
    vm.push(MARK, held["MinFontCompress"], held["MaxFontItem"])


operator("setvmthreshold", "i")(lambda vm, n: _table(vm, "user", USER).update(VMThreshold=max(0, n)))


@operator("vmreclaim", "i")
def _(vm, n):
    if not -2 <= n <= 2:
        raise PSError("rangecheck")
    if n <= 0:
        _table(vm, "user", USER)["VMReclaim"] = n


# The distiller's parameters that are checked, and their defaults.
DISTILLER = {"CompressPages": True, "EmbedAllFonts": False, "SubsetFonts": True, "CompatibilityLevel": 1.7, "DownsampleColorImages": False, "DownsampleGrayImages": False, "DownsampleMonoImages": False, "ColorImageResolution": 150, "GrayImageResolution": 150, "MonoImageResolution": 300, "ColorImageDownsampleType": name("Average"), "GrayImageDownsampleType": name("Average"), "MonoImageDownsampleType": name("Average"), "ColorConversionStrategy": name("LeaveColorUnchanged"), "AutoRotatePages": name("None")}


@operator("setdistillerparams", "d")
def _(vm, d):
    kinds = lambda x: (int, float) if type(x) in (int, float) else (type(x),)
    for key, value in d.items():
        default = DISTILLER.get(getattr(key, "text", None))
        if default is not None and type(value) not in kinds(default):
            raise PSError("typecheck")
    held = vm.parameters.setdefault("distiller", {})
    for key, value in d.items():
        held[plain_text(key)] = value
        vm.events.append(("param", plain_text(key), syntax(value)))


@operator("currentdistillerparams")
def _(vm):
    d = vm.dictionary()
    for key, value in (DISTILLER | vm.parameters.get("distiller", {})).items():
        vm.define(d, key, value)
    vm.push(d)


