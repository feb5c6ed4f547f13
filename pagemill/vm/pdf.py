"""Pages as a PDF document."""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

from . import geometry as g
from . import images
from .dump import listed, nums
from .fonts import glyph_names, rule_width, standard_encoding
from .graphics import Page
from .objects import canonical, escaped


class Document:
    """Numbered objects, then a cross-reference table and a trailer."""

    def __init__(self, compress: bool = True) -> None:
        self.objects: list[bytes | None] = []
        self.compress = compress

    def reserve(self) -> int:
        self.objects.append(None)
        return len(self.objects)

    def put(self, body: str | bytes, number: int | None = None) -> int:
        number = number or self.reserve()
        self.objects[number - 1] = body if isinstance(body, bytes) else body.encode("latin-1", "replace")
        return number

    def stream(self, entries: str, data: bytes, number: int | None = None) -> int:
        if self.compress:
            data, entries = zlib.compress(data), entries + " /Filter /FlateDecode"
        head = f"<< {entries} /Length {len(data)} >>\nstream\n".encode("latin-1")
        return self.put(head + data + b"\nendstream", number)

    def bytes(self, root: int, info: int | None, version: str = "1.7") -> bytes:
        out = bytearray(b"%PDF-" + version.encode() + b"\n%\xe2\xe3\xcf\xd3\n")
        places = []
        for n, body in enumerate(self.objects, 1):
            places.append(len(out))
            out += f"{n} 0 obj\n".encode() + (body if body is not None else b"null") + b"\nendobj\n"
        at = len(out)
        out += f"xref\n0 {len(places) + 1}\n0000000000 65535 f \n".encode()
        out += b"".join(b"%010d 00000 n \n" % p for p in places)
        trailer = f"/Size {len(places) + 1} /Root {root} 0 R" + (f" /Info {info} 0 R" if info else "")
        return bytes(out + f"trailer\n<< {trailer} >>\nstartxref\n{at}\n%%EOF\n".encode())


def name_text(text: str) -> str:
    return "/" + "".join(c if c.isalnum() or c in "-_+." else f"#{ord(c):02X}" for c in text)


def space_text(doc: Document, s: tuple) -> str:
    kind = s[0]
    if kind in ("DeviceGray", "DeviceRGB", "DeviceCMYK"):
        return "/" + kind
    if kind == "CalGray":
        return f"[/CalGray << /WhitePoint {listed(s[1])} /BlackPoint {listed(s[2])} /Gamma {canonical(s[3])} >>]"
    if kind == "CalRGB":
        return f"[/CalRGB << /WhitePoint {listed(s[1])} /BlackPoint {listed(s[2])} /Gamma {listed(s[3])} /Matrix {listed(s[4])} >>]"
    if kind == "Lab":
        return f"[/Lab << /WhitePoint {listed(s[1])} /BlackPoint {listed(s[2])} /Range {listed(s[3])} >>]"
    if kind == "Indexed":
        return f"[/Indexed {space_text(doc, s[1])} {s[2]} <{s[3].hex()}>]"
    if kind in ("Separation", "DeviceN"):
        n, outs = (1 if kind == "Separation" else len(s[1])), {"DeviceGray": 1, "DeviceCMYK": 4}.get(s[2][0], 3)
        tint = doc.stream(f"/FunctionType 4 /Domain [{'0 1 ' * n}] /Range [{'0 1 ' * outs}]", s[3].encode("latin-1"))
        names = name_text(s[1]) if kind == "Separation" else "[" + " ".join(map(name_text, s[1])) + "]"
        return f"[/{kind} {names} {space_text(doc, s[2])} {tint} 0 R]"
    return "/Pattern" if len(s) < 2 else f"[/Pattern {space_text(doc, s[1])}]"


def path_text(path, back: tuple | None = None) -> list[str]:
    out = []
    for s in path:
        points = s[1:]
        if back is not None:
            points = [v for i in range(0, len(points), 2) for v in g.apply(back, points[i], points[i + 1])]
        out.append((nums(points) + " " if points else "") + s[0])
    return out


def content_text(ops: list[tuple], resources, states: dict) -> bytes:
    """Content stream; a colour is set for fills and strokes alike."""
    out: list[str] = []
    space = 0

    def state(key: str) -> str:
        return states.setdefault(key, f"GS{len(states)}")

    for op in ops:
        kind = op[0]
        if kind in ("q", "Q"):
            out.append(kind)
        elif kind in ("W", "W*"):
            out += [*path_text(op[1]), f"{kind} n"]
        elif kind in ("f", "f*"):
            out += [*path_text(op[1]), kind]
        elif kind == "S":
            m = tuple(op[2])
            back = g.inverse(m)
            if m == g.IDENTITY or back is None:
                out += [*path_text(op[1]), "S"]
            else:
                out += ["q", nums(m) + " cm", *path_text(op[1], back), "S", "Q"]
        elif kind == "op":
            out.append(f"/{state('/OP true /op true' if op[1] else '/OP false /op false')} gs")
        elif kind == "sa":
            out.append(f"/{state('/SA true' if op[1] else '/SA false')} gs")
        elif kind == "cs":
            space = op[1]
            out += [f"/CS{space} cs", f"/CS{space} CS"]
        elif kind == "sc":
            out += [nums(op[1]) + " scn", nums(op[1]) + " SCN"]
        elif kind == "pattern":
            lead = nums(op[2]) + " " if op[2] else ""
            out += [f"{lead}/P{op[1]} scn", f"{lead}/P{op[1]} SCN"]
        elif kind == "d":
            out.append(f"{listed(op[1])} {canonical(op[2])} d")
        elif kind in ("form", "Do"):
            out += ["q", nums(op[2]) + " cm", f"/{'Fm' if kind == 'form' else 'Im'}{op[1]} Do", "Q"]
        elif kind == "sh":
            out += ["q", nums(op[2]) + " cm", f"/Sh{op[1]} sh", "Q"]
        elif kind == "text":
            out += text_lines(op, resources.items["font"][op[1]])
        else:
            out.append(f"{canonical(op[1])} {kind}")
    return ("\n".join(out) + "\n").encode("latin-1", "replace")


def text_lines(op: tuple, font: dict) -> list[str]:
    """A run as one TJ, with the difference of each displacement to the glyph's width."""
    _, n, m, codes, steps, length, _ = op
    unit = font["matrix"] if font["kind"] == "type3" else (0.001, 0, 0, 0.001, 0, 0)
    back = g.inverse(unit) if font["kind"] == "type3" else (1000.0, 0.0, 0.0, 1000.0, 0.0, 0.0)
    matrix = g.then(back, m) if back else m
    parts, waiting = [], b""
    for i, (dx, _dy) in enumerate(steps):
        code = codes[i * length : (i + 1) * length]
        waiting += code
        usual = font["widths"].get(int.from_bytes(code, "big"), dx) if "widths" in font else dx
        if abs(usual - dx) > 0.005:
            parts += ["<" + waiting.hex() + ">", canonical((usual - dx) * unit[0] * 1000)]
            waiting = b""
    if waiting:
        parts.append("<" + waiting.hex() + ">")
    return ["BT", f"/F{n} 1 Tf", nums(matrix) + " Tm", "[" + " ".join(parts) + "] TJ", "ET"]


def function_text(doc: Document, f: dict) -> str:
    head = f"/FunctionType {f['type']} /Domain {listed(f['domain'])}" + (f" /Range {listed(f['range'])}" if f["range"] is not None else "")
    if f["type"] == 0:
        return f"{doc.stream(f'{head} /Size {listed(f["size"])} /BitsPerSample {f["bits"]} /Order {f["order"]} /Encode {listed(f["encode"])} /Decode {listed(f["decode"])}', f['samples'])} 0 R"
    if f["type"] == 2:
        return f"{doc.put(f'<< {head} /C0 {listed(f["c0"])} /C1 {listed(f["c1"])} /N {canonical(f["n"])} >>')} 0 R"
    parts = " ".join(function_text(doc, p) for p in f["parts"])
    return f"{doc.put(f'<< {head} /Functions [{parts}] /Bounds {listed(f["bounds"])} /Encode {listed(f["encode"])} >>')} 0 R"


def shading_object(doc: Document, s: dict) -> int:
    head = f"/ShadingType {s['type']} /ColorSpace {space_text(doc, s['space'])}"
    head += f" /Background {listed(s['background'])}" if s["background"] else ""
    head += f" /BBox {listed(s['box'])}" if s["box"] else ""
    head += " /AntiAlias true" if s["antialias"] else ""
    if s["functions"]:
        made = [function_text(doc, f) for f in s["functions"]]
        head += f" /Function {made[0] if len(made) == 1 else '[' + ' '.join(made) + ']'}"
    if s["type"] == 1:
        return doc.put(f"<< {head} /Domain {listed(s['domain'])} /Matrix {listed(s['matrix'])} >>")
    if s["type"] in (2, 3):
        extend = " ".join("true" if e else "false" for e in s["extend"])
        return doc.put(f"<< {head} /Coords {listed(s['coords'])} /Domain {listed(s['domain'])} /Extend [{extend}] >>")
    head += f" /BitsPerCoordinate {s['coordinate']} /BitsPerComponent {s['component']} /Decode {listed(s['decode'])}"
    head += f" /VerticesPerRow {s['row']}" if s["type"] == 5 else f" /BitsPerFlag {s['flag']}"
    return doc.stream(head, s["data"])


def font_object(doc: Document, f: dict, resources) -> int:
    if f["kind"] == "type3":
        procs = {}
        for glyph, d in sorted(f["glyphs"].items()):
            lead = f"{nums(d['width'])} {nums(d['box'])} d1\n" if d["box"] else f"{nums(d['width'])} d0\n"
            procs[glyph] = doc.stream("", lead.encode() + content_text(d["ops"], resources, {}))
        codes = sorted(f["used"])
        first, last = (codes[0], codes[-1]) if codes else (0, 0)
        widths = [f["glyphs"][f["used"][c]]["width"][0] if c in f["used"] else 0 for c in range(first, last + 1)]
        diff = " ".join(f"{c} {name_text(f['used'][c])}" for c in codes)
        return doc.put(f"<< /Type /Font /Subtype /Type3 /FontBBox {listed(f['box'])} /FontMatrix {listed(f['matrix'])} /CharProcs << {' '.join(f'{name_text(k)} {v} 0 R' for k, v in procs.items())} >> /Encoding << /Type /Encoding /Differences [{diff}] >> /FirstChar {first} /LastChar {last} /Widths {listed(widths)} >>")
    if f["kind"] == "composite":
        inner = doc.put(f"<< /Type /Font /Subtype /CIDFontType0 /BaseFont {name_text(f['name'])} /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> >>")
        return doc.put(f"<< /Type /Font /Subtype /Type0 /BaseFont {name_text(f['name'])} /Encoding /Identity-{'V' if f['wmode'] else 'H'} /DescendantFonts [{inner} 0 R] >>")
    diff = f.get("diff") or f.get("encoding") or {}
    encoding = f" /Encoding << /Type /Encoding /Differences [{' '.join(f'{c} {name_text(n)}' for c, n in sorted(diff.items()))}] >>" if diff else ""
    if diff:
        encoding += f" /ToUnicode {doc.stream('', to_unicode(diff))} 0 R"
    shown = sorted(f.get("shown", ()))
    listed_widths = f" /FirstChar {shown[0]} /LastChar {shown[-1]} /Widths {listed([f['widths'].get(c, 0) if c in f['shown'] else 0 for c in range(shown[0], shown[-1] + 1)])}" if shown else ""
    return doc.put(f"<< /Type /Font /Subtype /Type1 /BaseFont {name_text(f['name'])}{encoding}{listed_widths} >>")


def to_unicode(names: dict[int, str]) -> bytes:
    """A CMap from codes to the characters of their glyphs, where a glyph's name says which."""
    known = glyph_names()
    pairs = [(c, known[n]) for c, n in sorted(names.items()) if n in known]
    out = ["/CIDInit /ProcSet findresource begin", "12 dict begin", "begincmap", "/CMapName /Unicode def", "/CMapType 2 def", "1 begincodespacerange", "<00> <ff>", "endcodespacerange"]
    for a in range(0, len(pairs), 100):
        part = pairs[a : a + 100]
        out += [f"{len(part)} beginbfchar", *[f"<{c:02x}> <{t.encode('utf-16-be').hex()}>" for c, t in part], "endbfchar"]
    return "\n".join([*out, "endcmap", "end", "end", ""]).encode()


def widths_of(f: dict) -> dict[int, float]:
    if f["kind"] == "type3":
        return {c: f["glyphs"][n]["width"][0] for c, n in f["used"].items()}
    usual, other = _standard_widths(f["name"]), f.get("diff", {}) | f.get("encoding", {})
    return usual | {c: float(rule_width(f["name"], n)) for c, n in other.items()} if other else usual


@lru_cache(maxsize=64)
def _standard_widths(face: str) -> dict[int, float]:
    return {c: float(rule_width(face, n)) for c, n in enumerate(standard_encoding())}


def resource_text(doc: Document, resources, ops_of: list) -> tuple[str, list[bytes]]:
    """(reference to the resource dictionary, contents); the contents are written first, as they fill the states."""
    states: dict[str, str] = {}
    items, out = resources.items, []
    for f in items["font"]:
        if f["kind"] != "composite":
            f["widths"] = widths_of(f)
            f["shown"] = set()
    for ops in (*ops_of, *(x["ops"] for kind in ("form", "pattern") for x in items[kind] if "ops" in x)):
        for op in ops:
            if op[0] == "text" and "shown" in items["font"][op[1]]:
                items["font"][op[1]]["shown"].update(op[3])
    table = lambda key, letter, numbers: out.append(f"/{key} << {' '.join(f'/{letter}{i} {n}' for i, n in enumerate(numbers))} >>")
    if items["cs"]:
        table("ColorSpace", "CS", [space_text(doc, s) for s in items["cs"]])
    if items["shading"]:
        shadings = [shading_object(doc, s) for s in items["shading"]]
        table("Shading", "Sh", [f"{n} 0 R" for n in shadings])
    if items["font"]:
        table("Font", "F", [f"{font_object(doc, f, resources)} 0 R" for f in items["font"]])
    shared = doc.reserve()
    if items["pattern"]:
        made = []
        for p in items["pattern"]:
            if "shading" in p:
                made.append(doc.put(f"<< /Type /Pattern /PatternType 2 /Shading {shadings[p['shading']]} 0 R /Matrix {listed(p['matrix'])} >>"))
            else:
                made.append(doc.stream(f"/Type /Pattern /PatternType 1 /PaintType {p['paint']} /TilingType {p['tiling']} /BBox {listed(p['box'])} /XStep {canonical(p['step'][0])} /YStep {canonical(p['step'][1])} /Matrix {listed(p['matrix'])} /Resources {shared} 0 R", content_text(p["ops"], resources, states)))
        table("Pattern", "P", [f"{n} 0 R" for n in made])
    objects = [f"/Fm{i} {doc.stream(f'/Type /XObject /Subtype /Form /BBox {listed(f["box"])} /Resources {shared} 0 R', content_text(f['ops'], resources, states))} 0 R" for i, f in enumerate(items["form"])]
    for i, im in enumerate(items["img"]):
        head = f"/Type /XObject /Subtype /Image /Width {im['w']} /Height {im['h']} /BitsPerComponent {im['bits']} /Decode {listed(im['decode'])}"
        head += " /ImageMask true" if im["mask"] else f" /ColorSpace {space_text(doc, im['space'])}"
        head += " /Interpolate true" if im["interpolate"] else ""
        if im.get("stencil"):
            w, h, decode, data = im["stencil"]
            head += f" /Mask {doc.stream(f'/Type /XObject /Subtype /Image /ImageMask true /Width {w} /Height {h} /BitsPerComponent 1 /Decode {listed(decode)}', data)} 0 R"
        if im.get("key"):
            key = im["key"] if len(im["key"]) == len(im["decode"]) else [v for k in im["key"] for v in (k, k)]
            head += f" /Mask {listed(key)}"
        objects.append(f"/Im{i} {doc.stream(head, im['data'])} 0 R")
    if objects:
        out.append(f"/XObject << {' '.join(objects)} >>")
    contents = [content_text(ops, resources, states) for ops in ops_of]
    if states:
        out.append("/ExtGState << " + " ".join(f"/{label} << /Type /ExtGState {key} >>" for key, label in states.items()) + " >>")
    doc.put(f"<< {' '.join(out)} >>", shared)
    return f"{shared} 0 R", contents


def string_text(value) -> str:
    text = str(value)
    return "(" + escaped(text[1:-1] if text.startswith("(") and text.endswith(")") else text) + ")"


def destination(e: dict, pages: list[int]) -> str | None:
    if isinstance(e.get("Dest"), str):
        return f"/Dest {name_text(e['Dest'].lstrip('/'))}"
    action = e.get("Action")
    if isinstance(action, dict) and "URI" in action:
        return f"/A << /S /URI /URI {string_text(action['URI'])} >>"
    n = e.get("Page", 1)
    if isinstance(n, int) and 1 <= n <= len(pages):
        return f"/Dest [{pages[n - 1]} 0 R {view_text(e.get('View'))}]"
    return None


def view_text(v) -> str:
    if not isinstance(v, list) or not v:
        return "/Fit"
    return " ".join([str(v[0]), *["null" if x is None else canonical(x) for x in v[1:]]])


def outline(doc: Document, marks: list[dict], pages: list[int]) -> int | None:
    """The tree of bookmarks: a count's absolute value says how many of the marks after it lie below it."""
    if not marks:
        return None
    root = doc.reserve()
    at = 0

    def level(parent: int, n: int | None) -> tuple[list[int], int]:
        nonlocal at
        items, visible = [], 0
        while at < len(marks) and (n is None or len(items) < n):
            m, number = marks[at], doc.reserve()
            at += 1
            count = m.get("Count", 0) if isinstance(m.get("Count", 0), int) else 0
            kids, below = level(number, abs(count)) if count else ([], 0)
            items.append((number, m, kids, below, count))
            visible += 1 + (below if count > 0 else 0)
        numbers = [i[0] for i in items]
        for k, (number, m, kids, below, count) in enumerate(items):
            links = f"/Title {string_text(m.get('Title', ''))} /Parent {parent} 0 R"
            links += f" /Prev {numbers[k - 1]} 0 R" if k else ""
            links += f" /Next {numbers[k + 1]} 0 R" if k + 1 < len(items) else ""
            links += f" /First {kids[0]} 0 R /Last {kids[-1]} 0 R /Count {below if count > 0 else -below}" if kids else ""
            doc.put(f"<< {links} {destination(m, pages) or ''} >>", number)
        return numbers, visible

    numbers, visible = level(root, None)
    doc.put(f"<< /Type /Outlines /First {numbers[0]} 0 R /Last {numbers[-1]} 0 R /Count {visible} >>", root)
    return root


def write(pages: list[Page], events: list[tuple], compress: bool = True) -> bytes:
    """The document of a run's pages and document marks."""
    doc = Document(compress)
    root, tree = doc.reserve(), doc.reserve()
    numbers = [doc.reserve() for _ in pages]
    marks = [(kind, entries, page) for tag, page, kind, entries in (e for e in events if len(e) == 4) if tag == "mark"]
    defaults = {k: v for kind, e, _ in marks if kind == "PAGES" for k, v in e.items()}
    policy = {e[1]: e[2] for e in events if e[0] == "param"}
    for i, (page, number) in enumerate(zip(pages, numbers, strict=True)):
        for k, least in images.placements(page).items():
            page.resources.items["img"][k] = images.reduced(page.resources.items["img"][k], least, policy)
        refs, contents = resource_text(doc, page.resources, [page.content.ops])
        body = doc.stream("", contents[0])
        entries = f"/Type /Page /Parent {tree} 0 R /MediaBox {listed(page.media)} /Resources {refs} /Contents {body} 0 R"
        own = defaults | {k: v for kind, e, p in marks if kind == "PAGE" and p == i for k, v in e.items()}
        if isinstance(own.get("CropBox"), list):
            entries += f" /CropBox {listed(own['CropBox'])}"
        if isinstance(own.get("Rotate"), int):
            entries += f" /Rotate {own['Rotate']}"
        links = []
        for a in page.annotations:
            e = a["entries"]
            extra = f" /Border {listed(e['Border'][:3])}" if isinstance(e.get("Border"), list) else ""
            extra += f" /C {listed(e['Color'])}" if isinstance(e.get("Color"), list) else ""
            extra += f" /Contents {string_text(e['Contents'])}" if "Contents" in e else ""
            links.append(doc.put(f"<< /Type /Annot /Subtype /Link /Rect {listed(a['box'])} {destination(e, numbers) or ''}{extra} >>"))
        if links:
            entries += f" /Annots [{' '.join(f'{n} 0 R' for n in links)}]"
        doc.put(f"<< {entries} >>", number)
    doc.put(f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{n} 0 R' for n in numbers)}] >>", tree)
    catalog = f"/Type /Catalog /Pages {tree} 0 R"
    named = {}
    for kind, e, page in marks:
        if kind == "DEST" and isinstance(e.get("Dest"), str):
            n = e.get("Page", page + 1)
            if isinstance(n, int) and 1 <= n <= len(numbers):
                named[e["Dest"].lstrip("/")] = f"[{numbers[n - 1]} 0 R {view_text(e.get('View'))}]"
    if named:
        catalog += f" /Dests << {' '.join(f'{name_text(k)} {v}' for k, v in sorted(named.items()))} >>"
    tops = outline(doc, [e for kind, e, _ in marks if kind == "OUT"], numbers)
    if tops:
        catalog += f" /Outlines {tops} 0 R"
    shown = {k: v for kind, e, _ in marks if kind == "DOCVIEW" for k, v in e.items()}
    for key in ("PageMode", "PageLayout"):
        if isinstance(shown.get(key), str):
            catalog += f" /{key} {name_text(shown[key].lstrip('/'))}"
    info = {k: v for kind, e, _ in marks if kind == "DOCINFO" for k, v in e.items() if k != "Producer"}
    held = doc.put("<< " + " ".join(f"{name_text(k)} {string_text(v)}" for k, v in info.items()) + " >>") if info else None
    doc.put(f"<< {catalog} >>", root)
    level = policy.get("CompatibilityLevel", "1.7")
    return doc.bytes(root, held, level if re.fullmatch(r"1\.[3-7]", level) else "1.7")
