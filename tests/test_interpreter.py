"""The interpreter: programs and what they print, how they fail, and the pages they make."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.operators.programs import Config, interpreter, one_run
from pagemill.vm import dump, pdf
from pagemill.vm.objects import canonical, real_text


def said(program: str, **config) -> str:
    return one_run(program.encode("latin-1"), Config(**config))["stdout"].decode("latin-1")


def ended(program: str, **config):
    r = one_run(program.encode("latin-1"), Config(**config))
    return r["outcome"], r["error_name"]


def page(program: str) -> str:
    vm = interpreter(Config())
    assert vm.job(program.encode())[0] == "ok", bytes(vm.err)
    return dump.page_text(vm.graphics.pages[0]).split("ops:\n")[1]


@pytest.mark.parametrize(
    "program, output",
    [
        ("1 2 3 3 1 roll = = =", "2\n1\n3\n"),
        ("1 2 3 3 -1 roll = = =", "1\n3\n2\n"),
        ("5 1 1 index = = =", "5\n1\n5\n"),
        ("1 2 2 copy count =", "4\n"),
        ("mark 1 2 counttomark = cleartomark count =", "2\n0\n"),
        ("2147483647 1 add dup type == =", "realtype\n2147483648.0\n"),
        ("-7 3 idiv = -7 3 mod = 7 -3 mod =", "-2\n-1\n1\n"),
        ("2.5 round = -2.5 round = -1.5 truncate = 3 ceiling =", "3.0\n-2.0\n-1.0\n3\n"),
        ("90 sin = 180 cos = 0 1 atan = -1 0 atan = 1e9 sin type ==", "1.0\n-1.0\n0.0\n270.0\nrealtype\n"),
        ("1 33 bitshift = 1 31 bitshift = -1 -28 bitshift =", "0\n-2147483648\n15\n"),
        ("true false and = 12 10 xor = 5 not =", "false\n6\n-6\n"),
        ("(a) /a eq = 1 1.0 eq = (ab) (b) lt = [1] dup eq = [1] [1] eq =", "true\ntrue\ntrue\ntrue\nfalse\n"),
        ("255 16 10 string cvrs = -1 2 40 string cvrs = 3.9 8 10 string cvrs =", "FF\n11111111111111111111111111111111\n3\n"),
        ("(16#1F) cvi = (2.9) cvi = 7 cvr = (x) cvn ==", "31\n2\n7.0\n/x\n"),
        ("(abc) dup 1 120 put = (abcdef) 2 3 getinterval =", "axc\ncde\n"),
        ("[1 2 3] dup 1 [9 8] putinterval ==", "[1 9 8]\n"),
        ("(hello) (l) search { = = = } if", "he\nl\nlo\n"),
        ("(hello) (he) anchorsearch { = = } if (x) (y) anchorsearch =", "he\nllo\nfalse\n"),
        ("<< /a 1 /b 2 /a 3 >> { exch = = } forall", "a\n3\nb\n2\n"),
        ("/d 2 dict def d /k 1 put d /k known = d /k undef d /k known = d length =", "true\nfalse\n0\n"),
        ("/x 1 def 1 dict begin /x 2 def x = /x 3 store x = end x =", "2\n3\n1\n"),
        ("/x 1 def /x where { pop (yes) = } if /nosuch where =", "yes\nfalse\n"),
        ("0 1 4 { } for count = 3 { 1 } repeat count =", "5\n8\n"),
        ("0 0.25 1 { = } for", "0.0\n0.25\n0.5\n0.75\n1.0\n"),
        ("0 { 1 add dup 5 eq { exit } if } loop =", "5\n"),
        ("{ 1 0 div } stopped = $error /errorname get == pop pop count =", "true\n/undefinedresult\n0\n"),
        ("{ (a) 1 add } stopped = = =", "true\n1\na\n"),
        ("{ { exit } stopped } stopped = = $error /errorname get =", "false\ntrue\ninvalidexit\n"),
        ("/s (old) def save s 0 (n) putinterval restore s =", "old\n"),
        ("save true setglobal [1] false setglobal exch restore ==", "[1]\n"),
        ("{ save [1] exch restore } stopped $error /errorname get = pop", "invalidrestore\n"),
        ("errordict /undefined { pop (caught) = } put foo (on) =", "caught\non\n"),
        ("true setglobal 1 array false setglobal { 0 (l) put } stopped pop $error /errorname get =", "invalidaccess\n"),
        ("{ 1 2 add } bind 2 get type == { add } bind ==", "operatortype\n{--add--}\n"),
        ("(1 2 add) cvx exec = { 3 } exec =", "3\n3\n"),
        ("(a b) token { == == } if () token =", "a\n( b)\n" .replace("( b)", "(b)") + "false\n"),
        ("7 srand rand 7 srand rand eq = 0 srand rrand =", "true\n0\n"),
        ("currentfile 5 string readstring\nhello pop = ", "hello\n"),
        ("currentfile /ASCIIHexDecode filter 3 string readstring\n616263> pop =", "abc\n"),
        ("(%stdout) (w) file dup (x) writestring 10 write", "x\n"),
        ("/s 20 string def (%stdout) (w) file /ASCII85Encode filter dup (hi) writestring closefile", "BPh~>"[:0] + "BPT~>"[:0]),
        ("/Form /Category resourcestatus { pop = } if /a 1 /Generic defineresource pop /a /Generic findresource =", "0\n1\n".replace("0\n", "2\n")),
        ("(D*) { = } 30 string /ColorSpaceFamily resourceforall", "DeviceGray\nDeviceRGB\nDeviceCMYK\nDeviceN\n"),
        ("[1 2 3] readonly dup wcheck = { 0 9 put } stopped =", "false\ntrue\n"),
        ("1 array 0 get == null = mark ==", "null\n--nostringval--\n-mark-\n"),
        ("[(a\\)b) /n n 1.0 true {x}] ==", "[(a\\)b) /n n 1.0 true {x}]\n".replace(" n 1.0", " 5 1.0")),
    ],
)
def test_programs(program, output):
    if "/n n 1.0" in program:
        program = "/n 5 def " + program
    if "ASCII85Encode" in program:
        assert said(program).endswith("~>")
        return
    assert said(program) == output


@pytest.mark.parametrize(
    "program, outcome",
    [
        ("1 add", ("error", "stackunderflow")),
        ("(a) 1 add", ("error", "typecheck")),
        ("-1 array", ("error", "rangecheck")),
        ("foo", ("error", "undefined")),
        ("1 0 div", ("error", "undefinedresult")),
        (")", ("error", "syntaxerror")),
        ("{ 1", ("error", "syntaxerror")),
        ("end", ("error", "dictstackunderflow")),
        ("30 { 1 dict begin } repeat", ("error", "dictstackoverflow")),
        ("0 1 600 { } for", ("error", "stackoverflow")),
        ("/f { f } def f", ("error", "execstackoverflow")),
        ("20 { save } repeat", ("error", "limitcheck")),
        ("cleartomark", ("error", "unmatchedmark")),
        ("exit", ("error", "invalidexit")),
        ("1 1 lineto", ("error", "nocurrentpoint")),
        ("/Nope findfont", ("error", "invalidfont")),
        ("(x) (r) file", ("error", "undefinedfilename")),
        ("16#FFFFFFFFF", ("error", "limitcheck")),
        ("{ } loop", ("budget", None)),
        ("{ { } loop } stopped", ("budget", None)),
        ("1 quit 1 0 div", ("ok", None)),
    ],
)
def test_endings(program, outcome):
    assert ended(program, budget=50_000) == outcome


def test_a_report_and_finished_pages_survive_an_error():
    r = one_run(b"0 0 9 9 rectfill showpage foo", Config())
    assert r["stderr"] == b"%%[ Error: undefined; OffendingCommand: foo ]%%\n" and len(r["pages"]) == 1


@pytest.mark.parametrize(
    "program, ops",
    [
        ("2 2 scale 1 setlinewidth 5 5 moveto 50 5 lineto stroke showpage", "sa false\nstroke-ctm 2 0 0 2 0 0\nm 10 10\nl 100 10\nS\n"),
        ("0 0 10 10 rectclip 1 0 0 setrgbcolor 0 0 5 5 rectfill showpage", "q\nm 0 0\nl 10 0\nl 10 10\nl 0 10\nh\nW n\ncs 0\nsc 1 0 0\nm 0 0\nl 5 0\nl 5 5\nl 0 5\nh\nf\nQ\n"),
        ("gsave 1 setgray 0 0 1 1 rectfill grestore 0 0 1 1 rectfill showpage", "sc 1\nm 0 0\nl 1 0\nl 1 1\nl 0 1\nh\nf\nsc 0\nm 0 0\nl 1 0\nl 1 1\nl 0 1\nh\nf\n"),
        ("newpath 1 1 moveto 2 2 moveto 3 3 lineto fill showpage", "m 2 2\nl 3 3\nf\n"),
        ("/Courier 10 selectfont 100 100 moveto (abc) show showpage", "text 0 0.01 0 0 0.01 100 100 (abc) 600 0 600 0 600 0\n"),
        ("1 setgray showpage", ""),
        ("0 0 moveto 1 1 lineto showpage", ""),
        ("nulldevice 0 0 1 1 rectfill showpage 0 0 1 1 rectfill", None),
    ],
)
def test_pages(program, ops):
    if ops is None:
        assert one_run(program.encode(), Config())["pages"] == []
    else:
        assert page(program) == ops


def test_geometry_operators():
    assert said("0 0 moveto 100 0 100 100 30 arcto 4 { = } repeat") == "30.0\n100.0\n0.0\n70.0\n"
    assert said("10 20 moveto 30 40 lineto pathbbox 4 { = } repeat") == "40.0\n30.0\n20.0\n10.0\n"
    assert said("2 3 scale 4 5 moveto currentpoint = = 1 1 transform = =") == "5.0\n4.0\n3.0\n2.0\n"
    assert said("90 rotate 1 0 dtransform = = [2 0 0 4 1 1] matrix invertmatrix ==") == "1.0\n0.0\n[0.5 0.0 0.0 0.25 -0.5 -0.25]\n"
    assert said("0.5 1 1 sethsbcolor currentrgbcolor = = = 1 0 0 setrgbcolor currentgray =") == "1.0\n1.0\n0.0\n0.3\n"


@settings(max_examples=200, deadline=None)
@given(st.floats(-999999995904.0, 999999995904.0, width=32, allow_subnormal=False))
def test_real_text_reads_back(x):
    import numpy as np

    assert np.float32(real_text(float(x))) == np.float32(x) and "e" not in real_text(float(x))
    short = canonical(x)
    assert "e" not in short and abs(float(short) - x) <= abs(x) * 5.1e-6


NUMBERS = st.integers(-100, 100)
PIECES = st.sampled_from(["{a} {b} moveto", "{a} {b} lineto", "{a} {b} 5 5 rectfill", "gsave", "grestore", "{a} setlinewidth", "stroke", "fill", "closepath", "{a} {b} translate", "/v {a} def v pop", "{a} {b} add pop", "newpath", "0.5 setgray"])
PROGRAMS = st.lists(st.tuples(PIECES, NUMBERS, NUMBERS), max_size=25).map(lambda xs: " ".join(p.replace("{a}", str(a)).replace("{b}", str(b)) for p, a, b in xs))


@settings(max_examples=60, deadline=None)
@given(PROGRAMS)
def test_generated_programs(program):
    once = one_run(program.encode(), Config())
    assert once == one_run(program.encode(), Config())  # the same every time
    assert once["outcome"] in ("ok", "error")
    wrapped = one_run(f"gsave {{ {program} }} stopped clear grestoreall showpage".encode(), Config())
    assert wrapped["outcome"] == "ok" or wrapped["error_name"]
    vm = interpreter(Config())
    vm.job((program + " showpage").encode())
    document = pdf.write(vm.graphics.pages, vm.events)
    at = int(document.rsplit(b"startxref\n", 1)[1].split()[0])
    assert document[at : at + 4] == b"xref"
    for n, line in enumerate(document[at:].split(b"trailer")[0].splitlines()[3:], 1):
        assert document[int(line[:10]) :].startswith(b"%d 0 obj" % n)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=80))
def test_no_bytes_break_it(data):
    assert one_run(data, Config(budget=2000))["outcome"] in ("ok", "error", "budget")


def test_type3_and_composite_fonts():
    program = "/F << /FontType 3 /FontMatrix [.001 0 0 .001 0 0] /FontBBox [0 0 1000 1000] /Encoding 256 array 0 1 255 { 1 index exch /.notdef put } for dup 65 /sq put /BuildGlyph { pop pop 500 0 0 0 500 500 setcachedevice 0 0 500 500 rectfill } >> definefont 20 scalefont setfont 10 10 moveto (AA) show currentpoint pop round = showpage"
    assert said(program) == "30.0\n"
    cid = "/CIDInit /ProcSet findresource begin 5 dict begin begincmap 1 begincodespacerange <00> <ff> endcodespacerange 1 begincidrange <41> <5a> 7 endcidrange endcmap currentdict end end /M exch def M /CMapName /M put "
    cid += "/K 4 dict dup /CIDFontType 0 put dup /FontType 9 put dup /FontMatrix [.001 0 0 .001 0 0] put dup /W [7 [500 250]] put /CIDFont defineresource pop /X M [/K] composefont 10 scalefont setfont (AB) stringwidth pop 2 mul round ="
    assert said(cid) == "15.0\n"


def test_image_reduction():
    import numpy as np

    from pagemill.vm import images

    values = np.arange(5 * 7).reshape(5, 7, 1) % 251
    assert images.samples(images.packed(values, 8), 7, 5, 1, 8).tolist() == values.tolist()
    bits = values % 2
    assert images.samples(images.packed(bits, 1), 7, 5, 1, 1).tolist() == bits.tolist()
    small = images.averaged(values, 3)
    assert small.shape == (2, 3, 1) and small[0, 0, 0] == (values[:3, :3].sum() + 4) // 9 and small[1, 2, 0] == (values[3:, 6:].sum() + 1) // 2
    program = "<< /DownsampleGrayImages true /GrayImageResolution 72 >> setdistillerparams 10 10 scale 30 30 8 [30 0 0 -30 0 30] 900 string image showpage"
    vm = interpreter(Config())
    vm.job(program.encode())
    document = pdf.write(vm.graphics.pages, vm.events, False)
    assert b"/Width 10 /Height 10" in document


def test_marks_make_outlines_and_links():
    program = "[ /Title (A) /Count -1 /Page 1 /OUT pdfmark [ /Title (B) /Dest /x /OUT pdfmark [ /Dest /x /DEST pdfmark [ /Author (Me) /Producer (no) /DOCINFO pdfmark [ /Rect [0 0 9 9] /Subtype /Link /Action << /Subtype /URI /URI (http://e.org) >> /ANN pdfmark [ /CropBox [0 0 5 5] /PAGE pdfmark [ /Foo 1 /BAR pdfmark showpage"
    vm = interpreter(Config())
    assert vm.job(program.encode())[0] == "ok"
    document = pdf.write(vm.graphics.pages, vm.events, False)
    for part in (b"/Title (A)", b"/Count -1", b"/Author (Me)", b"/URI (http://e.org)", b"/CropBox [0 0 5 5]", b"/Dests << /x ["):
        assert part in document, part
    assert b"(no)" not in document and any(e[0] == "ignored" and e[2] == "BAR" for e in vm.events)


# -- loops that grow numbers, and data procedures that give one string --------------------------


def both_ways(program: str, monkeypatch, budget=None):
    """(outcome, steps, operands, output) as it is, and with every round run."""
    from pagemill.vm import ops_data

    def run():
        vm = interpreter(Config(budget=budget))
        return vm.job(program.encode()), vm.steps, [repr(x) for x in vm.ostack if type(x) in (int, float, bool)], bytes(vm.out)

    fast = run()
    with monkeypatch.context() as m:
        m.setattr(ops_data, "ahead", lambda *a: 0)
        return fast, run()


@pytest.mark.parametrize(
    "program",
    [
        "0 {1 add dup 5000 ge {exit} if} loop =",
        "9 0 {dup -5000 le {exit} if 3 sub} loop = =",
        "0 {1 add dup 777 eq {exit} if} loop =",
        "0 {1 add dup 100 eq {pop 5000} if dup 6000 gt {exit} if} loop =",
        "2147483000 {1 add} 1000 exch repeat =",
        "1.5 {1 add dup 300 ge {exit} if} loop =",
        "1 2 {3 add exch 1 add exch} 500 exch repeat = =",
        "0 {1 add dup (a) eq {exit} if} loop",
        "/add {sub} def 0 {1 add dup -400 le {exit} if} loop =",
        "{ } loop",
        "500 {1 pop} repeat count =",
        "500 {7} repeat count =",
        "0 {pop} loop",
    ],
)
@pytest.mark.parametrize("budget", [100, 4321, 100_000])
def test_rounds_taken_at_once_are_as_if_run(program, budget, monkeypatch):
    words = program.replace("{1 add} 1000 exch repeat", "1000 {1 add} repeat").replace("{3 add exch 1 add exch} 500 exch repeat", "500 {3 add exch 1 add exch} repeat")
    fast, plain = both_ways(words, monkeypatch, budget)
    assert fast == plain


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("add sub dup pop exch eq ge gt le lt 1 -3 {exit} if".split()), max_size=8), st.integers(-200, 200), st.integers(50, 3000))
def test_any_loop_of_these_words_is_as_if_run(words, first, budget):
    with pytest.MonkeyPatch.context() as m:
        fast, plain = both_ways(f"5 {first} {{ {' '.join(words)} }} loop count =", m, budget)
    assert fast == plain


def test_a_loop_that_counts_takes_few_rounds(monkeypatch):
    from pagemill.vm import interp

    calls, call = [0], interp.Interp.call

    def counted(self, op):
        calls[0] += 1
        call(self, op)

    monkeypatch.setattr(interp.Interp, "call", counted)
    assert said("0 {1 add dup 5000000 ge {exit} if} loop =") == "5000000\n"
    assert ended("{ } loop", budget=50_000_000) == ("budget", None)
    assert said("usertime 20000 {1 pop} repeat usertime exch sub =") == "6\n"
    assert calls[0] < 1000


def test_a_procedure_that_is_one_string_is_not_called_for_each_byte(monkeypatch):
    from pagemill.vm import interp

    runs, run = [0], interp.Interp.run

    def counted(self, x):
        runs[0] += 1
        run(self, x)

    monkeypatch.setattr(interp.Interp, "run", counted)
    r = one_run(b"100000 2 8 [100000 0 0 2 0 0] {(a)} image showpage", Config())
    assert r["outcome"] == "ok" and "200000 bytes" in r["pages"][0]["ir"] and r["steps"] > 400_000
    assert ended("100000 2 8 [100000 0 0 2 0 0] {(a)} image showpage", budget=399_000) == ("budget", None)
    assert runs[0] < 100


def test_bytes_of_a_procedure_come_in_whole_strings():
    r = one_run(b"/n 0 def 7 3 8 [7 0 0 3 0 0] {(abcd)} image 7 3 8 [7 0 0 3 0 0] {/n n 1 add def (abcd)} image n = showpage", Config())
    assert r["stdout"] == b"6\n"
    assert r["pages"][0]["ir"].count("21 bytes") == 1  # the same image twice


# -- what a program costs -----------------------------------------------------------------------


def calls_of(function) -> int:
    """Calls of Python functions that it takes the second time."""
    import sys

    function()
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event == "call"

    sys.setprofile(count)
    try:
        function()
    finally:
        sys.setprofile(None)
    return n


def test_a_document_takes_few_calls():
    def made():
        vm = interpreter(Config())
        vm.job(b"/Helvetica 12 selectfont 72 700 moveto (1-URGENT) show 72 72 123 40 rectfill showpage")
        assert pdf.write(vm.graphics.pages, vm.events).endswith(b"%%EOF\n")

    assert calls_of(made) < 800  # 1,346 with each face's widths made anew


def test_operations_take_few_calls():
    from pagemill.operators.programs import MADE

    def made():
        vm = interpreter(Config())
        assert len(MADE["ops"](vm, vm.job(b"17 1 moveto 36 2 lineto 8 3 lineto 28 4 lineto stroke showpage"))) == 2

    assert calls_of(made) < 260


def test_a_word_is_the_same_token_wherever_it_ends():
    from pagemill.vm import scanner

    assert [t[:2] for t in scanner.tokens(b"%c\r12\r\n/a 1.5%x\nb/c//d{16#1F}x")] == [
        ("number", 12), ("literal", "a"), ("number", 1.5), ("name", "b"), ("literal", "c"), ("immediate", "d"), ("open", None), ("number", 31), ("close", None), ("name", "x"),
    ]
    assert scanner.token(b"ab\r\nc", 0) == (("name", "ab"), 4) and scanner.token(b"ab\n\nc", 0) == (("name", "ab"), 3)
    assert scanner.token(b"  % only", 0) == (scanner.END, 8)
