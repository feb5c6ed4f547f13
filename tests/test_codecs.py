import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.functions import codecs as c
from pagemill.vm import scanner

DATA = st.binary(max_size=700) | st.binary(min_size=1, max_size=3).map(lambda b: b * 900)


@settings(max_examples=80, deadline=None)
@given(DATA)
def test_round_trips(data):
    assert c.ascii_hex_decode(c.ascii_hex_encode(data))[0] == data
    assert c.ascii85_decode(c.ascii85_encode(data) + b"rest")[0] == data
    for record in (0, 7):
        packed = c.run_length_encode(data, record)
        assert c.run_length_decode(packed + b"x") == (data, len(packed))
    for early in (0, 1):
        packed = c.lzw_encode(data, early)
        assert c.lzw_decode(packed + b"x", early) == (data, len(packed))
    packed = c.flate_encode(data)
    assert c.flate_decode(packed + b"tail") == (data, len(packed))
    for predictor in (2, 12):
        assert c.unpredicted(c.predicted(data, predictor, 1, 8, 5), predictor, 1, 8, 5) == data
    assert c.cipher_decode(c.cipher_encode(data, c.EEXEC_KEY), c.EEXEC_KEY) == data


def test_forms():
    assert c.ascii_hex_decode(b"4 8 6>x") == (b"H`", 6)
    assert c.ascii85_decode(b"z~>") == (b"\0\0\0\0", 3)
    assert c.sub_file_decode(b"aXXbXXc", 0, b"XX") == (b"a", 3)
    assert c.sub_file_decode(b"aXXbXXc", 1, b"XX")[0] == b"aXX"
    assert c.encoded_numbers(bytes([149, 32, 0, 2, 0, 1, 255, 255])) == [1, -1]
    with pytest.raises(c.BadData):
        c.flate_decode(b"nonsense")
    png = zlib.compress(b"\x01\x01\x01\x01\x04\x01\x02\x03")
    assert c.unpredicted(c.flate_decode(png)[0], 15, 1, 8, 3)[:3] == b"\x01\x02\x03"
    assert c.jpeg_length(b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x04ab1\xff\0\xff\xd9zz") == 21 - 2


@pytest.mark.parametrize("word, value", [(b"12", 12), (b"-3.5", -3.5), (b"16#ff", 255), (b"36#zz", 1295), (b"8#9", None), (b"1e3", 1000.0), (b".", None), (b"16#", None), (b"2147483648", 2147483648.0), (b"1x", None)])
def test_numbers(word, value):
    assert scanner.number(word) == value


def test_tokens():
    kinds = [(k, v) for k, v, *_ in scanner.tokens(b"/a {1 (x\\051) <41> } % no\n//b << >> [")]
    assert kinds == [("literal", "a"), ("open", None), ("number", 1), ("string", b"x)"), ("string", b"A"), ("close", None), ("immediate", "b"), ("name", "<<"), ("name", ">>"), ("name", "[")]
    assert list(scanner.tokens(b"(ab"))[-1][:2] == ("error", "syntaxerror")


def test_base_85_by_groups(monkeypatch):
    data = bytes(range(256)) * 40 + b"\0" * 41 + b"xyz"
    whole = c.ascii85_encode(data)
    assert c.ascii85_decode(whole) == (data, len(whole))
    monkeypatch.setattr(c, "GROUPS", 3)
    assert c.ascii85_encode(data) == whole and c.ascii85_decode(whole) == (data, len(whole))
    for wrong in (b"abz~>", b"uuuuu~>", b"a~>", b"ab\xffde~>", b"!!!!!abcd~~>"):
        with pytest.raises(c.BadData):
            c.ascii85_decode(wrong)


def test_text_codecs_take_few_steps():
    """Work by the byte in Python took more than a second for each of these."""
    from time import process_time

    data = bytes(range(256)) * 8000
    before = process_time()
    for encode, decode in ((c.ascii_hex_encode, c.ascii_hex_decode), (c.ascii85_encode, c.ascii85_decode)):
        assert decode(encode(data))[0] == data
    assert process_time() - before < 2


def test_long_values_are_worked_on_in_parts(monkeypatch):
    import pyarrow as pa

    from pagemill.operators import programs as p

    monkeypatch.setattr(p, "PART_BYTES", 100)
    values = [b"x" * 60, b"y" * 60, None, b"", b"z" * 500, b"a", b"b"]
    batch = pa.record_batch([pa.array(range(7)), pa.array(values, pa.binary())], names=["id", "bytes"])
    parts = [x.column(1).to_pylist() for x in p._parts(batch)]
    assert sum(parts, []) == values and max(len(x) for x in parts) == 3
    assert all(len(x) == 1 or sum(len(v or b"") for v in x) <= 100 for x in parts)
    assert [x.num_rows for x in p._parts(batch.slice(0, 0))] == [0]
