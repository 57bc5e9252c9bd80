import codecs
import random

import pytest
from pyspark.sql import functions as F

from markloom.functions import decode

# Bytes, whether something comes out, the byte at which the error shows (0: none), the code point.
VECTORS = [
    ("00", True, 0, 0x0000), ("7F", True, 0, 0x007F), ("C280", True, 0, 0x0080), ("DFBF", True, 0, 0x07FF),
    ("E0A080", True, 0, 0x0800), ("EFBFBF", True, 0, 0xFFFF), ("F0908080", True, 0, 0x10000), ("F48FBFBF", True, 0, 0x10FFFF),
    ("C080", False, 2, None), ("C1BF", False, 2, None), ("E08080", False, 3, None), ("F0808080", False, 4, None),
    ("C220", False, 2, None), ("E228A1", False, 2, None), ("F0288CBC", False, 2, None), ("C2", False, 0, None),
    ("E282", False, 0, None), ("F09080", False, 0, None), ("F5", False, 0, None), ("F6", False, 0, None),
    ("F7", False, 0, None), ("F8", False, 1, None), ("F9", False, 1, None), ("FA", False, 1, None), ("FB", False, 1, None),
    ("FC", False, 1, None), ("FD", False, 1, None), ("FE", False, 1, None), ("FF", False, 1, None),
]
RESYNC = [("C241", ""), ("E228A141", "A"), ("F528414243", "ABC"), ("F490808041", "A"), ("F7BFBFBF41", "A"), ("EDA08041", "A"), ("F480808041", "\U00100000A"), ("EFBBBF41", "﻿A")]


def run(spark, data):
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(data)], "i int, b binary")
    c = F.col("b")
    rows = df.select("i", decode.utf8_decode(c), decode.utf8_error_pos(c), decode.utf8_valid(c)).collect()
    return [tuple(r)[1:] for r in sorted(rows)]


def test_vectors(spark):
    got = run(spark, [bytes.fromhex(h) for h, *_ in VECTORS])
    for (text, pos, _), (h, ok, at, point) in zip(got, VECTORS, strict=True):
        assert text == (chr(point) if ok else ""), h
        assert pos == at, h


def test_resync(spark):
    got = run(spark, [bytes.fromhex(h) for h, _ in RESYNC])
    assert [g[0] for g in got] == [t for _, t in RESYNC]


def by_byte(data):
    """Decodes a byte at a time."""
    out, pos, need, seen = [], 0, 0, b""
    for i, b in enumerate(data, 1):
        wrong = False
        if need:
            if b & 0xC0 == 0x80:
                seen += bytes([b])
                need -= 1
                if not need:
                    try:
                        out.append(codecs.decode(seen, "utf-8"))
                    except UnicodeDecodeError:
                        wrong = True
            else:
                need, wrong = 0, True
        elif b < 0x80:
            out.append(chr(b))
        elif 0xC0 <= b < 0xF8:
            need, seen = (1 if b < 0xE0 else 2 if b < 0xF0 else 3), bytes([b])
        else:
            wrong = True
        if wrong and not pos:
            pos = i
    return "".join(out), pos


def test_random_bytes(spark):
    r = random.Random(5)
    pool = bytes([0x41, 0x7F, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC0, 0xC2, 0xDF, 0xE0, 0xE1, 0xED, 0xEF, 0xF0, 0xF1, 0xF4, 0xF5, 0xF8, 0xFF])
    data = [bytes(r.choice(pool) for _ in range(r.randint(0, 12))) for _ in range(600)]
    for (text, pos, valid), b in zip(run(spark, data), data, strict=True):
        assert (text, pos) == by_byte(b), b.hex()
        try:
            b.decode()
            assert valid
        except UnicodeDecodeError:
            assert not valid


def test_null_and_long(spark):
    df = spark.createDataFrame([(None,), (bytearray("é".encode() * 100_000 + b"\xff"),)], "b binary")
    rows = df.select(F.length(decode.utf8_decode(F.col("b"))), decode.utf8_error_pos(F.col("b"))).collect()
    assert {tuple(r) for r in rows} == {(None, None), (100_000, 200_001)}


@pytest.mark.parametrize("size", [16, 4, 1, 0])
def test_file_round_trip(spark, tmp_path, size):
    from markloom.sources import binary_files

    (tmp_path / "x.bin").write_bytes(bytes(range(size)))
    row = binary_files(spark, str(tmp_path)).first()
    if not size:  # Spark plans no split for an empty file, so there is no row
        assert row is None
        return
    assert bytes(row.content) == bytes(range(size)) and row.length == size


def test_missing_file_raises(spark, tmp_path):
    from markloom.sources import binary_files

    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        binary_files(spark, str(tmp_path / "nothing")).collect()
