"""UTF-8 decoding under a fixed policy for malformed input, inside Catalyst.

A malformed sequence is deleted, with the byte at which the error shows; decoding goes on behind it. A sequence
that the end cuts short vanishes without an error. A byte order mark is an ordinary character.

Bytes are seen as ISO-8859-1 text (byte = code point), split by one alternation of well-formed and malformed units.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_C, _N, _A = r"[\x80-\xbf]", r"[^\x80-\xbf]", r"[\x00-\xff]"
VALID = (
    rf"[\x00-\x7f]|[\xc2-\xdf]{_C}|\xe0[\xa0-\xbf]{_C}|\xed[\x80-\x9f]{_C}|[\xe1-\xec\xee\xef]{_C}{_C}"
    rf"|\xf0[\x90-\xbf]{_C}{_C}|\xf4[\x80-\x8f]{_C}{_C}|[\xf1-\xf3]{_C}{_C}{_C}"
)
INVALID = (
    rf"[\xc0-\xdf](?:{_A}|\z)|[\xe0-\xef](?:{_N}|{_C}{_A}|{_C}?\z)"
    rf"|[\xf0-\xf7](?:{_N}|{_C}{_N}|{_C}{_C}{_A}|{_C}{{0,2}}\z)|[\x80-\xbf\xf8-\xff]"
)
#: A unit that ends with the input before its error could show.
CUT_SHORT = rf"^(?:[\xc0-\xdf]|[\xe0-\xef]{_C}?|[\xf0-\xf7]{_C}{{0,2}})\z"


def as_latin(content: Column) -> Column:
    """Bytes as text of the same length."""
    return F.decode(content, "ISO-8859-1")


def utf8_decode(content: Column) -> Column:
    """Binary to text; never null for non-null input, never fails."""
    kept = F.regexp_replace(as_latin(content), F.lit(f"({VALID})|{INVALID}"), F.lit("$1"))
    return F.decode(F.encode(kept, "ISO-8859-1"), "UTF-8")


def utf8_valid(content: Column) -> Column:
    return F.is_valid_utf8(content)


def utf8_error_pos(content: Column) -> Column:
    """1-based index of the byte at which the first error shows; 0 for none."""
    units = F.regexp_extract_all(as_latin(content), F.lit(rf"[\x00-\x7f]+|{VALID}|{INVALID}"), F.lit(0))
    start = F.struct(F.lit(0).alias("pos"), F.lit(False).alias("found"))

    def step(acc: Column, unit: Column) -> Column:
        wrong = ~unit.rlike(rf"^(?:[\x00-\x7f]+|{VALID})\z") & ~unit.rlike(CUT_SHORT)
        return F.when(acc["found"], acc).otherwise(F.struct((acc["pos"] + F.length(unit)).alias("pos"), wrong.alias("found")))

    end = F.aggregate(units, start, step)
    return F.when(content.isNotNull(), F.when(end["found"], end["pos"]).otherwise(0))
