"""Sequence matching: patterns of mandatory and optional elements over bytes or code points.

The matcher is incremental and has rules of its own: a mismatch at a mandatory element consumes the value and
starts over (the value isn't tried as a first element); an optional element takes any one value; a completed match
starts over; matches never overlap. A scan is thus one alternation: a whole match, or a prefix with the value that
breaks it, or a run of values that can't begin one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from markloom.functions import classes as c
from markloom.functions.decode import as_latin

_BYTE_TOP, _POINT_TOP = 0xFF, 0x10FFFF


@dataclass(frozen=True)
class Element:
    values: c.Ranges
    optional: bool = False


@dataclass(frozen=True)
class Pattern:
    name: str
    domain: str  # "byte" or "codepoint"
    elements: tuple[Element, ...]

    @property
    def top(self) -> int:
        return _BYTE_TOP if self.domain == "byte" else _POINT_TOP

    def _any(self) -> c.Ranges:
        return ((0, self.top),)

    def parts(self) -> list[c.Ranges]:
        """What each element takes."""
        return [self._any() if e.optional else e.values for e in self.elements]


def _pattern(name: str, *elements: str | int | c.Ranges | Element, domain: str = "byte") -> Pattern:
    return Pattern(name, domain, tuple(e if isinstance(e, Element) else Element(e if isinstance(e, tuple) else c.ranges(e)) for e in elements))


def _points(name: str, *elements) -> Pattern:
    return _pattern(name, *elements, domain="codepoint")


# The catalogue of named patterns.
CATALOGUE: tuple[Pattern, ...] = (
    _pattern("UTF16BEBOM", 0xFE, 0xFF),
    _pattern("UTF16LEBOM", 0xFF, 0xFE),
    _pattern("UTF8BOM", 0xEF, 0xBB, 0xBF),
    _pattern("UTF16BEXML", 0x00, 0x3C, 0x00, 0x3F, 0x00, 0x78),
    _pattern("UTF16LEXML", 0x3C, 0x00, 0x3F, 0x00, 0x78, 0x00),
    _pattern("OPENCOMMENT", *"<!--"),
    _pattern("CLOSECOMMENT", *"-->"),
    _pattern("OPENMETA", "<", "Mm", "Ee", "Tt", "Aa", c.union(c.WHITESPACE, c.ranges("/"))),
    _pattern("THREEC", "<", Element(c.ranges("/"), optional=True), c.LETTERS),
    _pattern("ESQ", "<", "!/?"),
    _pattern("CLOSETAG", ">"),
    _pattern("SKIPSEQUENCE", c.union(c.WHITESPACE, c.ranges(">"))),
    _pattern("GETATTRSKIP", c.union(c.WHITESPACE, c.ranges("/"))),
    _pattern("GETATTREQ", "="),
    _pattern("GETATTRIFSPACES", c.WHITESPACE),
    _pattern("GETATTRBYTEABORT", "Mm"),
    _pattern("GETATTRMAIUSCLETTERS", c.ranges((0x41, 0x5A))),
    _pattern("GETATTRQUOTE", "\"'"),
    _pattern("XMLOPENTAG", *"<?xml"),
    _pattern("XMLENCODING", *"encoding"),
    _pattern("XMLG", "g"),
    _pattern("XMLSPACEORCONTROL", c.ranges((0x00, 0x20))),
    _pattern("SPACESANDSEMICOLON", c.union(c.WHITESPACE, c.ranges(";"))),
    _points("SURROGATES", c.SURROGATES),
    _points("NON_CHARACTER", c.NON_CHARACTERS),
    _points("CONTROL", c.CONTROLS),
    _points("CRLF", 0x0D, 0x0A),
    _points("CR", 0x0D),
    _points("WHITESPACES", c.WHITESPACE),
)
BY_NAME = {p.name: p for p in CATALOGUE}


def scan_regex(p: Pattern) -> str:
    """The scan's alternation; group 1 is a whole match."""
    parts = p.parts()
    whole = "".join(map(c.regex, parts))
    broken = [
        "".join(map(c.regex, parts[:k])) + c.regex(c.complement(parts[k], p.top))
        for k in range(len(parts) - 1, 0, -1)
        if not p.elements[k].optional
    ]
    return "|".join([f"({whole})", *broken, f"{c.regex(c.complement(parts[0], p.top))}+"])


def prefix_regex(p: Pattern) -> str:
    """A proper prefix of the pattern, whole."""
    parts = p.parts()
    return r"^(?:" + "|".join("".join(map(c.regex, parts[:k])) for k in range(1, len(parts))) + r")\z"


def _view(p: Pattern, value: Column) -> Column:
    return as_latin(value) if p.domain == "byte" else value


def _impossible(p: Pattern) -> bool:
    """Surrogates are in no Spark string, and no class of a regex can name them."""
    return any(c.size(c.difference(e.values, c.SURROGATES)) == 0 for e in p.elements)


def match_count(p: Pattern, value: Column) -> Column:
    """Completed matches in binary (byte patterns) or text."""
    if _impossible(p):
        return F.when(value.isNotNull(), F.lit(0))
    if len(p.elements) == 1:  # nothing can break: a plain count
        return F.regexp_count(_view(p, value), F.lit(c.regex(p.parts()[0])))
    return F.size(F.filter(F.regexp_extract_all(_view(p, value), F.lit(scan_regex(p)), F.lit(1)), lambda x: x != ""))


def match_result(p: Pattern, value: Column) -> Column:
    """What the matcher says to the last value: TRUE, PENDING or FALSE; null for no value."""
    if _impossible(p):
        return F.when(F.length(value) > 0, "FALSE")
    if len(p.elements) == 1:  # nothing is pending: the last value decides
        last = _view(p, F.substring(value, -1, 1))
        return F.when(F.length(value) > 0, F.when(last.rlike(c.regex(p.parts()[0])), "TRUE").otherwise("FALSE"))
    text = _view(p, value)
    # a pending prefix is left over at the end, where no alternative takes it
    pending = prefix_regex(p)
    last = F.element_at(F.regexp_extract_all(text, F.lit(f"{scan_regex(p)}|{pending.removeprefix('^')}"), F.lit(0)), -1)
    done = last.rlike("^(?:" + "".join(map(c.regex, p.parts())) + r")\z")
    return F.when(F.length(text) > 0, F.when(done, "TRUE").when(last.rlike(pending), "PENDING").otherwise("FALSE"))
