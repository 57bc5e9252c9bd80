"""Sets of bytes or code points, their algebra, and the regular-expression classes they become."""

from __future__ import annotations

from collections.abc import Iterable

#: A set as sorted, disjoint, inclusive ranges.
Ranges = tuple[tuple[int, int], ...]


def ranges(*parts: int | tuple[int, int] | str) -> Ranges:
    """From single values, inclusive ranges and the characters of strings."""
    found: list[tuple[int, int]] = []
    for p in parts:
        if isinstance(p, str):
            found += [(ord(c), ord(c)) for c in p]
        else:
            found.append((p, p) if isinstance(p, int) else p)
    return _merge(found)


def _merge(found: Iterable[tuple[int, int]]) -> Ranges:
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return tuple(out)


def union(*sets: Ranges) -> Ranges:
    return _merge(r for s in sets for r in s)


def difference(one: Ranges, two: Ranges) -> Ranges:
    out = list(one)
    for a, b in two:
        out = [piece for x, y in out for piece in ((x, min(y, a - 1)), (max(x, b + 1), y)) if piece[0] <= piece[1]]
    return _merge(out)


def complement(s: Ranges, top: int) -> Ranges:
    """Within 0..top."""
    return difference(((0, top),), s)


def size(s: Ranges) -> int:
    return sum(b - a + 1 for a, b in s)


def _item(c: int) -> str:
    if chr(c).isascii() and chr(c).isalnum():
        return chr(c)
    return rf"\x{{{c:x}}}"


def body(s: Ranges) -> str:
    """The inside of a class, read alike by Java and RE2."""
    return "".join(_item(a) if a == b else f"{_item(a)}-{_item(b)}" for a, b in s)


def regex(s: Ranges) -> str:
    return f"[{body(s)}]"


def negated(s: Ranges) -> str:
    return f"[^{body(s)}]"


# The sets that the lexer's rules name.
WHITESPACE = ranges(0x09, 0x0A, 0x0C, 0x0D, 0x20)
LETTERS = ranges((0x41, 0x5A), (0x61, 0x7A))
ALPHANUMERIC = union(LETTERS, ranges((0x30, 0x39)))
NAME = union(ALPHANUMERIC, ranges("!"))
SURROGATES = ranges((0xD800, 0xDFFF))
NON_CHARACTERS = ranges((0xFDD0, 0xFDEF), *((p << 16 | 0xFFFE, p << 16 | 0xFFFF) for p in range(17)))
CONTROLS = ranges((0x7F, 0x9F))
