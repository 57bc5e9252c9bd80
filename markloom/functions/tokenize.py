"""Markup tokens from text, as regular expressions and array functions.

The dialect is small: attribute values are unquoted letters and digits, names may hold `!`, there are no comments,
entities or raw-text elements. A document that leaves the dialect is reported (code and offset); the tokens before
the failing tag stand.

A text is split by one alternation into whole tags, text runs and a bare `<`. The first bare `<` is the failing tag,
or a tag that the end of the document cuts short; what is behind it isn't looked at.

Attributes repeat possessively (`*+`): the engine then loops where it would else go one call deeper for each, so a tag
may have any number of them. Nothing is lost: an attribute with blanks behind it never has to be given back, since what
may follow those blanks is spelled out in its own alternative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom.functions import classes as c

W, L, B = c.regex(c.WHITESPACE), c.regex(c.ALPHANUMERIC), c.regex(c.NAME)
_w, _l, _b = c.body(c.WHITESPACE), c.body(c.ALPHANUMERIC), c.body(c.NAME)
#: An attribute that others, or the end, may follow.
_A = rf"{L}+{W}*={W}*{L}+{W}+"
TAG = rf"<{W}*(?:/{W}*)?{B}+(?:{W}*/?>|{W}+(?:{_A})*+(?:{L}*/?>|{L}+{W}*={W}*{L}*{W}*/?>))"
LEXEME = rf"{TAG}|<|[^<]+"
HEAD = rf"^<{W}*(?:/{W}*)?{B}+"
ATTRIBUTE = rf"(?:{L}+){W}*={W}*{L}*|{L}+/?>"
KINDS = ("OPENTAG", "TAGNAME", "ATTRNAME", "ATTRVALUE", "CLOSETAG", "SELFCLOSETAG", "TEXTCONTENT")

_H = rf"<{W}*(?:/{W}*)?{B}+"
_P = rf"{_H}{W}+(?:{_A})*+{L}+"
#: Code of an error and what leads to the character where it shows, from the bare `<`. At most one fits.
ERRORS: tuple[tuple[str, str], ...] = (
    ("BAD_TAG_START", rf"^<{W}*[^{_b}{_w}/]"),
    ("EMPTY_TAG_NAME", rf"^<{W}*/{W}*[^{_b}{_w}]"),
    ("EMPTY_ATTR_NAME", rf"^{_H}{W}*="),
    ("BAD_ATTR_NAME_CHAR", rf"^{_H}(?:{W}+[^{_l}=>/{_w}]|[^{_b}=>/{_w}])|^{_P}[^{_l}=>/{_w}]"),
    ("EXPECTED_EQUALS", rf"^{_P}{W}+[^={_w}]"),
    ("BAD_SELF_CLOSE", rf"^(?:{_H}{W}*|{_H}{W}+(?:{_A})++|{_P}|{_P}{W}*={W}*{L}*{W}*)/[^>]"),
    ("BAD_AFTER_VALUE", rf"^(?:{_H}{W}+(?:{_A})++|{_P}{W}*={W}*{L}*{W}*)[^{_l}>/{_w}]"),
)
_TOKENS = "array<struct<kind:string,value:string>>"


def lexemes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LEXEME), F.lit(0))


def _token(kind: str | Column, value: Column | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), (F.lit(None).cast("string") if value is None else value).alias("value"))


def _none() -> Column:
    return F.array().cast(_TOKENS)


def _attributes(rest: Column, last_value: bool = True, bare: bool = True) -> Column:
    """Tokens of what follows a tag's name. last_value: a value that reaches the end counts; bare: so do names alone."""
    pieces = F.regexp_extract_all(rest, F.lit(ATTRIBUTE), F.lit(0))

    def of(piece: Column) -> Column:
        name = F.regexp_extract(piece, rf"^({L}+)", 1)
        named = F.when(piece.rlike(rf"^{L}+="), F.array(_token("ATTRNAME", name))).otherwise(_none())
        value = F.array(_token("ATTRVALUE", F.regexp_extract(piece, rf"={W}*({L}*)\z", 1)))
        alone = F.when(piece.endswith("/>") | ~F.lit(bare), _none()).otherwise(F.array(_token("ATTRNAME", name)))
        return F.when(piece.contains("="), F.concat(named, value)).otherwise(alone)

    found = F.flatten(F.transform(pieces, of))
    if last_value:
        return found
    last = F.try_element_at(pieces, F.lit(-1))
    return F.when(last.contains("=") & rest.endswith(last), F.slice(found, F.lit(1), F.size(found) - 1)).otherwise(found)


def _tag(lexeme: Column) -> Column:
    first = F.when(lexeme.rlike(rf"^<{W}*/"), "CLOSETAG").otherwise("OPENTAG")
    head = F.array(_token(first), _token("TAGNAME", F.regexp_extract(lexeme, rf"^<{W}*/?{W}*({B}+)", 1)))
    rest = F.regexp_replace(lexeme, F.lit(HEAD), F.lit(""))
    plain = rest == ">"  # most tags
    closed = F.when(lexeme.endswith("/>"), F.array(_token("SELFCLOSETAG"))).otherwise(_none())
    return F.when(plain, head).otherwise(F.concat(head, _attributes(rest), closed))


def _text(lexeme: Column) -> Column:
    value = F.regexp_replace(lexeme, F.lit(rf"^{W}+"), F.lit(""))
    return F.when(value != "", F.array(_token("TEXTCONTENT", value))).otherwise(_none())


def _good(parts: Column, bad: Column | None = None) -> Column:
    """Lexemes before the bare `<`; without one, all but a last run of text, which is never emitted."""
    bad = F.array_position(parts, "<") if bad is None else bad
    last = F.element_at(parts, -1)
    end = F.when(F.size(parts) == 0, 0).when(~last.startswith("<"), F.size(parts) - 1).otherwise(F.size(parts))
    return F.slice(parts, F.lit(1), F.when(bad > 0, bad - 1).otherwise(end).cast("int"))


def _of_lexemes(good: Column) -> Column:
    return F.flatten(F.transform(good, lambda x: F.when(x.startswith("<"), _tag(x)).otherwise(_text(x))))


def whole_tokens(parts: Column) -> Column:
    """Tokens of the lexemes before the failing or unfinished tag."""
    return _of_lexemes(_good(parts))


def remainder(text: Column, parts: Column, bad: Column | None = None) -> Column:
    """offset, rest: from the first bare `<` on; null without one."""
    bad = (F.array_position(parts, "<") if bad is None else bad).cast("int")
    before = F.aggregate(F.slice(parts, F.lit(1), bad - 1), F.lit(0), lambda a, x: a + F.length(x))
    return F.when(bad > 0, F.struct(before.alias("offset"), F.substring(text, before + 1, F.length(text)).alias("rest")))


def error(rest: Column) -> Column:
    """code and size (characters up to the one where it shows) of the error in what remainder() leaves; null for none."""
    found = None
    for code, pattern in ERRORS:
        hit = F.regexp_extract(rest, rf"{pattern}", 0)
        here = F.struct(F.lit(code).alias("code"), F.length(hit).alias("size"))
        found = F.when(hit != "", here) if found is None else found.when(hit != "", here)
    return found


def partial_tokens(rest: Column, wrong: Column) -> Column:
    """What the failing or unfinished tag gave before its error, or before the end."""
    seen = F.when(wrong.isNotNull(), F.substring(rest, F.lit(1), wrong["size"])).otherwise(rest)
    kind = F.when(seen.rlike(rf"^<{W}*/"), F.array(_token("CLOSETAG"))).when(seen.rlike(rf"^<{W}*{B}"), F.array(_token("OPENTAG"))).otherwise(_none())
    named = seen.rlike(rf"^{_H}[^{_b}]")
    name = F.when(named, F.array(_token("TAGNAME", F.regexp_extract(seen, rf"^<{W}*/?{W}*({B}+)", 1)))).otherwise(_none())
    after = F.regexp_replace(seen, F.lit(HEAD), F.lit(""))
    return F.concat(kind, name, F.when(named, _attributes(after, last_value=False, bare=False)).otherwise(_none()))


def tokens(text: Column, with_partial: bool = False) -> Column:
    """All tokens in order. A tag that the end cuts short gives what it has; a failing one does with with_partial."""
    parts = lexemes(text)
    rest = remainder(text, parts)["rest"]
    wrong = error(rest)
    more = F.when(rest.isNotNull() & (F.lit(with_partial) | wrong.isNull()), partial_tokens(rest, wrong)).otherwise(_none())
    return F.concat(whole_tokens(parts), more)


def split_up(df: DataFrame, keep: list[str], text: Column) -> DataFrame:
    """keep's columns, good (lexemes that give whole tokens) and left (as of remainder()).

    Step by step, so that Spark evaluates each once: what is used twice is not merged into its users.
    """
    df = df.select(*keep, text.alias("text"))
    df = df.select(*keep, "text", lexemes(F.col("text")).alias("parts"))
    df = df.select(*keep, "text", "parts", F.array_position("parts", "<").alias("bad"))
    bad = F.col("bad")
    return df.select(*keep, _good(F.col("parts"), bad).alias("good"), remainder(F.col("text"), F.col("parts"), bad).alias("left"))


def tokenized(df: DataFrame, keep: list[str], text: Column, with_partial: bool = False) -> DataFrame:
    """keep's columns and all: the array that tokens() gives."""
    rest = F.col("left.rest")
    df = split_up(df, keep, text).select(*keep, "good", "left", error(rest).alias("wrong"))
    more = F.when(rest.isNotNull() & (F.lit(with_partial) | F.col("wrong").isNull()), partial_tokens(rest, F.col("wrong"))).otherwise(_none())
    whole = _of_lexemes(F.col("good"))
    return df.select(*keep, F.when(F.col("left").isNull(), whole).otherwise(F.concat(whole, more)).alias("all"))


def accepted(text: Column) -> Column:
    """Whether the document stays in the dialect (a tag cut short by the end does)."""
    rest = remainder(text, lexemes(text))["rest"]
    return F.when(text.isNotNull(), rest.isNull() | error(rest).isNull())


def accepted_each(df: DataFrame, keep: list[str], texts: dict[str, Column]) -> DataFrame:
    """keep's columns and accepted() of each text under its name; step by step, as in split_up()."""
    df = df.select(*keep, *[t.alias(f"text_{n}") for n, t in texts.items()])
    df = df.select("*", *[lexemes(F.col(f"text_{n}")).alias(f"parts_{n}") for n in texts])
    df = df.select(*keep, *[remainder(F.col(f"text_{n}"), F.col(f"parts_{n}"))["rest"].alias(f"rest_{n}") for n in texts], *[F.col(f"text_{n}").isNotNull().alias(f"is_{n}") for n in texts])
    fine = lambda n: F.col(f"rest_{n}").isNull() | error(F.col(f"rest_{n}")).isNull()
    return df.select(*keep, *[F.when(F.col(f"is_{n}"), fine(n)).alias(n) for n in texts])
