"""The queries in SQL, in words of their own: patterns and sets are written out here once more, joins and ordinals stand for
arrays, pairs of hex digits for bytes. Nothing of the functions under test is used, only the inputs made for them."""

from __future__ import annotations

from markloom.plans import fixtures as fx
from markloom.plans.queries import FAULTS

# UTF-8 over pairs of hex digits: every alternative takes whole pairs
_C, _N, _A = "[89AB].", "[0-7C-F].", ".."
_VALID = f"[0-7].|(?:C[2-9A-F]|D.){_C}|E0[AB].{_C}|ED[89].{_C}|E[1-9A-CEF]{_C}{_C}|F0[9AB].{_C}{_C}|F48.{_C}{_C}|F[1-3]{_C}{_C}{_C}"
_INVALID = (
    rf"[CD].(?:{_A}|\z)|E.(?:{_N}|{_C}{_A}|(?:{_C})?\z)|F[0-7](?:{_N}|{_C}{_N}|{_C}{_C}{_A}|(?:{_C}){{0,2}}\z)|[89AB].|F[89A-F]"
)
_CUT_SHORT = rf"^(?:[CD].|E.(?:{_C})?|F[0-7](?:{_C}){{0,2}})\z"


def _q(s: str) -> str:
    return s.replace("'", "''")


# The catalogue. Name, elements (values and ranges; ? for an optional one), and each element as a regex
# over pairs of hex digits (bytes) or characters (code points; and single bytes, which are all of ASCII).
_UP, _LOW = "4[1-9A-F]|5[0-9A]", "6[1-9A-F]|7[0-9A]"
_BYTES: list[tuple[str, str, list[str]]] = [
    ("UTF16BEBOM", "254 255", ["FE", "FF"]),
    ("UTF16LEBOM", "255 254", ["FF", "FE"]),
    ("UTF8BOM", "239 187 191", ["EF", "BB", "BF"]),
    ("UTF16BEXML", "0 60 0 63 0 120", ["00", "3C", "00", "3F", "00", "78"]),
    ("UTF16LEXML", "60 0 63 0 120 0", ["3C", "00", "3F", "00", "78", "00"]),
    ("OPENCOMMENT", "60 33 45 45", ["3C", "21", "2D", "2D"]),
    ("CLOSECOMMENT", "45 45 62", ["2D", "2D", "3E"]),
    ("OPENMETA", "60 77,109 69,101 84,116 65,97 9-10,12-13,32,47", ["3C", "[46]D", "[46]5", "[57]4", "[46]1", "(?:09|0A|0C|0D|20|2F)"]),
    ("THREEC", "60 ?47 65-90,97-122", ["3C", "..", f"(?:{_UP}|{_LOW})"]),
    ("ESQ", "60 33,47,63", ["3C", "(?:21|2F|3F)"]),
    ("CLOSETAG", "62", ["[>]"]),
    ("SKIPSEQUENCE", "9-10,12-13,32,62", ["[\\t\\n\\f\\r >]"]),
    ("GETATTRSKIP", "9-10,12-13,32,47", ["[\\t\\n\\f\\r /]"]),
    ("GETATTREQ", "61", ["[=]"]),
    ("GETATTRIFSPACES", "9-10,12-13,32", ["[\\t\\n\\f\\r ]"]),
    ("GETATTRBYTEABORT", "77,109", ["[Mm]"]),
    ("GETATTRMAIUSCLETTERS", "65-90", ["[A-Z]"]),
    ("GETATTRQUOTE", "34,39", ["[\"']"]),
    ("XMLOPENTAG", "60 63 120 109 108", ["3C", "3F", "78", "6D", "6C"]),
    ("XMLENCODING", "101 110 99 111 100 105 110 103", ["65", "6E", "63", "6F", "64", "69", "6E", "67"]),
    ("XMLG", "103", ["[g]"]),
    ("XMLSPACEORCONTROL", "0-32", ["[\\x00-\\x20]"]),
    ("SPACESANDSEMICOLON", "9-10,12-13,32,59", ["[\\t\\n\\f\\r ;]"]),
]
_NEVER = "[^\\x{0}-\\x{10ffff}]"  # surrogates are in no string
_NON = "\\x{fdd0}-\\x{fdef}" + "".join(f"\\x{{{p:x}fffe}}-\\x{{{p:x}ffff}}".replace("{0f", "{f") for p in range(17))
_POINTS: list[tuple[str, str, list[str]]] = [
    ("SURROGATES", "55296-57343", [_NEVER]),
    ("NON_CHARACTER", ",".join(["64976-65007", *(f"{65536 * p + 65534}-{65536 * p + 65535}" for p in range(17))]), [f"[{_NON}]"]),
    ("CONTROL", "127-159", ["[\\x{7f}-\\x{9f}]"]),
    ("CRLF", "13 10", ["\\r", "\\n"]),
    ("CR", "13", ["\\r"]),
    ("WHITESPACES", "9-10,12-13,32", ["[\\t\\n\\f\\r ]"]),
]
_OPTIONAL = {"THREEC": 1}
_ALL = [(*p, "byte") for p in _BYTES] + [(*p, "codepoint") for p in _POINTS]
_PATTERN = {name: (parts, domain) for name, _, parts, domain in _ALL}


def _scan(name: str, pending: bool = False) -> str:
    """A whole match (group 1); where asked for, what the end leaves unfinished; a prefix and the value that breaks it; values that begin nothing."""
    parts, domain = _PATTERN[name]
    any_one, a, b = (".." if domain == "byte" else "."), parts[0][0], parts[0][1]
    others = f"(?:[^{a}].|{a}[^{b}])+" if domain == "byte" else f"[^{parts[0]}]+"
    unfinished = ["".join(parts[:k]) + "\\z" for k in range(len(parts) - 1, 0, -1)] if pending else []
    broken = ["".join(parts[:k]) + any_one for k in range(len(parts) - 1, 0, -1) if _OPTIONAL.get(name) != k]
    return _q("(?s)" + "|".join([f"({''.join(parts)})", *unfinished, *broken, others]))


def _view(name: str) -> str:
    return "h" if _PATTERN[name][1] == "byte" and len(_PATTERN[name][0]) > 1 else "t"


def _count(name: str, view: str) -> str:
    if len(_PATTERN[name][0]) == 1:
        return f"(length({view}) - length(regexp_replace({view}, '{_q(_PATTERN[name][0][0])}', '', 'g')))"
    return f"len(list_filter(regexp_extract_all({view}, '{_scan(name)}', 1), lambda x: x <> ''))"


def _counts(key: str, source: str, text: str) -> str:
    parts = [f"SELECT {key}, '{name}' AS name, {_count(name, _view(name))}::BIGINT AS n FROM d" for name in _PATTERN]
    return f"WITH d AS (SELECT {key}, {text} AS t, hex(encode({text})) AS h FROM {source})\nSELECT * FROM ({' UNION ALL '.join(parts)}) WHERE n > 0"


def _result(name: str, view: str) -> str:
    parts, _ = _PATTERN[name]
    if len(parts) == 1:
        return f"CASE WHEN length({view}) = 0 THEN NULL WHEN regexp_matches(right({view}, 1), '{_q(parts[0])}') THEN 'TRUE' ELSE 'FALSE' END"
    last = f"regexp_extract_all({view}, '{_scan(name, True)}', 0)[-1]"
    begun = "|".join("".join(parts[:k]) for k in range(1, len(parts)))
    more = f"WHEN regexp_matches({last}, '^(?:{_q(begun)})\\z') THEN 'PENDING' " if begun else ""
    return f"CASE WHEN length({view}) = 0 THEN NULL WHEN regexp_matches({last}, '^(?:{_q(''.join(parts))})\\z') THEN 'TRUE' {more}ELSE 'FALSE' END"


def _results(key: str, source: str, text: str) -> str:
    parts = [f"SELECT {key}, '{name}' AS name, {_result(name, _view(name))} AS result FROM d" for name in _PATTERN]
    return f"WITH d AS (SELECT {key}, {text} AS t, hex(encode({text})) AS h FROM {source})\n{' UNION ALL '.join(parts)}"


def _table(columns: str, rows: list[tuple]) -> str:
    """Rows by number, as literals."""
    shown = ", ".join(f"({i}::BIGINT, {', '.join(f"'{x}'" if isinstance(x, str) else f'{x}::BIGINT' for x in r)})" for i, r in enumerate(rows))
    return f"SELECT * FROM (VALUES {shown}) AS v({columns})"


# What the matcher says to whole sequences.
_SAID = [
    ("UTF16BEBOM", "FEFF", "TRUE"),
    ("OPENMETA", "3C4D6554612F", "TRUE"),
    ("UTF16BEBOM", "FEFEFF", "FALSE"),
    ("UTF16BEBOM", "FE", "PENDING"),
    ("THREEC", "3C2F61", "TRUE"),
    ("THREEC", "3C7861", "TRUE"),
    ("THREEC", "3C613E", "FALSE"),
    ("UTF8BOM", "EFBBBF", "TRUE"),
    ("OPENCOMMENT", "3C212D2D", "TRUE"),
    ("XMLENCODING", "656E636F64696E67", "TRUE"),
]
# Vectors of the decoder: input, output, byte at which the first error shows (0: none).
_DECODED_VECTORS = [
    *((h, h, 0) for h in ("00", "7F", "C280", "DFBF", "E0A080", "EFBFBF", "F0908080", "F48FBFBF")),
    ("C080", "", 2), ("C1BF", "", 2), ("E08080", "", 3), ("F0808080", "", 4), ("C220", "", 2), ("E228A1", "", 2), ("F0288CBC", "", 2),
    ("C2", "", 0), ("E282", "", 0), ("F09080", "", 0), ("F5", "", 0), ("F6", "", 0), ("F7", "", 0),
    *((h, "", 1) for h in ("F8", "F9", "FA", "FB", "FC", "FD", "FE", "FF")),
    ("C241", "", 2), ("E228A141", "41", 2), ("F528414243", "414243", 2), ("F490808041", "41", 4), ("F7BFBFBF41", "41", 4),
    ("EDA08041", "41", 3), ("F480808041", "F480808041", 0),
]

# The dialect: white space, letters and digits, and what names hold. An attribute that another may follow; a tag's head;
# what leads to a further attribute's name.
_W, _L, _B = r"[\t\n\f\r ]", "[0-9A-Za-z]", "[!0-9A-Za-z]"
_ATTR = rf"{_L}+{_W}*={_W}*{_L}+{_W}+"
_HEAD = rf"<{_W}*(?:/{_W}*)?{_B}+"
_NAMED = rf"{_HEAD}{_W}+(?:{_ATTR})*{_L}+"
_ENDS = rf"{_W}*/?>|{_W}+(?:{_ATTR})*(?:{_L}*/?>|{_L}+{_W}*={_W}*{_L}*{_W}*/?>)"
_FAILS = [
    ("BAD_TAG_START", rf"^<{_W}*[^!0-9A-Za-z\t\n\f\r /]"),
    ("EMPTY_TAG_NAME", rf"^<{_W}*/{_W}*[^!0-9A-Za-z\t\n\f\r ]"),
    ("EMPTY_ATTR_NAME", rf"^{_HEAD}{_W}*="),
    ("BAD_ATTR_NAME_CHAR", rf"^{_HEAD}(?:{_W}+[^0-9A-Za-z=>/\t\n\f\r ]|[^!0-9A-Za-z=>/\t\n\f\r ])|^{_NAMED}[^0-9A-Za-z=>/\t\n\f\r ]"),
    ("EXPECTED_EQUALS", rf"^{_NAMED}{_W}+[^=\t\n\f\r ]"),
    ("BAD_SELF_CLOSE", rf"^(?:{_HEAD}{_W}*|{_NAMED}|{_NAMED}{_W}*={_W}*{_L}*{_W}*)/[^>]"),
    ("BAD_AFTER_VALUE", rf"^{_NAMED}{_W}*={_W}*{_L}*{_W}*[^0-9A-Za-z>/\t\n\f\r ]"),
]
_LEXEME, _TAGHEAD = f"{_HEAD}(?:{_ENDS})|<|[^<]+", f"^{_HEAD}"


def _lexed(key: str, source: str, text: str) -> str:
    return (
        f"p AS (SELECT {key} AS k, {text} AS t FROM {source}), "
        f"l AS (SELECT k, t, regexp_extract_all(t, '{_LEXEME}', 0) AS lx FROM p), "
        "b AS (SELECT k, t, lx, coalesce(list_position(lx, '<'), 0) AS bad FROM l)"
    )


def _errors() -> str:
    whens = " ".join(f"WHEN regexp_matches(r, '{_q(p)}') THEN struct_pack(code := '{code}', size := length(regexp_extract(r, '{_q(p)}', 0)))" for code, p in _FAILS)
    return f"CASE {whens} END"


_WITH_REST = (
    "s AS (SELECT k, bad, coalesce(list_sum(list_transform(lx[1 : bad - 1], lambda x: length(x))), 0)::BIGINT AS begins, t FROM b WHERE bad > 0), "
    "r AS (SELECT k, begins, substring(t, begins + 1) AS r FROM s), "
    f"e AS (SELECT k, begins, r, {_errors()} AS e FROM r)"
)


def _tokens(key: str, source: str, text: str) -> str:
    w, l_, b = _W, _L, _B
    name = rf"regexp_extract(x, '^<{w}*/?{w}*({b}+)', 1)"
    piece = rf"(?:{l_}+){w}*={w}*{l_}*|{l_}+/?>"
    return f"""
WITH {_lexed(key, source, text)}, {_WITH_REST},
u AS (SELECT k, i, lx[i] AS x FROM (SELECT k, lx, bad, unnest(range(1, len(lx) + 1)) AS i FROM b)
      WHERE CASE WHEN bad > 0 THEN i < bad ELSE i < len(lx) OR lx[i] LIKE '<%' END),
cut AS (SELECT k, r AS x FROM e WHERE e IS NULL),
pieces AS (
  SELECT k, i, j, x, ps[j] AS p, false AS partial, false AS ends FROM (SELECT k, i, x, ps, unnest(range(1, len(ps) + 1)) AS j FROM
    (SELECT k, i, x, regexp_extract_all(regexp_replace(x, '{_TAGHEAD}', ''), '{piece}', 0) AS ps FROM u WHERE x LIKE '<%'))
  UNION ALL
  SELECT k, 1000000000, j, x, ps[j], true, j = len(ps) AND ends_with(x, ps[j]) FROM (SELECT k, x, ps, unnest(range(1, len(ps) + 1)) AS j FROM
    (SELECT k, x, regexp_extract_all(regexp_replace(x, '{_TAGHEAD}', ''), '{piece}', 0) AS ps FROM cut WHERE regexp_matches(x, '^{_HEAD}[^!0-9A-Za-z]')))
),
t AS (
  SELECT k, i, 0 AS j, 0 AS m, CASE WHEN regexp_matches(x, '^<{w}*/') THEN 'CLOSETAG' ELSE 'OPENTAG' END AS kind, NULL AS value FROM u WHERE x LIKE '<%'
  UNION ALL SELECT k, i, 0, 1, 'TAGNAME', {name} FROM u WHERE x LIKE '<%'
  UNION ALL SELECT k, i, 1000000000, 0, 'SELFCLOSETAG', NULL FROM u WHERE x LIKE '<%/>'
  UNION ALL SELECT k, i, 0, 0, 'TEXTCONTENT', regexp_replace(x, '^{w}+', '') FROM u WHERE x NOT LIKE '<%' AND regexp_replace(x, '^{w}+', '') <> ''
  UNION ALL SELECT k, i, j, 0, 'ATTRNAME', regexp_extract(p, '^({l_}+)', 1) FROM pieces WHERE regexp_matches(p, '^{l_}+=') OR (p NOT LIKE '%=%' AND p NOT LIKE '%/>' AND NOT partial)
  UNION ALL SELECT k, i, j, 1, 'ATTRVALUE', regexp_extract(p, '={w}*({l_}*)\\z', 1) FROM pieces WHERE p LIKE '%=%' AND NOT ends
  UNION ALL SELECT k, 1000000000, 0, 0, CASE WHEN regexp_matches(x, '^<{w}*/') THEN 'CLOSETAG' ELSE 'OPENTAG' END, NULL FROM cut WHERE regexp_matches(x, '^<{w}*(?:/|{b})')
  UNION ALL SELECT k, 1000000000, 0, 1, 'TAGNAME', {name} FROM cut WHERE regexp_matches(x, '^{_HEAD}[^!0-9A-Za-z]')
)
SELECT k AS {key}, (row_number() OVER (PARTITION BY k ORDER BY i, j, m) - 1)::INT AS pos, kind, value FROM t
""".replace("\\\\z", "\\z")


_PAGES_TOKENS = _tokens("page_id", "pages", fx.SQL_VALUED)
_DECODED = rf"regexp_replace({fx.SQL_CORRUPTED_HEX}, '({_VALID})|{_INVALID}', '\1', 'g')"
_NEWLINES = r"regexp_replace(regexp_replace({}, '\r[\r\n]', chr(10), 'g'), '\r', '', 'g')"
_SANITIZED = f"regexp_replace({fx.SQL_INJECTED}, '[\\x{{7f}}-\\x{{9f}}{_NON}]', '', 'g')"
_FAULT = "list_value(" + ", ".join(f"'{_q(f)}'" for f in FAULTS) + f")[(page_id % {len(FAULTS)}) + 1]"


def _error_sql(text: str) -> str:
    return f"WITH {_lexed('page_id', 'pages', text)}, {_WITH_REST} SELECT k AS page_id, e.code AS error, (begins + e.size - 1)::INT AS \"offset\" FROM e WHERE e IS NOT NULL"


def _accept_sql() -> str:
    parts = []
    for n, t in (("raw", "html"), ("strict", fx.SQL_STRICT), ("cut", fx.SQL_CUT)):
        parts.append(f"{n}_bad AS (WITH {_lexed('page_id', 'pages', t)}, {_WITH_REST} SELECT k FROM e WHERE e IS NOT NULL)")
    tests = ", ".join(f'page_id NOT IN (SELECT k FROM {n}_bad) AS "{n}"' for n in ("raw", "strict", "cut"))
    return f"WITH {', '.join(parts)} SELECT page_id, {tests} FROM pages"


ORACLE: dict[str, str] = {
    # this table is the same at every scale
    "src_binary": "SELECT parse_filename(filename) AS name, size::BIGINT AS length, sha256(content) AS sha256 FROM read_blob('/root/testdata/sf0.01/nation.parquet')",
    "src_values": f"SELECT doc_id, hex, length(hex) // 2 AS n FROM ({_table('doc_id, name, hex, result', _SAID)})",
    "utf8_vectors": _table("doc_id, hex, decoded, error_pos", _DECODED_VECTORS),
    "utf8_decode": f"SELECT doc_id, decode(unhex({_DECODED})) AS text FROM documents",
    "utf8_valid": f"""SELECT doc_id, regexp_matches(h, '^(?:{_VALID})*\\z') AS valid FROM
        (SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN {fx.SQL_CORRUPTED_HEX} ELSE hex(encode(text)) END AS h FROM documents)""",
    "utf8_error_pos": rf"""WITH d AS (SELECT doc_id, regexp_extract_all({fx.SQL_CORRUPTED_HEX}, '{_VALID}|{_INVALID}', 0) AS us FROM documents),
        u AS (SELECT doc_id, i, us[i] AS x, us FROM (SELECT doc_id, us, unnest(range(1, len(us) + 1)) AS i FROM d)),
        f AS (SELECT doc_id, min(i) AS i FROM u WHERE NOT regexp_matches(x, '^(?:{_VALID})\z') AND NOT regexp_matches(x, '{_CUT_SHORT}') GROUP BY doc_id)
        SELECT d.doc_id, coalesce(length(array_to_string(us[1 : i], '')) // 2, 0)::BIGINT AS error_pos FROM d LEFT JOIN f USING (doc_id)""",
    "pre_sanitize": f"SELECT doc_id, {_SANITIZED} AS text FROM documents",
    "pre_newline": f"SELECT doc_id, {_NEWLINES.format(fx.SQL_INJECTED)} AS text FROM documents",
    "pre_full": f"SELECT doc_id, {_NEWLINES.format(_SANITIZED)} AS text FROM documents",
    "pre_error_count": f"SELECT doc_id, (length({fx.SQL_INJECTED}) - length({_SANITIZED}))::BIGINT AS sanitized_count FROM documents",
    "seq_match": _counts("doc_id", "documents", fx.SQL_INJECTED),
    "seq_match_pages": _counts("page_id", "pages", "html"),
    "seq_result": f"SELECT id, name, result FROM ({_table('id, name, hex, result', _SAID)})",
    "seq_result_pages": _results("page_id", "pages", fx.SQL_CUT),
    "seq_open_meta": f"SELECT doc_id, {_count('OPENMETA', "hex(encode('<meta ' || text))")}::BIGINT AS n FROM documents",
    "seq_utf16be_bom": f"SELECT doc_id, {_count('UTF16BEBOM', "('FEFF' || hex(encode(text)))")}::BIGINT AS n FROM documents",
    "seq_catalogue": f"SELECT name, domain, len(string_split(elements, ' '))::BIGINT AS n, elements FROM ({_table('i, name, elements, domain', [(n, e, d) for n, e, _, d in _ALL])})",
    "tok_lexemes": f"SELECT page_id, (i - 1)::INT AS pos, lx[i] AS lexeme FROM (SELECT page_id, lx, unnest(range(1, len(lx) + 1)) AS i FROM (SELECT page_id, regexp_extract_all({fx.SQL_STRICT}, '{_LEXEME}', 0) AS lx FROM pages))",
    "tok_tokens": _PAGES_TOKENS,
    "sink_tokens": _PAGES_TOKENS,
    "tok_tokens_cut": _tokens("page_id", "pages", fx.SQL_CUT),
    "tok_accept": _accept_sql(),
    "tok_error": _error_sql("html"),
    "tok_error_classes": _error_sql(f"'<p>x' || {_FAULT} || {fx.SQL_STRICT}"),
    "tok_histogram": f"SELECT page_id, kind, count(*) AS n FROM ({_PAGES_TOKENS}) GROUP BY ALL",
    "tok_pipeline": _tokens("doc_id", "documents", _NEWLINES.format(f"('<doc id=' || doc_id::VARCHAR || '> ' || {_SANITIZED} || '</doc>')")),
}
for _name, _kind in (("opentag", "OPENTAG"), ("closetag", "CLOSETAG"), ("selfclose", "SELFCLOSETAG"), ("tagname", "TAGNAME"), ("attrname", "ATTRNAME"), ("attrvalue", "ATTRVALUE"), ("text", "TEXTCONTENT")):
    ORACLE[f"tok_{_name}"] = f"SELECT page_id, pos, value FROM ({_PAGES_TOKENS}) WHERE kind = '{_kind}'"
