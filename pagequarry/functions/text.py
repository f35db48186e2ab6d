"""Text helpers as SQL expressions.

Functions take and return SQL text, to be used with ``F.expr`` or ``selectExpr``: one call
builds a whole expression, and Catalyst sees only built-in functions.
"""

from __future__ import annotations

import html.entities

# The characters a Unicode-aware strip removes.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = (
    r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# Line ends, and the lines a browser driver wraps around the real error.
LINE_END = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
WRAPPER_LINES = ("unexpected error in ", "error: failed on navigating")
NET_ERROR = r"net::ERR_[A-Z0-9_]+"

_ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{1,31};?)"


def lit(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def listed(values) -> str:
    """Literals for an ``in (...)`` list."""
    return "(" + ", ".join(lit(v) if isinstance(v, str) else str(v) for v in values) + ")"


def replace_all(c: str, pattern: str, new: str) -> str:
    return f"regexp_replace({c}, {lit(pattern)}, {lit(new)})"


def extract(c: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({c}, {lit(pattern)}, {group})"


def matches(c: str, pattern: str) -> str:
    return f"({c} rlike {lit(pattern)})"


def strip(c: str) -> str:
    """Trim Unicode white space on both ends."""
    return f"btrim({c}, {lit(SPACE_CHARS)})"


def blank(c: str) -> str:
    """True for null or white space only."""
    return f"coalesce({strip(c)} = '', true)"


def collapse(c: str) -> str:
    """Runs of white space become one blank; ends are trimmed."""
    return strip(replace_all(c, SPACE_CLASS + "+", " "))


def null_if_empty(c: str) -> str:
    return f"nullif({c}, '')"


def first_line(c: str) -> str:
    """First line of a text; null for an empty one."""
    return null_if_empty(f"get(split({c}, {lit(LINE_END)}, 2), 0)")


def summary(detail: str) -> str:
    """The most telling line of an error text.

    A ``net::ERR_*`` code wins, then the first non-blank line that is not a wrapper line,
    then the first non-blank line, then the empty string. Null stays null.
    """
    code = extract(detail, NET_ERROR, 0)
    lines = f"filter(transform(split({detail}, {lit(LINE_END)}), _ln -> {strip('_ln')}), _ln -> _ln <> '')"
    wrapped = " or ".join(f"startswith(lower(_pl), {lit(w)})" for w in WRAPPER_LINES)
    return (
        f"case when {detail} is null then null when {code} <> '' then {code} "
        f"else coalesce(get(filter({lines}, _pl -> not ({wrapped})), 0), get({lines}, 0), '') end"
    )


def one_newline(c: str) -> str:
    """Text that ends with a line feed, adding one only when it is missing."""
    return f"if(endswith(coalesce({c}, ''), '\\n'), {c}, concat(coalesce({c}, ''), '\\n'))"


def lossy_text(c: str) -> str:
    """Decode UTF-8 bytes, replacing bad sequences."""
    return f"make_valid_utf8(cast({c} as string))"


def cut_utf8(c: str, max_bytes: int) -> str:
    """The longest prefix of at most ``max_bytes`` UTF-8 bytes that splits no character."""
    cuts = ", ".join(
        f"try_validate_utf8(cast(substring(encode({c}, 'UTF-8'), 1, {max_bytes - k}) as string))"
        for k in range(4)
    )
    return f"if(octet_length({c}) <= {max_bytes}, {c}, coalesce({cuts}, ''))"


def _entity_lines(names) -> str:
    """One text of lines "name, tab, value"; searching it keeps plans small where a map
    literal of this size would not."""
    return "\n" + "".join(f"&{n}\t{html.entities.html5[n]}\n" for n in names if "\n" not in html.entities.html5[n])


# Built from the public HTML 5 table of the standard library. Old names also work without a
# semicolon, and then as a prefix of a longer word.
_ALL_NAMES = _entity_lines(html.entities.html5)
_OLD_NAMES = _entity_lines(n for n in html.entities.html5 if not n.endswith(";"))
# References common enough for a direct answer.
_COMMON = {
    "&amp;": "&",
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#39;": "'",
    "&nbsp;": "\xa0",
    "&copy;": "\xa9",
    "&middot;": "\xb7",
    "&ndash;": "\u2013",
    "&mdash;": "\u2014",
    "&hellip;": "\u2026",
}


def _found(key: str, table: str, rest: str) -> str:
    """Value of ``key`` in a table of lines followed by ``rest``; null when it is not there."""
    return (
        f"get(transform(array({lit(table)}), _tab -> get(transform(array(position(concat('\\n', {key}, '\\t'), _tab)), "
        f"_at -> if(_at > 0, concat(substring_index(substr(_tab, _at + length({key}) + 2, 8), '\\n', 1), {rest}), null)), 0)), 0)"
    )


def _entity_text(token: str) -> str:
    """Value of one reference; an unknown name stays as it is."""
    common = " ".join(f"when {lit(k)} then {lit(v)}" for k, v in _COMMON.items())
    digits, hexits = extract(token, r"^&#([0-9]+)"), extract(token, r"^&#[xX]0*([0-9a-fA-F]*)")
    code = (
        f"if({digits} <> '', try_cast({digits} as bigint), "
        f"try_cast(conv(if(length({hexits}) < 9, {hexits}, null), 16, 10) as bigint))"
    )
    number = (
        f"get(transform(array({code}), _cp -> if(_cp > 0 and _cp < 1114112 and not _cp between 55296 and 57343, "
        f"decode(unhex(lpad(hex(_cp), 8, '0')), 'UTF-32'), {lit(chr(0xFFFD))})), 0)"
    )
    prefixes = (
        f"transform(sequence(least(length({token}), 8), 2, -1), _len -> "
        + _found(f"substr({token}, 1, _len)", _OLD_NAMES, f"substr({token}, _len + 1)")
        + ")"
    )
    exact = _found(token, _ALL_NAMES, "''")
    named = f"coalesce({exact}, get(array_compact({prefixes}), 0), {token})"
    return f"case {token} {common} else if(startswith({token}, '&#'), {number}, {named}) end"


def decode_entities(c: str) -> str:
    """Decode HTML character references in one pass, so nothing is decoded twice."""
    pieces = f"split({c}, {lit(_ENTITY)}, -1)"
    decoded = f"transform(regexp_extract_all({c}, {lit(_ENTITY)}, 0), _ent -> {_entity_text('_ent')})"
    joined = f"array_join(zip_with({pieces}, {decoded}, (_pc, _dc) -> concat(_pc, coalesce(_dc, ''))), '')"
    # With common references only, plain replacing is enough, the ampersand last.
    simple = c
    for name, value in sorted(_COMMON.items(), key=lambda item: item[0] == "&amp;"):
        simple = f"replace({simple}, {lit(name)}, {lit(value)})"
    rare = matches(c, "&(?!(?:" + "|".join(name[1:] for name in _COMMON) + "))[A-Za-z#]")
    return f"case when not contains({c}, '&') then {c} when {rare} then {joined} else {simple} end"


def keep_if(value: str, name: str, test: str) -> str:
    """A generator that yields ``value`` as column ``name`` when ``test`` on ``_v`` holds.

    A filter on a computed column is pushed below the projection and computes it twice; this
    computes it once.
    """
    return f"inline(filter(array(struct({value} as v)), _kv -> {test.replace('_v', '_kv.v')})) as ({name})"


def fill(template: str, params: str) -> str:
    """Put the values of a string map into the ``{name}`` fields of a template."""
    return (
        f"reduce(map_entries({params}), {template}, (_tx, _pa) -> "
        "replace(_tx, concat('{', _pa.key, '}'), coalesce(_pa.value, '')))"
    )


def short_number(c: str) -> str:
    """A number as text without a trailing ``.0``."""
    return replace_all(f"cast({c} as string)", r"\.0$", "")
