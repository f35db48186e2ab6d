"""Response header functions over ``map<string,string>`` expressions, as SQL text."""

from __future__ import annotations

from pagequarry.functions.text import extract, listed, lit, null_if_empty, strip

# Media types that count as a web page, and the longest body a browser keeps.
HTML_TYPES = ("text/html", "application/xhtml+xml")
KEPT_BODY_BYTES = 64 * 1024 * 1024


def header(headers: str, name: str) -> str:
    """Value of a header, name matched without case; the first match decides."""
    return f"get(filter(map_entries({headers}), _he -> lower(_he.key) = {lit(name.lower())}), 0).value"


def last_header(headers: str, name: str) -> str:
    """Like :func:`header`, but null values are skipped and the last match decides."""
    return (
        f"get(reverse(filter(map_entries({headers}), _he -> lower(_he.key) = {lit(name.lower())} "
        "and _he.value is not null)), 0).value"
    )


def lower_names(headers: str) -> str:
    """Headers with lower-case names, without null values; the last of equal names wins."""
    entries = (
        f"transform(filter(map_entries({headers}), _he -> _he.value is not null), "
        "_he -> struct(lower(_he.key) as key, _he.value as value))"
    )
    last = (
        f"filter({entries}, (_he, _hi) -> not exists(slice({entries}, _hi + 2, size({entries})), "
        "_la -> _la.key = _he.key))"
    )
    return f"map_from_entries({last})"


def media_type(content_type: str) -> str:
    """Media type without parameters, lower case; null when empty."""
    return null_if_empty(f"lower({strip(extract(content_type, r'(?s)^([^;]*)'))})")


def may_be_html(content_type: str) -> str:
    """True for an HTML type and for an unknown one."""
    return f"coalesce({media_type(content_type)} in {listed(HTML_TYPES)}, true)"


def is_not_html(content_type: str) -> str:
    return f"(not {may_be_html(content_type)})"


def is_success(status: str) -> str:
    return f"coalesce({status} between 200 and 299, false)"


def keeps_body(status: str, headers: str, limit: int | None = None) -> str:
    """True when the body of a final response is one to keep: a file, 2xx.

    ``limit`` is for whoever still has to receive the body: the length header must be missing
    or name at most so many bytes. A body that is stored already needs no limit.
    """
    kept = f"{is_not_html(header(headers, 'content-type'))} and {is_success(status)}"
    if limit is None:
        return f"({kept})"
    length = header(headers, "content-length")
    return f"({kept} and ({length} is null or coalesce(try_cast({strip(length)} as bigint) <= {limit}, false)))"


def probe_ok(status: str, error_kind: str, skipped: str = "false") -> str:
    """True for a plain HTTP answer that came, was not skipped and is 2xx."""
    return f"({error_kind} is null and not coalesce({skipped}, false) and {is_success(status)})"


def public_origin(headers: str, scheme: str) -> str:
    """``scheme://host`` a client used, seen through a chain of proxies; null without a host."""

    def first(c: str) -> str:
        return null_if_empty(strip(extract(c, r"(?s)^([^,]*)")))

    host = f"coalesce({first(header(headers, 'x-forwarded-host'))}, {first(header(headers, 'host'))})"
    proto = f"coalesce({first(header(headers, 'x-forwarded-proto'))}, {first(scheme)})"
    return f"concat({proto}, '://', {host})"
