"""Message texts: keys and parameters of errors and notes, filled in where they are."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import catalog as C
from pagequarry.functions import rules
from pagequarry.functions.inline import let
from pagequarry.functions.text import extract, fill, listed, lit, null_if_empty, short_number, summary


def template(texts: Mapping[str, str], key: str) -> str:
    """The template of a key; the key itself when there is none."""
    return f"case {key} " + " ".join(f"when {lit(k)} then {lit(v)}" for k, v in texts.items()) + f" else {key} end"


def reason(status: str) -> str:
    """The reason phrase of an HTTP status; null when it has none."""
    return f"case {status} " + " ".join(f"when {code} then {lit(text)}" for code, text in rules.reason_rows()) + " end"


def error_key(error: str) -> str:
    """Message key of an error struct."""
    return (
        f"case when {error}.kind = 'http_status' and {reason(error + '.status_code')} is null then 'http_status_bare' "
        f"when {error}.kind = 'proxy' and {error}.refused then 'proxy_refused' "
        f"when {error}.kind in ('tls', 'other') and coalesce({summary(error + '.detail')}, '') = '' "
        f"then concat({error}.kind, '_bare') else {error}.kind end"
    )


def error_text(error: str, url: str, texts: Mapping[str, str]) -> str:
    """The message of an error struct; null where there is no error."""
    params = (
        f"map('url', {url}, 'status_code', cast({error}.status_code as string), "
        f"'reason', if({error}.kind = 'http_status', {reason(error + '.status_code')}, null), "
        f"'timeout_s', {short_number(error + '.timeout_s')}, 'proxy', {error}.proxy, 'summary', {summary(error + '.detail')})"
    )
    return f"if({error} is null, null, {let(error_key(error), '_ky', fill(template(texts, '_ky'), params))})"


def message(texts: Mapping[str, str], key: str, **params: str) -> str:
    """A message with a fixed key and parameters given as SQL text."""
    pairs = ", ".join(f"{lit(name)}, {value}" for name, value in params.items())
    return fill(lit(texts.get(key, key)), f"map({pairs})") if pairs else lit(texts.get(key, key))


def with_error_text(
    rows: DataFrame, texts: Mapping[str, str], error: str = "error", url: str = "url", name: str = "error_text"
) -> DataFrame:
    """Add the rendered message of an error column; null where there is no error."""
    return rows.withColumn(name, F.expr(error_text(error, url, texts)))


def note_texts(texts: Mapping[str, str], notes: str = "notes", url: str = "url") -> str:
    """The texts of an array of notes, in order.

    The retry note quotes an earlier error, which is rendered first in the same language.
    """
    quoted = (
        "if(_nt.key = 'retried_direct', struct(_nt.params['kind'] as kind, false as refused, _nt.params['detail'] as detail, "
        "try_cast(_nt.params['status_code'] as int) as status_code, try_cast(_nt.params['timeout_s'] as double) as timeout_s, "
        "_nt.params['proxy'] as proxy), null)"
    )
    params = let(quoted, "_qt", f"if(_qt is null, _nt.params, map('error', {error_text('_qt', url, texts)}))")
    return f"transform({notes}, _nt -> {let(params, '_np', fill(template(texts, '_nt.key'), '_np'))})"


def note_rows(
    outcomes: DataFrame, texts: Mapping[str, str], keep: tuple[str, ...] = ("batch_id", "ord", "url")
) -> DataFrame:
    """One row per note with its text: ``(keep, n, key, note)``."""
    both = f"zip_with(notes, {note_texts(texts)}, (_nz, _tz) -> struct(_nz.key as key, _tz as note))"
    rows = outcomes.selectExpr(*keep, f"posexplode_outer({both}) as (n, _z)").where("n is not null")
    return rows.select(*keep, "n", "_z.key", "_z.note")


def locale_language(columns: dict[str, str]) -> str:
    """Language named by locale variables (variable -> column): the first that is set
    decides; null if it names no known language."""
    value = ", ".join(null_if_empty(columns[v]) for v in C.LOCALE_VARIABLES if v in columns)
    code = f"lower({extract(f'coalesce({value})', '^([^:_.@]*)')})"
    return f"if({code} in {listed(C.LANGUAGES)}, {code}, null)"


def resolve_language(explicit: str, setting: str, columns: dict[str, str]) -> str:
    """Explicit language, else the job's setting, else the locale, else English."""
    known = listed(C.LANGUAGES)
    return (
        f"coalesce(if({explicit} in {known}, {explicit}, null), if({setting} in {known}, {setting}, null), "
        f"{locale_language(columns)}, 'en')"
    )
