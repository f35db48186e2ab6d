"""Message templates by key and language.

A job can bring its own templates; keys without one fall back to English. Templates are a few
dozen short texts: they travel inside the plan, and no join is needed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

ENGLISH = {
    "http_status": "the server answered {status_code} ({reason}): {url}",
    "http_status_bare": "the server answered {status_code}: {url}",
    "name_resolution": "host name not found: {url}",
    "connection_refused": "the host refused the connection: {url}",
    "timeout": "no page within {timeout_s}s: {url}",
    "proxy": "no connection through the proxy {proxy}: {url}",
    "proxy_refused": "the proxy {proxy} denies this address (status {status_code}): {url}",
    "tls": "secure connection failed ({summary}): {url}",
    "tls_bare": "secure connection failed: {url}",
    "blocked": "the site wants proof of a human visitor (status {status_code}): {url}",
    "browser_not_installed": "no browser is installed for this job",
    "non_html": "neither a web page nor a file that could be downloaded: {url}",
    "other": "could not be fetched ({summary}): {url}",
    "other_bare": "could not be fetched: {url}",
    "retried_direct": "second try without the proxy, after: {error}",
    "pdf_not_converted": "the PDF could not be turned into Markdown ({error}); original kept",
    "pdf_without_text": "the PDF holds no text; the document is empty",
    "pdf_as_is": "a PDF was kept unchanged; the format {format} has no use for it",
    "not_a_page": "a file of type {media_type}, kept unchanged",
    "not_a_page_unknown": "a file of unknown type, kept unchanged",
    "filter_failed": "main content could not be chosen ({reason}); the whole page was kept",
    "filter_kept_nothing": "no main content found; the whole page was kept",
    "duplicate_url": "this address was given before: {url}",
    "long_timeout": "a timeout of {timeout_s}s is over {factor} times the default of {default}s",
    "write_failed": "could not be written to {path}: {reason}",
    "saved": "{url} -> {path} ({size} bytes)",
    "binary": "{size} bytes of {content_type} are not shown; save the file instead: {url}",
    "binary_unknown": "{size} bytes of unknown type are not shown; save the file instead: {url}",
    "summary_fetched": "{succeeded} fetched, {failed} not",
    "summary_saved": "{succeeded} saved, {failed} not",
    "no_text": "nothing to read: {url}",
    "not_fetched": "not fetched: {url}",
    "none_saved": "none of {failed} could be saved",
    "bad_port": "the port of the address is left out of the file name: {url}",
    "invalid_url": "not a web address: {url}",
}

JAPANESE = {
    "http_status": "サーバーの応答 {status_code}（{reason}）: {url}",
    "http_status_bare": "サーバーの応答 {status_code}: {url}",
    "name_resolution": "ホスト名が見つかりません: {url}",
    "connection_refused": "ホストに接続を断られました: {url}",
    "timeout": "{timeout_s}秒以内にページを取得できません: {url}",
    "proxy": "プロキシ {proxy} を通して接続できません: {url}",
    "proxy_refused": "プロキシ {proxy} がこの宛先を禁止しています（状態 {status_code}）: {url}",
    "tls": "安全な接続に失敗しました（{summary}）: {url}",
    "tls_bare": "安全な接続に失敗しました: {url}",
    "blocked": "サイトが人による操作の確認を求めています（状態 {status_code}）: {url}",
    "browser_not_installed": "ブラウザーがありません",
    "non_html": "ウェブページでもダウンロードできるファイルでもありません: {url}",
    "other": "取得できません（{summary}）: {url}",
    "other_bare": "取得できません: {url}",
    "retried_direct": "プロキシなしで再試行しました。理由: {error}",
    "not_a_page": "{media_type} のファイルをそのまま保存",
    "duplicate_url": "同じアドレスが前にあります: {url}",
    "summary_fetched": "取得 {succeeded} 件、失敗 {failed} 件",
    "summary_saved": "保存 {succeeded} 件、失敗 {failed} 件",
    "long_timeout": "タイムアウト {timeout_s} 秒は既定値 {default} 秒の {factor} 倍を超えています",
    "write_failed": "{path} に書き込めません: {reason}",
    "not_fetched": "取得していません: {url}",
    "none_saved": "{failed} 件のどれも保存できません",
}

LANGUAGES = ("en", "ja")
LOCALE_VARIABLES = ("LANGUAGE", "LC_ALL", "LC_MESSAGES", "LANG")


def texts(lang: str = "en", own: Mapping[str, str] | None = None) -> dict[str, str]:
    """Templates by key: English, then those of the language, then the job's ``own``."""
    return ENGLISH | (JAPANESE if lang == "ja" else {}) | dict(own or {})


def read(spark: SparkSession, path: str, lang: str) -> dict[str, str]:
    """Own templates of a language from CSV files with the columns lang, key and template."""
    table = spark.read.schema("lang string, key string, template string").option("header", "true").csv(path)
    # A hand-written catalog; what has no place in the built-in one is not a message.
    known = table.where(table.lang.eqNullSafe(lang) & table.key.isin(*ENGLISH)).dropDuplicates(["key"])
    return {row["key"]: row["template"] for row in known.collect()}
