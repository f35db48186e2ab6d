"""The registered queries: each reads the test tables and runs one job of the library."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions import catalog, rules, urls
from pagequarry.functions import headers as H
from pagequarry.functions import judging as J
from pagequarry.functions import text as T
from pagequarry.operators import artifacts as A
from pagequarry.operators import batches as B
from pagequarry.operators import content
from pagequarry.operators import html as P
from pagequarry.operators import judge, mainfit, markdown, messages, naming, report
from pagequarry.plans import derived as D
from pagequarry.session import shared_folder, written
from pagequarry.sources import captures as capture_source
from pagequarry.sources import requests as request_source
from pagequarry.streaming import intake

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES["q_" + fn.__name__] = fn
    return fn


# --- requests -----------------------------------------------------------------------------


def _valid(spark: SparkSession, sf: str) -> DataFrame:
    return B.split_valid(D.requests(spark, sf))[0]


def _first(spark: SparkSession, sf: str) -> DataFrame:
    return B.first_seen(_valid(spark, sf))[0]


@query
def valid_urls(spark, sf):
    """Trimmed valid URLs and their parts."""
    return _valid(spark, sf).selectExpr(
        "batch_id", "ord", "url", f"{urls.scheme('url')} as scheme", f"{urls.host('url')} as host",
        f"{urls.path('url')} as path", f"{urls.query('url')} as query_part",
    )


@query
def rejected_urls(spark, sf):
    return B.split_valid(D.requests(spark, sf))[1].select("batch_id", "ord", "url_raw")


@query
def first_seen_urls(spark, sf):
    return _first(spark, sf).select("batch_id", "ord", "url", "format", "timeout_s")


@query
def duplicate_urls(spark, sf):
    return B.first_seen(_valid(spark, sf))[1].select("batch_id", "ord", "url")


@query
def repeat_counts(spark, sf):
    return B.repeat_counts(_valid(spark, sf))


@query
def batch_gate(spark, sf):
    requests = D.requests(spark, sf)
    strict = B.gate(requests, strict=True)
    return strict.select(
        "batch_id", "n_urls", "n_invalid", "n_unique", F.col("reason").alias("strict_reason"),
        F.when(F.col("n_unique") > rules.DEFAULT_MAX_URLS, "too_many_urls").alias("lenient_reason"),
    )


@query
def accepted_urls(spark, sf):
    """URLs of the batches the lenient gate lets through."""
    return _accepted(spark, sf).select("batch_id", "ord", "url")


@query
def invalid_lists(spark, sf):
    return B.invalid_lists(D.requests(spark, sf))


@query
def timeout_resolution(spark, sf):
    return B.with_options(D.requests(spark, sf)).select(
        "batch_id", "ord", "timeout", "timeout_reason", "long_timeout"
    )


@query
def long_timeout_lines(spark, sf):
    return report.long_timeout_lines(B.with_options(D.requests(spark, sf)), catalog.texts())


def _bodies(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").alias("batch_id"), F.expr(D.BODY_SQL).alias("body"))


@query
def request_bodies(spark, sf):
    """Parsed bodies: a rejection reason or the listed URLs."""
    parsed = request_source.parse_bodies(_bodies(D.pages(spark, sf)))
    return parsed.select(
        "batch_id", "reason", F.size("urls").cast("bigint").alias("n_urls"),
        F.array_join("urls", " ").alias("listed"),
    )


@query
def body_rows(spark, sf):
    """Accepted bodies as request rows."""
    rows, _ = request_source.from_bodies(_bodies(D.pages(spark, sf)))
    return rows.select("batch_id", "ord", "url_raw")


# --- captures -----------------------------------------------------------------------------


def _headers(spark: SparkSession, sf: str) -> DataFrame:
    return D.raw_captures(spark, sf).select(
        "url", "attempt", "headers_json", F.from_json("headers_json", "map<string,string>").alias("h"),
        F.coalesce("final_status", "first_status").alias("status"),
    )


@query
def media_types(spark, sf):
    df = _headers(spark, sf).selectExpr("*", f"{H.header('h', 'content-type')} as ct")
    return df.selectExpr(
        "url", "attempt", f"{H.media_type('ct')} as media_type", f"{H.may_be_html('ct')} as may_be_html",
        f"{H.is_not_html('ct')} as not_html",
    )


@query
def header_lookup(spark, sf):
    return _headers(spark, sf).selectExpr(
        "url", "attempt", f"{H.header('h', 'Content-Type')} as content_type",
        f"{H.header('h', 'content-length')} as content_length",
        f"{H.last_header('h', 'x-squid-error')} as proxy_error",
        f"array_join(array_sort(map_keys({H.lower_names('h')})), ',') as names",
    )


@query
def body_kept(spark, sf):
    return _headers(spark, sf).selectExpr(
        "url", "attempt", f"{H.is_success('status')} as success", f"{H.keeps_body('status', 'h', H.KEPT_BODY_BYTES)} as kept"
    )


@query
def error_kinds(spark, sf):
    text = "error_text"
    return D.raw_captures(spark, sf).where("error_text is not null").selectExpr(
        "url", "attempt", f"{J.error_kind(text)} as kind", f"{T.summary(text)} as summary",
        f"{J.is_tls_text(text)} as tls", f"""{J.transport_kind(D.ERROR_CLASS_SQL, text)} as plain_kind""",
        f"{J.kind_by_rules(text, rules.error_rule_rows())} as rule_kind",
        f"""{J.connect_status("concat(page_id % 700 + 100, ' ', error_text)")} as connect_status""",
    )


@query
def interference(spark, sf):
    k = D.captures(spark, sf).withColumn("st", F.coalesce("final_status", "first_status"))
    seen = J.add_interference(k, "headers", "html", "st", "seen")
    return seen.where("seen_sign is not null").selectExpr(
        "url", "attempt", "seen_sign as sign", "seen_detail as detail",
        f"{J.interference_kind('seen_sign', 'proxy', 'st')} as kind",
    )


@query
def final_response(spark, sf):
    captures = D.captures(spark, sf)
    k = judge.effective(judge.with_final(captures, judge.final_by_url(captures, D.final_responses(spark, sf))))
    return k.select("url", "attempt", "status", "by_final", F.col("ctype").alias("content_type"))


@query
def verdicts(spark, sf):
    """The decision on every attempt."""
    return judge.verdict(D.captures(spark, sf)).select(
        "url", "attempt", "verdict", "kind", "refused", "detail", "judged_status", "retriable"
    )


@query
def fallback(spark, sf):
    """The attempt that counts for each URL."""
    chosen = judge.with_fallback(judge.verdict(D.captures(spark, sf)))
    return chosen.select(
        "url", "attempt", "verdict", "kind", F.col("proxy_error.kind").alias("proxy_error_kind"), "retry_missing"
    )


# --- outcomes -----------------------------------------------------------------------------


def _accepted(spark: SparkSession, sf: str) -> DataFrame:
    requests = D.requests(spark, sf)
    first, _ = B.first_seen(B.split_valid(requests)[0])
    return B.accepted(first, B.gate(requests, strict=False))


def _outcomes(
    spark: SparkSession, sf: str, requests: DataFrame, with_markdown: bool = True, fmt: str | None = None, **options: bool
) -> DataFrame:
    # The narrow request rows are read three times: to find hot URLs, to spread, to join.
    chosen = written(B.with_options(requests), "requests")
    if fmt is not None:
        # A constant format lets the optimizer drop the columns of the other formats.
        chosen = chosen.withColumn("format", F.lit(fmt))
    return judge.outcomes(
        chosen, D.captures(spark, sf), rules.media_types(spark),
        final=D.final_responses(spark, sf), markdown=content.page_text(**options) if with_markdown else None,
    )


def _all_outcomes(spark: SparkSession, sf: str, with_markdown: bool = False) -> DataFrame:
    return _outcomes(spark, sf, _first(spark, sf), with_markdown)


def _loader_outcomes(spark: SparkSession, sf: str, **options: bool) -> DataFrame:
    return _outcomes(spark, sf, _accepted(spark, sf), fmt="markdown", **options)


@query
def outcomes(spark, sf):
    """Outcome of every first-seen request in its own format."""
    return _all_outcomes(spark, sf, with_markdown=True).select(
        "batch_id", "ord", "url", "ok", "final_url", "status_code", "content_kind", "content_type",
        F.md5("text").alias("text_md5"), F.octet_length("data").cast("bigint").alias("bytes"), "extension", "title",
        F.col("error.kind").alias("error_kind"), F.col("error.detail").alias("error_detail"),
        F.col("error.status_code").alias("error_status"), F.col("error.proxy").alias("error_proxy"),
        F.array_join(F.transform("notes", lambda n: n["key"]), ",").alias("note_keys"), "retry_missing",
    )


@query
def documents(spark, sf):
    """Documents of the accepted batches, to be read in request order."""
    docs = report.documents(_loader_outcomes(spark, sf))
    return docs.select("batch_id", "ord", "page_content", F.to_json("metadata", {"ignoreNullFields": "false"}).alias("metadata"))


@query
def fit_documents(spark, sf):
    """Documents with the main content only, links as citations, and the notes of the filter."""
    rows = _loader_outcomes(spark, sf, fit=True, citations=True).where(report.has_text())
    return rows.select(
        "batch_id", "ord", F.col("text").alias("page_content"), F.array_join(F.transform("notes", lambda n: n["key"]), ",").alias("note_keys")
    )


@query
def batch_documents(spark, sf):
    """One JSON array per accepted batch: its length, and the digest of its documents in order."""
    arrays = report.batch_documents(report.documents(_loader_outcomes(spark, sf)))
    entries = F.from_json("documents", "array<struct<page_content:string,metadata:struct<source:string,url:string>>>")
    marks = F.transform(entries, lambda d: F.concat_ws("|", F.md5(d["page_content"]), d["metadata"]["source"], d["metadata"]["url"]))
    return arrays.select(
        "batch_id", "n_docs", F.length("documents").cast("bigint").alias("chars"), F.md5(F.array_join(marks, " ")).alias("digest")
    )


@query
def skipped(spark, sf):
    return report.skipped(_loader_outcomes(spark, sf))


@query
def batch_summary(spark, sf):
    return report.batch_summary(_all_outcomes(spark, sf))


@query
def failed_lists(spark, sf):
    return report.failed_lists(_all_outcomes(spark, sf)).select(
        "batch_id", "piece", F.array_join("failed_urls", " ").alias("failed_urls")
    )


@query
def outcome_rollup(spark, sf):
    return report.rollup(_all_outcomes(spark, sf, with_markdown=True))


@query
def progress(spark, sf):
    """Done-of-total per batch in the order requests finished."""
    finished = _first(spark, sf).select("batch_id", "ord", "url", F.expr(D.FINISHED_SQL).alias("finished_at"))
    return report.progress(finished)


@query
def page_records(spark, sf):
    records = report.page_records(_all_outcomes(spark, sf, with_markdown=True))
    return records.select(
        "batch_id", "ord", "url", "final_url", "title", "ok", "status_code", "content_kind", "content_type", "bytes", "chars",
        F.md5("text").alias("text_md5"), F.col("error.kind").alias("error_kind"), F.col("error.detail").alias("error_detail"),
        F.array_join(F.transform("notes", lambda n: n["key"]), ",").alias("note_keys"),
    )


@query
def log_lines(spark, sf):
    """What was fetched or failed, notes, and what was saved."""
    rows = written(_all_outcomes(spark, sf, with_markdown=True), "outcomes")
    lines = report.log_lines(rows, catalog.texts(), _records(spark, sf, rows))
    return lines.select("batch_id", "ord", F.col("n").cast("bigint").alias("n"), "level", "line")


@query
def large_bodies(spark, sf):
    """Files of any length: a stored body is used, whatever its length header says."""
    rows = _all_outcomes(spark, sf).where("content_kind = 'binary'")
    return rows.select("batch_id", "ord", "url", "ok", F.octet_length("data").cast("bigint").alias("bytes"), "content_type")


@query
def pdf_documents(spark, sf):
    """PDF files as Markdown, from tables with hundreds of page texts each."""
    pages = spark.sql(D.PDF_PAGES_SQL.replace("from pages", "from {p}"), p=D.pages(spark, sf))
    requests = written(B.with_options(_first(spark, sf)).withColumn("format", F.lit("markdown")), "requests")
    rows = judge.outcomes(requests, D.captures(spark, sf), rules.media_types(spark), pdf_pages=report.pdf_texts(pages, error="error"))
    return rows.where("content_kind = 'pdf'").select(
        "batch_id", "ord", "url", "extension", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("chars"),
        F.octet_length("data").cast("bigint").alias("bytes"), F.array_join(F.transform("notes", lambda n: n["key"]), ",").alias("note_keys"),
    )


def _format_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes of pages asked for as pictures, PDF and archives, some missing or damaged."""
    pages = D.pages(spark, sf)
    requests = pages.selectExpr(
        "cast(floor(page_id / 40) as bigint) as batch_id", "page_id as ord", "url", f"{D.FORMAT_SQL.replace('doc_id', 'page_id')} as format",
        f"cast({D.TIMEOUT_SQL} as double) as timeout_s",
    )
    shots = pages.selectExpr("url", *[f"{sql} as {name}" for name, sql in D.PICTURES_SQL.items()])
    captures = D.captures(spark, sf).drop("pdf", "screenshot", "mhtml").join(shots, "url").withColumn("pdf", F.encode("pdf", "UTF-8"))
    return judge.outcomes(
        written(B.with_options(requests), "requests"), capture_source.normalise(captures), rules.media_types(spark)
    )


@query
def format_outcomes(spark, sf):
    return _format_rows(spark, sf).select(
        "batch_id", "ord", "ok", "content_kind", "extension", F.md5("data").alias("data_md5"), F.md5("text").alias("text_md5"),
        F.col("error.kind").alias("error_kind"), F.col("error.detail").alias("error_detail"),
    )


@query
def prechecks(spark, sf):
    """Decisions before and beside the browser: probes, start failures, raised errors."""
    rows = spark.sql(D.PRECHECK_SQL.replace("from pages", "from {p}"), p=D.pages(spark, sf))
    made = capture_source.normalise(rows.withColumn("probe_body", F.encode("probe_text", "UTF-8")).drop("probe_text"))
    return judge.verdict(made).select("url", "verdict", "kind", "refused", "detail", "retriable")


@query
def custom_rules(spark, sf):
    """Verdicts with a proxy product, a challenge and an error text of the job's own."""
    signs = replace(
        rules.SIGNS, challenges=(*rules.SIGNS.challenges, ("Content-Type", "image/png")),
        proxy_titles=(*rules.SIGNS.proxy_titles, "Gateway down"), proxy_headers=(*rules.SIGNS.proxy_headers, "x-own-proxy"),
    )
    rows = judge.verdict(D.captures(spark, sf), signs, [(0, "timeout 30000ms", "connection_refused")])
    return rows.select("url", "attempt", "verdict", "kind", "detail")


@query
def unpaired(spark, sf):
    """Requested URLs that nothing was captured for."""
    seen = D.captures(spark, sf).where(F.length("url") % 5 != 0)
    return judge.unpaired(_first(spark, sf), seen)


# --- names and files ----------------------------------------------------------------------


@query
def file_names(spark, sf):
    """Names of plain URLs and of URLs with port, escapes and reserved characters."""
    rows = D.pages(spark, sf).selectExpr(
        "page_id", "url", f"{D.ODD_URL_SQL} as odd", "concat(url, repeat('/0123456789', 20)) as long"
    )
    return rows.selectExpr(
        "page_id", f"""{urls.file_name("url", "'.md'")} as name""", f"""{urls.file_name("url", "'.html'")} as html_name""",
        f"""{urls.file_name("odd", "'.md'")} as odd_name""", f"""{urls.file_stem("long", "''")} as long_stem""",
    )


@query
def extensions(spark, sf):
    """Extensions of raw files: by media type, else by URL, else ``.bin``."""
    k = D.captures(spark, sf).selectExpr("url", "attempt", f"{H.header('headers', 'content-type')} as ct")
    guessed = k.selectExpr("*", f"{H.media_type('ct')} as media_type").join(
        F.broadcast(rules.media_types(spark)), "media_type", "left"
    )
    return guessed.selectExpr(
        "url", "attempt", f"coalesce(guessed_extension, {urls.path_suffix('url')}, '.bin') as extension",
        f"coalesce({urls.path_suffix('url')}, '.bin') as by_url",
    )


@query
def allocated_names(spark, sf):
    """Names of a whole run as one batch, so that equal names meet."""
    pages = D.pages(spark, sf).select(
        F.lit(0).alias("batch_id"), F.col("page_id").alias("ord"),
        F.expr(f"concat({urls.host('url')}, '.md')").alias("name"),
    )
    return naming.allocate(pages).drop("batch_id")


@query
def contested_names(spark, sf):
    """Names where a numbered name can also be asked for as it is."""
    pages = D.pages(spark, sf).select(
        (F.col("page_id") % 7).alias("batch_id"), F.col("page_id").alias("ord"),
        F.expr(D.CONTESTED_SQL).alias("name"),
    )
    return naming.allocate(pages)


def _records(spark: SparkSession, sf: str, rows: DataFrame, lang: str = "en") -> DataFrame:
    """Download records; some files could not be written, and tokens come from the caller."""
    named = naming.named_records(rows).withColumn("token", F.expr(D.TOKEN_SQL))
    write_errors = _first(spark, sf).where(F.col("ord") % 130 == 0).select(
        "batch_id", "ord", F.lit("disk full").alias("reason")
    )
    return report.manifest(named, catalog.texts(lang), "downloads", write_errors, "https://files.example", "token")


def _manifest(spark: SparkSession, sf: str, lang: str = "en") -> DataFrame:
    return _records(spark, sf, _all_outcomes(spark, sf, with_markdown=True), lang)


@query
def manifest(spark, sf):
    return _manifest(spark, sf).withColumn("notes", F.array_join("notes", " | ")).drop("unwritten")


@query
def download_lines(spark, sf):
    lines = report.download_lines(_manifest(spark, sf), catalog.texts())
    return lines.select("batch_id", "ord", F.col("n").cast("bigint").alias("n"), "line")


@query
def saved_summary(spark, sf):
    """Saved and failed files per batch; a failed write is a failure."""
    return report.saved_summary(_manifest(spark, sf))


@query
def saved_lines(spark, sf):
    lines = report.saved_lines(_manifest(spark, sf, "ja"), catalog.texts("ja")).where("section > 1")
    return lines.select("batch_id", "section", "ord", F.col("n").cast("bigint").alias("n"), "line")


@query
def unsaved_lists(spark, sf):
    """URLs without a file, write failures included."""
    return report.failed_lists(_manifest(spark, sf)).select("batch_id", "piece", F.array_join("failed_urls", " ").alias("failed_urls"))


@query
def payloads(spark, sf):
    """What is written per file: size and digest."""
    rows = _all_outcomes(spark, sf, with_markdown=True).where("ok")
    return rows.select("batch_id", "ord", "extension", F.octet_length(report.payload()).cast("bigint").alias("bytes"), F.md5(report.payload()).alias("digest"))


# --- pages --------------------------------------------------------------------------------


@query
def titles(spark, sf):
    return P.titles(D.pages(spark, sf))


@query
def tokens(spark, sf):
    return P.tokens(D.pages(spark, sf)).select("page_id", F.col("pos").cast("bigint").alias("pos"), "tok", "tag", "closing")


@query
def blocks(spark, sf):
    return P.blocks(D.pages(spark, sf)).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "tag", "container", "list_depth", "ordered", "txt", "link_chars"
    )


@query
def links(spark, sf):
    return P.links(D.pages(spark, sf)).select("page_id", F.col("pos").cast("bigint").alias("pos"), "href", "anchor")


@query
def resolved_links(spark, sf):
    """Links of the page, and the same targets in other relative forms."""
    rows = P.links(D.pages(spark, sf), ("page_id", "url")).selectExpr("*", f"{D.ODD_HREF_SQL} as odd")
    return rows.selectExpr(
        "page_id", "bigint(pos) as pos", "resolved", f"{urls.resolve('url', 'odd')} as odd_resolved"
    )


@query
def citation_numbers(spark, sf):
    rows = P.links(D.pages(spark, sf).repartition("page_id"))
    return markdown.numbers(rows).select(
        "page_id", "resolved", F.col("first_pos").cast("bigint").alias("first_pos"), F.col("number").cast("bigint").alias("number")
    )


@query
def markdown_full(spark, sf):
    return markdown.render(D.pages(spark, sf))


@query
def markdown_no_links(spark, sf):
    return markdown.render(D.pages(spark, sf), links=False, images=False)


@query
def markdown_images(spark, sf):
    """Pages with pictures, with and without them."""
    rows = D.pages(spark, sf).withColumn("html", F.expr(D.IMAGES_SQL))
    plain = markdown.render(rows, images=False).withColumnRenamed("markdown", "without")
    return markdown.render(rows).join(plain, "page_id")


@query
def cited_markdown(spark, sf):
    text = markdown.render(D.pages(spark, sf), ("page_id", "url"))
    return markdown.cite(text.withColumnRenamed("url", "base"))


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with their blocks, which counting and marking both read."""
    pages = written(P.with_blocks(D.pages(spark, sf)).select("page_id", "url", "blocks"), "blocks")
    return pages.where(F.size("blocks") > 0)


@query
def repeated_blocks(spark, sf):
    return mainfit.repeated_blocks(P.with_blocks(D.pages(spark, sf)))


def _fit(spark: SparkSession, sf: str, **options) -> DataFrame:
    return mainfit.fit(mainfit.mark_repeated(_blocks(spark, sf)), **options)


@query
def fit(spark, sf):
    """Markdown of the main content."""
    return markdown.rendered(_fit(spark, sf), ["page_id"])


@query
def fit_scored(spark, sf):
    """Main content by a score of the caller: the length of a block."""
    rows = _fit(spark, sf, score=lambda b: F.length(b["txt"]) / 60.0, keep=1.0)
    return markdown.with_markdown(rows).select("page_id", "markdown", F.get("md_notes", 0)["key"].alias("note"))


@query
def fit_notes(spark, sf):
    return _fit(spark, sf).select("page_id", F.get("md_notes", 0)["key"].alias("note"))


@query
def fit_cited(spark, sf):
    """Main content with citations, numbered on what was kept."""
    return markdown.cite(markdown.rendered(_fit(spark, sf), ["page_id", "url as base"]))


@query
def page_text(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select(
        F.col("conv_id").alias("doc"), F.col("turn").alias("page_no"), "text"
    )
    return report.page_text(rows)


# --- messages and lines -------------------------------------------------------------------


def _messages(spark: SparkSession, sf: str, lang: str) -> DataFrame:
    return messages.with_error_text(_all_outcomes(spark, sf).where("not ok"), catalog.texts(lang))


@query
def error_messages(spark, sf):
    return _messages(spark, sf, "en").select("batch_id", "ord", F.col("error_text").alias("message"))


@query
def error_messages_ja(spark, sf):
    return _messages(spark, sf, "ja").select("batch_id", "ord", F.col("error_text").alias("message"))


@query
def note_lines(spark, sf):
    rows = report.note_lines(_all_outcomes(spark, sf), catalog.texts())
    return rows.select("batch_id", "ord", F.col("n").cast("bigint").alias("n"), "line")


@query
def report_lines(spark, sf):
    valid = _valid(spark, sf)
    outcome_rows = written(_all_outcomes(spark, sf), "outcomes")
    rows = report.report_lines(outcome_rows, B.first_seen(valid)[1], catalog.texts())
    return rows.select("batch_id", "section", "ord", "line")


@query
def page_blocks(spark, sf):
    sizes = B.gate(D.requests(spark, sf), strict=False)
    rows = report.page_blocks(_all_outcomes(spark, sf, with_markdown=True), sizes, catalog.texts())
    return rows.select("batch_id", "ord", F.col("n").cast("bigint").alias("n"), "type", "text", "mime")


@query
def text_helpers(spark, sf):
    """First lines, final newlines, and which formats give text."""
    df = spark.read.parquet(f"{sf}/documents.parquet")
    return df.selectExpr(
        "doc_id", f"{T.first_line('text')} as first", f"md5({T.one_newline('text')}) as file_md5",
        f"{J.is_text_format(D.FORMAT_SQL)} as is_text",
    )


@query
def languages(spark, sf):
    """Message language from an explicit choice, a setting and locale variables."""
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", *[F.expr(sql).alias(n) for n, sql in D.LOCALE_SQL.items()])
    columns = {v: v for v in catalog.LOCALE_VARIABLES}
    return df.selectExpr(
        "doc_id", f"{messages.locale_language(columns)} as from_locale",
        f"{messages.resolve_language('explicit', 'setting', columns)} as language",
    )


@query
def origins(spark, sf):
    """Public origin of requests that came through proxies."""
    df = D.pages(spark, sf).select("page_id", F.from_json(F.expr(D.FORWARDED_SQL), "map<string,string>").alias("h"))
    return df.selectExpr("page_id", f"""{H.public_origin("h", "'http'")} as origin""")


# --- settings and folders -----------------------------------------------------------------


@query
def redacted(spark, sf):
    rows = D.pages(spark, sf).selectExpr("page_id", f"{D.PROXY_SQL} as proxy")
    return rows.selectExpr("page_id", f"{urls.redact('proxy')} as shown", f"{urls.is_socks('proxy')} as socks")


@query
def proxy_check(spark, sf):
    rows = D.pages(spark, sf).selectExpr("page_id", f"{D.PROXY_SQL} as proxy")
    full = rows.selectExpr("page_id", f"{urls.full_proxy('proxy')} as full_url")
    checked = full.selectExpr(
        "page_id", f"{urls.proxy_reason('full_url')} as reason", f"{urls.normal_proxy('full_url')} as normal",
        "full_url",
    )
    return checked.selectExpr(
        "page_id", "if(reason is null, normal, null) as proxy", "reason",
        f"{urls.redact('if(reason is null, normal, full_url)')} as shown",
    )


@query
def safe_directory(spark, sf):
    rows = D.pages(spark, sf).selectExpr("page_id", f"{D.DIRECTORY_SQL} as dir")
    return rows.selectExpr("page_id", f"{urls.check_directory('dir')} as reason")


# --- artifacts ----------------------------------------------------------------------------


def _registrations(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'signup'").select(
        F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("token"),
        F.concat(F.lit("out/"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("seq"),
    )


def _deliveries(events: DataFrame) -> DataFrame:
    """Deliveries name the registration some events before them."""
    return events.where("event_type in ('view', 'click')").select(
        F.concat(F.lit("t"), (F.col("event_id") - 3).cast("string")).alias("token"),
        F.when(F.col("event_id") % 4 == 0, "HEAD").otherwise("GET").alias("method"),
        (F.col("event_id") % 5 == 0).alias("ranged"), (F.col("event_id") % 7 != 0).alias("complete"),
    )


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


@query
def newest_artifacts(spark, sf):
    return A.newest(_registrations(_events(spark, sf)), 100)


@query
def live_artifacts(spark, sf):
    events = _events(spark, sf)
    files = events.where("event_type = 'purchase'").select(F.concat(F.lit("out/"), F.col("user_id").cast("string")).alias("path"))
    return A.present(A.live(_registrations(events), _deliveries(events)), files)


# --- streams ------------------------------------------------------------------------------

_PAGES = "page_id bigint, url string, html string"
_EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _stream_bodies(spark: SparkSession, sf: str) -> DataFrame:
    stream = intake.read_table(spark, f"{sf}/pages.parquet", _PAGES)
    return stream.select(F.col("page_id").alias("batch_id"), F.expr(D.BODY_SQL).alias("body"))


@query
def stream_intake(spark, sf):
    return intake.run_append(spark, intake.intake(_stream_bodies(spark, sf)), shared_folder(spark, "stream-intake"))


@query
def stream_rejects(spark, sf):
    return intake.run_append(spark, intake.rejects(_stream_bodies(spark, sf)), shared_folder(spark, "stream-rejects"))


@query
def stream_counts(spark, sf):
    stream = intake.read_table(spark, f"{sf}/events.parquet", _EVENTS)
    counted = intake.counts(stream, F.col("event_type"), F.col("ts"))
    out = intake.run_sums(spark, counted, ["window_start", "kind"], shared_folder(spark, "stream-counts"))
    return out.withColumn("window_start", F.col("window_start").cast("string"))


@query
def stream_intake_once(spark, sf):
    """Every call is delivered twice, half an hour apart."""
    def delivered(minutes: int) -> DataFrame:
        at = F.expr(f"timestamp_seconds(1700000000 + page_id + {60 * minutes})")
        return intake.read_table(spark, f"{sf}/pages.parquet", _PAGES).select(
            F.col("page_id").alias("batch_id"), F.expr(D.BODY_SQL).alias("body"), at.alias("at")
        )

    once = intake.intake_once(delivered(0).unionByName(delivered(30)))
    return intake.run_append(spark, once, shared_folder(spark, "stream-intake-once")).select("batch_id", "ord", "url")


@query
def stream_closed_counts(spark, sf):
    stream = intake.read_table(spark, f"{sf}/events.parquet", _EVENTS)
    closed = intake.closed_counts(stream, F.col("event_type"), F.col("ts"))
    out = intake.run_append(spark, closed, shared_folder(spark, "stream-closed-counts"))
    return out.withColumn("window_start", F.col("window_start").cast("string"))


@query
def stream_progress(spark, sf):
    stream = intake.read_table(spark, f"{sf}/pages.parquet", _PAGES)
    finished = stream.select(F.floor(F.col("page_id") / 20).cast("bigint").alias("batch_id"), F.lit(20).cast("bigint").alias("total"))
    out = intake.run_sums(spark, finished, ["batch_id"], shared_folder(spark, "stream-progress"), ("total",))
    return out.withColumnRenamed("n", "done")


@query
def stream_retention(spark, sf):
    events = intake.read_table(spark, f"{sf}/events.parquet", _EVENTS)
    sent = _deliveries(events).where((F.col("method") == "GET") & ~F.col("ranged") & F.col("complete"))
    stream = _registrations(events).withColumn("delivered", F.lit(False)).unionByName(
        sent.select("token", F.lit(True).alias("delivered")), allowMissingColumns=True
    )
    return intake.retention(spark, stream, shared_folder(spark, "stream-retention"), n=500)
