"""Judging captures: one decision per attempt, the retry rule, and the outcome of each request."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pagequarry import schemas
from pagequarry.functions import headers as H
from pagequarry.functions import judging as J
from pagequarry.functions import rules, urls
from pagequarry.functions.text import blank, listed, lit, lossy_text
from pagequarry.operators import skew


def note(key: str, **params: Column) -> Column:
    """A note row: a message key and the values of its fields."""
    pairs = [x for name, value in params.items() for x in (F.lit(name), value)]
    fields = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(F.lit(key).alias("key"), fields.cast("map<string,string>").alias("params"))


def no_notes() -> Column:
    return F.array().cast(schemas.NOTES)


def final_by_url(captures: DataFrame, final: DataFrame) -> DataFrame:
    """Final responses by the URL of the capture they belong to: ``(url, fins)``.

    A response is stored under its URL or under the same URL with or without the trailing
    slash, and serves one attempt; the exact URL goes first. Matching runs on keys alone.
    ``fins`` holds one entry per attempt.
    """
    have = schemas.conform(final, schemas.FINAL_RESPONSES).selectExpr(
        "url as _stored", "coalesce(attempt, 1) as attempt", "struct(status, headers, body) as fin"
    )
    shorter = f"if(endswith(_stored, '/') and not endswith(_stored, '//'), {urls.slash_variant('_stored')}, null)"
    candidates = have.selectExpr(
        "_stored",
        "attempt",
        f"inline(array(struct(_stored as u, 0 as r), struct(concat(_stored, '/') as u, 1 as r), struct({shorter} as u, 1 as r))) as (url, _rank)",
    ).where("url is not null")
    wanted = captures.select("url", "attempt").join(candidates, ["url", "attempt"])
    owner = wanted.groupBy("_stored", "attempt").agg(
        F.min_by("url", F.struct("_rank", "url")).alias("url"), F.min("_rank").alias("_rank")
    )
    matched = owner.join(have, ["_stored", "attempt"])
    return matched.groupBy("url").agg(
        F.collect_list(F.struct("attempt", "_rank", "fin")).alias("fins")
    )


def with_final(captures: DataFrame, fins: DataFrame, keys: tuple[str, ...] = ("url",)) -> DataFrame:
    """Add ``fin``, the final response of a capture's attempt, from :func:`final_by_url`.

    The join is on the URL alone, the partitioning the fallback window uses as well.
    """
    joined = captures.join(fins, list(keys), "left")
    own = "array_sort(filter(fins, _f -> _f.attempt = attempt), (_x, _y) -> _x._rank - _y._rank)"
    return joined.selectExpr(*captures.columns, f"get({own}, 0).fin as fin")


def effective(captures: DataFrame) -> DataFrame:
    """Add the status, headers and kept body an attempt is judged by."""
    df = captures
    if "fin" not in df.columns:
        df = df.withColumn("fin", F.lit(None).cast(f"struct<status:int,headers:{schemas.HEADERS},body:binary>"))
    same = "(fin is not null and fin.status <=> coalesce(final_status, first_status))"
    chosen = df.selectExpr(
        "*",
        "coalesce(final_status, first_status) as status",
        f"{same} as by_final",
        f"if({same}, fin.headers, headers) as hdr",
        f"if({same}, fin.body, body) as received",
    )
    return chosen.selectExpr(
        *[x for x in chosen.columns if x not in ("fin", "received")],
        f"{H.header('hdr', 'content-type')} as ctype",
        # The body is here already, whatever its length header says.
        f"if({H.keeps_body('status', 'hdr')}, received, null) as kept",
    )


def _rule() -> str:
    """The rule that decides an attempt. The order of the branches is the meaning.

    ``page`` or a file (``probe``, ``kept``), a failure (``refused``, ``start``, ``raised``,
    ``seen``, ``http``, ``classified``), or a download, named after what a download that
    cannot be used is reported as (``load_non_html``, ``load_other``).
    """
    anti_bot = f"coalesce(startswith(error_text, {lit(rules.ANTI_BOT_PREFIX)}), false)"
    file_type = H.is_not_html("ctype")
    bad_status = "coalesce(status >= 400, false)"
    anti_bot_file = f"({anti_bot} and coalesce(status < 400, false) and {file_type})"
    refused = (
        "(coalesce(probe_error_kind = 'proxy', false) and proxy is not null "
        f"and coalesce(proxy_status = {rules.REFUSAL_STATUS}, false))"
    )
    probe_file = (
        f"({H.probe_ok('probe_status', 'probe_error_kind', 'probe_skipped')} "
        f"and {H.is_not_html('probe_type')} and probe_body is not null)"
    )
    no_page = f"({file_type} and {blank('html')})"
    return f"""case
        when {refused} then 'refused'
        when {probe_file} then 'probe'
        when start_error is not null then 'start'
        when raised then 'raised'
        when seen_kind is not null then 'seen'
        when not success and {anti_bot_file} then if(kept is not null, 'kept', 'load_non_html')
        when not success and {anti_bot} and {bad_status} then 'http'
        when not success then if(text_kind = 'non_html', 'load_non_html', 'classified')
        when {bad_status} then 'http'
        when {no_page} then if(kept is not null, 'kept', 'load_other')
        else 'page' end"""


def verdict(
    captures: DataFrame, signs: rules.Signs = rules.SIGNS, error_rules: Iterable[tuple[int, str, str]] = (),
    scan: int = rules.SCAN_LENGTH,
) -> DataFrame:
    """Add ``verdict``, ``kind``, ``refused``, ``detail``, ``judged_status`` and ``retriable``.

    A job can bring its own ``signs`` of interference and its own ``error_rules``
    ``(priority, fragment, kind)``; ``scan`` is how far into a page signs are looked for.

    Verdicts: ``page``, ``probe`` / ``kept`` / ``download`` (a file, from the named source)
    or ``failed``. Projections over the scan: nothing moves between tasks. A proxy failure of
    an attempt that used no proxy, and a failure to start the browser, have no proxy to name
    and become ``other``.
    """
    df = effective(captures)
    dl_head = lossy_text(f"substring(dl_body, 1, {scan})")
    error_rules = list(error_rules)
    dl_html = f"if({H.may_be_html('dl_type')} and dl_body is not null, {dl_head}, null)"
    seen = J.add_interference(df, "hdr", "html", "status", "seen", signs, scan)
    seen = J.add_interference(seen, "dl_headers", dl_html, "dl_status", "dl", signs, scan)
    facts = seen.selectExpr(
        "*",
        f"{J.interference_kind('seen_sign', 'proxy', 'status')} as seen_kind",
        f"if(error_text is null, 'other', {J.error_kind('error_text', error_rules)}) as text_kind",
        f"coalesce(if(dl_error_kind in {listed(rules.DOWNLOAD_PATH_KINDS)}, dl_error_kind, null), "
        f"{J.interference_kind('dl_sign', 'proxy', 'dl_status')}) as dl_kind",
        f"({H.probe_ok('dl_status', 'dl_error_kind')} and dl_body is not null) as dl_ok",
    )
    # A download is decided by what came back: an error on the way, a usable body, or nothing.
    ruled = facts.selectExpr("*", f"{_rule()} as first_rule").selectExpr(
        "*",
        """case when not startswith(first_rule, 'load_') then first_rule
                when dl_kind is not null then 'load_bad'
                when dl_ok then 'download' else first_rule end as rule""",
    )
    kind = f"""case when rule = 'refused' then 'proxy'
        when rule = 'start' then {J.error_kind('start_error', error_rules)}
        when rule in ('raised', 'classified') then text_kind
        when rule = 'seen' then seen_kind
        when rule = 'http' then 'http_status'
        when rule = 'load_bad' then dl_kind
        when startswith(rule, 'load_') then substring(rule, 6) end"""
    named = ruled.selectExpr("*", f"{kind} as raw_kind")
    return named.selectExpr(
        *df.columns,
        "if(rule in ('page', 'probe', 'kept', 'download'), rule, 'failed') as verdict",
        "if(raw_kind = 'proxy' and (proxy is null or rule = 'start'), 'other', raw_kind) as kind",
        "rule = 'refused' as refused",
        """case when rule = 'start' then start_error
            when rule in ('raised', 'classified', 'load_non_html') then error_text
            when rule = 'seen' then if(seen_kind = 'blocked', null, seen_detail)
            when rule = 'load_bad' and dl_error_kind is not null then dl_error_text
            when rule = 'load_bad' then if(dl_kind = 'blocked', null, dl_detail)
            when rule = 'load_other' then 'the response has no HTML' end as detail""",
        """case when rule = 'load_bad' then dl_status
            when rule in ('seen', 'http', 'classified', 'load_non_html', 'load_other') then status
            end as judged_status""",
        "rule not in ('refused', 'start') as retriable",
        # Here, where the page is read, so that outcomes need not carry the page for it.
        f"if(rule = 'page', {J.page_title('html')}, null) as title",
    )


def with_fallback(
    judged: DataFrame, enabled: bool = True, keys: tuple[str, ...] = ("url",)
) -> DataFrame:
    """One row per URL: the second attempt replaces a first one worth retrying.

    ``proxy_error`` then holds the first error for the note. ``retry_missing`` marks a first
    attempt that should have been repeated but was not captured again. One window over the
    one or two attempts of a URL, no self join.
    """
    retry = J.wants_retry("kind", "judged_status", "proxy")
    wants = F.expr(
        f"{str(enabled).lower()} and attempt = 1 and verdict = 'failed' and retriable and {retry}"
    )
    error = F.expr(
        "struct(kind, refused, detail, judged_status as status_code, cast(null as double) as timeout_s, "
        f"{urls.redact('proxy')} as proxy)"
    ).cast(schemas.ERROR)
    order = W.partitionBy(*keys).orderBy("attempt")
    marked = judged.withColumn("_wants", wants).withColumn("_error", error)
    paired = (
        marked.withColumn("_next", F.lead("attempt").over(order))
        .withColumn("_prev_wants", F.lag("_wants").over(order))
        .withColumn("_prev_error", F.lag("_error").over(order))
    )
    first = (F.col("attempt") == 1) & ~(F.col("_wants") & F.col("_next").isNotNull())
    second = (F.col("attempt") == 2) & F.coalesce("_prev_wants", F.lit(False))
    return paired.where(first | second).select(
        *judged.columns,
        F.when(second, F.col("_prev_error")).alias("proxy_error"),
        (F.col("_wants") & F.col("_next").isNull()).alias("retry_missing"),
    )


# Where a file outcome comes from, by verdict: type, body, final URL and status.
_FILE = {
    "file_type": ("probe_type", "ctype", "dl_type"),
    "file_body": ("probe_body", "kept", "dl_body"),
    "file_url": ("nullif(probe_url, '')", "nullif(final_url, '')", "nullif(dl_url, '')"),
    "file_status": ("probe_status", "status", "dl_status"),
}


def outcomes(
    requests: DataFrame,
    captures: DataFrame,
    extensions: DataFrame,
    final: DataFrame | None = None,
    markdown: Callable[[DataFrame], DataFrame] | None = None,
    pdf_pages: DataFrame | None = None,
    fallback: bool = True,
    signs: rules.Signs = rules.SIGNS,
    error_rules: Iterable[tuple[int, str, str]] = (),
) -> DataFrame:
    """The outcome of every request row, in the schema ``OUTCOMES``.

    ``requests`` holds first-seen rows ``(batch_id, ord, url, format, timeout)``. Captures are
    judged where they are read, spread over the parts of often-requested URLs, reduced to the
    deciding attempt and joined, all on one partitioning by URL: a page is read once and moves
    once. ``markdown`` adds ``markdown`` and ``md_notes`` to the deciding attempts where they
    are; without it Markdown outcomes have no text. ``pdf_pages`` holds converted documents
    ``(url, pdf_text, pdf_error)``; of several for one URL any one counts. A request whose
    ``timeout_reason`` says that it cannot be run fails with it, whatever was captured.
    """
    keys = ("url", "_part")
    hot = skew.hot_keys(requests, ["url"])
    wanted = skew.salt(requests, hot, ["url"], ["batch_id", "ord"])
    seen = skew.spread(captures, hot, ["url"])
    if final is not None:
        fins = skew.spread(final_by_url(captures, final), hot, ["url"])
        seen = with_final(seen, fins, keys)
    judged = verdict(seen, signs, error_rules)
    chosen = with_fallback(judged, fallback, keys).drop("timeout_s")
    if markdown is not None:
        chosen = markdown(chosen)
    else:
        chosen = chosen.withColumn("markdown", F.lit(None).cast("string")).withColumn("md_notes", no_notes())
    if "timeout_reason" not in wanted.columns:
        wanted = wanted.withColumn("timeout_reason", F.lit(None).cast("string"))
    joined = wanted.join(chosen, list(keys), "left")
    if pdf_pages is not None:
        once = pdf_pages.select("url", "pdf_text", "pdf_error").dropDuplicates(["url"])
        joined = skew.lookup(joined.drop("_part"), once, ["url"], ["batch_id", "ord"])
    else:
        joined = joined.withColumn("pdf_text", F.lit(None).cast("string")).withColumn("pdf_error", F.lit(None).cast("string"))
    return assemble(joined, extensions)


def assemble(joined: DataFrame, extensions: DataFrame) -> DataFrame:
    """Project judged requests to outcomes, by verdict and requested format."""
    unusable = F.col("timeout_reason").isNotNull()
    joined = (
        joined.withColumn("_captured", F.col("verdict").isNotNull())
        .withColumn("verdict", F.when(unusable, "unusable").otherwise(F.col("verdict")))
        .withColumn("proxy_error", F.when(~unusable, F.col("proxy_error")))
        .withColumn("retry_missing", F.col("retry_missing") & ~unusable)
        # One picture that cannot be read is one failure, not the end of the job.
        .withColumn("shot", F.expr("try_to_binary(screenshot, 'base64')"))
    )
    sources = [
        f"case verdict when 'probe' then {p} when 'kept' then {k} when 'download' then {d} end as {name}"
        for name, (p, k, d) in _FILE.items()
    ]
    files = joined.selectExpr("*", *sources, f"{J.format_extension('format')} as format_ext")
    typed = files.selectExpr("*", f"{H.media_type('file_type')} as media_type")
    # A table of the caller; Spark broadcasts it if its size allows.
    with_ext = typed.join(extensions, "media_type", "left")
    is_file = "verdict in ('probe', 'kept', 'download')"
    missing = """case when format = 'mhtml' and mhtml is null then 'no MHTML was captured'
        when format = 'pdf' and pdf is null then 'no PDF was captured'
        when format = 'screenshot' and screenshot is null then 'no screenshot was captured'
        when format = 'screenshot' and shot is null then 'the screenshot cannot be read' end"""
    shaped = with_ext.selectExpr(
        "*",
        f"if(verdict = 'page', {missing}, null) as missing",
        f"coalesce({is_file}, false) as is_file",
        "coalesce(media_type = 'application/pdf', false) as is_pdf",
        "coalesce(file_url, url) as resource_url",
    )
    ruled = shaped.selectExpr(
        "*",
        "coalesce(is_file or (verdict = 'page' and missing is null), false) as ok",
        "if(is_file and is_pdf and format = 'markdown', pdf_text, null) as converted",
        "if(verdict = 'unusable', null, refused) as refused_by_proxy",
        "case when verdict = 'failed' then kind else 'other' end as error_kind",
        "case verdict when 'failed' then judged_status when 'unusable' then null else status end as error_status",
        "case verdict when 'failed' then detail when 'unusable' then timeout_reason "
        "else if(verdict is null, 'no capture for this URL', missing) end as error_detail",
    )
    page_text = "case format when 'markdown' then markdown when 'html' then coalesce(html, '') when 'mhtml' then mhtml end"
    page_data = (
        "case format when 'pdf' then pdf when 'screenshot' then shot "
        "when 'raw' then encode(coalesce(html, ''), 'UTF-8') end"
    )
    raw_ext = f"coalesce(guessed_extension, {urls.path_suffix('resource_url')}, '.bin')"
    # Only some kinds carry a status, a timeout or a proxy in their error.
    error = f"""struct(error_kind as kind, coalesce(refused_by_proxy, false) as refused,
        if(error_kind in ('http_status', 'blocked'), null, error_detail) as detail,
        case when error_kind in ('http_status', 'blocked') then error_status
             when refused_by_proxy then proxy_status end as status_code,
        if(error_kind = 'timeout', if(retriable, timeout, {rules.DEFAULT_TIMEOUT_S}), null) as timeout_s,
        if(error_kind = 'proxy', {urls.redact('proxy')}, null) as proxy)"""
    c = F.col
    file_notes = (
        F.when(
            c("is_pdf") & (c("format") == "markdown") & c("converted").isNull(),
            F.array(note("pdf_not_converted", error=F.coalesce("pdf_error", F.lit("no converter")))),
        )
        .when(c("is_pdf") & (c("converted") == ""), F.array(note("pdf_without_text")))
        .when(c("is_pdf") & c("format").isin("markdown", "raw", "pdf"), no_notes())
        .when(c("is_pdf"), F.array(note("pdf_as_is", format=c("format"))))
        .when(c("media_type").isNotNull(), F.array(note("not_a_page", media_type=c("media_type"))))
        .otherwise(F.array(note("not_a_page_unknown")))
    )
    own_notes = (
        F.when(c("ok") & c("is_file"), file_notes)
        .when(c("ok") & (c("format") == "markdown"), F.coalesce("md_notes", no_notes()))
        .otherwise(no_notes())
    )
    retried = note(
        "retried_direct",
        kind=c("proxy_error.kind"),
        detail=c("proxy_error.detail"),
        status_code=c("proxy_error.status_code").cast("string"),
        proxy=c("proxy_error.proxy"),
        timeout_s=c("timeout").cast("string"),
    )
    notes = F.concat(F.when(c("proxy_error").isNotNull(), F.array(retried)).otherwise(no_notes()), own_notes)

    def of_file(file: str, page: str, otherwise: str = "null") -> str:
        return f"case when ok and is_file then {file} when ok then {page} else {otherwise} end"

    return ruled.select(
        "batch_id",
        "ord",
        "url",
        "ok",
        F.expr(of_file("resource_url", "coalesce(nullif(final_url, ''), url)")).alias("final_url"),
        F.expr(of_file("file_status", "status", "error_status")).alias("status_code"),
        F.expr(of_file("if(is_pdf, 'pdf', 'binary')", "'html'", "'html'")).alias("content_kind"),
        F.expr(of_file("file_type", "ctype")).alias("content_type"),
        F.expr(of_file("converted", page_text)).alias("text"),
        F.expr(of_file("if(converted is null, coalesce(file_body, X''), null)", page_data)).alias("data"),
        F.expr(
            of_file(
                f"case when converted is not null then '.md' when is_pdf then '.pdf' else {raw_ext} end",
                "coalesce(format_ext, '.html')",
                "coalesce(format_ext, '.bin')",
            )
        ).alias("extension"),
        F.expr("if(ok and verdict = 'page', title, null)").alias("title"),
        F.when(~c("ok"), F.expr(error)).cast(schemas.ERROR).alias("error"),
        notes.alias("notes"),
        F.coalesce("retry_missing", F.lit(False)).alias("retry_missing"),
        "timeout",
        c("_captured").alias("captured"),
    )


def unpaired(requests: DataFrame, captures: DataFrame) -> DataFrame:
    """Requested URLs without any capture: must be empty for a complete run."""
    asked = requests.select("url").distinct()
    return asked.join(captures.select("url").distinct(), "url", "left_anti")
