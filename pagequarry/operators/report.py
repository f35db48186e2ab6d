"""Reports over outcomes: documents, records, manifests, summaries and text lines.

Messages come from ``texts``, a catalog for one language (:mod:`pagequarry.functions.catalog`).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import judging as J
from pagequarry.functions import rules, urls
from pagequarry.functions.text import blank, lossy_text, short_number, strip
from pagequarry.operators import messages, skew

# Prefixes that stay the same in every language, so tools can match them.
ERROR_PREFIX, NOTE_PREFIX, SAVED_PREFIX, FILE_PREFIX, DONE_PREFIX, FAILED_PREFIX = (
    "error: ",
    "note: ",
    "saved: ",
    "file: ",
    "done: ",
    "  failed: ",
)
HEADER_NAME = "page"


def has_text() -> Column:
    """True for an outcome that gives a document: fetched, with text that is not blank."""
    return F.expr(f"ok and not {blank('text')}")


def documents(outcomes: DataFrame) -> DataFrame:
    """Loader documents ``(batch_id, ord, page_content, metadata)``."""
    return outcomes.where(has_text()).select(
        "batch_id",
        "ord",
        F.col("text").alias("page_content"),
        F.struct(
            F.col("url").alias("source"),
            F.coalesce(F.when(F.col("final_url") != "", F.col("final_url")), "url").alias("url"),
            "title",
            "status_code",
            "content_type",
        ).alias("metadata"),
    )


def skipped(outcomes: DataFrame) -> DataFrame:
    """Requests that gave no document, with the reason."""
    return outcomes.where(~F.coalesce(has_text(), F.lit(False))).select(
        "batch_id", "ord", "url",
        F.when(F.col("ok"), "no_text").otherwise(F.coalesce("error.kind", F.lit("fetch_failed"))).alias("reason"),
    )


def batch_documents(docs: DataFrame) -> DataFrame:
    """Documents of each batch as one JSON array in request order.

    Meant for batches that passed the gate: these hold at most ``max_urls`` distinct URLs,
    which bounds the array. Use :func:`documents` for anything larger.
    """
    row = F.struct("ord", F.struct("page_content", "metadata").alias("doc"))
    return docs.groupBy("batch_id").agg(F.sort_array(F.collect_list(row)).alias("_d")).select(
        "batch_id",
        F.size("_d").cast("bigint").alias("n_docs"),
        F.to_json(F.transform("_d", lambda x: x["doc"]), {"ignoreNullFields": "false"}).alias("documents"),
    )


def payload() -> Column:
    """Bytes to save: data before text, text as UTF-8, nothing when there is neither."""
    return F.coalesce(F.col("data"), F.encode(F.col("text"), "UTF-8"), F.lit(b""))


def payload_size() -> Column:
    return F.coalesce(F.octet_length("data"), F.octet_length("text"), F.lit(0)).cast("bigint")


def page_records(outcomes: DataFrame, notes: bool = True) -> DataFrame:
    """Record of each page: ids, status, sizes and text."""
    return outcomes.select(
        "batch_id", "ord", "url", "final_url", "title", "ok", "status_code", "content_kind", "content_type",
        F.when(F.col("ok"), F.col("text")).alias("text"),
        F.length("text").cast("bigint").alias("chars"),
        F.octet_length("data").cast("bigint").alias("bytes"),
        *(["error", "notes"] if notes else []),
    )


def manifest(
    rows: DataFrame, texts: Mapping[str, str], root: str, write_errors: DataFrame | None = None,
    base: str | None = None, token: str | None = None,
) -> DataFrame:
    """Download records of all outcomes, with the texts of their notes.

    ``rows`` are outcomes with ``allocated``, the name of a successful one, and ``size``, the
    bytes of its payload; the payload itself is not needed. ``write_errors`` ``(batch_id, ord,
    reason)`` turn a success into a failure and go before any fetch error. Sizes are only given
    for what was saved. With ``base`` and ``token``, a column of the caller's that nobody can
    guess, records have an address.
    """
    reasons = (
        rows.select("batch_id", "ord", F.lit(None).cast("string").alias("write_error")).limit(0)
        if write_errors is None
        else write_errors.select("batch_id", "ord", F.col("reason").alias("write_error"))
    )
    noted = rows.withColumn("_notes", F.expr(messages.note_texts(texts))).withColumn("_error", F.expr(messages.error_text("error", "url", texts)))
    joined = noted.join(reasons, ["batch_id", "ord"], "left")
    unwritten = F.col("ok") & F.col("write_error").isNotNull()
    saved = F.col("ok") & ~unwritten
    target = F.concat_ws("/", F.lit(root), "allocated")
    failure = F.expr(messages.message(texts, "write_failed", path="_target", reason="write_error"))
    address = F.concat(F.lit(base), F.lit("/files/"), F.col(token)) if base and token else F.lit(None).cast("string")
    return joined.withColumn("_target", target).select(
        "batch_id", "ord", "url", saved.alias("ok"),
        F.when(saved, target).alias("path"),
        F.when(saved, F.col("size")).alias("bytes"),
        "content_kind", "content_type", "status_code",
        F.when(unwritten, failure).otherwise(F.col("_error")).alias("error"),
        F.col("_notes").alias("notes"),
        F.when(saved, address).alias("file_url"),
        unwritten.alias("unwritten"),
    )


def saved_summary(records: DataFrame) -> DataFrame:
    """Counts and verdicts per batch of download records; a write that failed counts as failed."""
    return records.groupBy("batch_id").agg(
        F.count_if("ok").alias("saved"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.max(F.when(F.col("ok"), 0).otherwise(1)).cast("bigint").alias("exit_code"),
        (~F.bool_or("ok")).alias("none_saved"),
    )


def saved_lines(records: DataFrame, texts: Mapping[str, str]) -> DataFrame:
    """The report of a download run as rows ``(batch_id, section, ord, n, line)``, to be sorted by them.

    Sections: 1 the lines of each record, 2 counts, and a line more when nothing was saved,
    3 failed URLs. Nothing is gathered per batch.
    """
    lines = download_lines(records, texts).select("batch_id", F.lit(1).alias("section"), "ord", "n", "line")
    counts = saved_summary(records).withColumn("lines", F.expr(
        "filter(array("
        + f"concat('{DONE_PREFIX}', " + messages.message(texts, "summary_saved", succeeded="string(saved)", failed="string(failed)") + "), "
        + f"if(none_saved, concat('{ERROR_PREFIX}', " + messages.message(texts, "none_saved", failed="string(failed)") + "), null)), _l -> _l is not null)"
    ))
    done = counts.select("batch_id", F.lit(2).alias("section"), F.lit(0).cast("bigint").alias("ord"), F.posexplode_outer("lines").alias("n", "line"))
    failed = records.where("not ok").select(
        "batch_id", F.lit(3).alias("section"), "ord", F.lit(0).alias("n"), F.concat(F.lit(FAILED_PREFIX), "url").alias("line")
    )
    return lines.unionByName(done).unionByName(failed)


def batch_summary(outcomes: DataFrame) -> DataFrame:
    """Counts and verdicts per batch; partial sums make a huge batch cheap."""
    return outcomes.groupBy("batch_id").agg(
        F.count_if("ok").alias("succeeded"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.max(F.when(F.col("ok"), 0).otherwise(1)).cast("bigint").alias("exit_code"),
        (~F.bool_or("ok")).alias("all_failed"),
    )


def failed_lists(outcomes: DataFrame, piece: int = skew.LIST_PIECE) -> DataFrame:
    """Failed URLs of each batch in order: of outcomes, or of download records.

    A batch with more than ``piece`` of them has several rows, numbered by ``piece``.
    """
    return skew.listed(outcomes.where("not ok"), ["batch_id"], "ord", "url", "failed_urls", piece)


def rollup(outcomes: DataFrame) -> DataFrame:
    """Outcomes, characters and bytes by host, kind and use of a retry, with subtotals."""
    rows = outcomes.select(
        F.expr(urls.host("url")).alias("host"),
        F.when(F.col("ok"), F.col("content_kind")).otherwise(F.col("error.kind")).alias("kind"),
        F.exists("notes", lambda n: n["key"] == "retried_direct").alias("retried"),
        F.length("text").cast("bigint").alias("_c"),
        payload_size().alias("_b"),
    )
    return rows.rollup("host", "kind", "retried").agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum("_c"), F.lit(0)).alias("chars"),
        F.coalesce(F.sum("_b"), F.lit(0)).alias("bytes"),
        F.grouping_id().cast("bigint").alias("grouping"),
    )


def progress(finished: DataFrame, order: str = "ord", at: str = "finished_at", coarse: int = 1_000) -> DataFrame:
    """Done-of-total after each finished request ``(batch_id, ord, url, finished_at)``.

    The running count of a batch is put together from counts per time range, per instant and
    per order range, so one huge batch is numbered by many tasks.
    """
    done = skew.positions(
        finished, ["batch_id"], order, "done",
        levels=[F.floor(F.col(at) / coarse), F.col(at)],
    )
    totals = finished.groupBy("batch_id").agg(F.count("*").alias("total"))
    hot = skew.hot_keys(totals, ["batch_id"], counts="total")
    return skew.lookup(done, totals, ["batch_id"], [order], "inner", hot)


def error_lines(outcomes: DataFrame, texts: Mapping[str, str]) -> DataFrame:
    """One error line per failed request; a general text when there is no error."""
    text = f"coalesce({messages.error_text('error', 'url', texts)}, {messages.message(texts, 'not_fetched', url='url')})"
    return outcomes.where("not ok").select("batch_id", "ord", "url", F.concat(F.lit(ERROR_PREFIX), F.expr(text)).alias("line"))


def note_lines(outcomes: DataFrame, texts: Mapping[str, str]) -> DataFrame:
    notes = messages.note_rows(outcomes, texts)
    return notes.select(
        "batch_id", "ord", "url", "n",
        F.concat(F.lit(NOTE_PREFIX), "url", F.lit(": "), "note").alias("line"),
    )


def report_lines(outcomes: DataFrame, duplicates: DataFrame, texts: Mapping[str, str]) -> DataFrame:
    """The report of a run as rows ``(batch_id, section, ord, n, line)``, to be sorted by them.

    Sections: 0 duplicates, 1 notes and errors per request, 2 counts, 3 failed URLs. Nothing
    is gathered per batch.
    """
    dup = duplicates.select(
        "batch_id", F.lit(0).alias("section"), "ord", F.lit(0).alias("n"),
        F.concat(F.lit(NOTE_PREFIX), F.expr(messages.message(texts, "duplicate_url", url="url"))).alias("line"),
    )
    notes = note_lines(outcomes, texts).select("batch_id", F.lit(1).alias("section"), "ord", "n", "line")
    errors = error_lines(outcomes, texts).select(
        "batch_id", F.lit(1).alias("section"), "ord", F.lit(1_000_000).alias("n"), "line"
    )
    counted = messages.message(texts, "summary_fetched", succeeded="string(succeeded)", failed="string(failed)")
    done = batch_summary(outcomes).select(
        "batch_id", F.lit(2).alias("section"), F.lit(0).cast("bigint").alias("ord"), F.lit(0).alias("n"),
        F.concat(F.lit(DONE_PREFIX), F.expr(counted)).alias("line"),
    )
    failed = outcomes.where("not ok").select(
        "batch_id", F.lit(3).alias("section"), "ord", F.lit(0).alias("n"),
        F.concat(F.lit(FAILED_PREFIX), "url").alias("line"),
    )
    return dup.unionByName(notes).unionByName(errors).unionByName(done).unionByName(failed)


def download_lines(records: DataFrame, texts: Mapping[str, str]) -> DataFrame:
    """Lines of download records: notes, saved files, their addresses, and errors."""
    saved = F.concat(F.lit(SAVED_PREFIX), F.expr(messages.message(texts, "saved", url="url", path="path", size="string(bytes)")))
    notes = F.transform("notes", lambda x: F.concat(F.lit(NOTE_PREFIX), "url", F.lit(": "), x))
    failure = F.coalesce("error", F.expr(messages.message(texts, "not_fetched", url="url")))
    lines = F.when(
        F.col("ok"),
        F.filter(F.array(saved, F.concat(F.lit(FILE_PREFIX), F.col("file_url"))), lambda x: x.isNotNull()),
    ).otherwise(F.array(F.concat(F.lit(ERROR_PREFIX), with_url(failure, F.col("url")))))
    return records.select("batch_id", "ord", F.posexplode_outer(F.concat(notes, lines)).alias("n", "line"))


def with_url(message: Column, url: Column) -> Column:
    """Append the URL unless the message names it already."""
    return F.when(F.contains(message, url), message).otherwise(F.concat(message, F.lit(": "), url))


def log_lines(outcomes: DataFrame, texts: Mapping[str, str], records: DataFrame | None = None) -> DataFrame:
    """Log lines ``(batch_id, ord, n, level, line)``: what came, its notes, and what was saved.

    A failed request is logged with its whole message. ``records`` are download records, whose
    saved files and write failures follow the lines of the fetch.
    """
    status = F.coalesce(F.col("status_code").cast("string"), F.lit("-"))
    size = F.when(
        F.col("text").isNotNull(), F.concat(F.length("text").cast("string"), F.lit(" chars"))
    ).otherwise(F.concat(payload_size().cast("string"), F.lit(" bytes")))
    fetched = F.concat(
        F.lit("fetched: "), "url", F.lit(" (HTTP "), status, F.lit(", "), "content_kind", F.lit(", "), size, F.lit(")")
    )
    text = f"coalesce({messages.error_text('error', 'url', texts)}, {messages.message(texts, 'not_fetched', url='url')})"
    failed = F.concat(F.lit(ERROR_PREFIX), with_url(F.expr(text), F.col("url")))
    notes = F.transform(
        F.expr(messages.note_texts(texts)), lambda x: _logged("INFO", F.concat(F.lit(NOTE_PREFIX), "url", F.lit(": "), x))
    )
    first = F.when(F.col("ok"), _logged("INFO", fetched)).otherwise(_logged("WARNING", failed))
    lines = outcomes.select("batch_id", "ord", F.posexplode_outer(F.concat(F.array(first), notes)).alias("n", "_l"))
    if records is not None:
        saved = F.concat(F.lit(SAVED_PREFIX), F.expr(messages.message(texts, "saved", url="url", path="path", size="string(bytes)")))
        unsaved = F.concat(F.lit(ERROR_PREFIX), with_url(F.col("error"), F.col("url")))
        # Those that failed before are logged already: they have no name.
        lines = lines.unionByName(
            records.where("ok or unwritten").select(
                "batch_id", "ord", F.lit(1_000_000).alias("n"),
                F.when(F.col("ok"), _logged("INFO", saved)).otherwise(_logged("WARNING", unsaved)).alias("_l"),
            )
        )
    return lines.select("batch_id", "ord", "n", "_l.level", "_l.line")


def _logged(level: str, line: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), line.alias("line"))


def page_blocks(outcomes: DataFrame, sizes: DataFrame, texts: Mapping[str, str]) -> DataFrame:
    """What a reader is shown per request: ``(batch_id, ord, n, type, text, mime)`` rows.

    ``sizes`` ``(batch_id, n_urls)`` is what the gate has counted. A header comment is added
    when the batch has several requests; note comments come next. Everything but that one
    number is in the row, and batches too large for a broadcast are few: only their rows would
    have to be shuffled.
    """
    rows = outcomes.join(sizes.select("batch_id", F.col("n_urls").alias("_requests")), "batch_id", "left")
    status = F.coalesce(F.col("status_code").cast("string"), F.lit("-"))
    first = F.when(
        F.col("_requests") > 1,
        F.array(F.concat(F.lit(f"<!-- {HEADER_NAME}: url="), "url", F.lit(" status="), status, F.lit(" -->"))),
    ).otherwise(F.array().cast("array<string>"))
    comments = F.transform(
        F.expr(messages.note_texts(texts)), lambda x: F.concat(F.lit(f"<!-- {NOTE_PREFIX}"), x, F.lit(" -->"))
    )
    rows = rows.withColumn("_head", F.concat(first, comments)).withColumn(
        "_mime", F.expr(J.image_mime("content_kind", "content_type", "extension"))
    )
    head, mime = F.col("_head"), F.col("_mime")
    fields = {"size": "string(coalesce(octet_length(data), 0))", "content_type": "content_type", "url": "url"}
    message = F.when(F.col("content_type").isNotNull(), F.expr(messages.message(texts, "binary", **fields))).otherwise(
        F.expr(messages.message(texts, "binary_unknown", **fields))
    )
    failure = F.coalesce(F.expr(messages.error_text("error", "url", texts)), F.expr(messages.message(texts, "not_fetched", url="url")))

    def block(kind: str, text: Column, mime_: Column | None = None) -> Column:
        return F.struct(
            F.lit(kind).alias("type"), text.alias("text"),
            (F.lit(None) if mime_ is None else mime_).cast("string").alias("mime"),
        )

    def text_with_head(body: Column) -> Column:
        return F.array(block("text", F.array_join(F.array_append(head, body), "\n")))

    image = F.array(block("image", F.replace(F.base64(F.coalesce("data", F.lit(b""))), F.lit("\r\n"), F.lit("")), mime))
    # The source of a page, asked for as it is, is text.
    source = (F.col("content_kind") == "html") & (F.col("extension") == ".html") & F.col("data").isNotNull()
    made = (
        F.when(~F.col("ok"), text_with_head(F.concat(F.lit(ERROR_PREFIX), failure)))
        .when(F.col("text").isNotNull(), text_with_head(F.col("text")))
        .when(source, text_with_head(F.expr(lossy_text("data"))))
        .when(
            mime.isNotNull(),
            F.when(F.size(head) > 0, F.concat(F.array(block("text", F.array_join(head, "\n"))), image)).otherwise(image),
        )
        .otherwise(text_with_head(message))
    )
    return rows.select("batch_id", "ord", F.posexplode_outer(made).alias("n", "_b")).select("batch_id", "ord", "n", "_b.*")


def long_timeout_lines(
    requests: DataFrame, texts: Mapping[str, str], default_timeout_s: float = rules.DEFAULT_TIMEOUT_S
) -> DataFrame:
    """A note per request whose timeout is far above the default."""
    fields = {"timeout_s": short_number("timeout_s"), "factor": f"'{rules.LONG_TIMEOUT_FACTOR}'", "default": f"'{default_timeout_s:g}'"}
    line = F.concat(F.lit(NOTE_PREFIX), F.expr(messages.message(texts, "long_timeout", **fields)))
    return requests.where("long_timeout").select("batch_id", "ord", line.alias("line"))


def page_text(pages: DataFrame, doc: str = "doc", page_no: str = "page_no", text: str = "text") -> DataFrame:
    """Text of a document from the texts of its pages: ``(doc, text)``, trimmed, blank ones left out.

    A document comes from the body of one row, so its text fits a row again. One without any
    text stays, empty.
    """
    rows = pages.selectExpr(doc, page_no, f"nullif({strip(text)}, '') as _t")
    entries = F.collect_list(F.when(F.col("_t").isNotNull(), F.struct(page_no, "_t")))
    texts = F.transform(F.sort_array(entries), lambda x: x["_t"])
    return rows.groupBy(doc).agg(F.array_join(texts, "\n\n").alias("text"))


def pdf_texts(pages: DataFrame, url: str = "url", page_no: str = "page_no", text: str = "text", error: str | None = None) -> DataFrame:
    """The ``pdf_pages`` argument of ``judge.outcomes`` from a table with a row per PDF page.

    ``error`` names a column with the reason why a document could not be converted; it then has
    no text.
    """
    made = page_text(pages, url, page_no, text).toDF("url", "pdf_text")
    if error is None:
        return made.withColumn("pdf_error", F.lit(None).cast("string"))
    reasons = pages.groupBy(F.col(url).alias("url")).agg(F.min(error).alias("pdf_error"))
    return made.join(reasons, "url").select("url", F.when(F.col("pdf_error").isNull(), F.col("pdf_text")).alias("pdf_text"), "pdf_error")
