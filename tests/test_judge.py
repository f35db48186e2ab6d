"""Hand-made captures through the whole decision."""

import base64
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from pagequarry import schemas
from pagequarry.functions import catalog, rules
from pagequarry.operators import batches, judge, messages, naming, report
from pagequarry.sources import captures as source

PROXY = "http://u:p@proxy.example:1"
HTML = {"content-type": "text/html"}


def capture(url, attempt=1, **fields):
    return {"url": url, "attempt": attempt, **fields}


def frame(spark, rows):
    df = spark.createDataFrame(
        [tuple(r.get(c) for c in schemas.CAPTURES) for r in rows], schemas.ddl(schemas.CAPTURES)
    )
    return source.normalise(df)


def run(spark, rows, fmt="markdown", **options):
    captures = frame(spark, rows)
    urls = list(dict.fromkeys(r["url"] for r in rows))
    requests = spark.createDataFrame(
        [(1, i, u, fmt, 9.0) for i, u in enumerate(urls)],
        "batch_id long, ord long, url string, format string, timeout double",
    )
    out = judge.outcomes(requests, captures, rules.media_types(spark), **options)
    return {r.url: r for r in out.collect()}


def test_pages_and_failures(spark):
    out = run(spark, [
        capture("page", html="<title> T&amp;U </title>x", first_status=200, headers=HTML, final_url="moved"),
        capture("redirect", html="x", first_status=301, final_status=404, headers=HTML),
        capture("start", start_error="Executable doesn't exist", proxy=PROXY),
        capture("startproxy", start_error="net::ERR_PROXY_X", proxy=PROXY),
        capture("raised", raised=True, error_text="net::ERR_ABORTED", first_status=200),
        capture("refused", proxy=PROXY, proxy_status=403, html="", error_text="net::ERR_TUNNEL_CONNECTION_FAILED"),
        capture("refused", 2, html="x", first_status=200),
        capture("noproxy", error_text="net::ERR_PROXY_X"),
        capture("slow", error_text="Timeout 1ms exceeded"),
    ], fmt="html")
    assert (out["page"].ok, out["page"].text, out["page"].title, out["page"].final_url) == (True, "<title> T&amp;U </title>x", "T&U", "moved")
    assert (out["redirect"].error.kind, out["redirect"].status_code, out["redirect"].extension) == ("http_status", 404, ".html")
    kinds = {u: out[u].error.kind for u in out if not out[u].ok}
    assert kinds == {
        "redirect": "http_status", "start": "browser_not_installed", "startproxy": "other", "raised": "non_html",
        "refused": "proxy", "noproxy": "other", "slow": "timeout",
    }
    assert out["refused"].error.proxy == "http://***@proxy.example:1" and out["refused"].error.status_code == 403
    assert not out["refused"].notes and out["slow"].error.timeout_s == 9.0


def test_files_from_every_source(spark):
    png = {"content-type": "image/png; x=y"}
    anti = "Blocked by anti-bot protection: near-empty"
    out = run(spark, [
        capture("probe", probe_status=200, probe_type="Application/PDF", probe_body=b"p", probe_url="final"),
        capture("kept", error_text=anti, first_status=200, headers=png, body=b"k"),
        capture("loaded", error_text=anti, first_status=200, headers=png, dl_status=200, dl_type="image/png", dl_body=b"d"),
        capture("lost", error_text=anti, first_status=200, headers=png, dl_status=404),
        capture("download", error_text="net::ERR_ABORTED", dl_status=200, dl_type=None, dl_body=b"z", dl_url="http://h/x.TGZ"),
        capture("blank", first_status=200, headers={"content-type": "text/plain"}, html="  "),
        capture("tls", first_status=200, headers=png, html="", dl_error_kind="tls", dl_error_text="[ssl: x"),
        capture("odd", first_status=200, headers=png, html="", dl_error_kind="other"),
        capture("proxied", first_status=200, headers=png, html="", dl_status=503, dl_headers={"x-squid-error": "ERR_X"}, dl_body=b""),
        capture("textual", first_status=200, headers={"content-type": "text/plain"}, html="<pre>x</pre>"),
    ], fmt="screenshot")
    assert (out["probe"].content_kind, out["probe"].data, out["probe"].final_url, out["probe"].extension) == ("pdf", b"p", "final", ".pdf")
    assert [n.key for n in out["probe"].notes] == ["pdf_as_is"]
    assert (out["kept"].data, out["kept"].extension, out["kept"].notes[0].params["media_type"]) == (b"k", ".png", "image/png")
    assert out["loaded"].data == b"d" and out["download"].extension == ".TGZ"
    assert [n.key for n in out["download"].notes] == ["not_a_page_unknown"]
    assert {u: out[u].error.kind for u in ("lost", "blank", "tls", "odd", "proxied")} == {
        "lost": "non_html", "blank": "other", "tls": "tls", "odd": "other", "proxied": "other"}
    assert out["blank"].error.detail == "the response has no HTML" and out["proxied"].status_code == 503
    assert out["textual"].error.detail == "no screenshot was captured"


@pytest.mark.parametrize("fmt,field,value,want", [
    ("pdf", "pdf", b"%PDF", b"%PDF"), ("screenshot", "screenshot", base64.b64encode(b"png").decode(), b"png"), ("mhtml", "mhtml", "MIME", "MIME"),
])
def test_browser_artifacts(spark, fmt, field, value, want):
    out = run(spark, [capture("a", html="x", first_status=200, **{field: value}), capture("b", html="x", first_status=200)], fmt)
    assert (out["a"].data or out["a"].text) == want
    assert not out["b"].ok and out["b"].status_code == 200 and out["b"].error.kind == "other"


def test_retries(spark):
    rows = []
    for i, (text, status) in enumerate([("net::ERR_SSL_X", None), (None, 503), (None, 404), ("net::ERR_NAME_NOT_RESOLVED", None), ("net::ERR_CONNECTION_REFUSED", None)]):
        rows += [capture(f"u{i}", proxy=PROXY, error_text=text, first_status=status, html=""), capture(f"u{i}", 2, html="ok", first_status=200, headers=HTML)]
    rows += [capture("alone", proxy=PROXY, error_text="net::ERR_SSL_X"), capture("direct", error_text="net::ERR_SSL_X"), capture("direct", 2, html="x", first_status=200)]
    out = run(spark, rows, "html")
    assert [out[f"u{i}"].ok for i in range(5)] == [True, True, False, False, True]
    assert out["u0"].notes[0].params["kind"] == "tls" and out["alone"].retry_missing and not out["direct"].ok
    assert not any(r.ok for r in run(spark, rows, "html", fallback=False).values())


def test_final_responses_serve_one_attempt(spark):
    rows = [capture(u, html="x", first_status=301, final_status=200, headers=HTML) for u in ("a", "a/", "b/", "c")]
    final = spark.createDataFrame(
        [("a", 200, {"content-type": "image/png"}, b"i"), ("b", 200, {"content-type": "image/gif"}, b"g"), ("c", 500, {}, None)],
        "url string, status int, headers map<string,string>, body binary",
    )
    captures = frame(spark, rows)
    got = {r.url: (r.by_final, r.ctype) for r in judge.effective(judge.with_final(captures, judge.final_by_url(captures, final))).collect()}
    assert got == {"a": (True, "image/png"), "a/": (False, "text/html"), "b/": (True, "image/gif"), "c": (False, "text/html")}


def test_converted_pdfs(spark):
    rows = [capture(u, probe_status=200, probe_type="application/pdf", probe_body=b"p") for u in ("t", "e", "f", "n")]
    pages = spark.createDataFrame([("t", "text", None), ("e", "", None), ("f", None, "broken")], "url string, pdf_text string, pdf_error string")
    out = run(spark, rows, pdf_pages=pages)
    assert (out["t"].text, out["t"].extension, out["t"].notes, out["t"].data) == ("text", ".md", [], None)
    assert (out["e"].text, out["e"].notes[0].key) == ("", "pdf_without_text")
    assert (out["f"].data, out["f"].notes[0].params) == (b"p", {"error": "broken"})


def test_often_requested_urls_are_spread_without_loss(spark, monkeypatch):
    from pagequarry.operators import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 4)
    captures = frame(spark, [capture("hot", proxy=PROXY, error_text="net::ERR_SSL_X"), capture("hot", 2, html="x", first_status=200), capture("cold", html="y", first_status=200)])
    requests = spark.range(60).select("id", (F.col("id") + 0).alias("batch_id"), F.lit(0).cast("long").alias("ord"), F.when(F.col("id") % 20 > 0, "hot").otherwise("cold").alias("url"), F.lit("html").alias("format"), F.lit(60.0).alias("timeout"))
    out = judge.outcomes(requests.drop("id"), captures, rules.media_types(spark))
    assert out.count() == 60 and out.where("ok").count() == 60


def test_messages_quote_errors_in_one_language(spark):
    rows = [capture("http://h/", proxy=PROXY, error_text="net::ERR_SSL_X"), capture("http://h/", 2, html="x", first_status=999)]
    captures = frame(spark, rows)
    requests = spark.createDataFrame([(1, 0, "http://h/", "html", 9.0)], "batch_id long, ord long, url string, format string, timeout double")
    out = judge.outcomes(requests, captures, rules.media_types(spark))
    assert report.error_lines(out, catalog.texts()).first().line == "error: the server answered 999: http://h/"
    note = messages.note_rows(out, catalog.texts("ja")).first().note
    assert "安全な接続" in note and "net::ERR_SSL_X" in note


def test_requests_without_capture_are_reported(spark):
    captures = frame(spark, [capture("a", html="x", first_status=200)])
    requests = spark.createDataFrame([(1, 0, "a", "html", 9.0), (1, 1, "b", "html", 9.0)], "batch_id long, ord long, url string, format string, timeout double")
    assert [r.url for r in judge.unpaired(requests, captures).collect()] == ["b"]
    out = {r.url: r for r in judge.outcomes(requests, captures, rules.media_types(spark)).collect()}
    assert not out["b"].captured and out["b"].error.detail == "no capture for this URL"


def test_a_stored_body_is_used_whatever_its_length_header_says(spark):
    lengths = ("99999999", "x", None)
    rows = [capture(f"u{i}", first_status=200, headers={"content-type": "image/png"} | ({"content-length": n} if n else {}), html="", body=b"png") for i, n in enumerate(lengths)]
    assert [bytes(r.data) for r in run(spark, rows).values()] == [b"png"] * 3


def test_a_damaged_screenshot_is_one_failed_row(spark):
    rows = [capture(u, html="x", first_status=200, screenshot=s) for u, s in (("bad", "a"), ("good", base64.b64encode(b"png").decode()))]
    out = run(spark, rows, "screenshot")
    assert (out["bad"].ok, out["bad"].error.detail, bytes(out["good"].data)) == (False, "the screenshot cannot be read", b"png")


def test_a_timeout_that_cannot_be_is_an_error(spark):
    requests = spark.createDataFrame([(1, 0, "u", "html", -1.0), (1, 1, "u", "html", None)], "batch_id long, ord long, url string, format string, timeout_s double")
    rows = [capture("u", proxy=PROXY, error_text="net::ERR_SSL_X"), capture("u", 2, html="x", first_status=200)]
    out = {r.ord: r for r in judge.outcomes(batches.with_options(requests), frame(spark, rows), rules.media_types(spark)).collect()}
    assert (out[0].ok, out[0].error.kind, out[0].error.detail, out[0].notes) == (False, "other", "timeout_not_positive", [])
    assert out[1].ok and out[1].notes[0].key == "retried_direct"


def test_repeated_pdf_texts_give_one_outcome(spark):
    rows = [capture("t", probe_status=200, probe_type="application/pdf", probe_body=b"p")]
    pages = spark.createDataFrame([("t", "text", None)] * 3, "url string, pdf_text string, pdf_error string")
    captures = frame(spark, rows)
    requests = spark.createDataFrame([(1, 0, "t", "markdown", 9.0)], "batch_id long, ord long, url string, format string, timeout double")
    assert judge.outcomes(requests, captures, rules.media_types(spark), pdf_pages=pages).count() == 1


def test_rules_of_the_job(spark):
    signs = replace(rules.SIGNS, proxy_headers=(*rules.SIGNS.proxy_headers, "X-Own"), challenges=(("x-guard", "Prove"),), denial_codes=("NO_ENTRY",))
    rows = [
        capture("own", proxy=PROXY, html="x", first_status=200, headers={"x-own": "GATE 7"}),
        capture("denied", proxy=PROXY, html="x", first_status=200, headers={"x-own": "NO_ENTRY 7"}),
        capture("guard", proxy=PROXY, html="x", first_status=200, headers={"X-Guard": " prove "}),
        capture("text", error_text="The moon is in the way"),
    ]
    got = {r.url: (r.verdict, r.kind) for r in judge.verdict(frame(spark, rows), signs, [(1, "MOON", "timeout")]).collect()}
    assert got == {"own": ("failed", "proxy"), "denied": ("page", None), "guard": ("failed", "blocked"), "text": ("failed", "timeout")}


def test_write_failures_count_and_are_told(spark):
    rows = [capture(f"http://h/{i}", html="x", first_status=200 if i < 3 else 404) for i in range(4)]
    captures = frame(spark, rows)
    requests = spark.createDataFrame([(b, i, f"http://h/{i}", "html", 9.0) for b in (1, 2) for i in range(4)], "batch_id long, ord long, url string, format string, timeout double")
    out = judge.outcomes(requests, captures, rules.media_types(spark))
    broken = spark.createDataFrame([(1, 0, "full"), (2, 0, "full"), (2, 1, "full"), (2, 2, "full")], "batch_id long, ord long, reason string")
    named = naming.named_records(out).withColumn("token", F.concat(F.lit("t"), "ord"))
    records = report.manifest(named, catalog.texts(), "d", broken, "https://f", "token").cache()
    assert {r.batch_id: (r.saved, r.failed, r.exit_code, r.none_saved) for r in report.saved_summary(records).collect()} == {1: (2, 2, 1, False), 2: (0, 4, 1, True)}
    assert {r.batch_id: r.failed_urls for r in report.failed_lists(records).collect()}[1] == ["http://h/0", "http://h/3"]
    lines = [r.line for r in report.saved_lines(records, catalog.texts()).orderBy("batch_id", "section", "ord", "n").collect()]
    assert "error: could not be written to d/h_0.html: full: http://h/0" in lines and "file: https://f/files/t1" in lines
    assert "done: 0 saved, 4 not" in lines and "error: none of 4 could be saved" in lines
    logged = [(r.level, r.line) for r in report.log_lines(out, catalog.texts(), records).where("batch_id = 1").orderBy("ord", "n").collect()]
    assert ("INFO", "saved: http://h/1 -> d/h_1.html (1 bytes)") in logged and ("WARNING", "error: the server answered 404 (Not Found): http://h/3") in logged


def test_failed_lists_go_on_in_pieces(spark):
    rows = spark.range(25).select(F.lit(1).alias("batch_id"), F.col("id").alias("ord"), F.concat(F.lit("u"), "id").alias("url"), F.lit(False).alias("ok"))
    got = report.failed_lists(rows, piece=10).orderBy("piece").collect()
    assert [x for r in got for x in r.failed_urls] == [f"u{i}" for i in range(25)] and len(got) == 3
