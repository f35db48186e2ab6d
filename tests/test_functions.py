"""Table-driven checks of the SQL-text functions, each in one job."""

import html

import pytest

from pagequarry.functions import headers as H
from pagequarry.functions import judging as J
from pagequarry.functions import rules, urls
from pagequarry.functions import text as T


def values(spark, rows, schema, sql):
    df = spark.createDataFrame(rows, schema).coalesce(1)
    return [r[0] for r in df.selectExpr(f"{sql} as v").collect()]


def test_url_validity(spark):
    cases = {
        "https://a.example/x": True, "HTTP://A.example": True, "http://h_x.example/a b": True,
        "http://": False, "ftp://a.example": False, "a.example": False, "http://:80/": False,
        "http://user@/": False, "http://[::1]/x": True, "http://[zz]/": False, "http://a]b/": False,
        "mailto:a@b": False, "": False, "https:a": False,
    }
    assert values(spark, [(k,) for k in cases], "u string", urls.is_web_url("u")) == list(cases.values())


def test_strip_is_unicode_aware(spark):
    raw = ["　http://a\xa0\n", "\x1c x  ", "plain"]
    assert values(spark, [(x,) for x in raw], "u string", T.strip("u")) == [x.strip() for x in raw]


@pytest.mark.parametrize(
    "url,ext,name",
    [
        ("https://u:p@Host.example:8443/a%20b/c%2Fd?q=1&r=/x#f", ".md", "host.example_8443_a b_c_d_q=1&r=_x.md"),
        ("http://h.example/page.md", ".md", "h.example_page.md"),
        ("http://h.example/page.md/", ".md", "h.example_page.md"),
        ("http://h.example/a+b/100%", ".html", "h.example_a+b_100%.html"),
        ("http://h.example:99999/x", ".md", "h.example_x.md"),
        ("http://h.example//a///b", "", "h.example_a_b"),
        ("http://[::1]:80/z", ".md", "_1_80_z.md"),
    ],
)
def test_file_names(spark, url, ext, name):
    assert values(spark, [(url, ext)], "u string, e string", urls.file_name("u", "e")) == [name]


def test_long_names_are_cut_at_a_character(spark):
    url = "http://h.example/" + "あ" * 80
    (name,) = values(spark, [(url,)], "u string", urls.file_stem("u", "''"))
    head, digest = name.rsplit("-", 1)
    assert len(digest) == 8 and 197 < len(head.encode()) <= 200 and set(head[10:]) == {"あ"}


def test_resolve_links(spark):
    base = "https://h.example/a/b/c.html?x=1#top"
    cases = {
        "/r": "https://h.example/r", "d": "https://h.example/a/b/d", "../d": "https://h.example/a/d",
        "../../../d": "https://h.example/d", "./": "https://h.example/a/b/", "?y": "https://h.example/a/b/c.html?y",
        "#f": "https://h.example/a/b/c.html?x=1#f", "//o.example/z": "https://o.example/z",
        "mailto:x@y": "mailto:x@y", "": "https://h.example/a/b/c.html?x=1", "d/../e?p=../q": "https://h.example/a/b/e?p=../q",
    }
    got = values(spark, [(base, k) for k in cases], "b string, r string", urls.resolve("b", "r"))
    assert got == list(cases.values())


def test_proxies(spark):
    cases = {
        "proxy.example:3128": None, "SOCKS5://u:p@h:1": None, "ftp://h:1": "unsupported_scheme",
        "http://:1": "missing_host", "http://h:x": "bad_port", "http://h:70000": "bad_port", "http://h": "missing_port",
    }
    got = values(spark, [(k,) for k in cases], "p string", urls.proxy_reason(urls.full_proxy("p")))
    assert got == list(cases.values())
    shown = values(spark, [("u:p@h:1",), ("http://a@b@h/x@y",), ("h:1",)], "p string", urls.redact("p"))
    assert shown == ["***@h:1", "http://***@h/x@y", "h:1"]


def test_directories(spark):
    cases = {"": None, "a/b": None, "/a": "absolute", "..": "outside", "a/../..": "outside", "a/..": None, "a/../b/../../c": "outside"}
    assert values(spark, [(k,) for k in cases], "d string", urls.check_directory("d")) == list(cases.values())


def test_suffixes(spark):
    cases = {"/a.PNG": ".PNG", "/a.tar.gz": ".gz", "/.bashrc": None, "/a.toolongsuffix": None, "/a.b/": ".b", "/a.b/c": None, "/a.": None}
    got = values(spark, [("http://h" + k + "?x=.y",) for k in cases], "u string", urls.path_suffix("u"))
    assert got == list(cases.values())


def test_entities_match_the_standard_library(spark):
    cases = ["a &amp; b", "&lt;&amp;lt;", "&amp;amp;", "&copyfoo", "&notit; &notin;", "&#8364;&#x20AC;&#x1F600;", "&#0;", "&am &amp", "& x &", "&eacute &hellip;", "&#38;lt;", "none"]
    assert values(spark, [(c,) for c in cases], "t string", T.decode_entities("t")) == [html.unescape(c) for c in cases]


def test_error_summaries(spark):
    cases = {
        "Unexpected error in f at line 1\nx net::ERR_ABORTED y": "net::ERR_ABORTED",
        "Unexpected error in f\n\n  Error: Failed on navigating a\n  real cause \nmore": "real cause",
        "Unexpected error in f": "Unexpected error in f", "\n \n": "", "one\r\ntwo": "one",
    }
    got = values(spark, [(k,) for k in cases] + [(None,)], "t string", T.summary("t"))
    assert got == [*cases.values(), None]


def test_one_newline_and_numbers(spark):
    assert values(spark, [("a",), ("a\n",), (None,)], "t string", T.one_newline("t")) == ["a\n", "a\n", "\n"]
    assert values(spark, [(60.0,), (2.5,)], "n double", T.short_number("n")) == ["60", "2.5"]


def test_error_kinds_and_their_order(spark):
    cases = {
        "Executable doesn't exist: timed out": "browser_not_installed", "net::ERR_PROXY_CERTIFICATE_INVALID": "proxy",
        "net::ERR_CERT_DATE_INVALID timed out": "tls", "[SSL: WRONG_VERSION_NUMBER]": "tls",
        "net::ERR_NAME_RESOLUTION_FAILED": "name_resolution", "net::ERR_CONNECTION_REFUSED": "connection_refused",
        "Timeout 30000ms exceeded": "timeout", "request timed out": "timeout", "net::ERR_ABORTED": "non_html",
        "Download is starting": "non_html", "timeout exceeded": "other", "": "other",
    }
    rows = [(k,) for k in cases] + [(None,)]
    assert values(spark, rows, "t string", J.error_kind("t")) == [*cases.values(), "other"]
    user = [(2, "teapot", "blocked"), (1, "short and stout", "timeout")]
    assert values(spark, [("Teapot, short and stout",), ("x",)], "t string", J.kind_by_rules("t", user)) == ["timeout", None]


def test_plain_http_kinds(spark):
    rows = [("proxy", "refused"), ("timeout", "[ssl: x"), ("read", "TLSv1 alert"), ("connect", "getaddrinfo failed"), ("connect", "Connection refused"), ("read", "refused")]
    got = values(spark, rows, "c string, t string", J.transport_kind("c", "t"))
    assert got == ["proxy", "timeout", "tls", "name_resolution", "connection_refused", "other"]
    assert values(spark, [("403 Forbidden",), (" 502",), ("4033",), ("x 403",)], "t string", J.connect_status("t")) == [403, 502, None, None]


MAP = "from_json(j, 'map<string,string>')"


def test_headers(spark):
    # From JSON, which keeps the order of the keys.
    df = [('{"A":"1","a":"2","B":null,"Content-Length":"x"}',)]
    schema = "j string"
    assert values(spark, df, schema, H.header(MAP, "a")) == ["1"]
    assert values(spark, df, schema, H.last_header(MAP, "A")) == ["2"]
    assert values(spark, df, schema, H.lower_names(MAP)) == [{"a": "2", "content-length": "x"}]
    assert values(spark, df, schema, H.header(MAP, "b")) == [None]


def test_kept_bodies(spark):
    png = {"content-type": "image/png"}
    rows = [
        (200, png), (200, png | {"content-length": str(rules.SCAN_LENGTH * 1024)}), (200, png | {"content-length": "67108865"}),
        (200, png | {"content-length": "many"}), (404, png), (200, {"content-type": "text/html"}), (200, {}), (None, png),
    ]
    got = values(spark, rows, "s int, h map<string,string>", H.keeps_body("s", "h", H.KEPT_BODY_BYTES))
    assert got == [True, True, False, False, False, False, False, False]


def test_interference_order(spark):
    stock = f"<title>\n {rules.PROXY_ERROR_TITLE.upper()} </title>"
    challenge = {"CF-Mitigated": "Challenge "}
    rows = [
        ({"X-Squid-Error": "ERR_DNS 0"}, "", 503), ({"X-Squid-Error": "err_access_denied 0"} | challenge, "", 503),
        ({"X-Squid-Error": "ERR_DNS"}, "", 403), ({}, stock, 503), ({}, stock, 200), ({}, stock, None),
        ({}, stock + '<body class=x id="ERR_FORWARDING_DENIED">', 503), (challenge, stock, 403), (challenge, "", 200),
        ({"X-Squid-Error": " "} | challenge, "", 503), (None, None, 503),
    ]
    df = spark.createDataFrame(rows, "h map<string,string>, html string, s int").coalesce(1)
    got = [tuple(r) for r in J.add_interference(df, "h", "html", "s", "x").select("x_sign", "x_detail").collect()]
    title = rules.PROXY_ERROR_TITLE.upper()
    page, none, bot = "proxy_page", (None, None), ("challenge", "challenge")
    assert got == [(page, "ERR_DNS 0"), none, none, (page, title), none, (page, title), none, none, bot, bot, none]
