import time

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import html, mainfit, markdown, report, skew
from pagequarry.sources import sinks

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<!-- <p>no</p> --><nav><ul><li><a href="/home">Home</a></li></ul></nav>
<main><h2>Head &amp; <em>more</em></h2><p>A <b>bold</b> <a title='x' href="b">link</a> and <a href=c>bare</a>, <a>none</a>
and <img src="i.png" alt="pic">.<br>Second<ul><li>one<ul><li>inner</li></ul></li><li>two</li></ul>
<ol><li>first</li></ol><blockquote>said</blockquote><script>document.write("</p>")</script><a href="d">open end</main>
<footer>foot</footer>"""


def pages(spark, *texts):
    return spark.createDataFrame(
        [(i, f"http://h.example/x/{i}", t) for i, t in enumerate(texts)], "page_id long, url string, html string"
    )


def test_markdown_of_nested_and_unclosed_tags(spark):
    blocks = html.blocks(pages(spark, PAGE))
    (row,) = markdown.render(pages(spark, PAGE)).collect()
    assert row.markdown == (
        "- [Home](/home)\n\n## Head & _more_\n\nA **bold** [link](b) and bare, none and ![pic](i.png).  \nSecond\n"
        "- one\n  - inner\n- two\n1. first\n\n> said\n\nopen end\n\nfoot"
    )
    (plain,) = markdown.render(pages(spark, PAGE), links=False, images=False).collect()
    assert "](" not in plain.markdown and "A **bold** link and bare" in plain.markdown
    kinds = {r.txt: (r.container, r.list_depth, r.ordered) for r in blocks.collect()}
    assert kinds["Home"] == ("nav", 1, False) and kinds["inner"] == ("main", 2, False) and kinds["first"] == ("main", 1, True)
    assert kinds["T"][0] == "head" and kinds["foot"][0] == "footer"


def test_stray_closing_tags_do_not_go_below_zero(spark):
    got = html.blocks(pages(spark, "</nav></nav><p>a<nav>b</nav>c</ul><li>d")).collect()
    assert {r.txt: r.container for r in got} == {"a": "body", "b": "nav", "c": "body", "d": "body"}
    assert all(r.list_depth == 0 for r in got)


def test_tokens_lose_nothing(spark):
    (text,) = ["<p>a < b <i>c</i> <unclosed"]
    rows = html.tokens(pages(spark, text)).orderBy("pos").collect()
    assert "".join(r.tok for r in rows).replace(" ", "") == text.replace(" ", "")


def test_citations_number_distinct_targets(spark):
    docs = spark.createDataFrame(
        [(1, "x [a](b) ![i](i.png) [c](/d) [e](b) end", "http://h/p/"), (2, "none", "http://h/")], "page_id long, markdown string, base string"
    )
    got = {r.page_id: r.markdown for r in markdown.cite(docs).collect()}
    assert got == {1: "x a [1] ![i](i.png) c [2] e [1] end\n\n## References\n\n[1]: http://h/p/b\n[2]: http://h/d", 2: "none"}


def test_fit_keeps_the_article(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 2)
    body = "<nav><a href=a>menu</a></nav><article><p>{}</article><div><p>Subscribe to the letter of this site, it is free</div><footer>all rights</footer>"
    table = pages(spark, *[body.format(f"A long enough paragraph number {i} with many words in it.") for i in range(4)], "<nav>only menu</nav>")
    blocks = html.with_blocks(table).drop("html")
    fitted = markdown.with_markdown(mainfit.fit(mainfit.mark_repeated(blocks)))
    got = {r.page_id: r for r in fitted.collect()}
    assert got[0].markdown == "A long enough paragraph number 0 with many words in it." and got[4].markdown == "only menu"
    assert {i: [n.key for n in r.md_notes] for i, r in got.items()} == {0: [], 1: [], 2: [], 3: [], 4: ["filter_kept_nothing"]}
    exact = {(r.host, r.digest): r.pages for r in mainfit.repeated_blocks(blocks).collect()}
    about = {(r.host, r.digest): r.pages for r in mainfit.repeated_blocks(blocks, approximate=True).collect()}
    assert exact == about and max(exact.values()) == 4


def test_a_score_of_the_user(spark):
    table = html.with_blocks(pages(spark, "<p>yes</p><p>no</p>", "<p>yes</p><p>broken</p>"))
    fitted = mainfit.fit(table, score=lambda b: F.when(b["txt"] == "yes", 1.0).when(b["txt"] == "no", 0.0))
    rows = {r.page_id: r for r in fitted.collect()}
    assert {i: [b.txt for b in r.blocks] for i, r in rows.items()} == {0: ["yes"], 1: ["yes", "broken"]}
    assert {i: [n.key for n in r.md_notes] for i, r in rows.items()} == {0: [], 1: ["filter_failed"]}


@pytest.mark.parametrize("unit", ["<a>", "<title>", "<p ", "<title <body id=", "<img ", "<b>", "<!", "</a", "<ul>"])
def test_hostile_pages_cost_in_proportion(spark, unit):
    def seconds(n):
        table = pages(spark, unit * n).cache()
        table.count()
        start = time.perf_counter()
        html.tokens(table).count()
        html.links(table).count()
        html.titles(table).collect()
        html.blocks(table).select(F.max("txt"), F.sum("link_chars")).collect()
        return time.perf_counter() - start

    seconds(100)
    # Eight times the page: far from the sixty-four times of a quadratic search.
    assert seconds(16_000) < 24 * max(seconds(2_000), 0.5)


def test_deep_nesting_over_many_segments(spark):
    text = "<ul>" * 1500 + "<li>deep" + "</ul>" * 1490 + "<li>up" + "</ul>" * 20 + "<ol><li>last</ol><p>out"
    got = {r.txt: (r.list_depth, r.ordered) for r in html.blocks(pages(spark, text)).collect()}
    assert got == {"deep": (1500, False), "up": (10, False), "last": (1, True), "out": (0, False)}


def test_page_texts(spark):
    df = spark.createDataFrame([(1, 2, " b "), (1, 1, "a"), (1, 3, " "), (2, 1, ""), (2, 2, None)], "doc long, page_no long, text string")
    assert sorted(tuple(r) for r in report.page_text(df).collect()) == [(1, "a\n\nb"), (2, "")]


def test_a_pdf_of_many_pages_is_one_row(spark):
    pages_ = spark.range(1500).select(F.lit("u").alias("url"), F.col("id").alias("page_no"), F.concat(F.lit("p"), "id").alias("text"), F.lit(None).cast("string").alias("error"))
    (row,) = report.pdf_texts(pages_, error="error").collect()
    assert row.pdf_text.split("\n\n") == [f"p{i}" for i in range(1500)] and row.pdf_error is None
    (bad,) = report.pdf_texts(pages_.withColumn("error", F.lit("damaged")), error="error").collect()
    assert (bad.pdf_text, bad.pdf_error) == (None, "damaged")


def test_payload_folders_are_replaced_one_by_one(spark, tmp_path):
    schema = "batch_id long, ord long, allocated string, text string, data binary, extension string"
    path = str(tmp_path / "out")
    sinks.write_payloads(spark.createDataFrame([(1, 0, "a.md", "é", None, ".md"), (1, 1, "a.png", None, bytearray(b"p"), ".png")], schema), path)
    sinks.write_payloads(spark.createDataFrame([(1, 0, "b.md", None, None, ".md")], schema), path)
    got = {r.name: bytes(r.payload) for r in spark.read.parquet(path).collect()}
    assert got == {"b.md": b"", "a.png": b"p"}


def test_lines_are_written_in_order(spark, tmp_path):
    df = spark.createDataFrame([(2, 0, 0, 0, "c"), (1, 1, 0, 0, "b"), (1, 0, 9, 0, "a")], "batch_id long, section int, ord long, n int, line string")
    sinks.write_lines(df.repartition(3), str(tmp_path / "lines"))
    files = sorted((tmp_path / "lines").glob("part-*"))
    assert "".join(f.read_text() for f in files) == "a\nb\nc\n"
