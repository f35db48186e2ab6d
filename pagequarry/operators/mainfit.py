"""Main-content filtering: block scores, text repeated across a site, and the notes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry import schemas
from pagequarry.functions import urls
from pagequarry.operators import skew
from pagequarry.operators.judge import no_notes, note

REPEATED_ON = 3  # a block on this many pages of one host is boilerplate
KEEP_SCORE = 0.5


def _digests(pages: DataFrame, keys: Sequence[str], blocks: str) -> DataFrame:
    """Each distinct block text of a page: ``(keys, host, digest)``. Texts stay where they are."""
    own = F.array_distinct(F.transform(blocks, lambda b: F.md5(b["txt"])))
    rows = pages.select(*keys, F.expr(urls.host("url")).alias("host"), F.explode_outer(own).alias("digest"))
    return rows.where("digest is not null")


def repeated_blocks(pages: DataFrame, blocks: str = "blocks", approximate: bool = False) -> DataFrame:
    """On how many pages of a host a block text appears: ``(host, digest, pages)``.

    ``pages`` holds ``url`` and a column of blocks, one row per page. Copies inside a page are
    dropped in its row; the count per text is partially aggregated, so a site with most of the
    pages, or a text on all of them, costs one row per task.
    """
    if approximate:
        hashed = pages.select(F.monotonically_increasing_id().alias("_page"), "url", blocks)
        return _digests(hashed, ["_page"], blocks).groupBy("host", "digest").agg(
            F.approx_count_distinct("_page").alias("pages")
        )
    return _digests(pages, [], blocks).groupBy("host", "digest").agg(F.count("*").alias("pages"))


def block_score(block: Column) -> Column:
    """Weight of the container, text length and link density; repeated text scores zero."""
    density = block["link_chars"] / F.greatest(F.length(block["txt"]), F.lit(1))
    weight = (
        F.when(block["container"].isin("head", "nav", "footer", "aside", "ad", "header"), 0.0)
        .when(block["container"].isin("article", "main"), 1.0)
        .otherwise(0.7)
    )
    heading = block["tag"].rlike("^h[1-6]$")
    length = F.when(heading, 1.0).otherwise(F.least(F.length(block["txt"]) / 40.0, F.lit(1.0)) * 0.5 + 0.5)
    return F.when(block["repeated"], 0.0).otherwise(weight * length * (1 - density))


def mark_repeated(
    pages: DataFrame,
    keys: Sequence[str] = ("page_id",),
    repeated_on: int = REPEATED_ON,
    blocks: str = "blocks",
    counted: Column | None = None,
) -> DataFrame:
    """Add ``repeated`` to every block of a table that holds ``url`` and a column of blocks.

    The table is read twice, so it should be a written one. Only digests are counted and joined
    back; a footer that makes up much of the data is a hot key of that join and is spread. What
    a page then gets is the set of its own repeated digests. ``counted`` says which rows count,
    where pages have copies.
    """
    own = _digests(pages if counted is None else pages.where(counted), [], blocks)
    frequent = own.groupBy("host", "digest").agg(F.count("*").alias("pages")).where(F.col("pages") >= repeated_on)
    hot = skew.hot_keys(frequent, ["host", "digest"], counts="pages")
    hits = skew.lookup(
        _digests(pages, keys, blocks), frequent.select("host", "digest"), ["host", "digest"], [*keys], "inner", hot
    )
    sets = hits.groupBy(*keys).agg(F.collect_set("digest").alias("_repeated"))
    marked = F.transform(
        blocks,
        lambda b: b.withField("repeated", F.coalesce(F.array_contains("_repeated", F.md5(b["txt"])), F.lit(False))),
    )
    return pages.join(sets, list(keys), "left").withColumn(blocks, marked).drop("_repeated")


def fit(
    pages: DataFrame,
    score: Callable[[Column], Column] = block_score,
    keep: float = KEEP_SCORE,
    blocks: str = "blocks",
) -> DataFrame:
    """Keep the blocks of the main content, and add ``md_notes``.

    ``score`` is any expression over the fields of a block. A page where nothing is kept, or
    where the score is null somewhere, keeps all its blocks and gets a note saying so. All of
    it happens inside the row.
    """
    rated = pages.withColumn("_scores", F.transform(blocks, score))
    failed = F.exists("_scores", lambda s: s.isNull())
    found = F.exists("_scores", lambda s: F.coalesce(s >= keep, F.lit(False)))
    kept = F.filter(blocks, lambda b, i: F.get("_scores", i) >= keep)
    notes = (
        F.when(failed, F.array(note("filter_failed", reason=F.lit("a block has no score"))))
        .when(~found, F.array(note("filter_kept_nothing")))
        .otherwise(no_notes())
        .cast(schemas.NOTES)
    )
    return (
        rated.withColumn("md_notes", F.when(F.size(blocks) > 0, notes).otherwise(no_notes()))
        .withColumn(blocks, F.when(~failed & found, kept).otherwise(F.col(blocks)))
        .drop("_scores")
    )
