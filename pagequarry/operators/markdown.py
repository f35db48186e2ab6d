"""Markdown documents from block tables, and numbered citations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pagequarry.functions import urls
from pagequarry.functions.inline import MD_LINK, markdown_text
from pagequarry.functions.text import keep_if, lit
from pagequarry.operators import html as pages_html


def _with_lines(df: DataFrame, blocks: str, links: bool, images: bool) -> DataFrame:
    """Add ``_lines``: the Markdown of each block with what stands before it.

    List items and line breaks stay close to the block before, other blocks do not.
    """
    bodies = (
        f"transform(filter({blocks}, _b -> _b.container <> 'head'), _b -> struct(_b.tag as tag, _b.list_depth as list_depth, "
        f"_b.ordered as ordered, if(contains(_b.inner, '<'), {markdown_text('_b.inner', links, images)}, _b.txt) as body))"
    )
    lines = """transform(filter(_bodies, _l -> _l.body <> ''), _l -> concat(
        case _l.tag when 'li' then '\\n' when 'br' then '  \\n' else '\\n\\n' end,
        case when _l.tag rlike '^h[1-6]$' then concat(repeat('#', cast(substring(_l.tag, 2, 1) as int)), ' ', _l.body)
            when _l.tag = 'li' then concat(repeat('  ', greatest(_l.list_depth - 1, 0)), if(_l.ordered, '1. ', '- '), _l.body)
            when _l.tag = 'blockquote' then concat('> ', _l.body)
            else _l.body end))"""
    return df.withColumn("_bodies", F.expr(bodies)).withColumn("_lines", F.expr(lines)).drop("_bodies")


_JOINED = "if(size(_lines) > 0, regexp_replace(array_join(_lines, ''), '^\\\\s+', ''), null)"


def with_markdown(
    df: DataFrame, blocks: str = "blocks", name: str = "markdown", links: bool = True, images: bool = True
) -> DataFrame:
    """Add the Markdown of a column of blocks; null without any text. Lines are never wrapped."""
    return _with_lines(df, blocks, links, images).withColumn(name, F.expr(_JOINED)).drop("_lines")


def rendered(
    df: DataFrame, keep: Sequence[str], blocks: str = "blocks", links: bool = True, images: bool = True
) -> DataFrame:
    """``(keep, markdown)`` of the rows whose blocks have any text."""
    return _with_lines(df, blocks, links, images).selectExpr(*keep, keep_if(_JOINED, "markdown", "_v is not null"))


def render(
    pages: DataFrame, keys: Sequence[str] = ("page_id",), html: str = "html", links: bool = True, images: bool = True
) -> DataFrame:
    """One Markdown text per page that has any: ``(keys, markdown)``."""
    return rendered(pages_html.with_blocks(pages, html, "_blocks"), keys, "_blocks", links, images)


def numbers(links: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """One number per distinct target of a page, in order of first use."""
    first = links.groupBy(*keys, "resolved").agg(F.min("pos").alias("first_pos"))
    return first.withColumn(
        "number", F.row_number().over(W.partitionBy(*keys).orderBy("first_pos"))
    )


def cite(docs: DataFrame) -> DataFrame:
    """Turn links into numbered references listed at the end.

    ``docs`` holds ``markdown`` and ``base`` next to any other columns, which stay. One number
    per distinct target in order of first use; images keep their form and get no number.
    Numbers come from the given text, so a filtered page is numbered by what was kept. All of
    it happens inside the row: no shuffle.
    """
    rest = [c for c in docs.columns if c not in ("markdown", "base")]
    found = docs.selectExpr(
        *rest,
        "base",
        f"split(markdown, {lit(MD_LINK)}, -1) as pieces",
        *[
            f"regexp_extract_all(markdown, {lit(MD_LINK)}, {i}) as {name}"
            for i, name in enumerate(("mark", "anchor", "target"), start=1)
        ],
    )
    resolved = found.selectExpr(
        "*", f"zip_with(mark, target, (_mk, _tg) -> if(_mk = '', {urls.resolve('base', '_tg')}, null)) as resolved"
    )
    listed = resolved.selectExpr("*", "array_distinct(array_compact(resolved)) as refs")
    texts = listed.selectExpr(
        *rest,
        "refs",
        "pieces",
        """transform(anchor, (_an, _i) -> if(mark[_i] = '',
            concat(_an, ' [', array_position(refs, resolved[_i]), ']'),
            concat('![', _an, '](', target[_i], ')'))) as texts""",
    )
    return texts.selectExpr(
        *rest,
        "concat(array_join(zip_with(pieces, texts, (_p, _t) -> concat(_p, coalesce(_t, ''))), ''), "
        "if(size(refs) = 0, '', concat('\\n\\n## References\\n\\n', "
        "array_join(transform(refs, (_r, _i) -> concat('[', _i + 1, ']: ', _r)), '\\n')))) as markdown",
    )
