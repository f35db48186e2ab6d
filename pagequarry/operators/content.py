"""Text of judged pages with the content options of a job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.operators import html, mainfit, markdown
from pagequarry.operators.judge import no_notes
from pagequarry.session import written


def page_text(
    fit: bool = False, citations: bool = False, links: bool = True, images: bool = True,
    score: Callable[[Column], Column] = mainfit.block_score,
) -> Callable[[DataFrame], DataFrame]:
    """The ``markdown`` argument of ``judge.outcomes`` for these options.

    It adds ``markdown`` and ``md_notes`` to judged rows where they are; only those that are a
    page have them. ``fit`` keeps the main content; ``citations`` numbers the links of what was
    kept; ``links`` and ``images`` can be dropped.
    """

    def texts(judged: DataFrame) -> DataFrame:
        rest = [c for c in judged.columns]
        rows = html.with_blocks(judged.withColumn("_page", F.expr("if(verdict = 'page', html, null)")), "_page")
        if fit:
            # Counted and marked: two readers. Copies of a page for its parts count once.
            rows = mainfit.mark_repeated(written(rows, "blocks"), ("url", "_part"), counted=F.col("_part") == 0)
            rows = mainfit.fit(rows, score)
        else:
            rows = rows.withColumn("md_notes", no_notes())
        rows = markdown.with_markdown(rows, links=links, images=images)
        if citations:
            rows = markdown.cite(rows.withColumn("base", F.expr("coalesce(nullif(final_url, ''), url)")))
        return rows.select(*rest, "markdown", "md_notes")

    return texts
