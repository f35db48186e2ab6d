"""HTML pages as tables: tokens, blocks, links and titles.

``keys`` name the columns that identify a page. A page is taken apart, numbered and nested inside
its row, so nothing here moves between tasks; tables of parts are the rows exploded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import urls
from pagequarry.functions.inline import anchors, attribute, let, link_text_length, plain_text
from pagequarry.functions.judging import page_title
from pagequarry.functions.text import extract, lit, matches, replace_all, strip

TOKEN = r"</?[A-Za-z][^>]*+(?:>|\z)|[^<]++|<"
# Tags that start or end a block, and the containers that matter for main content.
BLOCK_TAGS = (
    "address article aside blockquote body br dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section "
    "table tbody td tfoot th thead title tr ul"
).split()
CONTAINERS = ("head", "nav", "footer", "aside", "header", "article", "main")
BLOCK_START = r"(?i)(</?(?:" + "|".join(BLOCK_TAGS) + r")(?:\s[^>]*+)?+/?(?:>|\z))"
AD_CLASS = r"(^|[\s_-])(ad|ads|advert|banner|sponsored)([\s_-]|$)"
_MARK = "\x01"
_CHUNK = 512  # segments nested together, so that what is added up stays short
_WIDTH = 7  # digits of a depth
BLOCK = (
    "array<struct<pos:int,tag:string,container:string,list_depth:int,ordered:boolean,inner:string,txt:string,link_chars:int>>"
)


def without_hidden(html: str) -> str:
    """HTML without comments, scripts, styles, declarations; unclosed ones run to the end."""
    clean = replace_all(html, r"(?s)<!--.*?(?:-->|\z)", "")
    for tag in ("script", "style", "noscript", "template"):
        clean = replace_all(clean, rf"(?is)<{tag}\b.*?(?:</{tag}\s*>|\z)", "")
    return replace_all(clean, r"<[!?][^>]*+(?:>|\z)", "")


def tokens(pages: DataFrame, keys: Sequence[str] = ("page_id",), html: str = "html") -> DataFrame:
    """Tags and text runs in order: ``(keys, pos, tok, tag, closing)``.

    ``tag`` is null for text. No shuffle: a page is taken apart where it is read.
    """
    rows = pages.selectExpr(
        *keys, f"posexplode_outer(regexp_extract_all({without_hidden(html)}, {lit(TOKEN)}, 0)) as (pos, tok)"
    )
    is_tag = matches("tok", r"^</?[A-Za-z]")
    return rows.where(f"{is_tag} or {strip('tok')} <> ''").selectExpr(
        *keys,
        "pos",
        "tok",
        f"if({is_tag}, lower({extract('tok', r'^</?([A-Za-z][A-Za-z0-9]*)')}), null) as tag",
        "startswith(tok, '</') as closing",
    )


def _depth(state: str, i: int | str) -> str:
    return f"cast(substr({state}, {i} * {_WIDTH} + 1, {_WIDTH}) as int)"


def _moved(state: str, i: str) -> str:
    """A state with depth ``i`` moved by the sign of ``_m``, never below zero."""
    new = f"cast(greatest({_depth(state, i)} + cast(sign(_m) as int), 0) as string)"
    return f"overlay({state}, lpad({new}, {_WIDTH}, '0'), {i} * {_WIDTH} + 1, {_WIDTH})"


def with_blocks(pages: DataFrame, html: str = "html", name: str = "blocks") -> DataFrame:
    """Add the blocks with text as an array of ``BLOCK``, in page order; null for a null page.

    A page is split where a block tag starts. Nesting is counted along the segments, per
    container, and never falls below zero, so no tag has to be closed. ``container`` is the
    strongest one that is open.
    """
    marked = replace_all(f"translate({without_hidden(html)}, {lit(_MARK)}, '')", BLOCK_START, _MARK + "$1")
    lead = r"^</?([A-Za-z][A-Za-z0-9]*)(?:\s[^>]*+)?+/?(?:>|\z)"
    starts = BLOCK_START.replace("(?i)", "(?i)^", 1)
    # Which depth a segment moves: a container, or 8 for ul, 9 for ol, which is a list as well.
    codes = " ".join(f"when {lit(tag)} then {i}" for i, tag in enumerate((*CONTAINERS, "ul", "ol"), start=1))
    # All depths are one text of numbers of equal width: adding it up stays cheap on long pages.
    step = f"case when _m = 0 then _st when abs(_m) = 9 then {_moved(_moved('_st', '8'), '7')} else {_moved('_st', '(abs(_m) - 1)')} end"
    part = f"slice(_mv, cast(_c * {_CHUNK} + 1 as int), {_CHUNK})"
    chunk_starts = (
        f"aggregate(sequence(0, greatest(size(_moves) - 1, 0) div {_CHUNK}), "
        f"struct(repeat('0', {9 * _WIDTH}) as st, cast(array() as array<string>) as seen), "
        f"(_ac, _c) -> struct(aggregate({part}, _ac.st, (_st, _m) -> {step}) as st, array_append(_ac.seen, _ac.st) as seen), _ac -> _ac.seen)"
    )
    within = (
        f"aggregate({part}, struct(_s0 as st, '' as seen), (_ac, _m) -> "
        + let(let("_ac.st", "_st", step), "_ns", "struct(_ns as st, concat(_ac.seen, _ns) as seen)")
        + ", _ac -> _ac.seen)"
    )
    state = f"substr(_sa[cast(_p div {_CHUNK} as int)], cast(_p % {_CHUNK} as int) * {9 * _WIDTH} + 1, {9 * _WIDTH})"
    is_open = "substr(_st, {} * {} + 1, {}) <> " + lit("0" * _WIDTH)
    container = (
        f"case when startswith(_st, {lit('0' * _WIDTH * len(CONTAINERS))}) then 'body' "
        + " ".join(f"when {is_open.format(i, _WIDTH, _WIDTH)} then {lit(c)}" for i, c in enumerate(CONTAINERS))
        + " end"
    )
    is_ad = f"contains(_u.open_tag, ' ') and not _u.closing and coalesce({matches(f'lower({attribute("_u.open_tag", "class")})', AD_CLASS)}, false)"
    has_image = matches("_b.inner", r"(?i)<img\b")
    steps = (
        ("_segs", f"split({marked}, {lit(_MARK)})"),
        ("_segs", f"transform(_segs, _s -> struct(_s as s, {matches('_s', starts)} as tagged))"),
        (
            "_segs",
            f"transform(_segs, _s -> struct(if(_s.tagged, lower({extract('_s.s', '^</?([A-Za-z][A-Za-z0-9]*)')}), null) as tag, "
            f"_s.tagged and startswith(_s.s, '</') as closing, if(_s.tagged, {replace_all('_s.s', lead, '')}, _s.s) as inner, "
            f"if(_s.tagged, {extract('_s.s', '^<[^>]*+>?', 0)}, '') as open_tag))",
        ),
        ("_moves", f"transform(_segs, _s -> if(_s.closing, -1, 1) * case _s.tag {codes} else 0 end)"),
        # What a lambda reads again and again is bound first, or the optimizer may move its
        # computation into the lambda.
        ("_starts", let("_moves", "_mv", chunk_starts.replace("_moves", "_mv"))),
        ("_states", let("_moves", "_mv", f"transform(_starts, (_s0, _c) -> {within})")),
        (
            "_found",
            let("_states", "_sa", "transform(_segs, (_u, _p) -> "
            + let(
                state,
                "_st",
                "struct(_p as pos, if(_u.closing or _u.tag is null, '', _u.tag) as tag, "
                f"if({is_ad} and {_depth('_st', 0)} = 0, 'ad', {container}) as container, {_depth('_st', 7)} as list_depth, "
                f"{_depth('_st', 8)} > 0 and {_depth('_st', 8)} = {_depth('_st', 7)} as ordered, _u.inner as inner, "
                f"if(_u.inner = '', '', {plain_text('_u.inner')}) as txt)",
            )
            + ")"),
        ),
        ("_found", f"filter(_found, _b -> _b.txt <> '' or {has_image})"),
        (
            name,
            "transform(_found, _b -> struct(_b.pos as pos, _b.tag as tag, _b.container as container, _b.list_depth as list_depth, "
            f"_b.ordered as ordered, _b.inner as inner, _b.txt as txt, if(contains(_b.inner, '<'), cast({link_text_length('_b.inner')} as int), 0) as link_chars))",
        ),
    )
    out = pages
    for column, value in steps:
        out = out.withColumn(column, F.expr(value))
    return out.drop("_segs", "_moves", "_starts", "_states", "_found")


def blocks(
    pages: DataFrame, keys: Sequence[str] = ("page_id",), html: str = "html", keep: Sequence[str] = ()
) -> DataFrame:
    """Blocks with text: ``(keys, pos, tag, container, list_depth, ordered, inner, txt, link_chars)``."""
    # An inner explode would make the optimizer compute the blocks a second time, to filter by
    # their number; so would a filter on any other computed column.
    rows = with_blocks(pages, html, "_blocks").selectExpr(*keys, *keep, "inline_outer(_blocks)")
    return rows.where("pos is not null")


def links(
    pages: DataFrame, keys: Sequence[str] = ("page_id",), html: str = "html", base: str = "url"
) -> DataFrame:
    """Links in page order: ``(keys, pos, href, anchor, resolved)``. No shuffle."""
    # Anchors are a small part of a page; only they are carried beyond this point.
    rows = pages.selectExpr(*keys, f"{base} as _base", f"posexplode_outer({anchors(without_hidden(html))}) as (pos, _a)")
    found = rows.selectExpr(
        *keys, "pos", "_base", f"{attribute('_a.tag', 'href')} as href", f"{plain_text('_a.inner')} as anchor"
    ).where("href is not null")
    return found.selectExpr(*keys, "pos", "href", "anchor", f"{urls.resolve('_base', 'href')} as resolved")


def titles(pages: DataFrame, keys: Sequence[str] = ("page_id",), html: str = "html") -> DataFrame:
    return pages.select(*keys, F.expr(page_title(html)).alias("title"))
