"""Inline HTML to Markdown, as SQL text over short pieces of a page.

Pieces are found by splitting at an opening mark and cutting what follows at the first closing
mark. Each step reads a text once, so a page of nothing but unclosed tags costs no more than any
other of its size.
"""

from __future__ import annotations

from pagequarry.functions.text import collapse, decode_entities, extract, lit, null_if_empty, replace_all

# A tag; one that is never closed runs to the end of the page.
TAG = r"</?[A-Za-z][^>]*+(?:>|\z)"
# A Markdown link or image: mark, text, target.
MD_LINK = r"(!?)\[([^\[\]]*)\]\(([^()\s]*)\)"
ANCHOR_OPEN, ANCHOR_CLOSE = r"(?i)<a\b", r"(?i)</a\s*+>"


def attribute(tag: str, name: str, bare: bool = True) -> str:
    """Value of an attribute in a tag, quoted either way or (with ``bare``) unquoted; null when missing."""
    values = ['"([^"]*)"', "'([^']*)'", *([r"([^\s\"'>]+)"] if bare else [])]
    return null_if_empty("concat(" + ", ".join(extract(tag, rf"(?i)\s{name}\s*=\s*{value}") for value in values) + ")")


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def after_tag(piece: str) -> str:
    """What follows the first ``>`` of a piece; empty when there is none."""
    return f"if(contains({piece}, '>'), substr({piece}, position('>', {piece}) + 1), '')"


def plain_text(piece: str) -> str:
    """Text of a piece of HTML: tags out, entities decoded, white space collapsed."""
    bare = f"if(contains({piece}, '<'), {replace_all(piece, TAG, ' ')}, {piece})"
    return collapse(let(bare, "_pt", decode_entities("_pt")))


def element_text(html: str, name: str) -> str:
    """What stands in the first element of a name; null when it is missing or not closed."""
    rest = f"get(split({html}, {lit(rf'(?i)<{name}(?=[\s>])')}, 2), 1)"
    parts = f"split({after_tag('_el')}, {lit(rf'(?i)</{name}\s*+>')}, 2)"
    return let(rest, "_el", let(parts, "_ep", "if(size(_ep) = 2, _ep[0], null)"))


def open_tag(html: str, name: str) -> str:
    """The first opening tag of a name; null when it is missing."""
    rest = f"get(split({html}, {lit(rf'(?i)<{name}(?=[\s>])')}, 2), 1)"
    return f"concat('<{name}', substring_index({rest}, '>', 1), '>')"


def anchors(piece: str) -> str:
    """Closed anchors in order, as ``(tag, inner, rest)``; one ends where the next begins."""
    parts = f"split({piece}, {lit(ANCHOR_OPEN)}, -1)"
    cut = f"split({after_tag('_ac')}, {lit(ANCHOR_CLOSE)}, 2)"
    made = f"transform(slice(_as, 2, size(_as)), _ac -> struct(concat('<a', substring_index(_ac, '>', 1), '>') as tag, {cut} as parts))"
    closed = f"filter({made}, _ad -> size(_ad.parts) = 2)"
    return let(parts, "_as", f"transform({closed}, _ae -> struct(_ae.tag as tag, _ae.parts[0] as inner, _ae.parts[1] as rest))")


def link_text_length(piece: str) -> str:
    """Characters of a piece that are link text, counted before entities are decoded."""
    text = collapse(replace_all("_an.inner", TAG, " "))
    return f"reduce({anchors(piece)}, 0, (_lc, _an) -> _lc + length({text}))"


def _rewritten(text: str, opening: str, piece: str, body: str) -> str:
    """A text in which everything after an opening mark, up to the next one, becomes ``body``."""
    changed = f"transform(slice(_rw, 2, size(_rw)), {piece} -> {body})"
    return let(f"split({text}, {lit(opening)}, -1)", "_rw", f"concat(_rw[0], array_join({changed}, ''))")


def _marked(text: str, names: str, mark: str) -> str:
    """Elements of a name between two marks; one that is not closed only loses its tag."""
    cut = f"split(_mk, {lit(rf'(?i)</(?:{names})\s*+>')}, 2)"
    body = let(cut, "_mc", f"if(size(_mc) = 2, concat('{mark}', _mc[0], '{mark}', _mc[1]), _mk)")
    return _rewritten(text, rf"(?i)<(?:{names})(?:\s[^>]*+)?+(?:>|\z)", "_mk", body)


def markdown_text(piece: str, links: bool = True, images: bool = True) -> str:
    """Markdown of a piece without block tags.

    Links and images with a quoted target become Markdown; an anchor that is never closed keeps only
    its text. ``links=False`` keeps anchor texts, ``images=False`` drops images.
    """
    md = piece
    if images:
        tag = "concat('<img', substring_index(_im, '>', 1), '>')"
        shown = f"concat('![', coalesce({attribute('_it', 'alt', bare=False)}, ''), '](', {attribute('_it', 'src', bare=False)}, ')')"
        md = _rewritten(md, r"(?i)<img\b", "_im", let(tag, "_it", f"concat(coalesce({shown}, ''), {after_tag('_im')})"))
    if links:
        tag = "concat('<a', substring_index(_lk, '>', 1), '>')"
        cut = f"split({after_tag('_lk')}, {lit(ANCHOR_CLOSE)}, 2)"
        shown = f"if(size(_lp) = 2, concat('[', _lp[0], '](', {attribute(tag, 'href', bare=False)}, ')', _lp[1]), null)"
        md = _rewritten(md, ANCHOR_OPEN, "_lk", let(cut, "_lp", f"coalesce({shown}, concat('<a', _lk))"))
    md = _marked(md, "b|strong", "**")
    md = _marked(md, "i|em", "_")
    md = _marked(md, "code", "`")
    return collapse(let(replace_all(md, TAG, ""), "_mt", decode_entities("_mt")))
