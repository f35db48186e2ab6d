"""Secret scans in SQL functions only: fixed patterns, and a battery of randomness tests.

The patterns find assignments, access keys and hexadecimal strings. Every other run of at least
``SHORTEST`` token characters is a candidate: its encoding is inferred, its symbols are tested
for being random (chi-squared uniformity over the alphabet, runs above and below the middle, lag-1
serial correlation), and a p-value says how likely prose would make so few equal symbols, which
depends on the length. Candidates that pass the battery are taken by the Benjamini-Hochberg rule
on that p-value, per class of lengths, over all documents; the rule needs only a table of counts
per class and step of the p-value (at most ``CLASSES * (STEPS + 1)`` rows).

Positions are code points; ends are exclusive. A document is scanned whole. Defined cases: null
text counts as empty; repeated rows come out repeated; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.session import written

# The patterns and the least lengths of what they must find.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")

SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HEX_DIGITS = "0123456789abcdef"
# Of prose in Latin script: the chance that two (three) letters are equal, and of a digit.
EQUAL_TWO, EQUAL_THREE, DIGIT = 0.065, 0.0055, 0.05
CLASSES = 16  # of lengths, by powers of two
STEPS = 480  # of p-values, sixteen per power of ten
CHUNK = 256


def _with_starts(rows: DataFrame) -> DataFrame:
    """Add ``_starts``: the sum of the ``_widths`` before each entry.

    Summed chunk by chunk, so that a text with very many matches stays cheap.
    """
    add = "0L, (a, x) -> a + x"
    chunk = f"cast(i div {CHUNK} as int)"
    return (
        rows.withColumn("_sums", F.expr(
            f"transform(sequence(0, cast(size(_widths) div {CHUNK} as int)),"
            f" c -> aggregate(slice(_widths, c * {CHUNK} + 1, {CHUNK}), {add}))"
        ))
        .withColumn("_sums", F.expr(f"transform(_sums, (s, c) -> aggregate(slice(_sums, 1, c), {add}))"))
        .withColumn("_starts", F.expr(
            f"transform(_widths, (w, i) -> _sums[{chunk}]"
            f" + aggregate(slice(_widths, {chunk} * {CHUNK} + 1, cast(i % {CHUNK} as int)), {add}))"
        ))
        .drop("_sums")
    )


def found(docs: DataFrame, text: str, pattern: str, name: str, group: int = 0) -> DataFrame:
    """Add ``name``: the leftmost non-overlapping matches as ``(start, end, value)``, in order.

    ``value`` is the given group of the match. What lies between the matches (``split``) and the
    matches themselves give the positions.
    """
    quoted = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    any_found = F.expr(f"{text} rlike {quoted}")
    none = F.lit(None)
    spans = _with_starts(
        docs.withColumn("_any", any_found)
        .withColumn("_whole", F.when(F.col("_any"), F.expr(f"regexp_extract_all({text}, {quoted}, 0)")).otherwise(none))
        .withColumn("_gaps", F.when(F.col("_any"), F.expr(f"transform(split({text}, {quoted}, -1), g -> length(g))")).otherwise(none))
        .withColumn("_value", F.col("_whole") if not group else F.when(F.col("_any"), F.expr(f"regexp_extract_all({text}, {quoted}, {group})")).otherwise(none))
        .withColumn("_widths", F.expr("transform(_whole, (m, i) -> cast(length(m) + _gaps[i] as bigint))"))
    ).withColumn(
        name,
        F.expr(
            "coalesce(transform(_starts, (s, i) -> struct(s + _gaps[i] as start, s + _widths[i] as end, _value[i] as value)),"
            " cast(array() as array<struct<start: bigint, end: bigint, value: string>>))"
        ),
    )
    return spans.drop("_any", "_whole", "_gaps", "_value", "_widths", "_starts")


def _p_two_sided(z: str) -> str:
    """The chance of a normal value farther out than ``z``, by a rational approximation."""
    x = f"(abs({z}) / 1.4142135623730951D)"
    t = f"(1D / (1D + 0.3275911D * {x}))"
    series = f"({t} * (0.254829592D + {t} * (-0.284496736D + {t} * (1.421413741D + {t} * (-1.453152027D + {t} * 1.061405429D)))))"
    return f"({series} * exp(-{x} * {x}))"


def _tested(candidates: str) -> list[tuple[str, str]]:
    """The steps that turn candidate spans into tested ones, each a list of structures."""
    kind = (
        "case when c.value rlike '^([0-9a-f]+|[0-9A-F]+)$' then 'hex' when c.value rlike '^[A-Z2-7]+=*$' then 'base32'"
        " when c.value rlike '[+/_-]' then 'base64' else 'base62' end"
    )
    symbols = (
        f"transform(split(case c.kind when 'hex' then lower(c.value) else translate(c.value, '-_=', '+/') end, ''),"
        f" s -> locate(s, case c.kind when 'hex' then '{HEX_DIGITS}' when 'base32' then '{BASE32}' else '{SYMBOLS}' end) - 1)"
    )
    size = "case c.kind when 'hex' then 16 when 'base32' then 32 when 'base64' then 64 else 62 end"
    # Symbol v is counted by sorting: equal symbols lie together, and the square of a count is
    # the sum of its first odd numbers.
    pairs = (
        "aggregate(array_sort(c.x), struct(0L as pairs, 0L as same, -1 as last), (a, v) ->"
        " struct(a.pairs + if(v = a.last, a.same, 0L) as pairs, if(v = a.last, a.same, 0L) + 1L as same, v as last), a -> a.pairs)"
    )
    steps = "aggregate(slice(c.x, 2, size(c.x)), struct(c.x[0] as last, 0D as turns, 0D as prod), (a, v) -> struct(v as last," \
        " a.turns + if((v * 2 >= c.a) <> (a.last * 2 >= c.a), 1D, 0D) as turns," \
        " a.prod + (v - (c.a - 1) / 2D) * (a.last - (c.a - 1) / 2D) as prod))"
    n = "cast(c.n as double)"
    uniform = f"((c.a * (2 * c.pairs + {n}) / {n} - {n} - (c.a - 1)) / sqrt(2D * (c.a - 1) * ({n} - 1) / {n}))"
    runs = f"((2 * c.steps.turns - ({n} - 1)) / sqrt({n} - 1))"
    serial = f"(c.steps.prod / (sqrt({n} - 1) * (c.a * c.a - 1) / 12D))"
    mean = f"({n} * ({n} - 1) / 2 * {EQUAL_TWO}D)"
    spread = f"sqrt({n} * ({n} - 1) / 2 * {EQUAL_TWO * (1 - EQUAL_TWO)}D + {n} * ({n} - 1) * ({n} - 2) * {EQUAL_THREE - EQUAL_TWO**2}D)"
    z_prose = f"((c.pairs - {mean}) / {spread})"
    # One-sided: only fewer equal symbols than prose has count. Hexadecimal digits repeat as
    # letters of prose do, so there the decimal digits tell.
    p_prose = (
        f"case when c.kind = 'hex' then pow({DIGIT}D, c.digits) when {z_prose} >= 0 then 1D"
        f" else greatest(0.5D * {_p_two_sided(z_prose)}, 1e-30D) end"
    )
    random = f"3 * least(if({uniform} > 0, {_p_two_sided(uniform)} / 2, 1D), {_p_two_sided(runs)}, {_p_two_sided(serial)})"
    keep = "c.start as start, c.end as end"
    digits = "length(regexp_replace(c.value, '[^0-9]', '')) as digits, (c.value rlike '[0-9]' and c.value rlike '[A-Za-z]') as mixed"
    return [
        ("_c1", f"transform({candidates}, c -> struct({keep}, trim(trailing '=' from c.value) as value, {kind} as kind))"),
        ("_c2", f"transform(_c1, c -> struct({keep}, c.kind as kind, {size} as a, {digits}, {symbols} as x))"),
        ("_c3", f"transform(_c2, c -> struct({keep}, c.kind as kind, c.a as a, c.digits as digits, c.mixed as mixed, size(c.x) as n, {pairs} as pairs, {steps} as steps))"),
        ("_c4", f"transform(_c3, c -> struct({keep}, c.n as n, c.mixed as mixed, {random} as random, {p_prose} as prose))"),
        (
            "_candidates",
            f"transform(_c4, c -> struct({keep}, (c.mixed and c.random >= 0.001D) as passes,"
            f" least({CLASSES - 1}, cast(floor(log2(c.n)) as int)) as class,"
            f" least({STEPS}, cast(floor(-16 * log10(greatest(c.prose, 1e-30D))) as int)) as step))",
        ),
    ]


def scan(docs: DataFrame, rate: float = 0.01, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, spans)``: one row per row of ``docs``.

    ``spans`` is an array of ``(start, end, kind)`` in the order of start, then of ``KINDS``.
    ``random`` ones have an expected share of at most ``rate`` of false finds.
    """
    judged = written(candidates(docs.select(key, F.col(text).cast("string").alias("_text"))).drop("_text"), "secrets")
    names = F.array(*map(F.lit, KINDS))
    spans = F.transform(
        _all_spans(thresholds(judged, rate)),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["kind"]).alias("kind")),
    )
    return judged.select(key, spans.alias("spans"))


def candidates(docs: DataFrame) -> DataFrame:
    """Add the spans of the patterns (``_base``) and the tested candidates (``_candidates``) of ``_text``."""
    rows = docs.withColumn("_text", F.coalesce("_text", F.lit("")))
    rows = found(rows, "_text", ASSIGN, "_assign", 2)
    for pattern, name in ((ACCESS, "_access"), (HEX, "_hex"), (TOKEN, "_token")):
        rows = found(rows, "_text", pattern, name)
    rows = rows.withColumn("_assign", F.expr(f"filter(_assign, s -> length(s.value) >= {ASSIGN_VALUE})"))
    base = [f"transform(_{k}, s -> struct(s.start as start, {i} as kind, s.end as end))" for i, k in enumerate(KINDS[:3])]
    rows = rows.withColumn("_base", F.expr(f"array_sort(concat({', '.join(base)}))"))
    rows = rows.withColumn(
        "_token", F.expr("filter(_token, c -> not exists(_base, b -> b.start < c.end and c.start < b.end))")
    )
    for name, step in _tested("_token"):
        rows = rows.withColumn(name, F.expr(step))
    return rows.drop("_assign", "_access", "_hex", "_token", "_c1", "_c2", "_c3", "_c4")


def thresholds(judged: DataFrame, rate: float) -> dict[int, int]:
    """The least step a candidate needs, per class of lengths (at most ``CLASSES`` entries).

    Benjamini-Hochberg over all candidates of a class: the largest p-value (of the grid of
    steps) whose share of candidates at or below it, times the rate, is no less than it.
    """
    tests = judged.select(F.inline("_candidates")).groupBy("class", "step").agg(F.count("*").alias("n"))
    allowed = tests.selectExpr(
        "class", "step",
        "sum(n) over (partition by class order by step desc) as below",
        "sum(n) over (partition by class) as tests",
    ).where(F.expr(f"pow(10D, -step / 16D) <= {rate}D * below / tests"))
    return dict(allowed.groupBy("class").agg(F.min("step")).collect())


def _all_spans(limits: dict[int, int]) -> Column:
    """The spans of the patterns and the candidates that the false-discovery rule takes."""
    least = F.create_map(*[F.lit(x) for item in sorted(limits.items()) for x in item]) if limits else F.create_map(F.lit(-1), F.lit(0))
    taken = F.filter("_candidates", lambda c: c["passes"] & F.coalesce(c["step"] >= least[c["class"]], F.lit(False)))
    added = F.transform(taken, lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), c["end"].alias("end")))
    return F.array_sort(F.concat("_base", added))


def listed(spans: str | Column, base: bool = False) -> Column:
    """Spans as ``kind:start:end``, comma-joined; ``base``: only those of the patterns."""
    spans = F.col(spans) if isinstance(spans, str) else spans
    if base:
        spans = F.filter(spans, lambda s: s["kind"] != KINDS[-1])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")


def redact(docs: DataFrame, mark: str = "<secret>", rate: float = 0.01, text: str = "text") -> DataFrame:
    """``docs`` with each found span of ``text`` replaced by ``mark``; overlapping spans are one.

    The columns stay. Only the thresholds of the false-discovery rule go between rows, so whole
    texts are read twice and never shuffled.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text).cast("string").alias("_text"))
    limits = thresholds(written(candidates(rows.select("_text")).select("_candidates"), "secrets"), rate)
    # The end of the text before a span, so that overlapping spans are cut once.
    ends = (
        "aggregate(_spans, struct(0L as at, cast(array() as array<string>) as parts), (a, s) -> if(s.end <= a.at, a, struct("
        "s.end as at, concat(a.parts, array(substring(_text, cast(a.at + 1 as int), cast(greatest(s.start - a.at, 0L) as int)),"
        f" if(s.start < a.at, '', '{mark}'))) as parts)), a -> concat_ws('', a.parts, substring(_text, cast(a.at + 1 as int))))"
    )
    found = candidates(rows).withColumn("_spans", _all_spans(limits))
    cut = F.when(F.size("_spans") > 0, F.expr(ends)).otherwise(F.col("_doc")[text])
    return found.select(*(cut.alias(c) if c == text else F.col("_doc")[c].alias(c) for c in docs.columns))
