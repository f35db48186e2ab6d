"""Repair of conversations: the cheapest edits that make the roles follow a grammar.

Weighted CYK parsing over spans of rows. The grammar is in Chomsky normal form: a nonterminal
``X(p, q)`` stands for rows that lead from state p of a conversation to state q, with the rules

    X(p, q) -> X(p, r) X(r, q)        two spans, one after the other
    X(p, q) -> keep | rerole          one row that is said in state p and leads to q
    X(p, p) -> delete                 one row that goes
    X(p, q) -> insert ... insert      no row: the closure of the insertions

A cell holds, for each nonterminal, the least (cost, audit) of a span, the audit being the edits'
initials in order. The nonterminals of one row have the closure before it, and the end of a
conversation has it once more, so the edits of a span end with those of a row. Such audits of the
same rows are never a prefix of one another: the least audits of the parts make the least audit of
the whole, and the rank of an audit among those of its span stands for it in any comparison.

Whatever lies between two places of a conversation leaves it in some state r, wherever the places
are. So every way to split a span gives the same cell, one split is enough, and the cells are
combined bottom-up by span length, 1, 2, 4, ..., in linear time. For the same reason a long
conversation may be cut anywhere: rows are sorted over all tasks, each task parses the stretch it
has, and the stretches of a conversation that lies in several tasks, at most one per task, are
parsed as spans of their own, from the costs and ranks of their cells.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagequarry.llm.fields import with_fields
from pagequarry.session import written

BLANKS = " \t\n\x0b\x0c\r"
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
Cell = list  # of (cost, audit) or None, at p * states + q


@dataclass(frozen=True)
class Grammar:
    """Which initial of a role may come in which state, and what the edits cost.

    The default is ``(s?(ua)+)?``: nothing, or an optional system turn and then user and assistant
    in turns. States: 0 nothing so far, 1 after system, 2 after user, 3 after assistant.
    """

    states: int = 4
    steps: dict[tuple[int, str], int] = field(
        default_factory=lambda: {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    )
    accepted: tuple[int, ...] = (0, 3)
    names: dict[str, str] = field(default_factory=lambda: {"u": "user", "a": "assistant"})  # for new roles
    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1  # for a row that stays so
    pairs: tuple[str, ...] = ("su", "ua", "au")  # initials that may be neighbours


class Parser:
    """Cells of spans. A row is ``(initial, fault)``; those of short spans are kept for the next time."""

    KEPT = 16  # rows

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.made: dict[tuple, Cell] = {}
        n = grammar.states
        self.empty: Cell = [(0, "") if p == q else None for p in range(n) for q in range(n)]
        closure = list(self.empty)
        for (p, letter), q in grammar.steps.items():
            if letter in grammar.names:
                closure[p * n + q] = (grammar.insert, "I")
        before = None
        while closure != before:
            before, closure = closure, self.joined(closure, closure)
        self.inserted = closure

    def joined(self, x: Cell, y: Cell) -> Cell:
        """The cell of two spans, one after the other."""
        n = self.grammar.states
        out: Cell = []
        for p in range(n):
            for q in range(n):
                best, cost = None, None
                for r in range(n):
                    a, b = x[p * n + r], y[r * n + q]
                    if a is not None and b is not None and (cost is None or a[0] + b[0] <= cost):
                        new = a[0] + b[0], a[1] + b[1]
                        if best is None or new < best:
                            best, cost = new, new[0]
                out.append(best)
        return out

    def row(self, initial: str, fault: int) -> Cell:
        g, n = self.grammar, self.grammar.states
        cell: Cell = [None] * (n * n)
        for p in range(n):
            cell[p * n + p] = (g.delete, "D")
        if fault in (NO_FAULT, TRUNCATED):
            stays = g.truncated if fault == TRUNCATED else 0
            for (p, letter), q in g.steps.items():
                edits = [(stays, "K")] if letter == initial else []
                edits += [(g.rerole + stays, "R")] if letter in g.names else []
                edits += [cell[p * n + q]] if cell[p * n + q] else []
                cell[p * n + q] = min(edits, default=None)
        return self.joined(self.inserted, cell)

    def span(self, rows: tuple) -> Cell:
        """The cell of consecutive rows."""
        if (known := self.made.get(rows)) is not None:
            return known
        if len(rows) > 1:
            half = 1 << ((len(rows) - 1).bit_length() - 1)
            cell = self.joined(self.span(rows[:half]), self.span(rows[half:]))
        else:
            cell = self.row(*rows[0]) if rows else self.empty
        if len(rows) <= self.KEPT and len(self.made) < 1 << 16:
            self.made[rows] = cell
        return cell

    def ways(self, cells: list[Cell]) -> tuple[int, list[tuple[int, int]]]:
        """The cost of the best parse of spans in a row, and the states before and after each, and the end."""
        n = self.grammar.states
        levels = [[*cells, self.inserted]]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([self.joined(*last[i : i + 2]) if i + 1 < len(last) else last[i] for i in range(0, len(last), 2)])
        top = levels[-1][0]
        goal = min((q for q in self.grammar.accepted if top[q] is not None), key=lambda q: top[q])
        ways = [(0, goal)]
        for level in reversed(levels[:-1]):  # the state between two spans that gives their parent's cell
            parts = []
            for i, (p, q) in enumerate(ways):
                if 2 * i + 1 == len(level):
                    parts.append((p, q))
                    continue
                x, y = level[2 * i], level[2 * i + 1]
                both = [(x[p * n + r], y[r * n + q], r) for r in range(n)]
                r = min((a[0] + b[0], a[1] + b[1], r) for a, b, r in both if a is not None and b is not None)[2]
                parts += [(p, r), (r, q)]
            ways = parts
        return top[goal][0], ways

    def parsed(self, cells: list[Cell]) -> tuple[int, list[tuple[int, str]]]:
        """The cost of the best parse of spans in a row, and the state before each and its audit."""
        n = self.grammar.states
        cost, ways = self.ways(cells)
        audits = [cell[p * n + q][1] for (p, q), cell in zip(ways, [*cells, self.inserted])]
        end = audits.pop()
        audits[-1] += end
        return cost, [(p, audit) for (p, _), audit in zip(ways, audits)]

    def edits(self, initials: Iterable[str], state: int, audit: str) -> Iterator[tuple[str, str | None]]:
        """Each edit with the initial of the role it gives; None for rows that go."""
        rows = iter(initials)
        for edit in audit:
            own = None if edit == "I" else next(rows)
            if edit == "D":
                yield edit, None
                continue
            letter = own if edit == "K" else next(x for x in self.grammar.names if (state, x) in self.grammar.steps)
            state = self.grammar.steps[state, letter]
            yield edit, letter


class Repaired(NamedTuple):
    """What ``repair`` returns."""

    turns: DataFrame
    summary: DataFrame


def fault(conversations: DataFrame) -> DataFrame:
    """``(conv, turn, role, digest, _at, fault)`` of rows that also have their ``text``: the first fault of each.

    What a text says about its own row is found before rows are exchanged, so texts stay where they are.
    """
    last = F.substring(F.expr(f"trim(trailing '{BLANKS}' from text)"), -1, 1)
    own = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(NO_FAULT)
    first = conversations.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn", "_at"))["_at"].alias("_at"))
    rows = conversations.select("conv", "turn", "role", "digest", "_at", own.alias("_own"))
    seen = rows.join(first.select("_at", F.lit(True).alias("_first")), "_at", "left")
    kind = F.when((F.col("_own") != BLANK) & F.col("_first").isNull(), DUPLICATE).otherwise(F.col("_own"))
    return seen.select("conv", "turn", "role", "digest", "_at", kind.alias("fault"))


COUNTS = ("blank", "duplicate", "truncated", "illegal")
STRETCH = (
    "part int, first boolean, initials string, ats array<bigint>, state int, audit string, cost bigint, "
    "low bigint, high bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "open boolean, costs array<bigint>, ranks array<int>, audits array<string>"
)
# What is known of a stretch without its rows, and what the parse of the whole conversation says of it.
OUTLINE = ["part", "begin", "end", "low", "high", "turns", *COUNTS, "costs", "ranks"]
SETTLED = ["conv", "part", "first", "initials", "ats", "state", "audit", "cost", "low", "high", "turns", *COUNTS]
WAY = (
    "part int, first boolean, state int, chosen int, inserted int, cost bigint, "
    "low bigint, high bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
)


class Stretch:
    """The rows of one conversation that one task has, in order."""

    def __init__(self, conv: object, grammar: Grammar):
        self.conv, self.pairs = conv, grammar.pairs
        self.rows: list[tuple[str, int]] = []
        self.ats: list[int] = []
        self.low = self.high = None
        self.turns = 0
        self.counts = dict.fromkeys(COUNTS, 0)

    def add(self, turn: int | None, initial: str, fault: int, at: int) -> None:
        if self.rows and self.rows[-1][0] + initial not in self.pairs:
            self.counts["illegal"] += 1
        if fault:
            self.counts[COUNTS[fault - 1]] += 1
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.rows.append((initial, fault))
        self.ats.append(at)

    def as_row(self, part: int, parser: Parser, whole: bool) -> dict:
        cell = parser.span(tuple(self.rows))
        initials = [r[0] or "\0" for r in self.rows]
        row = {"conv": self.conv, "part": part, "first": whole, "initials": "".join(initials), "ats": self.ats, "open": not whole}
        row |= {"low": self.low, "high": self.high, "turns": self.turns, **self.counts}
        if whole:
            cost, [(state, audit)] = parser.parsed([cell])
            return row | {"state": state, "audit": audit, "cost": cost}
        audits = [c and c[1] for c in cell]
        rank = {audit: i for i, audit in enumerate(sorted({a for a in audits if a is not None}))}
        return row | {"costs": [c and c[0] for c in cell], "ranks": [rank.get(a) for a in audits], "audits": audits}


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _stretches(grammar: Grammar, schema: pa.Schema):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        parser, part = Parser(grammar), TaskContext.get().partitionId()
        now, begun = None, False
        for batch in batches:
            for conv, turn, initial, fault, at in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv != conv:
                    if now is not None:
                        yield now.as_row(part, parser, whole=begun)
                        begun = True
                    now = Stretch(conv, grammar)
                now.add(turn, initial, fault, at)
        if now is not None:  # the first and the last one may go on in other tasks
            yield now.as_row(part, parser, whole=False)

    return lambda batches: _batches(rows(batches), schema)


def _joined(grammar: Grammar, schema: pa.Schema):
    """The parse of conversations from the outlines of their stretches: rows ``WAY``, one per stretch."""

    def settled(group: list[dict], parser: Parser) -> Iterator[dict]:
        # One letter stands for the audit of a stretch, the one of its rank.
        cells = [[None if c is None else (c, chr(r)) for c, r in zip(g["costs"], g["ranks"])] for g in group]
        cost, [*ways, end] = parser.ways(cells)
        inserted = len(parser.inserted[end[0] * grammar.states + end[1]][1])
        total = group[0]
        for before, g in zip(group, group[1:]):
            for name in COUNTS:
                total[name] += g[name]
            total["illegal"] += before["end"] + g["begin"] not in grammar.pairs
            if g["turns"]:
                total["turns"] += g["turns"] - (g["low"] == total["high"])
                total |= {"low": g["low"] if total["low"] is None else total["low"], "high": g["high"]}
        for i, (g, (state, after)) in enumerate(zip(group, ways)):
            way = {"conv": g["conv"], "part": g["part"], "first": i == 0, "state": state, "chosen": state * grammar.states + after}
            way["inserted"] = inserted if i + 1 == len(group) else 0
            yield way | ({"cost": cost} | {name: total[name] for name in ("low", "high", "turns", *COUNTS)} if i == 0 else {})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        parser = Parser(grammar)
        group: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if group and group[0]["conv"] != row["conv"]:
                    yield from settled(group, parser)
                    group = []
                group.append(row)
        if group:
            yield from settled(group, parser)

    return lambda batches: _batches(rows(batches), schema)


def _edits(grammar: Grammar, schema: pa.Schema):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        parser = Parser(grammar)
        for batch in batches:
            for conv, part, initials, ats, state, audit in zip(*(c.to_pylist() for c in batch.columns)):
                at = iter(ats)
                for place, (edit, letter) in enumerate(parser.edits(initials, state, audit)):
                    name = grammar.names[letter] if edit in "RI" else None
                    yield {"conv": conv, "part": part, "place": place, "edit": edit, "new_role": name, "_at": None if edit == "I" else next(at)}

    return lambda batches: _batches(rows(batches), schema)


def repair(
    rows: DataFrame, grammar: Grammar | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> Repaired:
    """The edits that make each conversation fit the grammar at the least cost, ties by the least audit.

    Rows are taken by turn, nulls first; rows of one turn by role, then by a digest of the text, so
    equal rows are neighbours. Of each row the first fault counts: blank (nothing but ASCII white
    space), duplicate (role and text as in an earlier row), truncated (the last character that is
    not white space is none of ``.!?``). Blank and duplicate rows are deleted; a row may be kept,
    deleted, or given a new role; turns with an empty text may be inserted anywhere.

    ``turns`` is ``(conv, part, place, edit, role, text)``, one row per edit, in the order of
    ``part`` and ``place`` within a conversation; ``edit`` is K, R, D or I, and what is not D is the
    repaired conversation. ``summary`` is ``(conv, gaps, blank, duplicate, truncated, illegal, cost,
    audit)``, one row per conversation: turn numbers missing between the least and the greatest,
    rows by fault, neighbours whose roles' initials may not be such, and the parse.

    A null conversation id is an id like any other; a null turn comes first and is no turn number;
    a null role or text counts as empty. Repeated rows are rows of their own (and duplicates). An
    empty table gives empty tables; other columns are not read. A conversation may be spread over
    any number of tasks: what joins its stretches is 16 costs and ranks per task that has some of
    it. Only its audit, a letter per row, comes together in ``summary``.
    """
    grammar = grammar or Grammar()
    name = rows.schema[conv].dataType.simpleString()
    texts = F.coalesce(F.col(text).cast("string"), F.lit(""))
    given = written(
        rows.select(
            F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            texts.alias("text"), F.unhex(F.sha2(texts.cast("binary"), 256)).alias("digest"), F.monotonically_increasing_id().alias("_at"),
        ),
        "dialogue-rows",
    )
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv", "turn", "role", "digest", "_at"]
    ordered = fault(given).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = StructType([*with_fields(conv=name), *StructType.fromDDL(STRETCH)])
    arrow = to_arrow_schema(schema)
    found = written(
        ordered.select("conv", "turn", F.substring("role", 1, 1), "fault", "_at").mapInArrow(_stretches(grammar, arrow), schema), "dialogue-stretches"
    )
    ways = with_fields(conv=name).fields + StructType.fromDDL(WAY).fields
    ends = [F.substring("initials", place, 1).alias(which) for which, place in (("begin", 1), ("end", -1))]
    outlines = found.where("open").select("*", *ends).select("conv", *OUTLINE).repartition("conv").sortWithinPartitions("conv", "part")
    chosen = outlines.mapInArrow(_joined(grammar, to_arrow_schema(StructType(ways))), StructType(ways))
    # A task begins one stretch of this kind and ends one, so there are two of these short rows per task at most.
    chosen = F.broadcast(chosen.select(F.col("conv").alias("_conv"), F.col("part").alias("_part"), *[F.col(f.name).alias(f"_{f.name}") for f in ways[2:]]))
    met = found.where("open").join(chosen, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")))
    audit = F.concat(F.get("audits", F.col("_chosen")), F.repeat(F.lit("I"), F.col("_inserted")))
    settling = [c for c in SETTLED if c not in ("conv", "part", "initials", "ats", "audit")]
    split = met.withColumns({"audit": audit, **{c: F.col(f"_{c}") for c in settling}}).select(*SETTLED)
    settled = written(found.where("not open").select(*SETTLED).unionByName(split), "dialogue-parses")

    kinds = with_fields(conv=name, part="int", place="bigint", edit="string", new_role="string", _at="bigint")
    edits = settled.select("conv", "part", "initials", "ats", "state", "audit").mapInArrow(_edits(grammar, to_arrow_schema(kinds)), kinds)
    turns = edits.join(given.select("_at", "role", "text"), "_at", "left").select(
        "conv", "part", "place", "edit", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    audits = settled.groupBy("conv").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit")
    )
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).alias("gaps")
    totals = settled.where("first").select(F.col("conv").alias("_conv"), gaps, *COUNTS, "cost")
    summary = totals.join(audits, F.col("_conv").eqNullSafe(F.col("conv"))).select("conv", "gaps", *COUNTS, "cost", "audit")
    return Repaired(turns, summary)


def transcripts(turns: DataFrame) -> DataFrame:
    """``(conv, sha256)``: the digest of the repaired ``role:text``, one per line, as lower-case hex.

    Conversations without a repaired turn are not in the result. Rows are read in order as a
    stream; a conversation's texts are never held together.
    """
    kinds = with_fields(turns.schema["conv"], sha256="string")
    arrow = to_arrow_schema(kinds)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, digest = None, None
        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if digest is not None and now == conv:
                    digest.update(b"\n")
                else:
                    if digest is not None:
                        yield {"conv": now, "sha256": digest.hexdigest()}
                    now, digest = conv, hashlib.sha256()
                digest.update(f"{role}:{text}".encode())
        if digest is not None:
            yield {"conv": now, "sha256": digest.hexdigest()}

    ordered = turns.where("edit <> 'D'").repartition("conv").sortWithinPartitions("conv", "part", "place")
    return ordered.select("conv", "role", "text").mapInArrow(lambda batches: _batches(rows(batches), arrow), kinds)
