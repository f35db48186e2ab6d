import hashlib
import heapq
import random
import re
import zlib

import pytest
from pagequarry.llm import dialogue, queries

STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
SCHEMA = "conv_id long, turn long, role string, text string, part int, audit string, _at long, edit string"


def cheapest(rows):
    """Least (cost, audit) of rows ``(initial, fault)``, by trying all edits in order of cost."""
    heap, done, out = [(0, "", 0, 0)], set(), []
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            out.append((cost, audit))
        ways = [("I", 2, x, i) for x in "ua"]
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if fault in (0, 3):
                late = int(fault == 3)
                ways += [("K", late, initial, i + 1), *(("R", 2 + late, x, i + 1) for x in "ua")]
        for edit, more, letter, after in ways:
            if (state, letter) in STEPS:
                heapq.heappush(heap, (cost + more, audit + edit, after, STEPS[state, letter]))
    return min(out)


def random_rows(rng, n):
    return [(rng.choice(["s", "u", "a", "u", "a", "t", ""]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]


def test_cells_like_trying_all_edits():
    rng, parser = random.Random(1), dialogue.Parser(dialogue.Grammar())
    for _ in range(1500):
        rows = random_rows(rng, rng.randint(0, 14))
        cuts = sorted(rng.randint(0, len(rows)) for _ in range(rng.randint(0, 3)))
        parts = [tuple(rows[a:b]) for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        cost, ways = parser.parsed([parser.span(p) for p in parts])
        assert (cost, "".join(audit for _, audit in ways)) == cheapest(rows)


def test_every_split_of_a_span_gives_the_same_cell():
    rng, parser = random.Random(2), dialogue.Parser(dialogue.Grammar())
    for _ in range(100):
        rows = tuple(random_rows(rng, 9))
        cells = [parser.joined(parser.span(rows[:k]), parser.span(rows[k:])) for k in range(10)]
        assert all(cell == cells[0] for cell in cells)


def plain_query(rows):
    """The contract, row by row."""
    out, kept = {}, {}
    for conv, turn, role, text in rows:
        kept.setdefault(conv, [])
        shown = lambda x: " " if x is None else x
        hit = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", shown(text))}.get(hit, shown(text))
        kept[conv] += [(turn, "user" if hit == 4 else shown(role), text)] * {0: 0, 3: 2}.get(hit, 1)
    for conv, found in kept.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, marked, counts = set(), [], [0, 0, 0]
        for _, role, text in found:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = 1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0
            seen.add((role, text))
            marked.append((role[:1], fault))
            if fault:
                counts[fault - 1] += 1
        cost, audit = cheapest(marked)
        state, lines, i = 0, [], 0
        for edit in audit:
            _, role, text = (None, None, "") if edit == "I" else found[i]
            i += edit != "I"
            if edit != "D":
                if edit != "K":
                    role = next(name for name in ("user", "assistant") if (state, name[0]) in STEPS)
                state = STEPS[state, role[0]]
                lines.append(f"{role}:{text}")
        turns = {t for t, _, _ in found if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(rng, n):
    rows = []
    for conv in [*range(n), None]:
        length = 400 if conv == 3 else rng.randint(1, 9)
        for turn in range(length):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""])
            text = rng.choice(["Yes.", "No", "Why? ", " \n", None, "", f"Text {rng.randrange(30)}.", "été…"])
            turn = rng.choice([turn, turn, turn, turn + 2, None])
            rows += [(conv, turn, role, text)] * rng.choice([1, 1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("parts", [1, 5, 60])
def test_query_like_a_plain_version(spark, tmp_path, parts):
    rows = conversations(random.Random(parts), 60)
    spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = {r[0]: tuple(r)[1:] for r in queries.conversation_repair(spark, str(tmp_path)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == plain_query(rows)


def test_turns_are_the_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "assistant", "Yes"), (1, 2, "user", " "), (1, 3, "user", "And?"), (2, 0, "system", "Only.")]
    turns, summary = dialogue.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = [tuple(r) for r in turns.orderBy("conv", "part", "place").select("conv", "edit", "role", "text").collect()]
    audits = {r["conv"]: r["audit"] for r in summary.collect()}
    assert audits == {1: cheapest([("a", 0), ("a", 3), ("u", 1), ("u", 0)])[1], 2: "D"}
    for conv, audit in audits.items():
        assert "".join(edit for c, edit, _, _ in found if c == conv) == audit
    said = [(role, text) for conv, edit, role, text in found if conv == 1 and edit != "D"]
    assert [role for role, _ in said] == ["user", "assistant"] * (len(said) // 2)


def test_empty_and_dropped(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    turns, summary = dialogue.repair(none)
    assert turns.collect() == [] and summary.collect() == []
    gone = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    one = spark.createDataFrame([(7, gone, "user", "Hi.", 1, "x", 2, "y")], SCHEMA)
    one.write.parquet(f"{tmp_path}/conversations.parquet")
    row = queries.conversation_repair(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in row] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
