"""File names for outcomes, without collisions inside a batch."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import urls
from pagequarry.operators import skew
from pagequarry.operators.judge import note
from pagequarry.operators.report import payload_size
from pagequarry.session import written


def names(outcomes: DataFrame) -> DataFrame:
    """Add the ``name`` a successful outcome asks for; null for the others.

    A port that is not a number leaves no trace in the name, which a note says.
    """
    bad = F.col("ok") & F.expr(urls.bad_port("url"))
    return outcomes.withColumn("name", F.when(F.col("ok"), F.expr(urls.file_name("url", "extension")))).withColumn(
        "notes", F.when(bad, F.array_append("notes", note("bad_port", url=F.col("url")))).otherwise(F.col("notes"))
    )


def named_records(outcomes: DataFrame) -> DataFrame:
    """Outcomes without their payloads, with ``size`` and ``allocated``, for a manifest.

    Sizes are taken where the payload is, and only narrow rows go on to the names.
    """
    narrow = names(outcomes).select(
        "batch_id", "ord", "url", "ok", "name", payload_size().alias("size"),
        "content_kind", "content_type", "status_code", "error", "notes",
    )
    rows = written(narrow, "records")
    given = allocate(rows.where("ok").select("batch_id", "ord", "name")).drop("name")
    return rows.drop("name").join(given, ["batch_id", "ord"], "left")


def allocate(
    df: DataFrame, keys: Sequence[str] = ("batch_id",), order: str = "ord", name: str = "name"
) -> DataFrame:
    """Add ``allocated``: each name once per batch, later ones numbered ``-2``, ``-3``...

    A numbered name can meet a name that was asked for as it is (``a``, ``a``, ``a-2``): the
    first in order gets it. Splitting a name into a stem and a suffix, ``stem-k`` competes
    only with its own requests and with the later requests of ``stem``. So a request's number
    follows from its place among equal names plus the numbers that were taken before it came:

    * places come from :func:`skew.positions`, in parallel also for one very frequent name;
    * only names with a numbered sibling need more: one row per distinct name goes to a
      small replay, never the requests themselves.
    """
    keys = list(keys)
    # Only keys and names take part; they are read several times, so they are written once.
    slim = written(df.select(*keys, order, name), "names")
    stem = F.regexp_replace(name, r"(?s)(.)\.[^.]+\z", "$1")
    rows = slim.withColumn("_stem", stem).withColumn(
        "_suffix", F.expr(f"substr({name}, length(_stem) + 1)")
    )
    placed = skew.positions(rows, [*keys, name], order, "_place")

    # One row per distinct name, which most of what follows starts from.
    distinct = written(
        rows.groupBy(*keys, name, "_stem", "_suffix").agg(F.count("*").alias("_n"), F.min(order).alias("_first")),
        "distinct-names",
    )
    # A sibling's number: at least 2, written without leading zeros.
    number = F.regexp_extract("_stem", r"(?s)^.*-([1-9][0-9]{0,17})\z", 1).try_cast("bigint")
    children = distinct.withColumn("_k", F.when(number >= 2, number)).withColumn(
        "_parent",
        F.when(
            F.col("_k").isNotNull(),
            F.concat(F.regexp_replace("_stem", r"-[0-9]+\z", ""), F.col("_suffix")),
        ),
    )
    contested = children.join(
        distinct.select(*keys, F.col(name).alias("_parent"), F.col("_n").alias("_pn")),
        [*keys, "_parent"],
    )
    skips = _taken_numbers(rows, children, contested, keys, order, name)
    hot = skew.hot_keys(distinct, [*keys, name], counts="_n")
    joined = skew.lookup(placed, skips, [*keys, name], [order], "left", hot)

    generated = F.col("_place") - F.when(F.coalesce("_taken", F.lit(False)), 0).otherwise(1)
    k = F.aggregate(
        F.coalesce("_skipped", F.array().cast("array<bigint>")),
        generated + 1,
        lambda n, s: F.when(s <= n, n + 1).otherwise(n),
    )
    numbered = joined.withColumn(
        "allocated",
        F.when(generated == 0, F.col(name)).otherwise(
            F.concat("_stem", F.lit("-"), k.cast("string"), "_suffix")
        ),
    )
    return df.join(numbered.select(*keys, order, "allocated"), [*keys, order])


def _taken_numbers(
    rows: DataFrame, children: DataFrame, contested: DataFrame, keys: list[str], order: str, name: str
) -> DataFrame:
    """Per contested name: was it taken before its first request, and which numbers it skips."""
    # How many requests of the parent came before a sibling was first asked for: requests and
    # siblings are merged by order and counted with a running sum.
    parents = contested.select(*keys, F.col("_parent").alias(name)).distinct()
    asked = rows.select(*keys, name, order).join(parents, [*keys, name], "left_semi").select(
        *keys, F.col(name).alias("_parent"), F.col(order).alias("_at"), F.lit(1).alias("_one"), F.lit(None).cast("string").alias("_child")
    )
    probes = contested.select(
        *keys, "_parent", F.col("_first").alias("_at"), F.lit(0).alias("_one"), F.col(name).alias("_child")
    )
    merged = skew.positions(
        asked.unionByName(probes), [*keys, "_parent"], "_at", "_before", weight=F.col("_one")
    )
    before = merged.where(F.col("_child").isNotNull()).select(
        *keys, F.col("_child").alias(name), "_before"
    )
    tree = contested.join(before, [*keys, name])
    # The chain of names that only differ by numbers is replayed top down.
    root = F.concat(F.regexp_replace("_stem", r"(-[1-9][0-9]{0,17})+\z", ""), F.col("_suffix"))
    schema = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)
    return (
        tree.select(*keys, root.alias("_root"), "_parent", "_k", "_pn", "_before", F.col(name).alias("_name"))
        .groupBy(*keys, "_root")
        .applyInPandas(
            _replayer(keys, name), f"{schema}, {name} string, _taken boolean, _skipped array<bigint>"
        )
    )


def _replayer(keys: list[str], name: str):
    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: dict[str, bool] = {}
        skipped: dict[str, list[int]] = {}
        by_parent = dict(iter(pdf.sort_values("_k").groupby("_parent", sort=False)))
        # Parents before children: a parent's name is always shorter.
        for parent in sorted(by_parent, key=len):
            offset = 0 if taken.get(parent, False) else 1
            count = 0
            out: list[int] = []
            for row in by_parent[parent].itertuples(index=False):
                k, asked = int(row[_K]), int(row[_PN])
                came = max(int(row[_BEFORE]) - offset, 0)
                turn = k - 1 - count
                if turn > came:
                    out.append(k)
                    count += 1
                else:
                    taken[row[_NAME]] = turn <= asked - offset
            skipped[parent] = out
        first = {k: pdf[k].iloc[0] for k in keys}
        every = list(dict.fromkeys([*skipped, *taken]))
        return pd.DataFrame(
            [{**first, name: n, "_taken": taken.get(n, False), "_skipped": skipped.get(n, [])} for n in every]
        )

    columns = [*keys, "_root", "_parent", "_k", "_pn", "_before", "_name"]
    _K, _PN, _BEFORE, _NAME = (columns.index(c) for c in ("_k", "_pn", "_before", "_name"))
    return replay
