"""Mixing sources to target weights, in DataFrame functions only.

Sizes are added up per source, targets follow from the weights, and a document of a source with
repetition rate r comes floor(r) times, and once more with a probability of r - floor(r). That
last draw is a digest of the document, not a random number: reruns and retried tasks agree.

Only the table of sources is ever sorted or sent to tasks; it is written first, so that Spark
broadcasts it if its measured size allows and shuffles otherwise.

Defined cases: a null or blank text has size 0 and is repeated like any other of its source (it
takes no words); documents without a source form one source, the last; a source of size 0 has
the target 0 and none of its documents is taken; a document without an id draws by its text;
repeated rows draw alike; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.session import written

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """How many words a text has; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(
    sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """``(source, source_size, target)`` of a table ``(source, size)``, one row per source.

    The sources, by code point and null last, take the ``weights`` in turn and share ``share``
    times all sizes. A target stops at ``most`` times the size of its source; what is above is
    shared again by weight. Solved at once: ordered by the level at which they stop, the first
    sources stop, and the rest share what is left.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1
    )
    stop = W.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before, whole = stop.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(1))
    levels = (
        per_source.select("source", "source_size", weight.alias("_weight"))
        .withColumn("_cap", F.col("source_size") * most)
        .withColumn("_left", F.sum("source_size").over(whole) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_weights", F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.col("_weights"))
        .withColumn("_stops", F.col("_cap") <= F.col("_weight") * F.col("_level"))
    )
    level = F.min(F.when(~F.col("_stops"), F.struct(F.col("_cap") / F.col("_weight"), "_level"))).over(whole)["_level"]
    return levels.select(
        "source",
        "source_size",
        F.when(F.col("_stops"), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_weight") * level)).alias("target"),
    )


def draw(seed: int, key: str = "doc_id", text: str = "text") -> Column:
    """A number from 0 to below 1, fixed by the seed and the document's id (or else its text)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.col(text).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(16**13))


def planned(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 8,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``(key, size, source_size, target, copies, taken)``: one row per row of ``docs``."""
    sized = written(
        docs.select(key, F.col(source).alias("source"), words(F.col(text)).alias("size"), draw(seed, key, text).alias("_draw")),
        "mixing-sizes",
    )
    plan = written(targets(sized, weights, share, most), "mixing-targets").withColumnRenamed("source", "_source")
    copies = _copies(F.col("target"), F.col("source_size"), F.col("_draw"))
    return (
        sized.join(plan, F.col("source").eqNullSafe(F.col("_source")))
        .select(key, "size", "source_size", "target", copies.alias("copies"))
        .withColumn("taken", F.col("size") * F.col("copies"))
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 8,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; the columns stay."""
    sizes = docs.select(F.col(source).alias("source"), words(F.col(text)).alias("size"))
    plan = written(targets(sizes, weights, share, most), "mixing-targets").toDF("_mix_source", "_mix_size", "_mix_target")
    copies = _copies(F.col("_mix_target"), F.col("_mix_size"), draw(seed, key, text))
    return (
        docs.join(plan, F.col(source).eqNullSafe(F.col("_mix_source")))
        .withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(1), copies)))
        .select(*docs.columns)
    )


def _copies(target: Column, size: Column, drawn: Column) -> Column:
    rate = F.coalesce(F.try_divide(target, size), F.lit(0.0))
    return (F.floor(rate) + (drawn < rate - F.floor(rate)).cast("int")).cast("int")


ORACLE = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    ('0x' || substr(md5('8:' || coalesce(doc_id::varchar, text, '')), 1, 13))::bigint / 4503599627370496.0 as drawn
  from documents
), per_source as (
  select source, sum(size)::double as source_size from sized group by source
), weighed as (
  select source, source_size, 2.0::double * source_size as cap,
    [3.0::double, 1.0::double, 2.0::double][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight
  from per_source
), ordered as (
  select *, cap / weight as stop_level, row_number() over (order by cap / weight, source nulls last) as place from weighed
), levels as (
  select a.*,
    ((select sum(source_size) from weighed) * 1.5::double
      - coalesce((select sum(cap) from ordered b where b.place < a.place), 0))
    / ((select sum(weight) from weighed)
      - coalesce((select sum(weight) from ordered b where b.place < a.place), 0)) as level
  from ordered a
), targets as (
  select source, source_size, case when cap <= weight * level then cap
    else least(cap, weight * (select arg_min(level, place) from levels where cap > weight * level)) end as target
  from levels
), rated as (
  select doc_id, size, source_size, target, drawn,
    case when source_size = 0 then 0.0 else target / source_size end as rate
  from sized join targets on sized.source is not distinct from targets.source
)
select doc_id, size::bigint as size, source_size::bigint as source_size, target,
  (size * (floor(rate) + case when drawn < rate - floor(rate) then 1 else 0 end))::bigint as taken
from rated
"""
