"""Mixing sources to target weights along a time-varying curriculum.

Every source gets a word target by water-filling: shares by weight, none above ``limit`` times what the source holds.
A source's documents form a stream in a fixed pseudo-random order, repeated while its target lasts; a document enters
a pass if its middle word still lies inside the target. A source has two streams, of larger and of smaller documents;
the second makes good what the first missed, so a source ends within half a small document of its target.
The place of a copy in the training order is the inverse of the source's cumulative demand, the integral of the
source's weight schedule over training time t in [0, 1]. Copies are then range-sorted by that place, and numbered.

No source is handled by one task: running sums go by (source, tier, hash slice) groups whose totals are added first.
Only the table of sources, one row each, is ordered as a whole.

Defined cases: a NULL or blank text has size 0 and is never taken; NULL is a source of its own, last in order; rows
that repeat a doc_id are separate documents; a source without words has target 0; an empty table gives no rows. Other
columns pass through untouched, but those named like the columns added here are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.base import WORD_GAP, Scratch, read_table

#: Slope of each schedule by weight class: weight 1 fades out, 2 is steady, 3 fades in.
SLOPES = (-0.8, 0.0, 0.8)
#: Most copies of a document, and so the limit of a source's target over its size.
PASSES = 3
ADDED = ("size", "source_size", "target", "copies", "taken", "places")


def word_count(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space; 0 for NULL."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_GAP)
    return F.size(F.filter(parts, lambda w: w != "")).cast("long")


def source_targets(sizes: DataFrame, limit: float = 3.0) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target): the exact water-filling solution.

    In order of the level at which a source fills up (limit * size / weight), the first k sources are capped and the
    rest share what is left by weight. The first k for which the next source stays under its cap has the largest such share.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    level = F.col("cap") / F.col("weight")
    before = Window.orderBy(level, F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    share = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    return (
        sizes.withColumn("weight", (1 + (F.row_number().over(by_name) - 1) % 3).cast("double"))
        .withColumn("cap", limit * F.col("source_size"))
        .withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(whole))
        .withColumn("share", share)
        .withColumn("line", F.max(F.when(F.col("share") <= level, F.col("share"))).over(whole))
        .withColumn("target", F.least("cap", F.coalesce("line", F.lit(float("inf"))) * F.col("weight")))
        .select("source", "source_size", "weight", "target")
    )


def place(done: Column, slope: Column) -> Column:
    """The time t at which a source with schedule 1 + slope * (2 t - 1) has met the share ``done`` of its demand."""
    curved = (slope - 1 + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * done)) / (2 * slope)
    return F.when(F.abs(slope) < 1e-9, done).otherwise(curved)


def _streams(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Rows of ``sized`` with the middles of their passes that fall inside the goal of their (source, tier) stream.

    goals: source, tier, tier_size, goal. Offsets come from slice totals, so no window holds a whole source.
    """
    by_slice = sized.groupBy("source", "tier", "slice").agg(F.sum("size").alias("slice_size"))
    earlier = Window.partitionBy("source", "tier").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_slice.withColumn("offset", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)))
    known = (
        offsets.alias("o")
        .join(goals.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source")) & (F.col("o.tier") == F.col("g.tier")))
        .select(F.col("o.source").alias("_source"), F.col("o.tier").alias("_tier"), F.col("slice").alias("_slice"), "offset", "tier_size", "goal")
    )
    within = Window.partitionBy("source", "tier", "slice").orderBy("h", F.col("doc_id").asc_nulls_last(), "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("tier") == F.col("_tier")) & (F.col("slice") == F.col("_slice"))
    middle = F.col("offset") + F.coalesce(F.col("ahead"), F.lit(0)) + F.col("size") / 2
    passes = F.transform(F.sequence(F.lit(0), F.lit(PASSES - 1)), lambda k: middle + k * F.col("tier_size"))
    inside = F.filter(passes, lambda x: (x < F.col("goal")) & (F.col("size") > 0))
    return sized.withColumn("ahead", F.sum("size").over(within)).join(known, same).withColumn("middles", inside)


def stream_order(doc_id: Column) -> Column:
    """The place of a document in its stream: the first 60 bits of the md5 of its id's decimal text."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def place_copies(docs: DataFrame, slices: int = 4096, small: int = 256, texts: bool = True) -> DataFrame:
    """(row, size, source_size, target, places) of each row of docs, the row as a struct.

    ``slices``: hash slices of each stream in which running sums are formed; any number gives the same result.
    ``small``: each source has a stream of documents above so many words and one of the others. The first gets its part
    of the target; the second then gets what is really left, so that only a small document can miss the target.
    ``texts``: without it, of docs' columns only doc_id and source come back, with the row's number and the document's
    place in its stream, and texts are read once and never shuffled.
    """
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"), stream_order(F.col("doc_id")).alias("h"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("tie"))
    kept = kept.withColumn("slice", F.shiftrightunsigned("h", 60 - (slices - 1).bit_length())).withColumn("tier", (F.col("size") <= small).cast("int"))
    counted = kept.drop("row") if texts else kept.drop("row").withColumn("uid", F.monotonically_increasing_id())
    sized = Scratch(docs.sparkSession).write(counted)  # a text is counted once, however many sums follow
    if not texts:
        kept = sized.withColumn("row", F.struct("uid", "doc_id", "source", "h"))
    tiers = sized.groupBy("source", "tier").agg(F.sum("size").alias("tier_size"))
    targets = source_targets(tiers.groupBy("source").agg(F.sum("tier_size").alias("source_size")), float(PASSES))
    goals = tiers.alias("a").join(targets.alias("t"), F.col("a.source").eqNullSafe(F.col("t.source"))).select(
        F.col("a.source").alias("source"), "tier", "tier_size", "source_size", "weight", "target",
        F.when(F.col("source_size") > 0, F.col("target") * F.col("tier_size") / F.col("source_size")).otherwise(0.0).alias("goal"),
    )
    large = _streams(sized.filter("tier = 0"), goals.filter("tier = 0").select("source", "tier", "tier_size", "goal"))
    got = large.groupBy("source").agg(F.sum(F.size("middles") * F.col("size")).alias("got"))
    final = goals.alias("g").join(got.alias("x"), F.col("g.source").eqNullSafe(F.col("x.source")), "left").select(
        *[f"g.{c}" for c in ("source", "tier", "tier_size", "source_size", "weight", "target")],
        F.when(F.col("tier") == 0, F.col("goal")).otherwise(F.greatest(F.lit(0.0), F.least(F.col("target") - F.coalesce("got", F.lit(0)), PASSES * F.col("tier_size")))).alias("goal"),
    )
    facts = final.groupBy("source").agg(*[F.first(c).alias(c) for c in ("source_size", "weight", "target")])
    slope = F.element_at(F.array(*[F.lit(s) for s in SLOPES]), F.col("weight").cast("int"))
    out = _streams(kept, final.select("source", "tier", "tier_size", "goal")).drop("_source").alias("d").join(facts.alias("f"), F.col("d.source").eqNullSafe(F.col("f.source")))
    places = F.transform("middles", lambda x: place(F.least(x / F.col("goal"), F.lit(1.0)), slope))
    return out.select("row", "size", "source_size", F.col("target").cast("double").alias("target"), places.alias("places"))


def mix(docs: DataFrame, texts: bool = True) -> DataFrame:
    """Each row of docs with its size, its source's size and target, the copies and words taken, and the copies' places."""
    names = [c for c in (docs.columns if texts else ["doc_id", "source"]) if c not in ADDED]
    return place_copies(docs, texts=texts).select(
        *[F.col(f"row.`{c}`").alias(c) for c in names],
        "size",
        "source_size",
        "target",
        F.size("places").alias("copies"),
        (F.size("places") * F.col("size")).cast("long").alias("taken"),
        "places",
    )


def range_sorted(copies: DataFrame, *keys: Column | str) -> DataFrame:
    partitions = int(copies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return copies.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)


def curriculum(docs: DataFrame) -> DataFrame:
    """The mix as training input: one row for each copy, range-sorted by place, with docs' columns only."""
    copies = place_copies(docs).select("row", F.explode("places").alias("place"))
    return range_sorted(copies, "place", F.xxhash64("row.doc_id")).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def copies_in_order(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, source, size, source_size, target, place, position) of each copy that the mix takes, range-sorted by place.

    position: the copy's number in the training order, from 0. A range numbers its own copies; the totals of the ranges,
    one row each, are added first. A row of docs that is never taken comes once, after all copies, without place and
    position. uid tells rows of docs apart, those that share a doc_id too.
    """
    scratch = Scratch(docs.sparkSession)
    placed = scratch.write(place_copies(docs, texts=False))  # the ranges' bounds and the sort both read it
    copies = placed.select("row.*", "size", "source_size", "target", F.explode_outer("places").alias("place"))
    order = (F.col("place").asc_nulls_last(), F.col("h"), F.col("doc_id").asc_nulls_last(), F.col("source").asc_nulls_last(), F.col("size"))
    ranged = scratch.write(range_sorted(copies, *order).withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftrightunsigned("_at", 33))  # the id's high bits are the range, its low 33 the row in it
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").agg(F.count("place").alias("_copies")).select("_part", F.coalesce(F.sum("_copies").over(earlier), F.lit(0)).alias("_before"))
    position = F.when(F.col("place").isNotNull(), F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1))
    return ranged.join(F.broadcast(offsets), "_part").select("uid", "doc_id", "source", "size", "source_size", "target", "place", position.alias("position"))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    copies = copies_in_order(read_table(spark, folder, "documents").select("doc_id", "source", "text"))
    taken = F.coalesce(F.sum(F.when(F.col("position").isNotNull(), F.col("size"))), F.lit(0))
    return (
        copies.groupBy("uid", "doc_id", "size", "source_size", "target")
        .agg(F.count("position").cast("int").alias("copies"), taken.cast("long").alias("taken"), F.round(F.min_by("place", "position"), 6).alias("first_place"))
        .drop("uid")
    )


ORACLE = r"""
with d as (
  select doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) as size,
         ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15))::bigint as h, md5(coalesce(text, '')) as tie from documents),
e as (select *, (size <= 256)::int as tier from d),
s0 as (select source, sum(size)::bigint as source_size from d group by 1),
s1 as (select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as weight, 3.0 * source_size as cap from s0),
s2 as (select *, (sum(source_size) over ())::double as total, sum(weight) over () as all_weight,
         coalesce(sum(cap) over (order by cap / weight, weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0) as caps,
         coalesce(sum(weight) over (order by cap / weight, weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0) as weights from s1),
s3 as (select *, (total - caps) / (all_weight - weights) as share from s2),
s4 as (select *, max(case when share <= cap / weight then share end) over () as line from s3),
t as (select source, source_size, weight, least(cap, coalesce(line, 'inf'::double) * weight) as target from s4),
tiers as (select source, tier, sum(size)::bigint as tier_size from e group by 1, 2),
g as (select tiers.*, t.source_size, t.weight, t.target, case when t.source_size > 0 then t.target * tiers.tier_size / t.source_size else 0.0 end as goal
  from tiers join t on tiers.source is not distinct from t.source),
m as (select e.*, coalesce(sum(size) over (partition by source, tier order by h, doc_id nulls last, size, tie rows between unbounded preceding and 1 preceding), 0) + size / 2 as middle from e),
large as (select m.source, sum(m.size * ((m.middle < g.goal and m.size > 0)::int + (m.middle + g.tier_size < g.goal and m.size > 0)::int + (m.middle + 2 * g.tier_size < g.goal and m.size > 0)::int)) as got
  from m join g on m.source is not distinct from g.source and m.tier = g.tier where m.tier = 0 group by 1),
f as (select g.*, case when g.tier = 0 then g.goal else greatest(0.0, least(g.target - coalesce(large.got, 0), 3.0 * g.tier_size)) end as final_goal
  from g left join large on g.source is not distinct from large.source),
o as (select m.doc_id, m.size, f.source_size, f.target, f.weight, f.final_goal, m.middle,
    case when m.size = 0 then 0 else (m.middle < f.final_goal)::int + (m.middle + f.tier_size < f.final_goal)::int + (m.middle + 2 * f.tier_size < f.final_goal)::int end as copies
  from m join f on m.source is not distinct from f.source and m.tier = f.tier)
select doc_id, size::bigint as size, source_size, target, copies, (copies * size)::bigint as taken,
  case when copies > 0 then round(case weight when 1 then (-1.8 + sqrt(3.24 - 3.2 * least(middle / final_goal, 1.0))) / -1.6
    when 2 then least(middle / final_goal, 1.0) else (-0.2 + sqrt(0.04 + 3.2 * least(middle / final_goal, 1.0))) / 1.6 end, 6) end as first_place
from o
"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_mixing": op5_mixing}
ORACLES: dict[str, str] = {"op5_mixing": ORACLE}
