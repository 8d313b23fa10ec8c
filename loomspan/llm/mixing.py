"""Mixing sources to target weights by Pareto order sampling.

Every source has a target number of words; its ratio of target to size says how many copies of each of its
documents the mix holds on average. The whole part of the ratio is allocated to every document with
certainty. The fraction is an inclusion probability p: documents get the Pareto key (u / (1-u)) / (p / (1-p)), where u is
a random number fixed by the row, and those of smallest key are taken until the words that are left are reached.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.llm.common import Scratch, put_aside, take_back, word_count

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
SEED = 42
#: Slices of the key; only rows in the slice that the cut falls in are put in order.
SLICES = 4096


def uniform(id_col: Column, text: Column, seed: int) -> Column:
    """A number in (0, 1) fixed by id, text and seed: 52 bits of an MD5."""
    said = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit(""))), F.lit(f"|{seed}"))
    return (F.conv(F.substring(F.md5(said), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(4503599627370496.0)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, cap: int = CAP) -> DataFrame:
    """source, source_size, target for a table of source and size.

    Sources by code point, null last, take the weights in turn. A target over cap times its source's size stops there and
    the rest is shared out again by weight. In order of size per weight, the sources that stop are the first ones, so one
    pass over the sources finds the level at which no other stops. Works on one row per source.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    each = each.withColumn("turn", turn)
    each = each.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("turn") - 1, F.lit(len(weights))) + 1).cast("int")))
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    each = each.withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
    each = each.withColumn("words", F.sum("source_size").over(every) * F.lit(float(share))).withColumn("weights", F.sum("weight").over(every))
    order = W.orderBy(F.col("limit") / F.col("weight"), "turn")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    left = F.col("words") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    level = left / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    each = each.withColumn("place", F.row_number().over(order)).withColumn("level", level)
    each = each.withColumn("first", F.min(F.when(F.col("weight") * F.col("level") <= F.col("limit"), F.struct("place", "level"))).over(every))
    under = F.col("first").isNotNull() & (F.col("place") >= F.col("first.place"))
    return each.select("source", "source_size", F.when(under, F.col("weight") * F.col("first.level")).otherwise(F.col("limit")).alias("target"))


def _plan(scored: DataFrame, scratch: Scratch, weights: Sequence[float], share: float, cap: int) -> DataFrame:
    """A row per source: its target, whole copies, fraction, and the last (key, id, size) that is taken once more."""
    goal = targets(scored, weights, share, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("whole", F.floor(F.least(ratio, F.lit(float(cap)))).cast("long")).withColumn("fraction", F.least(ratio, F.lit(float(cap))) - F.col("whole"))
    goal = scratch.write(goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "goal")
    keyed = scored.join(goal.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).where("fraction > 0")
    keyed = keyed.withColumn("key", pareto_key(F.col("u"), F.col("fraction")))
    # Repeated rows have one key and are taken together.
    alike = keyed.groupBy("source", "key", "id", "size", "rest").agg(F.sum("size").alias("words"))
    alike = scratch.write(alike.withColumn("slice", F.floor(F.col("key") / (1 + F.col("key")) * SLICES).cast("int")), "keys")
    slices = alike.groupBy("source", "slice", "rest").agg(F.sum("words").alias("words"))
    upto = F.sum("words").over(W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    slices = slices.withColumn("before", F.coalesce(upto, F.lit(0)))
    cut = slices.where("before < rest and before + words >= rest").select(F.col("source").alias("of"), F.col("slice").alias("cut"), "before")
    under = alike.join(cut, F.col("source").eqNullSafe(F.col("of")), "left")
    wholly = under.where("cut is null or slice < cut").select("source", F.struct("key", "id", "size").alias("last"))
    inside = under.where("slice = cut").withColumn("upto", F.col("before") + F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = inside.where("upto + words / 2 <= rest").select("source", F.struct("key", "id", "size").alias("last"))
    last = wholly.union(inside).groupBy(F.col("source").alias("of")).agg(F.max("last").alias("last"))
    # Written, so that Spark knows its size and sends it to all tasks where that is small, as few sources are.
    return scratch.write(goal.join(last, F.col("source").eqNullSafe(F.col("of")), "left").select(F.col("source").alias("of"), "source_size", "target", "whole", "fraction", "last"), "plan")


def pareto_key(u: Column, inclusion: Column) -> Column:
    return (u / (1 - u)) / (inclusion / (1 - inclusion))


def _decide(rows: DataFrame, plan: DataFrame, source: str, size: str, u: str, id_col: str) -> DataFrame:
    joined = rows.join(plan, rows[source].eqNullSafe(plan["of"]))
    own = F.struct(pareto_key(F.col(u), F.col("fraction")).alias("key"), F.col(id_col).alias("id"), F.col(size).alias("size"))
    once = (F.col("fraction") > 0) & F.col("last").isNotNull() & (own <= F.col("last"))
    return joined.withColumn("copies", F.col("whole") + F.when(once, 1).otherwise(0))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = 1.0, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """id, source, size, source_size, target, copies, taken (copies times size): one row per row of df.

    Null texts have size 0 and are taken 0 words; a null source is a source of its own; repeated rows (same id and
    text) are taken alike; ids may be null. No document is taken more than cap times. Random numbers are fixed by
    id, text and seed, so reruns agree. An empty table gives an empty table.
    """
    scratch = Scratch(df.sparkSession, "mixing")
    scored = scratch.write(_scored(df, id_col, text_col, source_col, seed), "sizes")
    plan = _plan(scored, scratch, weights, share, cap)
    out = _decide(scored, plan, "source", "size", "u", "id")
    return out.select("id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _scored(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    text = F.col(text_col)
    return df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"), uniform(F.col(id_col), text, seed).alias("u"))


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = 1.0, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """The rows of df that the mix takes, with size, source_size, target, copies and taken beside df's columns.

    The cut of a source is one key, so the rows are judged where they are read and texts are not shuffled. Columns of df
    that have one of the added names are replaced.
    """
    scratch = Scratch(df.sparkSession, "mixing")
    plan = _plan(scratch.write(_scored(df, id_col, text_col, source_col, seed), "sizes"), scratch, weights, share, cap)
    plan = plan.select(*[F.col(c).alias("of" if c == "of" else f"_plan_{c}") for c in plan.columns]).withColumnRenamed("of", "_plan_of")
    own_id, own_text = F.col(f"own_{id_col}"), F.col(f"own_{text_col}")
    rows = put_aside(df).withColumn("_size", word_count(own_text)).withColumn("_u", uniform(own_id, own_text, seed))
    joined = rows.join(plan, rows[f"own_{source_col}"].eqNullSafe(plan["_plan_of"]))
    own = F.struct(pareto_key(F.col("_u"), F.col("_plan_fraction")).alias("key"), own_id.alias("id"), F.col("_size").alias("size"))
    once = (F.col("_plan_fraction") > 0) & F.col("_plan_last").isNotNull() & (own <= F.col("_plan_last"))
    joined = joined.withColumn("_copies", F.col("_plan_whole") + F.when(once, 1).otherwise(0)).where((F.col("_copies") > 0) & (F.col("_size") > 0))
    added = {"size": F.col("_size"), "source_size": F.col("_plan_source_size"), "target": F.col("_plan_target"), "copies": F.col("_copies"), "taken": F.col("_copies") * F.col("_size")}
    return joined.select(*take_back(joined, [c for c in df.columns if c not in added]), *[v.alias(k) for k, v in added.items()])


#: The same in SQL; {rows} is a query with columns doc_id, text, source.
SQL = r"""
with sized as (
  select doc_id, source, text,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    (('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, '')) || '|42'), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u
  from ({rows})),
sources as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as turn from sized group by source),
weighted as (select *, ([5.0, 2.0, 1.0])[1 + (turn - 1) % 3]::double as weight, 3.0::double * source_size as lim from sources),
summed as (select *, (sum(source_size) over ())::double as words, sum(weight) over () as weights from weighted),
levels as (
  select *, row_number() over (order by lim / weight, turn) as place,
    (words - coalesce(sum(lim) over (order by lim / weight, turn rows between unbounded preceding and 1 preceding), 0.0))
    / (weights - coalesce(sum(weight) over (order by lim / weight, turn rows between unbounded preceding and 1 preceding), 0.0)) as level
  from summed),
firsts as (select min(place) as place from levels where weight * level <= lim),
goals as (
  select l.source, l.source_size, case when f.place is not null and l.place >= f.place then l.weight * g.level else l.lim end as target
  from levels l cross join firsts f left join levels g on g.place = f.place),
ratios as (select *, least(case when source_size > 0 then target / source_size else 0.0 end, 3.0::double) as ratio from goals),
plans as (select *, floor(ratio)::bigint as whole, ratio - floor(ratio) as fraction, target - floor(ratio)::bigint * source_size as rest from ratios),
keyed as (
  select s.*, p.source_size, p.target, p.whole, p.fraction, p.rest, (u / (1 - u)) / (p.fraction / (1 - p.fraction)) as key
  from sized s join plans p on s.source is not distinct from p.source),
alike as (select source, key, doc_id, size, any_value(rest) as rest, sum(size) as words from keyed where fraction > 0 group by source, key, doc_id, size),
ranked as (
  select *, coalesce(sum(words) over (partition by source order by key, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0) as upto from alike),
once as (select source, key, doc_id, size from ranked where upto + words / 2 <= rest)
select k.doc_id, k.size, k.source_size, k.target, (k.size * (k.whole + case when o.key is null then 0 else 1 end))::bigint as taken
from keyed k left join once o on k.source is not distinct from o.source and k.key = o.key and k.doc_id is not distinct from o.doc_id and k.size = o.size
"""
