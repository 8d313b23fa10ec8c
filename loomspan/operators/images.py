"""Image hashes, duplicates, routes, batches and cost attribution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.functions import lexicons as L
from loomspan.session import Cuts

SENTINEL = 9999


def average_hash(grid: Column) -> Column:
    """16 hex digits of an 8x8 grid: a bit is set where the value is over the mean, the first value highest."""
    mean = F.aggregate(grid, F.lit(0.0), lambda a, v: a + v, lambda a: a / F.size(grid))
    bits = F.array_join(F.transform(grid, lambda v: F.when(v > mean, "1").otherwise("0")), "")
    return F.lower(F.concat(*[F.lpad(F.conv(F.substring(bits, at, 32), 2, 16), 8, "0") for at in (1, 33)]))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hex hashes; the sentinel where one is malformed or the lengths differ."""
    half = lambda c, at: F.conv(F.substring(c, at, 8), 16, 10).cast("long")
    good = a.rlike("^[0-9a-fA-F]{16}$") & b.rlike("^[0-9a-fA-F]{16}$")
    return F.when(good, sum((F.bit_count(half(a, at).bitwiseXOR(half(b, at))) for at in (9,)), F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))))).otherwise(SENTINEL)


def near_hashes(df: DataFrame, group_col: str, id_col: str, hash_col: str, most: int) -> DataFrame:
    """Pairs of different 16-digit hashes of a group that differ in at most `most` bits, with their first ids: group, left_id, right_id, distance.

    Equal hashes are one row (dedup_groups has their members). The 64 bits are cut into half as many parts as most + 1, so two such hashes differ by one bit at most in one of them, and no pair is lost: one of
    the two is looked up by each part as it is, the other by the part and all that differ from it in one bit. A pair is taken from the first part that is so near. Malformed hashes have no pair.
    Both sides are sorted: Spark judges them by the size they have before their parts are written out, and would broadcast one through the driver.
    """
    half = lambda at: F.conv(F.substring(hash_col, at, 8), 16, 10).cast("long")
    first = df.where(F.col(hash_col).rlike("^[0-9a-fA-F]{16}$")).groupBy(F.col(group_col).alias("grp"), half(1).alias("high"), half(9).alias("low")).agg(F.min(id_col).alias("id"))
    count = most // 2 + 1
    cuts = [64 * k // count for k in range(count + 1)]
    bits = F.shiftleft("high", 32).bitwiseOR(F.col("low"))
    masks = [(1 << (b - a)) - 1 for a, b in zip(cuts, cuts[1:])]
    part = lambda c, k: F.shiftrightunsigned(c, 64 - cuts[k + 1]).bitwiseAND(F.lit(masks[k] if masks[k] < 1 << 63 else -1))
    first = first.select("grp", "id", bits.alias("bits"))
    exact = F.array(*[F.struct(F.lit(k).alias("part"), part(F.col("bits"), k).alias("key")) for k in range(count)])
    one = lambda k: F.transform(F.array(*[F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)) for i in range(cuts[k + 1] - cuts[k])]]), lambda m: F.struct(F.lit(k).alias("part"), part(F.col("bits"), k).bitwiseXOR(m).alias("key")))
    l = first.select("grp", "id", "bits", F.explode(exact).alias("p")).select("grp", "id", "bits", "p.*").alias("l")  # noqa: E741
    r = first.select("grp", "id", "bits", F.explode(F.concat(*[one(k) for k in range(count)])).alias("p")).select("grp", "id", "bits", "p.*").alias("r")
    met = l.join(r.hint("merge"), [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("grp", "part", "key")] + [F.col("l.id") < F.col("r.id")])
    differs = F.col("l.bits").bitwiseXOR(F.col("r.bits"))
    distance = F.bit_count(differs)
    nearest = F.lit(count)
    for k in reversed(range(count)):
        nearest = F.when(F.bit_count(part(differs, k)) <= 1, k).otherwise(nearest)
    met = met.where((distance <= most) & (nearest == F.col("l.part")))
    return met.select(F.col("l.grp").alias(group_col), F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"), distance.alias("distance"))


def dedup_groups(df: DataFrame, id_col: str, hash_col: str, cost_col: str) -> DataFrame:
    """Rows of one hash form a group (a null hash is its own); the first is the representative and alone carries the cost."""
    key = F.coalesce(F.col(hash_col), F.concat(F.lit("#"), F.col(id_col).cast("string")))
    w = W.partitionBy("group_key").orderBy(id_col)
    out = df.withColumn("group_key", key).withColumn("place", F.row_number().over(w)).withColumn("representative", F.first(id_col).over(w))
    return out.withColumn("is_representative", F.col("place") == 1).withColumn("cost", F.when(F.col("place") == 1, F.col(cost_col)).otherwise(0.0)).drop("place", "group_key")


def first_match(df: DataFrame, group_col: str, order_col: str, hash_col: str, most: int) -> DataFrame:
    """Greedy duplicates in a group: a row takes the earliest stored hash within `most` bits, else is stored itself: group, order, matched (the order of the row taken).

    What is stored is the first independent set, in this order, of the graph of near hashes. In rounds, hashes without an undecided earlier neighbour are stored and
    their later neighbours fall; edges of decided hashes go, until none is left. Rounds grow with the longest chain of undecided
    neighbours, not with the rows. Malformed and null hashes match themselves. The order is unique within a group and not null. Edges and rows are joined sorted, as
    tables that are small on disk are not small in the driver.
    """
    cuts = Cuts(df.sparkSession)
    edges = every = cuts.write(near_hashes(df, group_col, order_col, hash_col, most).select(F.col(group_col).alias("grp"), "left_id", "right_id"), "edges")
    fallen = cuts.write(edges.select("grp", F.col("right_id").alias("id")).limit(0), "fallen-0")
    k = 0
    while edges.limit(1).count():
        k += 1
        later = edges.select("grp", F.col("right_id").alias("left_id")).distinct()
        stored = edges.join(later.hint("merge"), ["grp", "left_id"], "left_anti")
        falls = cuts.write(stored.select("grp", F.col("right_id").alias("id")).distinct(), f"falls-{k}")
        gone = [falls.select("grp", F.col("id").alias(c)).hint("merge") for c in ("left_id", "right_id")]
        edges = cuts.write(edges.join(gone[0], ["grp", "left_id"], "left_anti").join(gone[1], ["grp", "right_id"], "left_anti").select("grp", "left_id", "right_id"), f"edges-{k}")
        fallen = fallen.union(falls)
    of_fallen = every.join(fallen.withColumnRenamed("id", "right_id").hint("merge"), ["grp", "right_id"], "left_semi").join(fallen.withColumnRenamed("id", "left_id").hint("merge"), ["grp", "left_id"], "left_anti")
    taken = of_fallen.groupBy("grp", F.col("right_id").alias("_first")).agg(F.min("left_id").alias("_taken"))
    rows = df.select(F.col(group_col).alias("grp"), F.col(order_col).alias("id"), F.when(F.col(hash_col).rlike("^[0-9a-fA-F]{16}$"), F.lower(hash_col)).alias("hash"))
    firsts = rows.where("hash is not null").groupBy("grp", "hash").agg(F.min("id").alias("_first")).join(taken.hint("merge"), ["grp", "_first"], "left")
    firsts = firsts.select("grp", "hash", F.coalesce("_taken", "_first").alias("_match"))
    found = rows.join(firsts.hint("merge"), ["grp", "hash"], "left")
    return found.select(F.col("grp").alias(group_col), F.col("id").alias(order_col), F.coalesce("_match", "id").alias("matched"))


def density_route(density: Column, lines: Column, cloud: Column) -> Column:
    visual = F.when(cloud, "vlm").otherwise("ocr")
    return F.when((density <= 0.02) & (lines == 0), "skip_decorative").when((density >= 0.45) & (lines >= 3), "ocr").otherwise(visual)


def layout_route(label: Column, density: Column, lines: Column, cloud: Column, strict: Column) -> Column:
    visual = F.when(cloud, "vlm").otherwise("ocr")
    text = F.when(strict & (density < 0.45), visual).otherwise("ocr")
    return F.when(label.isin(*L.VLM_LABELS), visual).when(label.isin(*L.TEXT_LABELS), text).when((density <= 0.02) & (lines == 0), "skip_decorative").otherwise(visual)


def polygon_area(xs: Column, ys: Column) -> Column:
    """Shoelace area of a polygon given by its corners' coordinates."""
    n = F.size(xs)
    at = F.sequence(F.lit(0), n - 1)
    cross = F.transform(at, lambda i: F.get(xs, i) * F.get(ys, (i + 1) % n) - F.get(xs, (i + 1) % n) * F.get(ys, i))
    return F.when(n >= 3, F.abs(F.aggregate(cross, F.lit(0.0), lambda a, v: a + v)) / 2).otherwise(0.0)


def dominant_label(df: DataFrame, group_col: str, pos_col: str, label_col: str, area_col: str) -> DataFrame:
    """Label of the largest box, the first of equal ones."""
    return df.where(F.col(label_col).isNotNull() & (F.col(label_col) != "")).groupBy(group_col).agg(F.max_by(label_col, F.struct(F.col(area_col), -F.col(pos_col))).alias("dominant_label"))


def model_rates(provider: Column, model: Column) -> tuple[Column, Column]:
    """Prices per 1000 tokens in and out: the first listed model whose name is contained, else the provider's, else the default."""
    def pick(i: int) -> Column:
        other = F.lit(L.DEFAULT_PRICE[i])
        for name, price in L.PROVIDER_PRICES.items():
            other = F.when(provider == name, price[i]).otherwise(other)
        for name, *price in reversed(L.MODEL_PRICES):
            other = F.when(F.contains(F.lower(model), F.lit(name)), price[i]).otherwise(other)
        return other
    return pick(0), pick(1)


def cost(provider: Column, model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    a, b = model_rates(provider, model)
    return F.round(F.greatest(F.lit(0.0), tokens_in / 1000.0 * a + tokens_out / 1000.0 * b), 6)


def downscaled(width: Column, height: Column, longest: int = 768) -> tuple[Column, Column]:
    """Width and height with the longer side at most `longest`; never enlarged."""
    most = F.greatest(width, height)
    scale = lambda c: F.when(most > longest, F.greatest(F.lit(1), F.bround(c * longest / most).cast("long"))).otherwise(c)
    return scale(width), scale(height)


def batch_numbers(df: DataFrame, group_col: str, order_col: str, size: int) -> DataFrame:
    return df.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(group_col).orderBy(order_col)) - 1) / size))


def batch_items(df: DataFrame, id_col: str, raw_col: str, size_col: str) -> DataFrame:
    """Items of a batch answer (a bare array or under "items"): indexes in range, the first of repeated ones."""
    kind = "array<struct<index:int,label:string>>"
    items = F.coalesce(F.from_json(F.get_json_object(raw_col, "$.items"), kind), F.from_json(raw_col, kind))
    each = df.select(id_col, size_col, F.posexplode(items).alias("pos", "item")).select(id_col, "pos", size_col, "item.index", "item.label")
    good = each.where((F.col("index") >= 0) & (F.col("index") < F.col(size_col)))
    return good.groupBy(id_col, "index").agg(F.min_by("label", "pos").alias("label"))


def is_mermaid(text: Column) -> Column:
    """Cheap check of a diagram's source: length, opening word, balanced brackets, an arrow."""
    n = F.length(text)
    count = lambda c: n - F.length(F.replace(text, F.lit(c), F.lit("")))
    starts = reduce(lambda a, b: a | b, [F.startswith(text, F.lit(w)) for w in L.MERMAID_STARTS])
    arrows = reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in L.MERMAID_ARROWS])
    balanced = (count("(") == count(")")) & (count("[") == count("]")) & (count("{") == count("}"))
    return F.coalesce(n.between(20, 5000) & starts & balanced & arrows, F.lit(False))
