"""Prefix trie of conversations by prefix doubling.

Equal turns get equal dense names; then, round by round, two neighbouring blocks of 2^k turns get a name as a block of twice as many. Names are
places in the order of what they name, a missing block comes before all others, so the name of the block that holds a whole conversation tells its place
among all conversations in trie order. Conversations of equal turns are one sequence from there on. The prefix of d turns is the
prefix without the lowest bit of d, followed by one block; prefixes get names from the highest bit to the lowest. Both take logarithmically
many rounds of joins, whatever the depth of the trie.

A node is a group of prefixes. Its members are neighbours in trie order, so sums over its subtree are differences of running sums over
all nodes in that order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import Scratch, partitions, word_count

#: Conversations of which each twentieth opens those after it, and the bound of shared turns (values of the query).
EVERY, SHARED = 20, 4
#: Conversation ids of one piece of a node's list.
PIECE = 20_000


def _part() -> Column:
    """The range that a row numbered by monotonically_increasing_id is in."""
    return F.shiftright(F.col("_m"), 33)


def _in_order(df: DataFrame, order: list[str], scratch: Scratch, name: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """df with rank, its rows' places in this order from 1, and running sums up to and including each row, as sum_ and the column's name.

    Rows are dealt out by ranges and sorted within them; sums over the ranges, one row for each, are added to the places within.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    rows = scratch.write(rows, name)
    total = rows.groupBy(_part().alias("_part")).agg(F.count("*").alias("_rows"), *[F.sum(c).alias(f"_all_{c}") for c in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    lead = total.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_rows", *[f"_all_{c}" for c in sums])])
    within = Window.partitionBy("_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    if sums:
        rows = rows.withColumn("_p", _part()).withColumns({f"sum_{c}": F.sum(c).over(within) for c in sums})
    found = rows.join(F.broadcast(lead), _part() == F.col("_part"))
    return found.select(*df.columns, (F.col("_rows") + F.col("_m").bitwiseAND((1 << 33) - 1) + 1).alias("rank"), *[(F.col(f"sum_{c}") + F.col(f"_all_{c}")).alias(f"sum_{c}") for c in sums])


def _named(rows: DataFrame, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """rows with the dense name of their keys instead of these."""
    names = _in_order(rows.select(*keys).distinct(), keys, scratch, f"{name}-keys").withColumnRenamed("rank", "name")
    return scratch.write(rows.join(names, keys).drop(*keys), name)


def turns(df: DataFrame, scratch: Scratch, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns with their places: conv_id, place (from 0), key (SHA-256 of role and text), words (of the text).

    A conversation's turns are in order of turn, nulls first, then of role and text; null roles and texts are empty. Repeated rows are turns
    of their own. Rows without a conversation id belong to no conversation. Places come from a sort of all rows by ranges, so one long
    conversation is spread over tasks.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("_turn"), role.alias("_role"), text.alias("_text")).where("conv_id is not null")
    order = ["conv_id", "_turn", "_role", "_text"]
    key = F.unhex(F.sha2(F.concat(F.octet_length("_role").cast("string"), F.lit(":"), "_role", "_text"), 256))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", key.alias("key"), word_count(F.col("_text")).alias("words"), F.monotonically_increasing_id().alias("_m"))
    rows = scratch.write(rows, "turns")
    # A conversation's first place in each range; ranges that it fills in between count with all of their rows.
    ranges = rows.groupBy("conv_id", _part().alias("_part")).agg(F.min("_m").alias("_least"), F.count("*").alias("_rows"))
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    placed = rows.withColumn("_part", _part()).join(ranges, ["conv_id", "_part"])
    return scratch.write(placed.select("conv_id", (F.col("_before") + F.col("_m") - F.col("_least")).alias("place"), "key", "words"), "placed")


def share_openings(placed: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations as (turns, lengths): conversation c opens with the first h turns of conversation c - c % EVERY, h being
    the CRC-32 of c in decimals % SHARED, instead of its own first h. Opening conversations keep their own turns. Lengths has conv_id and length of
    every conversation, zero included."""
    opener = F.col("conv_id") - F.col("conv_id") % EVERY
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    heads = scratch.write(placed.where((F.col("conv_id") % EVERY == 0) & (F.col("place") < SHARED - 1)), "heads")
    known = heads.groupBy(F.col("conv_id").alias("_opener")).agg(F.count("*").alias("_known"))
    sizes = placed.groupBy("conv_id").agg(F.count("*").alias("_n")).withColumn("_opener", opener).withColumn("_h", h)
    plan = sizes.join(known, "_opener", "left").withColumn("_took", F.least("_h", F.coalesce("_known", F.lit(0))))
    plan = scratch.write(plan.withColumn("length", F.col("_took") + F.greatest(F.col("_n") - F.col("_h"), F.lit(0))), "plan")
    own = placed.join(plan.select("conv_id", "_h", "_took"), "conv_id").where("place >= _h").select("conv_id", (F.col("place") - F.col("_h") + F.col("_took")).alias("place"), "key", "words")
    heads = heads.withColumnRenamed("conv_id", "_opener")
    lent = plan.where("_took > 0").select("conv_id", "_opener", "_took").join(heads, "_opener").where("place < _took").select("conv_id", "place", "key", "words")
    return scratch.write(own.unionByName(lent), "rebuilt"), plan.select("conv_id", "length")


def _blocks(placed: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], int]:
    """Names of all blocks, level by level: conv_id, place (of the block among those of its size), name. The last level has one block a
    conversation. A block that the conversation ends in is named by what it holds."""
    top = placed.agg(F.max("place")).first()[0]
    longest = 0 if top is None else top + 1
    if not longest:
        return [], 0
    levels = [_named(placed.select("conv_id", "place", "key"), ["key"], scratch, "level-0")]
    while 1 << len(levels) - 1 < longest:
        k, half = len(levels), F.col("place") % 2
        pairs = levels[-1].groupBy("conv_id", F.shiftright("place", 1).alias("place")).agg(F.max(F.when(half == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(half == 1, F.col("name"))), F.lit(0)).alias("right"))
        levels.append(_named(scratch.write(pairs, f"pairs-{k}"), ["left", "right"], scratch, f"level-{k}"))
        scratch.drop(f"pairs-{k}")
    return levels, longest


def _prefixes(levels: list[DataFrame], sequences: DataFrame, scratch: Scratch) -> DataFrame:
    """Names of the prefixes of every sequence: sequence, depth, name. A prefix's last block has as many turns as the lowest bit of its depth."""
    parts = [level.where("place % 2 = 0").select("conv_id", F.lit(k).alias("bit"), F.shiftleft((F.col("place") + 1).cast("long"), k).alias("depth"), F.col("name").alias("block")) for k, level in enumerate(levels)]
    steps = reduce(DataFrame.unionByName, parts).join(sequences.select("conv_id", "sequence", "length"), "conv_id").where("depth <= length")
    steps = scratch.write(steps.select("sequence", "bit", "depth", "block"), "steps")
    done: list[DataFrame] = []
    for k in reversed(range(len(levels))):
        now = steps.where(F.col("bit") == k).select("sequence", "depth", "block", (F.col("depth") - (1 << k)).alias("_from"))
        both = now.where("_from = 0").select("sequence", "depth", F.lit(0).cast("long").alias("head"), "block")
        if done:
            known = reduce(DataFrame.unionByName, done).select("sequence", F.col("depth").alias("_from"), F.col("name").alias("head"))
            both = both.unionByName(now.where("_from > 0").join(known, ["sequence", "_from"]).select("sequence", "depth", "head", "block"))
        both = scratch.write(both.withColumn("size", F.col("depth")), f"heads-{k}")
        done.append(_named(both, ["size", "head", "block"], scratch, f"prefixes-{k}"))
        scratch.drop(f"heads-{k}")
    return reduce(DataFrame.unionByName, done)


def _id_digests(rows: DataFrame, group: str, id_col: str) -> DataFrame:
    """SHA-256 of each group's ids, ascending, in decimals and joined by commas: group, sha.

    All ids are sorted by ranges and written out as pieces of text in parallel; a task then only hashes a group's pieces in order, as a hash can't be split.
    """
    ids = rows.select(F.col(group).cast("long").alias("g"), F.col(id_col).cast("long").alias("c")).repartitionByRange("g", "c").sortWithinPartitions("g", "c")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, g, held = [], None, []
            for now, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and (now != g or len(held) >= PIECE):
                    out.append((g, held[0], ",".join(map(str, held))))
                    held = []
                g = now
                held.append(c)
            if held:
                out.append((g, held[0], ",".join(map(str, held))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["g", "c", "piece"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, sha, out = None, None, []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.string())], ["g", "sha"])
            out.clear()
            return made

        for b in batches:
            for now, piece in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if sha is not None and now == g:
                    sha.update(b",")
                else:
                    if sha is not None:
                        out.append((g, sha.hexdigest()))
                    g, sha = now, hashlib.sha256()
                sha.update(piece.encode())
            if out:
                yield batch()
        if sha is not None:
            out.append((g, sha.hexdigest()))
            yield batch()

    made = ids.mapInArrow(pieces, "g long, c long, piece string")
    made = made.repartition(partitions(rows.sparkSession), "g").sortWithinPartitions("g", "c")
    return made.mapInArrow(digests, T._parse_datatype_string("g long, sha string")).select(F.col("g").alias(group), "sha")


def prefix_trie(placed: DataFrame, lengths: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes of the trie over conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and words of the node's last turn.

    placed: conv_id (integers), place from 0 without gaps, key, words; lengths: conv_id, length of every conversation, those without turns included.
    Without conversations there are no nodes; conversations without turns end at the root. Turns are told apart by their keys. Saved tokens are what a node's
    subtree would take less if each of its turns were stored once. Hot turns and openings are counted before they are
    shuffled, and joins with a table that has one row a name are split by Spark's adaptive execution.
    """
    levels, longest = _blocks(placed, scratch)
    spark = lengths.sparkSession
    top = lengths.agg(F.min("conv_id").cast("long"), F.count("*")).first()
    nobody = F.sha2(F.lit(""), 256)
    if not top[1]:
        empty = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, words long"
        return spark.createDataFrame([], empty)
    whole = levels[-1].select("conv_id", F.col("name").alias("sequence")) if longest else lengths.limit(0).select("conv_id", F.lit(0).cast("long").alias("sequence"))
    ended = scratch.write(lengths.join(whole, "conv_id", "left").select("conv_id", "length", F.coalesce("sequence", F.lit(0)).alias("sequence")), "ended")
    sequences = scratch.write(ended.where("sequence > 0").groupBy("sequence").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"), F.max("length").alias("length")), "sequences")
    root = spark.createDataFrame([(top[0], 0, 0, 0, top[1], 0, 0, 0, 0, 0)], "conv_id long, depth long, name long, head long, n_convs long, low long, high long, deepest long, sequence long, words long")
    nodes = root
    if longest:
        prefixes = _prefixes(levels, sequences, scratch)
        member = F.min(F.struct("conv_id", "sequence"))
        rows = prefixes.join(sequences, "sequence").groupBy("depth", "name").agg(F.sum("copies").alias("n_convs"), member.alias("_m"), F.min("sequence").alias("low"), F.max("sequence").alias("high"), F.max("length").alias("deepest"))
        rows = rows.select(F.col("_m.conv_id").alias("conv_id"), "depth", "name", "n_convs", "low", "high", "deepest", F.col("_m.sequence").alias("sequence"), (F.col("depth") - 1).alias("place"))
        rows = rows.join(placed.select("conv_id", "place", "words"), ["conv_id", "place"])
        heads = prefixes.select("sequence", (F.col("depth") + 1).alias("depth"), F.col("name").alias("head"))
        rows = rows.join(heads, ["sequence", "depth"], "left").withColumn("head", F.coalesce("head", F.lit(0)))
        last = rows.agg(F.max("high"), F.max("deepest")).first()
        nodes = nodes.withColumns({"high": F.lit(last[0]), "deepest": F.lit(last[1])}).unionByName(rows.drop("place"))
    worth = (F.col("n_convs") - 1) * F.col("words")
    nodes = nodes.withColumns({"leaf": (F.col("deepest") == F.col("depth")).cast("long"), "worth": worth})
    nodes = scratch.write(_in_order(nodes, ["low", "depth"], scratch, "ordered", ("leaf", "worth")), "nodes")
    upto = nodes.groupBy(F.col("low").alias("high")).agg(F.max("sum_leaf").alias("_leaf"), F.max("sum_worth").alias("_worth"))
    found = nodes.join(upto, "high")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("head").alias("name")).agg(F.count("*").alias("n_children"))
    found = found.join(children, ["depth", "name"], "left")
    parents = nodes.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("name").alias("head"), F.col("conv_id").alias("_parent"))
    found = found.join(parents, ["depth", "head"], "left")
    ends = _id_digests(ended, "sequence", "conv_id").join(ended.groupBy("sequence").agg(F.max("length").alias("depth")), "sequence").withColumnRenamed("sequence", "low")
    found = found.join(ends, ["low", "depth"], "left")
    long = lambda c: c.cast("long")
    parent: Column = F.when(F.col("depth") == 1, F.lit(top[0])).otherwise(F.col("_parent"))
    return found.select(
        long(F.col("conv_id")).alias("conv_id"),
        long(F.col("depth")).alias("depth"),
        long(parent).alias("parent_conv_id"),
        long(F.col("n_convs")).alias("n_convs"),
        long(F.coalesce("n_children", F.lit(0))).alias("n_children"),
        long(F.col("_leaf") - F.col("sum_leaf") + F.col("leaf")).alias("n_leaves"),
        long(F.col("_worth") - F.col("sum_worth") + F.col("worth")).alias("saved_tokens"),
        F.coalesce("sha", nobody).alias("ends_sha256"),
        long(F.col("words")).alias("words"),
    )


#: The nodes of rebuilt conversations in SQL, each beside all of its descendants. CRC-32 is taken bit by bit.
SQL = r"""
with rows as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, turn from conversations where conv_id is not null),
own as (select c, list({'role': role, 'text': text} order by turn nulls first, role, text) as turns from rows group by c),
steps as (
  select c, turns, list_reduce(
    list_prepend(4294967295::bigint, flatten(list_transform(string_split(c::varchar, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1]))),
    lambda z, x: xor(xor(z, greatest(x, 0)) >> 1, (xor(z, greatest(x, 0)) & 1) * 3988292384)) as z
  from own),
known as (select c, turns, xor(z, 4294967295) % 4 as h from steps),
rebuilt as (
  select k.c, list_concat(coalesce(b.turns, [])[1:k.h], k.turns[k.h + 1:]) as s from known k left join own b on b.c = k.c - k.c % 20),
prefixes as (select c, len(s) as n, d, s[1:d] as p from (select c, s, unnest(range(0, len(s) + 1)) as d from rebuilt)),
nodes as (
  select p, d, min(c) as conv_id, count(*) as n_convs,
    coalesce(sha256(string_agg(c::varchar, ',' order by c) filter (where n = d)), sha256('')) as ends_sha256,
    coalesce(len(regexp_extract_all(p[d].text, '[^\x20\x09-\x0D]+')), 0) as words
  from prefixes group by p, d),
valued as (
  select n.*, (n_convs - 1) * words as worth, (not exists (select 1 from nodes m where m.d = n.d + 1 and m.p[1:n.d] = n.p))::bigint as leaf from nodes n),
above as (select worth, leaf, p[1:t] as top, t from (select *, unnest(range(0, d + 1)) as t from valued)),
sums as (select top, t, sum(leaf)::bigint as n_leaves, sum(worth)::bigint as saved_tokens from above group by top, t),
children as (select p[1:d - 1] as top, d - 1 as t, count(*) as n_children from nodes where d > 0 group by all)
select n.conv_id, n.d as depth, q.conv_id as parent_conv_id, n.n_convs, coalesce(k.n_children, 0) as n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
from nodes n join sums s on s.t = n.d and s.top = n.p
left join children k on k.t = n.d and k.top = n.p
left join nodes q on q.d = n.d - 1 and q.p = n.p[1:n.d - 1]
"""
