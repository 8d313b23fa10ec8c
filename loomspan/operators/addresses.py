"""Hosts as addresses, address tables by longest prefix, and chains of redirects.

An address is 32 hex digits: those of IPv6, or of IPv4 mapped into it. A table of prefixes becomes the places where its answer changes, and addresses and
these places are sorted together, so that each address has the last place at or before it: a range join that takes one sort, in
ranges of rows, for tables and addresses of any number.
"""

from __future__ import annotations

import ipaddress
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.operators.scan import BEFORE, in_ranges
from loomspan.session import Cuts

#: Networks that are no public hosts, and public ones inside of them (fixed values of the special-purpose registries).
NETWORKS = (
    ("0.0.0.0/8", "local"), ("10.0.0.0/8", "private"), ("100.64.0.0/10", "shared"), ("127.0.0.0/8", "loopback"), ("169.254.0.0/16", "link_local"), ("172.16.0.0/12", "private"),
    ("192.0.0.0/24", "reserved"), ("192.0.0.9/32", "public"), ("192.0.0.10/32", "public"), ("192.0.2.0/24", "example"), ("192.168.0.0/16", "private"), ("198.18.0.0/15", "private"),
    ("198.51.100.0/24", "example"), ("203.0.113.0/24", "example"), ("224.0.0.0/4", "multicast"), ("240.0.0.0/4", "reserved"),
    ("::/8", "reserved"), ("::/128", "local"), ("::1/128", "loopback"), ("::ffff:0:0/96", "public"), ("100::/8", "reserved"), ("200::/7", "reserved"), ("400::/6", "reserved"), ("800::/5", "reserved"), ("1000::/4", "reserved"),
    ("2001::/23", "reserved"), ("2001:1::1/128", "public"), ("2001:1::2/128", "public"), ("2001:3::/32", "public"), ("2001:4:112::/48", "public"), ("2001:20::/28", "public"), ("2001:30::/28", "public"),
    ("2001:db8::/32", "example"), ("2002::/16", "reserved"), ("4000::/3", "reserved"), ("6000::/3", "reserved"), ("8000::/3", "reserved"), ("a000::/3", "reserved"), ("c000::/3", "reserved"),
    ("e000::/4", "reserved"), ("f000::/5", "reserved"), ("f800::/6", "reserved"), ("fc00::/7", "private"), ("fe00::/9", "reserved"), ("fe80::/10", "link_local"), ("ff00::/8", "multicast"),
)
MAPPED = 0xFFFF << 32
NUMBER = re.compile(r"0[xX][0-9a-fA-F]*|0[0-7]*|[1-9][0-9]*")


def host_number(host: str | None) -> int | None:
    """The address that a host is written as: IPv6 with or without brackets and zone, or IPv4 in one to four parts, each decimal, octal or hexadecimal, as resolvers take them. None
    for names and malformed addresses."""
    host = (host or "").strip().removesuffix(".")
    if ":" in host:
        try:
            return int(ipaddress.IPv6Address(host.removeprefix("[").removesuffix("]").split("%")[0]))
        except ValueError:
            return None
    parts = host.split(".")
    if len(parts) > 4 or not all(NUMBER.fullmatch(p) for p in parts):
        return None
    values = [int(p[2:] or "0", 16) if p[1:2] in ("x", "X") else int(p, 8 if p[0] == "0" else 10) for p in parts]
    last = 256 ** (5 - len(parts))
    if any(v > 255 for v in values[:-1]) or values[-1] >= last:
        return None
    return MAPPED + sum(v << 8 * (3 - i) for i, v in enumerate(values[:-1])) + values[-1]


@F.pandas_udf(T.StringType())
def address(hosts: pd.Series) -> pd.Series:
    """32 hex digits of the address that a host is written as; null for names."""
    found = [host_number(h) for h in hosts]
    return pd.Series([None if n is None else f"{n:032x}" for n in found], dtype=object)


def prefixes(spark: SparkSession, networks: tuple[tuple[str, str], ...] = NETWORKS) -> DataFrame:
    """Networks as rows: first and after (32 hex digits; after is null at the end of all addresses), bits, label."""
    rows = []
    for text, label in networks:
        n = ipaddress.ip_network(text)
        first, bits = int(n.network_address) + (MAPPED if n.version == 4 else 0), n.prefixlen + (96 if n.version == 4 else 0)
        after = first + (1 << 128 - bits)
        rows.append((f"{first:032x}", None if after >> 128 else f"{after:032x}", bits, label))
    return spark.createDataFrame(rows, "first string, after string, bits int, label string")


def _changes(table: DataFrame) -> DataFrame:
    """Where the longest prefix changes: key, label (null: none). At the end of a prefix the one around it goes on."""
    lengths = [r.bits for r in table.select("bits").distinct().collect()]  # 129 at most
    digits = lambda bits: F.concat(F.substring("first", 1, bits // 4), F.lit("" if not bits % 4 else "?"))
    cut = lambda bits: F.struct(F.lit(bits).alias("b"), digits(bits).alias("d"), (F.lit(0) if not bits % 4 else F.shiftright(F.conv(F.substring("first", bits // 4 + 1, 1), 16, 10).cast("int"), 4 - bits % 4)).alias("r"))
    own = table.withColumns({"b": F.col("bits"), "cuts": F.array(*[cut(b) for b in sorted(lengths)])})
    around = own.select("first", "bits", F.explode(F.filter("cuts", lambda c: c["b"] < F.col("bits"))).alias("c")).select("first", "bits", "c.*")
    named = own.select(F.explode(F.filter("cuts", lambda c: c["b"] == F.col("bits"))).alias("c"), F.col("label").alias("outer")).select("c.*", "outer")
    outer = around.join(named, ["b", "d", "r"]).groupBy("first", "bits").agg(F.max_by("outer", "b").alias("outer"))
    ends = table.join(outer, ["first", "bits"], "left").where("after is not null").select(F.col("after").alias("key"), F.lit(1).alias("end"), "bits", F.col("outer").alias("label"))
    starts = table.select(F.col("first").alias("key"), F.lit(0).alias("end"), (-F.col("bits")).alias("bits"), "label")
    # Of several at one place: the longest prefix that begins, else the shortest that ends.
    return starts.union(ends).groupBy("key").agg(F.min_by(F.struct("label"), F.struct("end", "bits")).alias("l")).select("key", "l.label")


def longest_match(rows: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """rows with label, that of the longest prefix of the table which holds the address in this column; null where none does, or the address is null.

    Prefixes are unique. A column of rows named label is replaced. However many rows have one address, they are spread over ranges like others.
    """
    cuts = Cuts(rows.sparkSession)
    points = rows.select(F.struct(*rows.columns).alias("own"), F.col(column).alias("key")).withColumns({"point": F.lit(1), "label": F.lit(None).cast("string"), "spread": F.pmod(F.xxhash64("own"), F.lit(1 << 20))})
    changes = _changes(table).select(F.lit(None).cast(points.schema["own"].dataType).alias("own"), "key", F.lit(0).alias("point"), F.coalesce("label", F.lit("")).alias("label"), F.lit(0).cast("long").alias("spread"))
    sorted_ = in_ranges(points.select("own", "key", "point", "label", "spread").unionByName(changes), ["key", "point", "spread"], cuts, "addresses")
    within = W.partitionBy("_part").orderBy("_at")
    sorted_ = sorted_.withColumn("_here", F.last("label", ignorenulls=True).over(within.rowsBetween(W.unboundedPreceding, 0)))
    last = sorted_.groupBy("_part").agg(F.max_by("label", F.when(F.col("label").isNotNull(), F.col("_at"))).alias("_last"))
    lead = last.select(F.col("_part").alias("_p"), F.last("_last", ignorenulls=True).over(W.orderBy("_part").rowsBetween(*BEFORE)).alias("_before"))
    found = sorted_.where("point = 1").join(F.broadcast(lead), F.col("_part") == F.col("_p"))
    label = F.when(F.col("key").isNotNull(), F.coalesce("_here", "_before"))
    return found.select(*[F.col(f"own.`{c}`").alias(c) for c in rows.columns if c != "label"], F.when(label != "", label).alias("label"))


def blocked(label: Column) -> Column:
    """Whether an address with this label is not to be fetched."""
    return F.coalesce(label != "public", F.lit(False))


def redirected(urls: DataFrame, redirects: DataFrame, unsafe: DataFrame, limit: int = 5) -> DataFrame:
    """Where URLs (id, url) lead: id, final, hops, outcome (ok, unsafe or limit).

    redirects: url, location, one row a URL; unsafe: the URLs that may not be fetched. A chain ends at an unsafe URL, at one that redirects nowhere, or with
    the outcome limit after more than `limit` hops. All chains take a hop in one join; those that have ended stay behind.
    """
    cuts = Cuts(urls.sparkSession)
    bad = unsafe.select(F.col("url").alias("_u")).distinct().withColumn("_bad", F.lit(True))
    steps = redirects.select(F.col("url").alias("_from"), "location")
    now, done = urls.select("id", "url"), []
    for hops in range(limit + 1):
        judged = now.join(bad, now.url == bad["_u"], "left").join(steps, now.url == steps["_from"], "left")
        judged = cuts.write(judged.select("id", "url", F.coalesce("_bad", F.lit(False)).alias("bad"), "location"), f"hop-{hops}")
        ended = F.when(F.col("bad"), "unsafe").when(F.col("location").isNull(), "ok")
        if hops == limit:
            ended = F.coalesce(ended, F.lit("limit"))
        done.append(judged.withColumn("outcome", ended).where("outcome is not null").select("id", F.col("url").alias("final"), F.lit(hops).alias("hops"), "outcome"))
        now = judged.where(~F.col("bad") & F.col("location").isNotNull()).select("id", F.col("location").alias("url"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
