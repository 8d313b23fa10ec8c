"""Address tables against the standard library, hosts in every spelling, chains of redirects."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from loomspan.operators import addresses as A


@pytest.mark.parametrize("host, want", [("127.0.0.1", "127.0.0.1"), ("2130706433", "127.0.0.1"), ("0x7f.1", "127.0.0.1"), ("0177.0.0.01", "127.0.0.1"), ("0x7F000001", "127.0.0.1"), ("10.1.65535", "10.1.255.255"), ("[::ffff:10.0.0.1]", "10.0.0.1"), ("::1", "::1"), ("[fe80::1%eth0]", "fe80::1"), ("1.2.3.4.", "1.2.3.4"), ("0", "0.0.0.0")])
def test_spellings(host, want):
    ip = ipaddress.ip_address(want)
    assert A.host_number(host) == int(ip) + (A.MAPPED if ip.version == 4 else 0)


@pytest.mark.parametrize("host", [None, "", "example.com", "256.1.1.1", "1.2.3.4.5", "1..2", "08.1", "1.2.65536", "4294967296", "::g", "1.2.3.x", "-1"])
def test_names_and_malformed(host):
    assert A.host_number(host) is None


def test_blocked_as_the_library_says(spark):
    draw = random.Random(1)
    hosts = [str(ipaddress.IPv4Address(draw.getrandbits(32))) for _ in range(300)]
    for text, _ in A.NETWORKS:
        n = ipaddress.ip_network(text)
        for at in (0, -1):
            ip = n[at]
            hosts += [str(ip + d) for d in (-1, 0, 1) if 0 <= int(ip) + d < 1 << (32 if n.version == 4 else 128)]
    hosts += [str(ipaddress.IPv6Address(draw.getrandbits(128))) for _ in range(300)] + ["::ffff:192.168.1.1", "::ffff:8.8.8.8", "name.example", None]
    hosts += ["127.0.0.1"] * 200
    df = spark.createDataFrame(list(enumerate(hosts)), "label0 int, host string").withColumn("address", A.address("host"))
    got = A.longest_match(df, "address", A.prefixes(spark)).collect()
    assert len(got) == len(hosts)
    for r in got:
        if A.host_number(r.host) is None:
            assert r.label is None
            continue
        ip = ipaddress.ip_address(r.host)
        ip = getattr(ip, "ipv4_mapped", None) or ip
        want = not ip.is_global or ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified
        assert ((r.label or "public") != "public") == want, r


def test_longest_prefix_of_random_tables(spark):
    draw = random.Random(2)
    base = [draw.getrandbits(32) for _ in range(4)]
    nets = {str(ipaddress.ip_network((draw.choice(base) ^ draw.getrandbits(draw.choice([4, 12, 20, 31])), draw.randrange(0, 33)), strict=False)) for _ in range(120)}
    table = tuple((n, f"l{i}") for i, n in enumerate(sorted(nets)))
    rows = [(i, str(ipaddress.IPv4Address((draw.choice(base) ^ draw.getrandbits(draw.choice([2, 8, 16, 30]))) & 0xFFFFFFFF))) for i in range(1500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = A.longest_match(spark.createDataFrame(rows, "id int, host string").withColumn("a", A.address("host")), "a", A.prefixes(spark, table)).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parsed = [(ipaddress.ip_network(n), label) for n, label in table]
    for r in got:
        held = [(n.prefixlen, label) for n, label in parsed if ipaddress.ip_address(r.host) in n]
        assert r.label == (max(held)[1] if held else None)
    assert len(got) == 1500


def test_redirects(spark):
    steps = {f"u{i}": f"u{i + 1}" for i in range(9)} | {"a": "b", "b": "bad", "loop": "loop", "c": "d"}
    rows = [(i, u) for i, u in enumerate(["u9", "u8", "u4", "u3", "a", "bad", "loop", "c", "x", None])]
    frames = spark.createDataFrame(rows, "id int, url string"), spark.createDataFrame(list(steps.items()), "url string, location string"), spark.createDataFrame([("bad",)], "url string")
    got = {r.id: (r.final, r.hops, r.outcome) for r in A.redirected(*frames).collect()}
    assert got == {0: ("u9", 0, "ok"), 1: ("u9", 1, "ok"), 2: ("u9", 5, "ok"), 3: ("u8", 5, "limit"), 4: ("bad", 2, "unsafe"), 5: ("bad", 0, "unsafe"), 6: ("loop", 5, "limit"), 7: ("d", 1, "ok"), 8: ("x", 0, "ok"), 9: (None, 0, "ok")}
