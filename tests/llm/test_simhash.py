import random

import numpy as np
import xxhash
from pyspark.sql import types as T

from loomspan.llm import simhash
from loomspan.llm.common import Scratch

SCHEMA = "doc_id long, text string"


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, bits=4):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = sorted(set(prints))
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                parent[find(a)] = find(b)
    least = {}
    for i, p in zip(ids, prints):
        if i is not None:
            least[find(p)] = min(least.get(find(p), i), i)
    return [least.get(find(p)) for p in prints]


def check(spark, rows, schema=SCHEMA):
    out = simhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    prints = [plain_fingerprint(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], prints, plain_components([r[0] for r in rows], prints)), key=str)
    got = sorted(((r.id, r.fingerprint % 2**64, r.component_id) for r in out), key=str)
    assert got == want


def test_table_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(70_000))
    check(spark, [(None, None), (3, ""), (2, " \t\n\x0b\x0c\r"), (5, "One"), (4, "one"), (4, "one"), (None, "lonely text here"), (7, "AÉ b"), (8, "aé b"), (9, long), (10, long + " end")])


def test_empty_table(spark):
    out = simhash.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns == ["id", "text_hash", "fingerprint", "component_id"]


def test_every_link_within_four_bits_is_found(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = set(base)
    for p in base:
        for flips in range(7):
            q = p
            for b in rng.sample(range(64), flips):
                q ^= 1 << b
            prints.add(q)
    prints |= {0, 2**64 - 1, 1 << 63, (1 << 63) | 15}
    scratch = Scratch(spark, "test")
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], T.StructType([T.StructField("fingerprint", T.LongType())]))
    for homes in (50_000, 1):
        edges = simhash.links(df, scratch, homes=homes).collect()
        parent = {p: p for p in prints}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for e in edges:
            a, b = e.a % 2**64, e.b % 2**64
            parent[find(a)] = find(b)
        ordered = sorted(prints)
        want = plain_components(ordered, ordered)
        groups = {}
        for p in ordered:
            groups.setdefault(find(p), []).append(p)
        got = {p: g[0] for g in groups.values() for p in g}
        assert [got[p] for p in ordered] == want


def test_keep_one(spark):
    rows = [(3, "the same words here", "x"), (1, "The same words here", "y"), (1, "The same words here", "z"), (9, "other words are in this", "k"), (None, None, "n"), (None, "", "m")]
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string"))
    kept = sorted((str(r.doc_id), r.text or "") for r in out.collect())
    assert [k[0] for k in kept] == ["1", "9", "None"] and out.columns == ["doc_id", "text", "fingerprint"]
