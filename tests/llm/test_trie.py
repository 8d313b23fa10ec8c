import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from loomspan.llm import queries, trie
from loomspan.llm.common import Scratch

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"


def rebuilt(rows):
    """Conversations with shared openings, from sorted lists."""
    own = defaultdict(list)
    key = lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c, _, role, text in sorted((r for r in rows if r[0] is not None), key=key):
        own[c].append((role or "", text or ""))
    opener = lambda c: c - int(c - 20 * int(c / 20))
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(opener(c), [])[: h[c]] + t[h[c] :] for c, t in own.items()}


def expected(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        words = len(p[-1][1].encode().split()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * words
            leaves[p[:d]] += not children[p]
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(ends[p])) for p, m in members.items()), key=str)


def got(spark, rows):
    scratch = Scratch(spark, "trie")
    df = spark.createDataFrame([(*r, 7) for r in rows], f"{SCHEMA}, name long")
    found = trie.prefix_trie(*trie.share_openings(trie.turns(df, scratch), scratch), scratch)
    return sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=str)


def test_random_tries(spark):
    """Few different turns, so that prefixes meet at all depths; copies, ties, nulls, one long conversation."""
    draw = random.Random(5)
    rows = []
    for c in [*range(-25, 130), 2**40, 2**40 + 1]:
        for t in range(draw.choice([1, 2, 3, 4, 5, 8, 13])):
            rows.append((c, t if draw.random() < 0.9 else None, draw.choice(["user", "assistant", None]), draw.choice(["one", "two  words", "", None])))
    rows += [(140, t, "user", f"turn {t % 3}") for t in range(70)] + [(160, t, "user", f"turn {t % 3}") for t in range(70)] + [(200, 0, "user", "same"), (200, 0, "user", "same"), (200, 0, "user", "a much\tlonger\x1cone")]
    rows += [(None, 0, "user", "no id"), (221, 0, "user", "x")]
    assert got(spark, rows) == expected(rebuilt(rows))


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "x")], [(1, 0, "user", "one")], [(21, 0, "user", "opener is not there")], [(23, t, "r", "x") for t in range(2)]])
def test_small_tables(spark, rows):
    assert got(spark, rows) == expected(rebuilt(rows))


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    want = sorted(con.execute(f"select {', '.join(COLUMNS)} from ({trie.SQL})").fetchall(), key=str)
    found = queries.op11_prefix_trie(spark, sf_dir)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=str) == want
    assert queries.oracle_sql()["op11_prefix_trie"] == trie.SQL


def test_long_lists_of_ids(spark, monkeypatch):
    """A node at which very many conversations end: pieces in order give the hash of the whole list."""
    monkeypatch.setattr(trie, "PIECE", 7)
    rows = [(c, 0, "user", "same") for c in range(-300, 300) if zlib.crc32(str(c).encode()) % 4 == 0 or c % 20 == 0]
    assert got(spark, rows) == expected(rebuilt(rows))
