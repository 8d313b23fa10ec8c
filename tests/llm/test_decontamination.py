import hashlib
import re

from loomspan.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items):
    wins = []
    for name, text in items:
        w = WORD.findall(lower(text))
        for i in range(max(1, len(w) - 9) if w else 0):
            wins.append((None if name is None else str(name), w[i : i + 10]))
    out = []
    for doc_id, text in docs:
        w, hit, found = WORD.findall(lower(text)), set(), set()
        for name, x in wins:
            for s in range(len(w) - len(x) + 1):
                if w[s : s + len(x)] == x:
                    hit |= set(range(s, s + len(x)))
                    found.add(name)
        ids = sorted(found, key=lambda v: (v is None, v))
        said = ",".join("" if v is None else v for v in ids)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(said.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    out = D.report(D.contamination(d, b, **options)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    return sorted((tuple(r) for r in out), key=str)


ITEM = "One two three four five six seven eight nine ten eleven twelve"
DOCS = [(1, f"x {ITEM.upper()} y"), (2, "one two three four five six seven eight nine"), (3, None), (4, ""), (None, "short item, indeed"), (5, "Short-item! indeed short item indeed"), (5, "Short-item! indeed short item indeed"), (6, "été " * 30), (7, "a " * 50_000 + ITEM)]
ITEMS = [(10, ITEM), (9, ITEM + " more"), (9, ITEM + " more"), (2, "short item indeed"), (3, None), (4, "?!"), (None, "été été été"), (11, "never seen anywhere")]


def test_edges_in_one_block_and_in_several(spark):
    want = brute(DOCS, ITEMS)
    assert run(spark, DOCS, ITEMS) == want
    assert run(spark, DOCS, ITEMS, block_words=13) == want


def test_empty_tables(spark):
    assert run(spark, DOCS, []) == brute(DOCS, [])
    assert run(spark, [], ITEMS) == []


def test_clean_keeps_other_columns(spark):
    d = spark.createDataFrame([(1, ITEM, "a"), (2, "nothing here", "b")], "doc_id long, text string, n_words string")
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert [tuple(r) for r in D.clean(d, b).collect()] == [(2, "nothing here", "b")]
