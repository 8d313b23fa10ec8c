"""Queries without SQL, on all rows and whole texts, against plain versions."""

import duckdb

from loomspan.plans import quality as Q


def test_table_assignment_takes_every_order_and_line(spark, sf_dir):
    orders = {}
    for key, line, v in duckdb.sql(f"select l_orderkey, l_linenumber, max(l_partkey) % 4 from '{sf_dir}/lineitem.parquet' group by 1, 2").fetchall():
        orders.setdefault(key, {})[line] = v
    want = set()
    for key, v in orders.items():
        free = set(v)
        for ref in sorted(v):
            score, hyp = max(((v[ref] + v[h]) % 4 / 4, h) for h in free)
            free.remove(hyp)
            want.add((key, ref, hyp, score))
    got = [tuple(r) for r in Q.table_assignment(spark, sf_dir).select("l_orderkey", "ref", "hyp", "score").collect()]
    assert len(got) == len(want) and set(got) == want


def test_word_error_rate_reads_whole_texts(spark, sf_dir):
    rows = duckdb.sql(f"select item_id, b.text, d.text from '{sf_dir}/benchmark.parquet' b join '{sf_dir}/documents.parquet' d on item_id = doc_id").fetchall()
    want = {}
    for i, r, h in rows:
        a, b = (r or "").split(), (h or "").split()
        row = list(range(len(a) + 1))
        for y in b:
            new = [row[0] + 1]
            for k, x in enumerate(a):
                new.append(min(new[k] + 1, row[k + 1] + 1, row[k] + (x != y)))
            row = new
        want[i] = round(min(1.0, row[-1] / len(a)) if a else float(bool(b)), 6)
    got = Q.wer_report(spark, sf_dir).collect()
    assert len(got) == len(rows) and {r.item_id: r.wer for r in got} == want
