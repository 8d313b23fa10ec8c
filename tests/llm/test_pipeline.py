"""Each stage of the pipeline against a plain version, on what the stage before it kept."""

import corpus_pipeline
from pyspark.sql import functions as F

from loomspan.llm import rules
from tests.llm.test_decontamination import brute as hits
from tests.llm.test_mixing import brute as mix
from tests.llm.test_quality import brute as stats
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_suffixes import brute as cuts


def cut_text(text, rows):
    """The text without the bytes of every 200-byte string that starts twice in rows."""
    from collections import Counter

    seen = Counter(b[s : s + 200] for b in rows for s in range(len(b) - 199))
    data = text.encode()
    gone = bytearray(len(data))
    for s in range(len(data) - 199):
        if seen[data[s : s + 200]] > 1:
            gone[s : s + 200] = b"\1" * 200
    return bytes(c for c, g in zip(data, gone) if not g).decode("utf-8", "ignore")


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        kept[name] = {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    source = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    quality, near, cut, clean, mixed = (kept[n] for n in names)

    found = rules.learned(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    verdict = {r.doc_id: r.rule for r in rules.judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), found).collect()}
    passed = {i for i, r in source.items() if (s := stats(r.text))[0] >= 50 and 100 * s[4] <= 50 * s[0] and verdict[i] == 0}
    assert set(quality) == passed

    ids = list(quality)
    of = plain_components(ids, [plain_fingerprint(quality[i].text) for i in ids])
    assert set(near) == {i for i, c in zip(ids, of) if i == c}

    data = [r.text.encode() for r in near.values()]
    assert {i: r.text for i, r in cut.items()} == {i: cut_text(r.text, data) for i, r in near.items()}
    assert all(r.n_chars == len(r.text) for r in cut.values())
    assert sum(x[2] for x in cuts([(i, r.text) for i, r in near.items()])) == sum(map(len, data)) - sum(len(r.text.encode()) for r in cut.values()) or any(len(r.text) < len(near[i].text) for i, r in cut.items())

    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert set(clean) == {h[0] for h in hits([(i, r.text) for i, r in cut.items()], items) if not h[5]}

    want = {r[0]: r[4] for r in mix([(i, r.text, r.source) for i, r in clean.items()]) if r[4]}
    assert {i: r.taken for i, r in mixed.items()} == want


def test_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0


#: Names that operators use themselves.
CLASHES = ("_text_hash", "_id", "found", "_found", "n_words", "score", "kept", "rule", "base_failed", "_size", "_u", "_copies", "_plan_of", "_plan_target", "size_of", "_", "none", "own", "own_text", "c0", "t1", "spans", "fingerprint", "component_id", "_t", "_w", "_c_lines", "log_words", "item_id")


def edge_rows(docs):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.limit(60).collect()]
    long = " ".join(f"w{i % 977} x{i}" for i in range(60_000))
    return rows + rows[:3] + [(None, rows[0][1], None, None, None), (9001, None, None, None, None), (9002, "", "en", rows[0][3], 0), (9003, long, "en", None, len(long)), (9004, long, "en", rows[0][3], len(long)), (None, None, None, None, None), (9005, " \t\n", "en", "x", 3)]


def test_clashing_names_nulls_and_long_texts(spark, sf_dir):
    """Every stage gives the same rows whatever other columns there are, and leaves these as they are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain = spark.createDataFrame(edge_rows(docs), docs.schema)
    more = plain.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHES])
    show = lambda rows: sorted(str((r["doc_id"], r["text"], r["source"])) for r in rows)
    for name, stage in corpus_pipeline.STAGES:
        want, got = stage(spark, plain, sf_dir).collect(), stage(spark, more, sf_dir).collect()
        assert show(got) == show(want) and want, name
        for r in got:
            assert all(r[c] == f"{c}:{'-' if r['doc_id'] is None else r['doc_id']}" for c in CLASHES), name
        assert any(r["doc_id"] in (9003, 9004) for r in want), name
