"""JSON records, contracts, references and manifests on their corner cases."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from loomspan.functions import contracts as C
from loomspan.functions import records as R
from loomspan.operators import extract as X
from loomspan.operators import routing
from loomspan.sources.evals import read_evals


def column(spark, f, values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_redaction_and_masking_at_any_depth(spark):
    deep = json.dumps({"a": [{"Auth-Token": "x", "b": {"password": {"c": 1}}}], "longs": ["y" * 600], "url": "not a url", "callback_URL": "http://h:99/p?q"})
    bottom = "[" * 5000 + "]" * 5000
    got = column(spark, R.redact_json, [deep, None, "", "{", "3", bottom, '"s"'])
    assert json.loads(got[0]) == {"a": [{"Auth-Token": "[REDACTED]", "b": {"password": "[REDACTED]"}}], "longs": ["y" * 512 + "..."], "url": "not a url", "callback_URL": "http://h:99/p"}
    assert got[1:] == [None, None, None, "3", bottom, '"s"']
    got = column(spark, R.mask_json, ['{"x_API_KEY": "k", "api_keys": ["a", null], "key": "k", "l": [{"token": 5}]}', "[]", None])
    assert [None if g is None else json.loads(g) for g in got] == [{"x_API_KEY": "****", "api_keys": ["****"], "key": "k", "l": [{"token": "****"}]}, [], None]


def test_media_probe_and_answers(spark):
    got = column(spark, R.media_probe, [None, "", "[]", "{}", '{"streams": []}', '{"streams": [{"codec_type": "audio", "duration": "N/A", "sample_rate": "x"}], "format": {}}'])
    assert got[:4] == [None] * 4 and got[4].stream_count == 0 and got[4].has_audio is False and got[4].duration_s == 0
    assert got[5].has_audio and got[5].duration_s is None and got[5].sample_rate is None
    assert column(spark, R.json_part, ["```json\n[1]\n```", "so: {\"a\": [1]} ok", "none", None, "[1] ]"]) == ["[1]", '{"a": [1]}', "none", None, "[1] ]"]
    assert [tuple(r) for r in column(spark, R.token_usage, ['{"usage": {"input_tokens": 3, "output_tokens": 4}}', "x", None])] == [(3, 4), (0, 0), (0, 0)]


def test_contracts(spark):
    assert column(spark, C.exit_code, ["usage_error", "TIMEOUT", None, "?"]) == [2, 9, 0, 1]
    maps = [{"vlm_crop_max_px": "63", "max_batch_retries": "5"}, {"archive_max_compression_ratio": "0.5", "smart_router_level": "off"}, {}, None]
    assert column(spark, C.option_problems, maps, "map<string,string>") == [["vlm_crop_max_px"], ["archive_max_compression_ratio", "smart_router_level"], [], []]
    assert column(spark, C.mixed_plan_blockers, [{"force_ocr": "true", "profile": "FAST"}, {"image_handling_mode": "both", "converter_cls": "OCRConverter"}, {}], "map<string,string>") == [["force_ocr", "fast_profile"], ["image_understanding", "whole_file_converter"], []]


def test_asset_references():
    assert X.asset_refs(None) == [] == X.asset_refs("[a] (b) [c](d [e]") and X.asset_refs("![](<a b> 'T')") == [("image", "a b", "", "T")]
    assert X.asset_refs("[x](a(b)c) [x](a(b)c 't') [y](\\)z)") == [("link", "a(b)c", "x", ""), ("link", "\\)z", "y", "")]
    assert X.asset_refs("<a href='u'>open") == [] and X.asset_refs("<A HREF='u'><i>l</i></A>") == [("html_link", "u", "l", "")]
    assert len(X.asset_refs("[" * 3000)) == 0


def test_eval_manifests_with_files(spark, tmp_path):
    (tmp_path / "g.md").write_text("golden ü")
    sample = {"sample_id": "one", "golden_path": "g.md", "candidate_text": ""}
    (tmp_path / "a.json").write_text(json.dumps({"schema_version": "eval_manifest.v1", "name": "m", "samples": [sample, {**sample, "sample_id": "two", "golden_path": "gone.md"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"schema_version": "v0", "samples": [sample]}))
    (tmp_path / "c.json").write_text("no json")
    got = {(r.manifest.rsplit("/", 1)[1], r.sample_id): (r.golden_text, r.candidate_text, r.problem) for r in read_evals(spark, str(tmp_path)).collect()}
    assert got[("a.json", "one")] == ("golden ü", "", None) and got[("a.json", "two")] == (None, "", "missing_file")
    assert got[("b.json", "one")][2] == "version" and got[("c.json", None)][2] == "version"


def test_records_of_any_depth(spark):
    """Deeper than the interpreter's stack; malformed ones stay null."""
    deep = lambda n, leaf: '{"a":[' * n + leaf + "]}" * n
    for n in (3, 250, 60_000):
        assert R._walked(deep(n, '{"api_key":"x","page_url":"https://u:p@h/p?q=1"}'), R._redacted) == deep(n, '{"api_key":"[REDACTED]","page_url":"https://h/p"}')
        assert R._walked(deep(n, '{"z": 1, "secret": ["", "s"], "b": []}'), R._masked) == deep(n, '{"b":[],"secret":["****"],"z":1}')
    big = 60_000
    for broken in (deep(big, "1")[:-1], deep(big, "1") + "]", deep(big, "1,"), deep(big, "1 2"), deep(big, '{"a"}'), deep(big, '{"a":}'), deep(big, '{,"a":1}'), deep(big, "[,1]"), deep(big, "x"), deep(big, '"a'), deep(big, '{"a":1 "b":2}'), "[" * big, "[" * big + "}" * big):
        assert R._walked(broken, R._redacted) is None
    draw = random.Random(1)

    def tree(depth):
        kind = draw.randrange(6 if depth else 3)
        return [lambda: draw.choice([None, True, 1.5, -3, 10**30]), lambda: draw.choice(["", 'q"\\', "é\n", "[{,:}]"]), lambda: draw.choice([[], {}])][kind]() if kind < 3 else [tree(depth - 1) for _ in range(draw.randrange(4))] if kind == 3 else {draw.choice("abc\"é"): tree(depth - 1) for _ in range(draw.randrange(4))}

    for _ in range(40):
        text = json.dumps(tree(5), indent=draw.choice([None, 1]))
        whole = json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert R.written(R.parsed("[" * big + text + "]" * big)) == "[" * big + whole + "]" * big


@pytest.mark.parametrize("text", ["[" * 1_000_000, "[x](" * 250_000, "[x](a(" * 150_000, "[x]('" * 200_000, "<a href='u'>" * 80_000, "<http://" * 120_000, "<a " * 300_000, "\\[" * 400_000, "[x](<" * 200_000 + ">"])
def test_references_take_time_in_proportion(text):
    began = time.time()
    X.asset_refs(text)
    assert time.time() - began < 10


def test_references_far_and_near_agree():
    """Places worked out from the right are those found by reading ahead."""
    draw = random.Random(2)
    for _ in range(3000):
        text = "".join(draw.choice("()()'\"<>\\ab") for _ in range(draw.randrange(30)))
        near, far = X._Parentheses(text), X._Parentheses(text)
        far.known = far._all()
        for at in range(len(text) + 1):
            near.left = 10**9
            assert near.close(at) == far.close(at), (text, at)


def test_document_probe(spark):
    rows = [("a", 1000, 0.9, 0, False, 0.1, 0.1, "Microsoft Word", None), ("a", 1000, 0.9, 0, False, 0.1, 0.1, "Microsoft Word", None), ("b", 10, 0.2, 3, True, 0.5, 0.5, None, "CamScanner"), ("c", 10, 0.2, 3, True, 0.5, 0.5, "LaTeX", None), ("d", 1000, 0.9, 0, False, 0.1, 0.1, "ABBYY", "LaTeX")]
    df = spark.createDataFrame(rows, "doc string, chars int, quality double, images int, full_page boolean, layout double, sandwich double, creator string, producer string")
    got = {r.doc: (r.scan_likelihood, r.recommended_engine, r.reasons) for r in routing.document_probe(df, "doc").collect()}
    assert got == {"a": (0.0, "fast_pdf", "metadata_digital"), "b": (1.0, "deep_pdf", "text_layer,text_quality,scan,sandwich,visual,layout,metadata_scanner"), "c": (0.997, "deep_pdf", "text_layer,text_quality,scan,sandwich,visual,layout"), "d": (0.4, "deep_pdf", "scan,metadata_scanner")}
