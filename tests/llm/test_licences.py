import random
import textwrap

import numpy as np
import pytest

from loomspan.llm import licences as L

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def model():
    return L.train()


def test_held_out_accuracy_and_calibration(model):
    """On sentences, invented licence names and fillers that training does not see."""
    kept = L.examples(random.Random(99), True)
    p = [model.probabilities(" ".join(w)) for w, _ in kept]
    best = [max(x, key=x.get) for x in p]
    right = np.array([b == c for b, (_, c) in zip(best, kept, strict=True)])
    error = L.calibration_error(np.array([x[b] for x, b in zip(p, best, strict=True)]), right)
    print(f"held-out accuracy {right.mean():.3f}, calibration error {error:.3f}, temperature {model.temperature:.3f}")
    assert right.mean() >= 0.95 and error < 0.05 and model.error < 0.05 and 0.02 < model.temperature < 50
    unknown = [b for b, (_, c) in zip(best, kept, strict=True) if c == L.UNKNOWN]
    assert sum(b == L.UNKNOWN for b in unknown) >= 0.85 * len(unknown)


def rows():
    out = [(i, f"Some line of text.\n{t}.\nmore") for i, t in enumerate(t for ts in L.TEMPLATES.values() for t in ts)]
    return out + [(900, None), (901, ""), (902, "\n\n"), (903, "mit der Zeit und mit dem Wind"), (904, "the public version of the work"), (905, "Licensed under the Frobozz Magic License"), (905, "Released under the MIT License."), (None, "Released under the MIT License."), (906, "license " * 2000)]


def test_templates_are_found_and_clean_texts_are_not(spark, model):
    out = {}
    for r in L.scan(spark.createDataFrame(rows(), SCHEMA), model=model).collect():
        out.setdefault(r.id, []).append(r)
    at = 0
    for family, notices in L.TEMPLATES.items():
        for notice in notices:
            shared = [f for f, ts in L.TEMPLATES.items() if f != family and any(set(L.words_of(notice)) <= set(L.words_of(t)) for t in ts)]
            assert [(r.line, r.confirmed) for r in out[at]] == [(1, True)] and out[at][0].family in (family, *shared), (family, out.get(at))
            at += 1
    assert not {900, 901, 902, 903, 904} & set(out)
    assert {r.family for r in out[905]} == {"mit", "unknown"} and out[None][0].family == "mit"


def test_spark_agrees_with_the_model(spark, model):
    lines = L.paragraphs(spark.createDataFrame(rows(), SCHEMA))
    for r in L.classified(lines, model).collect():
        p = model.probabilities(r.paragraph)
        best = max(p, key=p.get)
        assert r.probability == pytest.approx(p[best]) and r.family in (best, L.UNKNOWN)


def wrapped(*paragraphs, width=72, prefix=""):
    return "\n\n".join("\n".join(prefix + x for x in textwrap.wrap(p, width)) for p in paragraphs)


def test_wrapped_licence_texts(spark, model):
    """Texts as they stand in files: hard-wrapped, with comment signs, among other lines, and in the middle of very long texts."""
    t = L.TEMPLATES
    want = [
        ("mit", wrapped("The MIT License (MIT)", "Copyright (c) 2020 Somebody", *t["mit"][4:])),
        ("mit", wrapped(*t["mit"][4:], width=60)),
        ("bsd", wrapped("Copyright 2011 Somebody", *t["bsd"][4:5], *t["bsd"][6:])),
        ("apache-2.0", wrapped(*t["apache-2.0"][3:], prefix="# ")),
        ("gpl-3.0", wrapped(*t["gpl-3.0"][2:4], width=65, prefix=" * ")),
        ("gpl-2.0", wrapped(*t["gpl-2.0"][2:3], prefix="// ")),
        ("lgpl", wrapped(*t["lgpl"][3:5])),
        ("agpl-3.0", wrapped(*t["agpl-3.0"][2:4])),
        ("mpl-2.0", wrapped(t["mpl-2.0"][0], width=50)),
        ("isc", wrapped(*t["isc"][3:])),
        ("unlicense", wrapped(t["unlicense"][0], t["unlicense"][3])),
    ]
    rng = random.Random(5)
    filler = lambda n: "\n".join(" ".join(rng.choices(L.FILLERS, k=9)) for _ in range(n))
    docs = [(2 * i + j, f"{filler(k)}\n\n{text}\n\n{filler(k)}") for i, (_, text) in enumerate(want) for j, k in enumerate((2, 3000))]
    found = {r.id: r for r in L.per_document(spark.createDataFrame(docs, SCHEMA), model=model).collect()}
    for i, (family, _) in enumerate(want):
        for j in (0, 1):
            assert 2 * i + j in found and found[2 * i + j].families == family and found[2 * i + j].confirmed, (family, found.get(2 * i + j))


def test_unknown_licences_and_plain_sentences(spark, model):
    held = lambda v: [t for i, t in enumerate(v) if i % 5 == 4]
    unknown = ["Released under the Blorptan License", "Artistic License 2.0 applies", *held(L.OTHERS)]
    docs = [(i, f"{t}.") for i, t in enumerate(unknown)] + [(100 + i, f"{t}.") for i, t in enumerate(held(L.PLAIN))]
    found = {r.id: r.families for r in L.per_document(spark.createDataFrame(docs, SCHEMA), model=model).collect()}
    assert set(found.values()) <= {"unknown"} and sum(i in found for i in range(len(unknown))) >= 0.8 * len(unknown)
    assert sum(i >= 100 for i in found) <= 1


def test_two_families_near_each_other(spark, model):
    text = "Released under the MIT License.\nLicensed under CC BY-NC 4.0\nwords of the river"
    out = L.scan(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"), model=model).collect()
    assert sorted((r.id, r.line, r.family) for r in out) == [(1, 0, "mit"), (1, 1, "cc-by-nc"), (2, 0, "mit"), (2, 1, "cc-by-nc")]


def test_table_and_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.id: r.families for r in L.per_document(docs).collect()}
    want = {"MIT License": "mit", "Apache License": "apache-2.0", "GNU General Public License, version 3": "gpl-3.0", "CC BY-NC": "cc-by-nc"}
    stated = 0
    for r in docs.collect():
        for said, family in want.items():
            if said in r.text:
                stated += 1
                assert family in found[r.doc_id].split(","), (r.doc_id, said)
    assert stated > 10
    assert L.per_document(spark.createDataFrame([], SCHEMA)).count() == 0
