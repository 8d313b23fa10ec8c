import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm import disclosure as d
from loomspan.llm import queries
from loomspan.llm.common import table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The patterns as they are given, and their tests."""
    found = {}
    for kind, pattern in PATTERNS.items():
        found[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                found[kind].append(m.span())
    return found


PIECES = ["a", "b.c", "@", "@x.y", ".", "..", "-", "+", "+1", "1", "12", "255", "256", "0001", "1.2.3.4", " ", "(", ")", "4111 1111 1111 1111", "4111111111111111", "0", "é", "\n", "_%"]


@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
@settings(max_examples=3000, deadline=None)
def test_base_spans(text):
    assert d.base_spans(text) == plain(text)


@pytest.mark.parametrize("text", ["a" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 200_000, "a.b@c-" * 80_000, "+1" * 200_000, "+" + "(1" * 200_000, "1 -" * 150_000])
def test_base_spans_take_time_in_proportion(text):
    d.base_spans(text)


def model(rows):
    """Disclosing terms by dictionaries."""
    occurrences, near, contexts = Counter(), Counter(), defaultdict(set)
    for _, text in rows:
        text = d.lower(text or "")
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        terms = [d.term_of(text[s:e]) for s, e in words]
        occurrences.update(terms)
        base = [(kind, s, e) for kind, own in plain(text).items() for s, e in own]
        hit = {i for i, (s, e) in enumerate(words) for _, x, y in base if s < y and x < e}
        seen = set()
        for kind, s, e in base:
            own = [i for i, (x, y) in enumerate(words) if x < e and s < y]
            around = [i for i in [*range(max(0, own[0] - d.WINDOW), own[0]), *range(own[-1] + 1, min(len(words), own[-1] + 1 + d.WINDOW))] if i not in hit]
            for i in around:
                name = d.entity(kind, text[s:e])
                if terms[i] and (name, i) not in seen:
                    seen.add((name, i))
                    near[name, terms[i]] += 1
                    contexts[name, terms[i]].add(" ".join(terms[j] for j in around))
    size = Counter()
    for (e, _), n in near.items():
        size[e] += n
    total, found = sum(occurrences.values()), {}
    for (e, t), n in near.items():
        information = -math.log2(size[e] / total)
        if len(contexts[e, t]) >= d.SUPPORT and information > 0:
            share = 1 + math.log2(n / occurrences[t]) / information
            if share >= d.GENERALISE:
                best = found.get(t)
                if best is None or (-share, -n, e) < best[:3]:
                    found[t] = (-share, -n, e, "remove" if share >= d.REMOVE else "generalise")
    return {t: (e, -n, action) for t, (_, n, e, action) in found.items()}


def digest(rows, terms):
    out = []
    for i, text in rows:
        text = text or ""
        base = [(k, s, e) for k, own in plain(text).items() for s, e in own]
        words = []
        for m in re.finditer(r"[^\x20\x09-\x0D]+", d.lower(text)):
            t = d.term_of(m[0])
            if t in terms and not any(m.start() < e and s < m.end() for _, s, e in base):
                start = m.start() + m[0].index(t)
                words.append(("term", start, start + len(t)))
        show = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        out.append((i, *[sum(k == kind for k, *_ in base) for kind in d.KINDS], hashlib.sha256(show(base).encode()).hexdigest(), show(base + words)))
    return sorted(out, key=str)


COLUMNS = "id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"
FILL = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def corpus():
    """Someone's nickname always stands near their address, another often; common words stand everywhere."""
    rng = np.random.default_rng(3)
    say = lambda n: " ".join(rng.choice(FILL, n))
    rows = [(i, say(60)) for i in range(80)]
    rows += [(100 + i, f"{say(20)} Zorblat, {say(2)} ann@x.org {say(3)} quibble {say(20)}") for i in range(6)]
    rows += [(200 + i, f"{say(9)} quibble {say(9)}") for i in range(4)]
    rows += [(300, f"{say(5)} (zorblat). {say(5)}"), (301, "one hapax bob@y.org here"), (302, None), (303, ""), (304, "zorblat@z.org ZORBLAT"), (305, "+1 (523) 555-1055 " + "mu " * 30_000 + "4111 1111 1111 1111 zorblat")]
    return rows + rows[80:83] + [(100, "another text 1.2.3.4 zorblat"), (None, "zorblat"), (None, None)]


def test_terms_and_spans(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, term string, entity string").select("*", "doc_id")
    df = df.toDF("doc_id", "text", "term", "entity", "key")
    terms = d.disclosing_terms(df)
    got = {r.term: (r.entity, r.near, r.action) for r in terms.collect()}
    assert got == model(rows)
    assert got["zorblat"][0] == "email:ann@x.org" and "quibble" in got and not set(got) & set(FILL)
    found = d.spans(df, terms)
    assert sorted(map(tuple, d.report(found).select(*COLUMNS).collect()), key=str) == digest(rows, got)
    texts = {r.id: r.text for r in d.sanitised(found).where("id in (200, 300, 304)").collect()}
    assert "zorblat" not in texts[300].lower() and "zorblat" not in texts[304].lower() and "[EMAIL]" in texts[304]
    assert "quibble" not in texts[200]


def test_a_full_bitmap_changes_nothing(spark):
    """With a map of eight bits nearly every word may be a term; the join tells."""
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    terms = d.disclosing_terms(df)
    found = [sorted(map(tuple, d.report(d.spans(df, terms, bits=b)).collect()), key=str) for b in (8, d.BITS)]
    assert found[0] == found[1]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert d.report(d.spans(df, d.disclosing_terms(df))).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    found = queries.op12_disclosure(spark, sf_dir).withColumnRenamed("doc_id", "id")
    assert sorted(map(tuple, found.select(*COLUMNS).collect()), key=str) == digest(rows, model(rows))
