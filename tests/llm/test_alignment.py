import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import sentencepiece
from loomspan.llm import alignment, queries
from loomspan.llm.common import table

COLUMNS = "id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"


class Plain:
    """Whole texts, one at a time, and every pair of token occurrences."""

    def __init__(self):
        self.a = Tokenizer.from_file(alignment.BYTE_BPE)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)
        self.alphabet = alignment.byte_alphabet()

    def tokens(self, text):
        a = self.a.encode(f" {text}", add_special_tokens=False)
        a = [(i, bytes(self.alphabet[c] for c in t)) for i, t in zip(a.ids, a.tokens, strict=True)]
        b = [(i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, self.b.id_to_piece(i)) for i in self.b.encode(text))]
        raw = f" {text}".encode()
        if not text or b"".join(t for _, t in a) != raw or b"".join(t for _, t in b) != raw:
            return None
        return [self.spans(x) for x in (a, b)]

    def spans(self, tokens):
        at, out = 0, []
        for i, t in tokens:
            out.append((i, at, at + len(t)))
            at += len(t)
        return out

    def aligned(self, text):
        both = self.tokens(text)
        if both is None:
            return None
        a, b = both
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, links, start, k = [], [], 0, 0
        for cut in cuts:
            groups.append(([i for i, _, e in a if start < e <= cut], [i for i, _, e in b if start < e <= cut]))
            start = cut
        for i, s, e in a:
            while k and b[k - 1][2] > s:
                k -= 1
            while k < len(b) and b[k][1] < e:
                if b[k][2] > s:
                    links.append((i, b[k][0]))
                k += 1
        return a, b, groups, links


def expected(rows):
    plain = Plain()
    found = [(i, plain.aligned(t or "")) for i, t in rows]
    counts = Counter(x for _, f in found if f for x in f[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


HARD = ["", None, " ", "  two  spaces ", "a", "x\n y\n\n  z \t q", "   x  y", " \x1cq \x1c\x1c r", "<|endoftext|> <s> </s> <unk>", "a▁b", "日本語 テキスト 🙂🙂 family 👨‍👩‍👧", "é ́ ﬁne ½", "don't  we'll I'M", "\x00 nul", "\r\nline\r\n", "aaaa" * 2000, " " * 500 + "x", "long " * 9000, "ab " * 300 + "\n" * 90, "x", "x"]


def test_hard_texts(spark, monkeypatch):
    rows = list(enumerate(HARD)) + [(3, HARD[3]), (3, HARD[3]), (3, "other text"), (None, "no id"), (None, None), (None, "")]
    df = spark.createDataFrame([(i, t, "q", 1) for i, t in rows], "doc_id long, text string, pairs string, at int")
    assert got(alignment.report(df)) == expected(rows)
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 0)
    assert got(alignment.report(df)) == expected(rows)


def test_query_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    out = queries.op13_alignment(spark, sf_dir)
    assert got(out.withColumnRenamed("doc_id", "id")) == expected(rows)


def test_groups_and_links(spark):
    rows = [(1, "Some words, étranges and 日本 ones\nof a  text."), (2, None), (3, "long " * 9000)]
    blocks = alignment.events(spark.createDataFrame(rows, "doc_id long, text string"))
    plain = Plain()
    groups, links = alignment.sweep(blocks, "groups"), alignment.sweep(blocks, "links")
    for i, t in rows:
        f = plain.aligned(t or "") or ((), (), [], [])
        mine = groups.where(f"id = {i}").orderBy("group_no").collect()
        assert [(list(r.a_ids), list(r.b_ids)) for r in mine] == f[2]
        assert [r.start for r in mine[1:]] == [r.stop for r in mine[:-1]]
        rows_ = links.where(f"id = {i}").orderBy("start").collect()
        assert [(r.a_id, r.b_id) for r in rows_] == f[3]
        assert all(f[0][r.a_no][1] <= r.start < r.stop <= f[0][r.a_no][2] and f[1][r.b_no][1] <= r.start < r.stop <= f[1][r.b_no][2] for r in rows_)


def test_empty_table(spark):
    assert alignment.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


TOKENS = st.lists(st.integers(1, 4), min_size=1, max_size=40)


@given(TOKENS, TOKENS, st.integers(1, 7))
@settings(max_examples=200, deadline=None)
def test_machine_holds_little(a, b, block):
    """Blocks of any size give the same links and groups; what stays open begins after the last common end."""
    both = [list(a), list(b)]
    short = sum(a) - sum(b)
    both[short > 0] += [1] * abs(short)
    lengths = np.arange(5), np.arange(5)
    rows = []
    for side, ids in enumerate(both):
        at = 0
        for k in range(0, len(ids), block):
            rows.append((at, side, np.array(ids[k : k + block])))
            at += sum(ids[k : k + block])
    machine, swept = alignment._Machine(lengths), []
    for at, side, ids in sorted(rows, key=lambda r: r[:2]):
        swept += machine.take(side, at, ids)
    swept += machine.close()
    ends = [np.cumsum(x) for x in both]
    assert np.array_equal(np.concatenate([s.ends for s in swept]), np.union1d(*ends))
    assert np.array_equal(np.concatenate([s.stops for s in swept]), np.intersect1d(*ends))
    assert np.concatenate([s.a_ids for s in swept]).tolist() == both[0] and np.concatenate([s.b_ids for s in swept]).tolist() == both[1]


@pytest.mark.parametrize("side", [0, 1])
def test_chunks_are_encoded_as_the_whole(side):
    a, b = (open(f, "rb").read() for f in (alignment.BYTE_BPE, alignment.PIECES))
    encoder = alignment._Encoder(alignment.byte_level(a), alignment.pieces(b))
    assert encoder.cuts
    texts = [t for t in HARD if t]
    whole = encoder.sides[side].encode([f" {t}" for t in texts])
    for _ in range(2):
        ids = [np.frombuffer(x[side], encoder.sides[side].code).tolist() for x in encoder.batch(texts)]
        assert ids == whole
