r"""Personal data and the terms that disclose it: information-theoretic sanitisation.

Protected entities are the e-mail, IP, card and phone numbers that patterns find. Their information content is estimated from the corpus: with
N words in all, of which n(e) stand within WINDOW words of entity e, IC(e) = -log(n(e) / N). A term t of n(t) occurrences, n(e, t) of them near e, discloses
PMI(t; e) = log(N n(e, t) / (n(e) n(t))) of that, at most all of it. A term that discloses a share of IC(e) of at least REMOVE is removed, one
of at least GENERALISE is replaced by its class, wherever it stands, provided that it was seen near e in SUPPORT different contexts: a word that stands beside an
address once tells nothing, nor do copies of the same passage.

Counts cover all documents. A task adds up the terms and pairs of a batch before they are shuffled. Documents meet the disclosing
terms by a bitmap of fixed size, whatever their number, and then by a join on the term.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import Scratch, arrow_batches, spread

KINDS = "email", "ip", "card", "phone"
#: The added kind; it comes after the others.
TERM = "term"
#: What stands for a span in sanitised texts (fixed values).
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
WINDOW, SUPPORT = 8, 3
GENERALISE, REMOVE = 0.9, 0.97
#: Bits of the map that tells which words may be disclosing terms (2 MiB).
BITS = 1 << 24

DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(values[::2] + [2 * v - 9 * (v > 4) for v in values[1::2]]) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A local part ends at its @, so each @ is looked at once, and to its left only as far as the match before."""
    done = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = m.end()


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in code points, end exclusive: matches from left to right that don't overlap, without those that fail their
    kind's test. Every pattern takes time in proportion to the text."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = list(_emails(text))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found["ip"].append(m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(own := _digits(m[0])) <= 19 and luhn(own):
            found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def entity(kind: str, text: str) -> str:
    """The protected value, however it is written."""
    return f"{kind}:{_digits(text) if kind in ('card', 'phone') else text.lower()}"


def lower(text: str) -> str:
    """A-Z only, so that places stay."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def term_of(word: str) -> str:
    """The term that a lower-cased word is: without punctuation at its ends; empty for words without letters and very short ones."""
    word = word.strip(EDGES)
    return word if len(word) >= 3 and any(c.isalpha() for c in word) else ""


def _near(text: str, spans: dict[str, list[tuple[int, int]]], window: int) -> Iterator[tuple[str, str, int]]:
    """(entity, term, context) of each word near an entity's occurrence; a word counts once for an entity, words of base spans don't count.

    A context is a hash of the words around the occurrence.
    """
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    starts = np.array([s for s, _ in words])
    inside = np.zeros(len(words), bool)
    places = []
    for kind in KINDS:
        for start, end in spans[kind]:
            first, last = int(np.searchsorted(starts, start, "right")) - 1, int(np.searchsorted(starts, end, "left"))
            inside[first:last] = True
            places.append((entity(kind, text[start:end]), first, last))
    seen = set()
    for name, first, last in places:
        around = [i for i in (*range(max(0, first - window), first), *range(last, min(len(words), last + window))) if not inside[i]]
        terms = [(i, term_of(text[slice(*words[i])])) for i in around]
        context = xxhash.xxh64_intdigest(" ".join(t for _, t in terms)) >> 1
        for i, t in terms:
            if t and (name, i) not in seen:
                seen.add((name, i))
                yield name, t, context


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _seen(df: DataFrame, text_col: str, window: int) -> DataFrame:
    """How often each term occurs (entity null) and how often near which entity in which context: entity, term, context, n."""
    rows = spread(df.select(F.col(text_col).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, near = Counter(), Counter()
            for text in map(lower, _texts(b.column(0))):
                words.update(WORD.findall(text))
                spans = base_spans(text)
                if any(spans.values()):
                    near.update(_near(text, spans, window))
            terms = Counter()
            for w, n in words.items():
                terms[term_of(w)] += n
            out = [(None, t, None, n) for t, n in terms.items()] + [(*k, n) for k, n in near.items()]
            if out:
                e, t, c, n = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(e, pa.string()), pa.array(t, pa.string()), pa.array(c, pa.int64()), pa.array(n, pa.int64())], ["entity", "term", "context", "n"])

    found = rows.mapInArrow(run, "entity string, term string, context long, n long")
    return found.groupBy("entity", "term", "context").agg(F.sum("n").alias("n"))


def disclosing_terms(df: DataFrame, text_col: str = "text", window: int = WINDOW, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Terms that disclose an entity: term, entity (the one disclosed most; of equals the first by name), near, occurrences, contexts, information (IC in bits), disclosed
    (the share of it), action (generalise or remove). The result is a written table.

    Words without letters and words shorter than three characters are no terms. Null texts are empty; an empty table has no terms. Repeated rows
    count in all numbers but that of contexts.
    """
    spark = df.sparkSession
    arrow_batches(spark, 1000)
    scratch = Scratch(spark, "disclosure")
    seen = scratch.write(_seen(df, text_col, window), "seen")
    total = seen.where("entity is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    near = seen.where("entity is not null").groupBy("entity", "term").agg(F.sum("n").alias("near"), F.count("*").alias("contexts"))
    near = scratch.write(near, "near")
    size = near.groupBy("entity").agg(F.sum("near").alias("of_entity"))
    counts = seen.where("entity is null").groupBy("term").agg(F.sum("n").alias("occurrences"))
    joined = near.where(F.col("contexts") >= support).join(size, "entity").join(counts, "term")
    information = -F.log2(F.col("of_entity") / F.lit(float(total or 1)))
    joined = joined.withColumn("information", information).where("information > 0")
    joined = joined.withColumn("disclosed", 1 + F.log2(F.col("near") / F.col("occurrences")) / F.col("information")).where(F.col("disclosed") >= min(generalise, remove))
    best = joined.groupBy("term").agg(F.max(F.struct("disclosed", "near")).alias("_b"))
    joined = joined.join(best, "term").where((F.col("disclosed") == F.col("_b.disclosed")) & (F.col("near") == F.col("_b.near"))).drop("_b")
    most = F.min(F.struct("entity", "near", "occurrences", "contexts", "information", "disclosed"))
    found = joined.groupBy("term").agg(most.alias("_m")).select("term", "_m.*")
    action = F.when(F.col("disclosed") >= remove, "remove").otherwise("generalise")
    return scratch.write(found.withColumn("action", action), "terms")


def _bitmap(terms: DataFrame, bits: int) -> np.ndarray:
    """A map of the terms' hashes, made by tasks; bits / 8 bytes whatever the number of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = np.array([xxhash.xxh64_intdigest(t) % bits for t in b.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(places))], ["place"])

    # Spark's buckets of 32768 places begin at 1.
    places = terms.select("term").mapInArrow(run, "place long").select((F.col("place") + 1).alias("place"))
    rows = places.groupBy(F.bitmap_bucket_number("place").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("m")).collect()
    made = np.zeros(bits // 8 + 4096, np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r["m"]), np.uint8)
        made[(r["b"] - 1) * 4096 : (r["b"] - 1) * 4096 + len(part)] = part
    return made


def spans(df: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """Each row's spans: id, text, email, ip, card, phone (arrays of start and stop) and term (array of start, stop, action).

    Offsets are code points, stop exclusive. Words that overlap a base span are no term spans; a term span leaves out the punctuation around the
    word. A null text is empty. Rows that repeat an id are judged by their own texts.
    """
    spark = df.sparkSession
    arrow_batches(spark, 1000)
    given = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    pairs = [T.StructField(k, T._parse_datatype_string("array<struct<start:bigint,stop:bigint>>")) for k in KINDS]
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *T._parse_datatype_string("text string, key binary").fields, *pairs])
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _texts(b.column(1))
            found = [base_spans(t) for t in texts]
            columns = [pa.array([[{"start": s, "stop": e} for s, e in f[k]] for f in found], span) for k in KINDS]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(map(_key, texts), pa.binary()), *columns], schema.names)

    rows = given.mapInArrow(run, schema)
    places = _places(given, _bitmap(terms, bits), bits)
    own = places.join(terms.select("term", "action"), "term").groupBy("id", "key").agg(F.array_sort(F.collect_set(F.struct("start", "stop", "action"))).alias(TERM))
    own = own.select(F.col("id").alias("_id"), F.col("key").alias("_key"), TERM)
    joined = rows.join(own, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    none = F.array().cast("array<struct<start:bigint,stop:bigint,action:string>>")
    return joined.select("id", "text", *KINDS, F.coalesce(F.col(TERM), none).alias(TERM))


def _key(text: str) -> bytes:
    """Tells apart the texts of rows that have one id."""
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:16]


def _places(given: DataFrame, bitmap: np.ndarray, bits: int) -> DataFrame:
    """Where words stand whose terms the bitmap knows, which may be a few more than the terms: id, key, term, start, stop."""
    schema = T.StructType([given.schema["id"], *T._parse_datatype_string("key binary, term string, start bigint, stop bigint").fields])
    held = given.sparkSession.sparkContext.broadcast(bitmap)
    kinds = [pa.binary(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, _key(text), *w) for i, text in enumerate(_texts(b.column(1))) for w in _candidates(text, held.value, bits)]
            if out:
                at, *columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], schema.names)

    return given.mapInArrow(run, schema) if bitmap.any() else given.sparkSession.createDataFrame([], schema)


def _candidates(text: str, table: np.ndarray, bits: int) -> Iterator[tuple[str, int, int]]:
    """Words of a text whose terms the bitmap knows and which overlap no base span: (term, start, stop)."""
    known, small = {}, lower(text)
    for w in set(WORD.findall(small)):
        t = term_of(w)
        if t:
            place = xxhash.xxh64_intdigest(t) % bits
            if table[place >> 3] >> (place & 7) & 1:
                known[w] = t
    if not known:
        return
    taken = sorted(s for own in base_spans(text).values() for s in own)
    starts, far = [s for s, _ in taken], np.maximum.accumulate([0, *[e for _, e in taken]])
    for m in WORD.finditer(small):
        t = known.get(m[0])
        if t and far[int(np.searchsorted(starts, m.end(), "left"))] <= m.start():
            start = m.start() + m[0].index(t)
            yield t, start, start + len(t)


def _listed(kind: str) -> Column:
    return F.transform(kind, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string")))


def report(found: DataFrame) -> DataFrame:
    """Digest of :func:`spans`: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term."""
    base = F.array_join(F.concat(*[_listed(k) for k in KINDS]), ",")
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("id", *counts, F.sha2(base, 256).alias("base_sha256"), F.array_join(F.concat(*[_listed(k) for k in (*KINDS, TERM)]), ",").alias("spans"), F.size(TERM).cast("long").alias(f"n_{TERM}"))


def sanitised(found: DataFrame) -> DataFrame:
    """Texts of :func:`spans` with their personal data and disclosing terms taken out: id, text.

    A base span becomes the mark of its kind; of overlapping ones the first stands for all it touches. A term to be generalised becomes [NAME] where it begins with an
    upper-case letter, [CODE] where it has a digit, else [TERM]; one to be removed becomes nothing.
    """
    schema = T.StructType([found.schema["id"], T.StructField("text", T.StringType())])
    rows = found.select("id", "text", *KINDS, TERM)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, *kinds, terms in zip(*(b.column(i).to_pylist() for i in range(1, len(KINDS) + 3)), strict=True):
                marks = [(s["start"], s["stop"], MARKS[k]) for k, own in zip(KINDS, kinds, strict=True) for s in own]
                marks += [(s["start"], s["stop"], "" if s["action"] == "remove" else _class(text[s["start"] : s["stop"]])) for s in terms]
                out, at = [], 0
                for start, stop, mark in sorted(marks):
                    if start >= at:
                        out += [text[at:start], mark]
                    at = max(at, stop)
                texts.append("".join(out) + text[at:])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return rows.mapInArrow(run, schema)


def _class(word: str) -> str:
    return "[NAME]" if word[:1].isupper() else "[CODE]" if any(c.isdigit() for c in word) else "[TERM]"
