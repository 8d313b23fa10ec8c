"""Queries of the image operators; the 64 numbers of an embedding stand for an 8x8 grid."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.functions import lexicons as L
from loomspan.operators import images as I
from loomspan.session import table


def _hashes(s, d):
    return table(s, d, "embeddings").select("vec_id", "label", I.average_hash(F.col("embedding").cast("array<double>")).alias("hash"))


def average_hash(s, d):
    return _hashes(s, d).select("vec_id", "hash")


def _altered(s, d):
    """Images, and beside each one whose hash begins with up to three zeros, as those of the table are far from each other."""
    h = _hashes(s, d)
    zeros = (F.col("vec_id") % 4).cast("int")
    return h.union(h.select((-F.col("vec_id") - 1).alias("vec_id"), "label", F.concat(F.repeat(F.lit("0"), zeros), F.substring("hash", zeros + 1, F.lit(16))).alias("hash")))


def hamming_pairs(s, d):
    """Pairs of a label's different hashes that differ in at most seven bits, each hash by the first image that has it."""
    return I.near_hashes(_altered(s, d), "label", "vec_id", "hash", 7)


def image_dedup_groups(s, d):
    h = _hashes(s, d).select("vec_id", F.when(F.col("vec_id") % 10 != 0, F.col("hash")).alias("hash"), F.lit(0.25).alias("price"))
    return I.dedup_groups(h, "vec_id", "hash", "price").select("vec_id", "representative", "is_representative", "cost")


def image_first_match(s, d):
    """Each image with the first stored image of its label within seven bits."""
    return I.first_match(_altered(s, d), "label", "vec_id", "hash", 7)


def image_caps(s, d):
    ranked = _hashes(s, d).withColumn("place", F.row_number().over(W.partitionBy("label").orderBy("vec_id")))
    return ranked.groupBy("label").agg(F.count_if(F.col("place") <= 50).alias("processed"), F.count_if(F.col("place") > 50).alias("skipped"))


def image_batches(s, d):
    return I.batch_numbers(_hashes(s, d), "label", "vec_id", 8).select("vec_id", "label", "batch")


def split_cost(s, d):
    b = I.batch_numbers(_hashes(s, d), "label", "vec_id", 8)
    return b.select("vec_id", F.round(F.lit(0.8) / F.count("*").over(W.partitionBy("label", "batch")), 6).alias("cost"))


def _signals(s, d):
    k = F.col("event_id")
    labels = [*L.TEXT_LABELS, *L.VLM_LABELS, "Picture", "Figure", "Other"]
    return table(s, d, "events").select(k, ((k % 60) / 100.0).alias("density"), (k % 5).alias("lines"), (k % 3 != 0).alias("cloud"), (k % 2 == 0).alias("strict"), F.element_at(F.array(*[F.lit(x) for x in labels]), (k % len(labels) + 1).cast("int")).alias("label"))


def density_route(s, d):
    return _signals(s, d).select("event_id", I.density_route(F.col("density"), F.col("lines"), F.col("cloud")).alias("route"))


def layout_route(s, d):
    return _signals(s, d).select("event_id", I.layout_route(*[F.col(c) for c in ("label", "density", "lines", "cloud", "strict")]).alias("route"))


def polygon_density(s, d):
    k = F.col("p_partkey")
    xs = F.array(*[v.cast("double") for v in (k % 7, k % 7 + 40, k % 7 + 50, k % 5)])
    ys = F.array(*[v.cast("double") for v in (k % 3, k % 4, k % 4 + 30, k % 3 + 25)])
    return table(s, d, "part").select(k, F.round(I.polygon_area(xs, ys), 6).alias("area"), F.round(F.least(F.lit(1.0), I.polygon_area(xs, ys) / 1200.0), 6).alias("text_density"))


def dominant_label(s, d):
    li = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("area"), F.max("l_returnflag").alias("label"))
    return I.dominant_label(li, "l_orderkey", "l_linenumber", "label", "area")


def model_cost(s, d):
    k = F.col("p_partkey")
    models = [m[0].upper() + "-x" for m in L.MODEL_PRICES] + ["other"]
    providers = [*L.PROVIDER_PRICES, "none"]
    pick = lambda v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % len(v) + 1).cast("int"))
    return table(s, d, "part").select(k, I.cost(pick(providers), pick(models), F.col("p_size") * 1000, k % 1000 * 1000).alias("cost"))


def usage_extract(s, d):
    e = table(s, d, "events")
    raw = F.concat(F.lit('{"usage": {"prompt_tokens": '), F.col("event_id").cast("string"), F.lit(', "completion_tokens": '), F.get_json_object("props", "$.k"), F.lit("}}"))
    return e.select("event_id", F.get_json_object(raw, "$.usage.prompt_tokens").cast("long").alias("prompt_tokens"), F.get_json_object(raw, "$.usage.completion_tokens").cast("long").alias("completion_tokens"))


def downscale(s, d):
    w, h = I.downscaled(F.col("p_partkey") % 2000 + 1, F.col("p_size") * 31)
    return table(s, d, "part").select("p_partkey", w.alias("width"), h.alias("height"))


def batch_answers(s, d):
    k = F.col("o_orderkey")
    items = F.concat(F.lit('[{"index": 0, "label": "a'), k.cast("string"), F.lit('"}, {"index": '), (k % 4).cast("string"), F.lit(', "label": "b"}, {"index": 9, "label": "c"}, {"index": 0, "label": "d"}]'))
    raw = F.when(k % 2 == 0, items).otherwise(F.concat(F.lit('{"items": '), items, F.lit("}")))
    return I.batch_items(table(s, d, "orders").select("o_orderkey", raw.alias("raw"), F.lit(3).alias("size")), "o_orderkey", "raw", "size")


def mermaid_check(s, d):
    k = F.col("doc_id")
    made = F.when(k % 3 == 0, F.concat(F.lit("graph TD; A[start] --> B(end) "), F.substring("lang", 1, 2))).when(k % 3 == 1, F.concat(F.lit("flowchart LR; A[x --> "), F.col("lang"))).otherwise(F.col("text"))
    return table(s, d, "documents").select("doc_id", I.is_mermaid(made).alias("valid"))


def ocr_merge(s, d):
    docs = table(s, d, "documents").select("doc_id", F.length("text").cast("long").alias("n"))
    got = docs.where("doc_id % 4 = 0").select(F.col("doc_id").alias("target_id"), (F.col("doc_id") % 8 == 0).alias("accepted"))
    joined = docs.join(got, docs.doc_id == got.target_id, "left")
    return joined.select("doc_id", F.when(F.col("accepted"), "replaced").when(F.col("accepted").isNotNull(), "rejected").otherwise("kept").alias("state"))


def image_outcomes(s, d):
    g = image_dedup_groups(s, d)
    model = F.when(F.col("representative") % 3 == 0, "router-local").when(F.col("representative") % 3 == 1, "local-ocr").otherwise("vision-model")
    return g.select("vec_id", model.alias("origin"), (F.col("representative") % 3 == 0).alias("omitted"), (~F.col("is_representative")).alias("replayed"), "cost")


def missing_retries(s, d):
    """Items of a batch that the answer lacks, which alone are asked for again."""
    want = I.batch_numbers(_hashes(s, d), "label", "vec_id", 8).select("vec_id", "label", "batch")
    got = want.where("vec_id % 5 <> 0").select("vec_id")
    return want.join(got, "vec_id", "left_anti")


QUERIES = {f.__name__: f for f in (average_hash, hamming_pairs, image_dedup_groups, image_first_match, image_caps, image_batches, split_cost, density_route, layout_route, polygon_density, dominant_label, model_cost, usage_extract, downscale, batch_answers, mermaid_check, ocr_merge, image_outcomes, missing_retries)}

HASH = """h as (select vec_id, label, printf('%08x%08x', list_sum(list_transform(range(0, 32), lambda i: case when e[i + 1] > m then (1::bigint << (31 - i)) else 0 end))::bigint, list_sum(list_transform(range(0, 32), lambda i: case when e[i + 33] > m then (1::bigint << (31 - i)) else 0 end))::bigint) as hash
 from (select vec_id, label, embedding::double[] as e, list_reduce(list_prepend(0.0::double, embedding::double[]), lambda a, b: a + b) / len(embedding) as m from embeddings))"""
BIT = " + ".join(f"bit_count(xor(('0x' || substr(a.hash, {at}, 8))::bigint, ('0x' || substr(b.hash, {at}, 8))::bigint))" for at in (1, 9))
HIT = "list_filter(f.kept, lambda k: " + BIT.replace("a.hash", "k.hash").replace("b.hash", "r.hash") + " <= 7)[1].id"
BATCH = "b as (select vec_id, label, ((row_number() over (partition by label order by vec_id) - 1) // 8) as batch from embeddings)"
GROUPS = "g as (select vec_id, coalesce(case when vec_id % 10 <> 0 then hash end, '#' || vec_id) as k from h), r as (select vec_id, min(vec_id) over (partition by k) as representative from g)"
_labels = "[" + ", ".join(f"'{x}'" for x in [*L.TEXT_LABELS, *L.VLM_LABELS, "Picture", "Figure", "Other"]) + "]"
_n = len(L.TEXT_LABELS) + len(L.VLM_LABELS) + 3
SIGNALS = f"s as (select event_id, (event_id % 60) / 100.0::double as density, event_id % 5 as lines, case when event_id % 3 <> 0 then 'vlm' else 'ocr' end as visual, event_id % 2 = 0 as strict, ({_labels})[1 + event_id % {_n}] as label from events)"
_models = "(values " + ", ".join(f"({i}, '{m}', {a}::double, {b}::double)" for i, (m, a, b) in enumerate(L.MODEL_PRICES)) + ") m(ord, name, a, b)"
_mnames = "[" + ", ".join(f"'{m[0]}-x'" for m in L.MODEL_PRICES) + ", 'other']"
_provs = "[" + ", ".join(f"'{p}'" for p in L.PROVIDER_PRICES) + ", 'none']"
_pp = "(values " + ", ".join(f"('{p}', {a}::double, {b}::double)" for p, (a, b) in L.PROVIDER_PRICES.items()) + ") p(name, a, b)"

SQL = {
    "average_hash": f"with {HASH} select vec_id, hash from h",
    "hamming_pairs": f"with {HASH}, f as (select label, hash, min(vec_id) as vec_id from (select vec_id, label, hash from h union all select -vec_id - 1, label, repeat('0', (vec_id % 4)::int) || substr(hash, (vec_id % 4)::int + 1) from h) group by 1, 2) select a.label, a.vec_id as left_id, b.vec_id as right_id, ({BIT})::int as distance from f a join f b on a.label = b.label and a.vec_id < b.vec_id where {BIT} <= 7",
    "image_first_match": f"with recursive {HASH}, a as (select vec_id, label, hash from h union all select -vec_id - 1, label, repeat('0', (vec_id % 4)::int) || substr(hash, (vec_id % 4)::int + 1) from h), r as (select *, row_number() over (partition by label order by vec_id) as n from a), fold as (select label, 1::bigint as n, [{{'id': vec_id, 'hash': hash}}] as kept, vec_id, vec_id as matched from r where n = 1 union all select r.label, r.n, case when {HIT} is null then list_append(f.kept, {{'id': r.vec_id, 'hash': r.hash}}) else f.kept end, r.vec_id, coalesce({HIT}, r.vec_id) from fold f join r on r.label = f.label and r.n = f.n + 1) select label, vec_id, matched from fold",
    "image_dedup_groups": f"with {HASH}, {GROUPS} select vec_id, representative, vec_id = representative as is_representative, case when vec_id = representative then 0.25 else 0.0 end::double as cost from r",
    "image_caps": "with r as (select label, row_number() over (partition by label order by vec_id) as p from embeddings) select label, count(*) filter (p <= 50) as processed, count(*) filter (p > 50) as skipped from r group by label",
    "image_batches": f"with {BATCH} select vec_id, label, batch from b",
    "split_cost": f"with {BATCH} select vec_id, round(0.8::double / count(*) over (partition by label, batch), 6) as cost from b",
    "density_route": f"with {SIGNALS} select event_id, case when density <= 0.02 and lines = 0 then 'skip_decorative' when density >= 0.45 and lines >= 3 then 'ocr' else visual end as route from s",
    "layout_route": f"with {SIGNALS} select event_id, case when label in ('Table', 'Equation') then visual when label in ('Picture', 'Figure', 'Other') then case when density <= 0.02 and lines = 0 then 'skip_decorative' else visual end when strict and density < 0.45 then visual else 'ocr' end as route from s",
    "polygon_density": "with c as (select p_partkey, (p_partkey % 7)::double as a, (p_partkey % 3)::double as b, p_partkey % 7 + 40.0::double as c, (p_partkey % 4)::double as d, p_partkey % 7 + 50.0::double as e, p_partkey % 4 + 30.0::double as f, (p_partkey % 5)::double as g, p_partkey % 3 + 25.0::double as h from part), x as (select p_partkey, abs(a * d - c * b + c * f - e * d + e * h - g * f + g * b - a * h) / 2 as area from c) select p_partkey, round(area, 6) as area, round(least(1.0, area / 1200.0), 6) as text_density from x",
    "dominant_label": "with b as (select l_orderkey, l_linenumber, max(l_quantity) as area, max(l_returnflag) as label from lineitem group by 1, 2) select l_orderkey, label as dominant_label from b qualify row_number() over (partition by l_orderkey order by area desc, l_linenumber) = 1",
    "model_cost": f"with k as (select p_partkey, ({_mnames})[1 + p_partkey % {len(L.MODEL_PRICES) + 1}] as model, ({_provs})[1 + p_partkey % {len(L.PROVIDER_PRICES) + 1}] as provider, p_size * 1000 as i, p_partkey % 1000 * 1000 as o from part), r as (select k.*, (select struct_pack(a := arg_min(a, ord), b := arg_min(b, ord)) from {_models} where contains(model, name)) as mr, p.a as pa, p.b as pb from k left join {_pp} on p.name = provider) select p_partkey, round(i / 1000.0::double * coalesce(mr.a, pa, 0.005) + o / 1000.0::double * coalesce(mr.b, pb, 0.015), 6) as cost from r",
    "usage_extract": "select event_id, event_id as prompt_tokens, (props->>'$.k')::bigint as completion_tokens from events",
    "downscale": "with d as (select p_partkey, p_partkey % 2000 + 1 as w, (p_size * 31)::bigint as h from part) select p_partkey, case when greatest(w, h) > 768 then greatest(1, round_even(w * 768 / greatest(w, h)::double, 0)::bigint) else w end as width, case when greatest(w, h) > 768 then greatest(1, round_even(h * 768 / greatest(w, h)::double, 0)::bigint) else h end as height from d",
    "batch_answers": "select o_orderkey, 0 as index, 'a' || o_orderkey as label from orders union all select o_orderkey, (o_orderkey % 4)::int, 'b' from orders where o_orderkey % 4 in (1, 2)",
    "mermaid_check": "with m as (select doc_id, case doc_id % 3 when 0 then 'graph TD; A[start] --> B(end) ' || lang when 1 then 'flowchart LR; A[x --> ' || lang else text end as t from documents) select doc_id, length(t) between 20 and 5000 and regexp_matches(t, '^(graph |flowchart|sequenceDiagram|stateDiagram|classDiagram|erDiagram|gitGraph|pie|journey)') and length(replace(t, '[', '')) = length(replace(t, ']', '')) and length(replace(t, '(', '')) = length(replace(t, ')', '')) and regexp_matches(t, '(->|---|-\\.-|==>)') as valid from m",
    "ocr_merge": "select doc_id, case when doc_id % 8 = 0 then 'replaced' when doc_id % 4 = 0 then 'rejected' else 'kept' end as state from documents",
    "image_outcomes": f"with {HASH}, {GROUPS} select vec_id, case representative % 3 when 0 then 'router-local' when 1 then 'local-ocr' else 'vision-model' end as origin, representative % 3 = 0 as omitted, vec_id <> representative as replayed, case when vec_id = representative then 0.25 else 0.0 end::double as cost from r",
    "missing_retries": f"with {BATCH} select vec_id, label, batch from b where vec_id % 5 = 0",
}
