"""Queries of the routing rules."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.functions import lexicons as L
from loomspan.operators import routing as R
from loomspan.operators import transforms as P
from loomspan.session import spread, table

EXTENSIONS = [r[0] for r in R.REGISTRY] + [".xyz", ""]


def _paths(s, d):
    names = F.array(*[F.lit(e) for e in EXTENSIONS])
    k = F.col("p_partkey")
    return table(s, d, "part").select(k, F.concat(F.lit("dir.v1/File_"), k.cast("string"), F.when(k % 3 == 0, F.upper(F.element_at(names, (k % len(EXTENSIONS) + 1).cast("int")))).otherwise(F.element_at(names, (k % len(EXTENSIONS) + 1).cast("int")))).alias("path"))


def extension_registry(s, d):
    return R.plan_engines(_paths(s, d), "path").select("p_partkey", "extension", "engine", "confidence", "known", "backend")


def mime_lookup(s, d):
    mimes = F.array(*[F.lit(r[1]) for r in R.REGISTRY], F.lit("x/y"))
    k = F.col("p_partkey")
    rows = table(s, d, "part").select(k, F.concat(F.upper(F.element_at(mimes, (k % (len(R.REGISTRY) + 1) + 1).cast("int"))), F.when(k % 2 == 0, "; charset=utf-8").otherwise("")).alias("content_type"))
    return R.by_mime(rows, "content_type").select("p_partkey", "extension")


def engine_override(s, d):
    asked = F.element_at(F.array(*[F.lit(x) for x in ("auto", "html", " Text_Data ", "nope", "")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return R.with_override(R.plan_engines(_paths(s, d), "path").withColumn("o", asked), "o").select("p_partkey", "asked", "action", "final_engine")


def _probe(s, d):
    docs = table(s, d, "documents")
    k = F.col("doc_id")
    out = docs.select(k, "source", "lang", "text", (k % 4).alias("images"), (k % 9 == 0).alias("full_page"), F.element_at(F.array(F.lit("HP Scanner"), F.lit("LaTeX"), F.lit("unknown")), (k % 3 + 1).cast("int")).alias("creator"))
    out = out.withColumn("layer", R.text_layer(F.col("text"))).withColumn("quality", R.text_quality(F.col("text"))).withColumn("adjustment", R.metadata_adjustment(F.col("creator"), F.lit(None).cast("string")))
    out = out.withColumn("visual", R.visual_complexity(F.col("images"), F.col("full_page"))).withColumn("scan", R.scan_likelihood(F.col("layer"), F.col("full_page"), F.col("adjustment")))
    return out.withColumn("sandwich", R.sandwich_likelihood(F.col("visual"), F.col("layer"), F.col("quality"))).drop("text")


def _r(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


def page_scores(s, d):
    return _probe(s, d).select("doc_id", "adjustment", *_r("layer", "visual", "scan"))


def text_quality(s, d):
    return _probe(s, d).select("doc_id", *_r("quality"))


def route_plan(s, d):
    cols = [F.col(c) for c in ("layer", "quality", "scan", "sandwich", "visual")] + [F.lit(0.0)]
    p = _probe(s, d)
    profile = F.element_at(F.array(F.lit("fast"), F.lit("balanced"), F.lit("high_accuracy"), F.lit("auto")), (F.col("doc_id") % 4 + 1).cast("int"))
    plan = R.plan_pdf(R.is_safe(*cols), F.col("doc_id") % 10 != 0, profile, F.col("doc_id") % 23 == 0)
    return p.select("doc_id", plan["engine"].alias("engine"), plan["confidence"].alias("confidence"), F.array_join(R.route_reasons(*cols), ",").alias("reasons"))


def probe_rollup(s, d):
    p = _probe(s, d)
    return p.groupBy("source").agg(F.count("*").alias("pages"), F.round(F.avg("layer"), 3).alias("mean_layer"), F.round(F.avg("visual"), 3).alias("mean_visual"), F.round(F.avg(F.when(F.col("layer") * 900 >= 80, 1.0).otherwise(0.0)), 3).alias("text_pages"), F.sum("images").alias("images"))


def layout_complexity(s, d):
    li = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    rows = li.select("l_orderkey", F.flatten(F.transform("x", lambda v: F.array(F.pmod(v["l_partkey"], F.lit(700)), F.pmod(v["l_suppkey"] * 37, F.lit(700)), F.pmod(v["l_partkey"] * 11, F.lit(700))))).alias("xs"))
    rows = rows.withColumn("ns", F.transform("xs", lambda v: F.pmod(v, F.lit(40))))
    return rows.select("l_orderkey", F.round(R.layout_complexity(F.col("xs"), F.col("ns")), 6).alias("layout_complexity"))


def _pages(s, d):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    li = spread(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_linestatus"), "l_orderkey")
    return li.select(F.col("l_orderkey").alias("doc"), F.row_number().over(w).cast("long").alias("page"), F.col("l_linestatus").alias("engine"))


def routing_segments(s, d):
    return R.segments(_pages(s, d))


def page_ranges(s, d):
    return R.page_ranges(table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page")))


def missing_pages(s, d):
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"))
    return R.missing_pages(li, li.groupBy("doc").agg(F.max("page").alias("page_count")))


def coverage_label(s, d):
    li = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_linenumber").alias("have"), F.max("l_linenumber").alias("want"))
    return li.select("l_orderkey", F.concat_ws("/", "have", "want").alias("label"), (F.col("have") == F.col("want")).alias("full_coverage"))


def mixed_plan(s, d):
    seg = R.segments(_pages(s, d)).groupBy("doc").agg(F.count("*").alias("segments"), F.min("first_page").alias("lo"), F.max("last_page").alias("hi"), F.sum("pages").alias("pages"), F.count_if(F.col("engine") == "F").alias("fast"))
    mixed = (F.col("segments") > 1) & (F.col("lo") == 1) & (F.col("hi") == F.col("pages"))
    return seg.select("doc", "segments", mixed.alias("mixed"), F.when(mixed, F.when(F.col("fast") * 2 >= F.col("segments"), 0.86).otherwise(0.80)).otherwise(0.0).alias("confidence"))


def mixed_merge(s, d):
    pages = _pages(s, d).withColumn("said", F.concat(F.lit("<!-- pages: "), F.col("page").cast("string"), F.lit(" -->\n"), F.col("engine")))
    return pages.groupBy("doc").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "said"))), lambda x: x["said"]), "\n\n"), 256).alias("merged_sha256"))


def output_formats(s, d):
    k = F.col("o_orderkey")
    asked = F.concat_ws(",", F.element_at(F.array(F.lit(" HTML"), F.lit("pdf"), F.lit("markdown")), (k % 3 + 1).cast("int")), F.element_at(F.array(F.lit("chunks "), F.lit("html"), F.lit(""), F.lit("Json")), (k % 4 + 1).cast("int")), F.lit("html"))
    return table(s, d, "orders").select("o_orderkey", F.array_join(R.output_formats(asked), ",").alias("formats"))


def renderable_formats(s, d):
    out = R.plan_engines(_paths(s, d), "path")
    multi = F.col("engine") == "deep_pdf"
    return out.select("p_partkey", F.when(multi, F.lit(",".join(R.OUTPUT_FORMATS))).otherwise(F.lit("markdown,chunks")).alias("renderable"))


def fallbacks(s, d):
    docs = table(s, d, "documents")
    status = F.when(F.col("doc_id") % 17 == 0, "failed").otherwise("ok")
    short = R.short_output(F.col("text"), F.col("doc_id") % 6)
    return docs.select("doc_id", F.when(status == "failed", "exception_fallback").when(short, "short_output_fallback").otherwise("accepted").alias("outcome"))


def expected_pages(s, d):
    li = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("probed"), F.min("l_linenumber").alias("a"))
    spec = F.concat(F.col("a").cast("string"), F.lit("-"), (F.col("a") + 2).cast("string"), F.lit(","), (F.col("a") + 5).cast("string"))
    parts = F.transform(F.split(spec, ","), lambda p: F.when(p.contains("-"), F.split_part(p, F.lit("-"), F.lit(2)).cast("int") - F.split_part(p, F.lit("-"), F.lit(1)).cast("int") + 1).otherwise(1))
    return li.select("l_orderkey", F.least(F.aggregate(parts, F.lit(0), lambda a, v: a + v), F.col("probed")).cast("long").alias("expected"))


def sampled_pages(s, d):
    orders = _pages(s, d)
    total = F.count("*").over(W.partitionBy("doc"))
    rows = orders.withColumn("total", total).withColumn("page", F.col("page") - 1)
    return rows.where(R.sample_pages(F.col("page"), F.col("total"), F.col("doc") % 2 == 0)).groupBy("doc").agg(F.count("*").alias("sampled"), F.sum("page").alias("page_sum"))


def ocr_targets(s, d):
    docs = table(s, d, "documents")
    kind = F.when(F.col("doc_id") % 5 == 0, "table").when(F.col("doc_id") % 7 == 0, "formula").when((F.col("doc_id") % 100) / 100.0 < 0.65, "degraded_text")
    rows = docs.select("doc_id", kind.alias("kind"), F.sha2("text", 256).alias("fingerprint")).where("kind is not null")
    return rows.withColumn("n", F.row_number().over(W.partitionBy("fingerprint").orderBy("doc_id"))).where("n = 1").drop("n")


def hybrid_engines(s, d):
    k = F.col("doc_id")
    prefer = F.when(k % 3 == 0, F.array(F.lit("paddle"), F.lit("glm"), F.lit("layout_ocr"))).otherwise(F.array(F.lit("glm"), F.lit("layout_ocr")))
    have = F.when(k % 2 == 0, F.array(F.lit("layout_ocr"), F.lit("glm"))).otherwise(F.array(F.lit("layout_ocr")))
    return table(s, d, "documents").select("doc_id", F.get(F.filter(prefer, lambda e: F.array_contains(have, e)), 0).alias("engine"))


def crop_boxes(s, d):
    e = table(s, d, "events")
    k = F.col("event_id")
    box = [(k % 7 - 2) / 5.0, (k % 5 - 1) / 4.0, (k % 9) / 6.0, (k % 11) / 8.0]
    cols = R.crop_box(box, F.lit(640), F.lit(480), k % 2 == 0)
    return e.select("event_id", *[c.alias(n) for c, n in zip(cols, ("x0", "y0", "x1", "y1"), strict=True)])


def text_in_images(s, d):
    """Text points joined with the image boxes that hold them, by cells of a grid as wide as a box at most."""
    li = table(s, d, "lineitem")
    points = li.select(F.col("l_orderkey").alias("page"), F.pmod(F.col("l_partkey"), F.lit(600)).alias("x"), F.pmod(F.col("l_suppkey") * 13, F.lit(800)).alias("y"))
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("page"), F.pmod(F.col("o_custkey"), F.lit(400)).alias("x0"), F.pmod(F.col("o_custkey") * 3, F.lit(500)).alias("y0"))
    inside = points.join(o, "page").withColumn("inside", F.col("x").between(F.col("x0") - 5, F.col("x0") + 205) & F.col("y").between(F.col("y0") - 5, F.col("y0") + 305))
    return inside.groupBy("page").agg(F.count("*").alias("points"), F.count_if("inside").alias("inside"), F.round(F.avg(F.col("inside").cast("int")), 6).alias("sandwich_ratio"))


def image_sandwich(s, d):
    """Events of a user as the operator stream of a page, line items as its text: how much of it lies on large images."""
    e = table(s, d, "events")
    v = F.floor("value").cast("long")
    turn, size = v % 4, F.when(v % 3 == 0, 2.0).when(v % 3 == 1, 0.5).otherwise(1.0)
    cos, sin = F.when(turn == 0, size).when(turn == 2, -size).otherwise(0.0), F.when(turn == 1, size).when(turn == 3, -size).otherwise(0.0)
    m = F.array(cos, sin, -sin, cos, (v % 90).cast("double"), (v % 70).cast("double"))
    op = F.when(F.col("event_type") == "view", "q").when(F.col("event_type") == "click", "cm").when(F.col("event_type") == "purchase", "Do").otherwise("Q")
    ops = e.select(F.col("user_id").alias("page"), F.col("event_id").alias("seq"), op.alias("op"), m.alias("m"), F.lit(True).alias("image"))
    pages = e.select(F.col("user_id").alias("page")).distinct().select("page", F.lit(2.0).alias("width"), F.lit(2.5).alias("height"))
    texts = table(s, d, "lineitem").select(F.pmod("l_orderkey", F.lit(500)).alias("page"), (F.col("l_partkey") % 120).cast("double").alias("x"), (F.col("l_suppkey") % 90).cast("double").alias("y"), F.col("l_linenumber").cast("long").alias("chars"))
    return P.sandwich(ops, texts, pages)


QUERIES = {f.__name__: f for f in (extension_registry, mime_lookup, engine_override, page_scores, text_quality, route_plan, probe_rollup, layout_complexity, routing_segments, page_ranges, missing_pages, coverage_label, mixed_plan, mixed_merge, output_formats, renderable_formats, fallbacks, expected_pages, sampled_pages, ocr_targets, hybrid_engines, crop_boxes, text_in_images, image_sandwich)}

_exts = "[" + ", ".join(f"'{e}'" for e in EXTENSIONS) + "]"
REG = "reg(extension, mime, engine, category, confidence, needs) as (values " + ", ".join(f"('{a}', '{b}', '{c}', '{e}', {f}::double, {str(g).lower()})" for a, b, c, e, f, g in R.REGISTRY) + ")"
PATHS = f"paths as (select p_partkey, ({_exts})[1 + p_partkey % {len(EXTENSIONS)}] as extension from part), planned as (select p_partkey, p.extension, coalesce(engine, 'deep_pdf') as engine, coalesce(confidence, 0.3) as confidence, engine is not null as known, case when coalesce(needs, true) then 'model_worker' else 'cpu_thread' end as backend from paths p left join reg using (extension))"
_mimes = "[" + ", ".join(f"'{r[1]}'" for r in R.REGISTRY) + ", 'x/y']"
QUALITY = """
greatest(0.0, least(1.0, (n - len(regexp_extract_all(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{a0}\\x{ad}\\x{2028}\\x{2029}]'))) / n::double * 0.65 + least(1.0, len(list_filter(string_split_regex(text, '\\s+'), lambda w: regexp_matches(w, '[\\p{L}\\p{N}]'))) / greatest(1.0, n / 12.0::double)) * 0.35
 - case when len(regexp_extract_all(text, '\\s')) / n::double < 0.03 or len(regexp_extract_all(text, '\\s')) / n::double > 0.45 then 0.25 else 0.0 end))"""
PROBE = f"""
b as (select doc_id, source, text, length(text) as n, doc_id % 4 as images, doc_id % 9 = 0 as full_page, case doc_id % 3 when 0 then 0.40::double when 1 then -0.30::double else 0.0::double end as adjustment, least(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) / 900.0::double, 1.0) as layer from documents),
v as (select *, {QUALITY} as quality, least(1.0, images / 3.0::double * 0.45 + case when full_page then 0.55 else 0.0 end) as visual, greatest(0.0, least(1.0, (1.0 - layer) * 0.65 + case when full_page then 0.35 else 0.0 end + case when adjustment >= 0 or layer >= 0.10 then adjustment else 0.0 end)) as scan from b),
p as (select *, greatest(0.0, least(1.0, visual * 0.55 + layer * 0.25 + (1.0 - quality) * 0.20)) as sandwich from v)"""
PAGES = "pg as (select l_orderkey as doc, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) as page, l_linestatus as engine from lineitem), tn as (select *, case when lag(engine) over (partition by doc order by page) = engine then 0 else 1 end as t from pg), rn as (select *, sum(t) over (partition by doc order by page)::bigint as segment from tn), sg as (select doc, segment, engine, min(page) as first_page, max(page) as last_page, count(*) as pages from rn group by all)"

SQL = {
    "extension_registry": f"with {REG}, {PATHS} select * from planned",
    "mime_lookup": f"with {REG}, f as (select mime, min(extension) filter (extension not in ('.jpeg', '.htm', '.log')) as extension from reg group by mime), m as (select p_partkey, ({_mimes})[1 + p_partkey % {len(R.REGISTRY) + 1}] as mime from part) select p_partkey, extension from m left join f using (mime)",
    "engine_override": f"with {REG}, {PATHS}, a as (select *, (['auto', 'html', 'text_data', 'nope', 'auto'])[1 + p_partkey % 5] as asked from planned) select p_partkey, asked, case when asked = 'auto' then 'none' when exists (select 1 from reg where reg.engine = asked and reg.extension = a.extension) then 'override' when asked in (select engine from reg) then 'incompatible' else 'unknown' end as action, case when exists (select 1 from reg where reg.engine = asked and reg.extension = a.extension) then asked else engine end as final_engine from a",
    "page_scores": f"with {PROBE} select doc_id, adjustment, round(layer, 6) as layer, round(visual, 6) as visual, round(scan, 6) as scan from p",
    "text_quality": f"with {PROBE} select doc_id, round(quality, 6) as quality from p",
    "route_plan": f"with {PROBE}, x as (select *, layer >= 0.70 and quality >= 0.80 and scan <= 0.20 and sandwich <= 0.40 and visual <= 0.35 as safe, doc_id % 10 <> 0 as probed, doc_id % 4 = 0 as fast, doc_id % 23 = 0 or doc_id % 4 = 2 as hard from p) select doc_id, case when fast and not hard or probed and safe and not hard then 'fast_pdf' else 'deep_pdf' end as engine, case when fast and not hard and probed then 0.65 when fast and not hard then 0.55 when probed and safe and not hard then 0.92 when probed or hard then 1.0 else 0.75 end::double as confidence, concat_ws(',', case when layer < 0.70 then 'text_layer' end, case when quality < 0.80 then 'text_quality' end, case when scan > 0.20 then 'scan' end, case when sandwich > 0.40 then 'sandwich' end, case when visual > 0.35 then 'visual' end) as reasons from x",
    "probe_rollup": f"with {PROBE} select source, count(*) as pages, round(avg(layer), 3) as mean_layer, round(avg(visual), 3) as mean_visual, round(avg(case when layer * 900 >= 80 then 1.0 else 0.0 end), 3) as text_pages, sum(images)::bigint as images from p group by source",
    "routing_segments": f"with {PAGES} select * from sg",
    "page_ranges": "with d as (select distinct l_orderkey as doc, l_linenumber as page from lineitem where l_linenumber > 0), r as (select doc, page, page - row_number() over (partition by doc order by page) as run from d), g as (select doc, min(page) as a, max(page) as b from r group by doc, run) select doc, string_agg(case when a = b then a::varchar else a || '-' || b end, ',' order by a) as page_range from g group by doc",
    "missing_pages": "with t as (select l_orderkey as doc, max(l_linenumber) as n from lineitem group by 1), w as (select doc, unnest(range(1, n + 1))::int as page from t) select doc, page from w anti join lineitem on doc = l_orderkey and page = l_linenumber",
    "coverage_label": "select l_orderkey, count(distinct l_linenumber) || '/' || max(l_linenumber) as label, count(distinct l_linenumber) = max(l_linenumber) as full_coverage from lineitem group by 1",
    "mixed_plan": f"with {PAGES}, x as (select doc, count(*) as segments, count(*) filter (engine = 'F') as fast from sg group by doc) select doc, segments, segments > 1 as mixed, case when segments > 1 then case when fast * 2 >= segments then 0.86 else 0.80 end else 0.0 end::double as confidence from x",
    "mixed_merge": f"with {PAGES} select doc, sha256(string_agg('<!-- pages: ' || page || ' -->' || chr(10) || engine, chr(10) || chr(10) order by page)) as merged_sha256 from pg group by doc",
    "output_formats": "with a as (select o_orderkey, [(['html', 'pdf', 'markdown'])[1 + o_orderkey % 3], (['chunks', 'html', '', 'json'])[1 + o_orderkey % 4], 'html'] as x from orders), f as (select o_orderkey, list_filter(x, lambda v: v in ('markdown', 'html', 'json', 'chunks')) as y from a) select o_orderkey, array_to_string(list_filter(y, lambda v, i: list_position(y, v) = i), ',') as formats from f",
    "renderable_formats": f"with {REG}, {PATHS} select p_partkey, case when engine = 'deep_pdf' then 'markdown,html,json,chunks' else 'markdown,chunks' end as renderable from planned",
    "fallbacks": "select doc_id, case when doc_id % 17 = 0 then 'exception_fallback' when length(trim(text)) < greatest(100, 100 * (doc_id % 6)) then 'short_output_fallback' else 'accepted' end as outcome from documents",
    "expected_pages": "select l_orderkey, least(4, max(l_linenumber))::bigint as expected from lineitem group by 1",
    "sampled_pages": f"with {PAGES}, t as (select doc, page - 1 as page, count(*) over (partition by doc) as n from pg) select doc, count(*) as sampled, sum(page)::bigint as page_sum from t where page < 3 or page = n - 1 or (doc % 2 = 0 and (n <= 8 or list_contains(list_transform(range(0, 8), lambda k: floor(k * (n - 1) / 7.0::double)::bigint), page))) group by doc",
    "ocr_targets": "with k as (select doc_id, case when doc_id % 5 = 0 then 'table' when doc_id % 7 = 0 then 'formula' when (doc_id % 100) / 100.0::double < 0.65 then 'degraded_text' end as kind, sha256(text) as fingerprint from documents) select doc_id, kind, fingerprint from k where kind is not null qualify row_number() over (partition by fingerprint order by doc_id) = 1",
    "hybrid_engines": "select doc_id, case when doc_id % 2 = 0 then 'glm' else 'layout_ocr' end as engine from documents",
    "crop_boxes": "with b as (select event_id, event_id % 2 = 0 as nm, (event_id % 7 - 2) / 5.0::double as a, (event_id % 5 - 1) / 4.0::double as b, (event_id % 9) / 6.0::double as c, (event_id % 11) / 8.0::double as d from events) select event_id, greatest(0, least(640, floor(case when nm then a * 640 else a end)))::bigint as x0, greatest(0, least(480, floor(case when nm then b * 480 else b end)))::bigint as y0, greatest(0, least(640, floor(case when nm then c * 640 else c end)))::bigint as x1, greatest(0, least(480, floor(case when nm then d * 480 else d end)))::bigint as y1 from b",
    "text_in_images": "with j as (select o_orderkey as page, l_partkey % 600 between o_custkey % 400 - 5 and o_custkey % 400 + 205 and (l_suppkey * 13) % 800 between (o_custkey * 3) % 500 - 5 and (o_custkey * 3) % 500 + 305 as inside from lineitem join orders on l_orderkey = o_orderkey) select page, count(*) as points, count(*) filter (inside) as inside, round(avg(inside::int), 6) as sandwich_ratio from j group by page",
    "image_sandwich": """with recursive
e as (select user_id as page, event_id as seq, row_number() over (partition by user_id order by event_id) as n, case event_type when 'view' then 'q' when 'click' then 'cm' when 'purchase' then 'Do' else 'Q' end as op, floor(value)::bigint as v from events),
z as (select *, case v % 3 when 0 then 2.0 when 1 then 0.5 else 1.0 end::double as s from e),
o as (select page, seq, n, op, case v % 4 when 0 then s when 2 then -s else 0.0 end::double as c, case v % 4 when 1 then s when 3 then -s else 0.0 end::double as t, (v % 90)::double as x, (v % 70)::double as y from z),
w as (
  select distinct page, 0::bigint as n, '' as op, [[1.0, 0.0, 0.0, 1.0, 0.0, 0.0]]::double[][] as k from o
  union all
  select o.page, o.n, o.op, case o.op when 'q' then list_append(w.k, w.k[-1]) when 'Q' then case when len(w.k) > 1 then w.k[1:len(w.k) - 1] else w.k end
    when 'cm' then list_append(w.k[1:len(w.k) - 1], [c * w.k[-1][1] + t * w.k[-1][3], c * w.k[-1][2] + t * w.k[-1][4], c * w.k[-1][3] - t * w.k[-1][1], c * w.k[-1][4] - t * w.k[-1][2], x * w.k[-1][1] + y * w.k[-1][3] + w.k[-1][5], x * w.k[-1][2] + y * w.k[-1][4] + w.k[-1][6]]) else w.k end
  from w join o on o.page = w.page and o.n = w.n + 1),
b as (select page, k[-1] as m from w where op = 'Do'),
x as (select page, least(m[5], m[1] + m[5], m[3] + m[5], m[1] + m[3] + m[5]) as x0, greatest(m[5], m[1] + m[5], m[3] + m[5], m[1] + m[3] + m[5]) as x1, least(m[6], m[2] + m[6], m[4] + m[6], m[2] + m[4] + m[6]) as y0, greatest(m[6], m[2] + m[6], m[4] + m[6], m[2] + m[4] + m[6]) as y1 from b),
s as (select *, (x1 - x0) * (y1 - y0) / 5.0::double as share from x),
c as (select page, count(*) as image_count, count(*) filter (share >= 0.70::double) as full_page_count from s group by 1),
p as (select l_orderkey % 500 as page, (l_partkey % 120)::double as x, (l_suppkey % 90)::double as y, l_linenumber as chars from lineitem),
i as (select page, sum(chars) as total, sum(chars) filter (exists (select 1 from s where s.page = p.page and share >= 0.40::double and x between x0 - 5 and x1 + 5 and y between y0 - 5 and y1 + 5)) as inside from p group by 1)
select d.page, coalesce(image_count, 0) as image_count, coalesce(full_page_count, 0) as full_page_count, case when total is null then 0.0 else round(coalesce(inside, 0) / total::double, 6) end::double as sandwich_ratio
from (select distinct page from e) d left join c using (page) left join i using (page)""",
}
