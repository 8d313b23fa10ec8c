"""Queries of the scalar functions and of the quality metrics."""

from __future__ import annotations

from ipaddress import ip_network

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.functions import lexicons as L
from loomspan.functions import scalars as S
from loomspan.operators import addresses as A
from loomspan.operators import metrics as M
from loomspan.session import table


def _docs(s, d):
    return table(s, d, "documents")


def secret_scan(s, d):
    made = F.concat(F.col("text"), F.when(F.col("doc_id") % 5 == 0, F.lit("\napi_key=abcdef12345")).when(F.col("doc_id") % 7 == 0, F.lit("\n/home/me/x.txt")).otherwise(""))
    private, secret = made.rlike(S.PRIVATE_PATH), made.rlike(S.SECRET)
    return _docs(s, d).select("doc_id", private.alias("private_path"), secret.alias("secret"), F.when(private | secret, 0.0).otherwise(1.0).alias("privacy_score"))


def path_redaction(s, d):
    made = F.concat("text", F.lit(" see C:\\data\\a.txt in/home/user/"), F.col("lang"), F.lit(".txt and /tmp/x"))
    return _docs(s, d).select("doc_id", S.redact_paths(made).alias("redacted"))


def redact_flat(s, d):
    k = F.col("event_id").cast("string")
    m = F.create_map(F.lit("user_token"), k, F.lit("X-Api-Key"), k, F.lit("note"), F.repeat(F.lit("x"), (F.col("event_id") % 600).cast("int")), F.lit("page_url"), F.concat(F.lit("https://u:p@Example.com:8080/a/b?q="), k))
    out = S.redact_map(m)
    return table(s, d, "events").select("event_id", out["user_token"].alias("token"), out["X-Api-Key"].alias("header"), F.length(out["note"]).cast("long").alias("note_chars"), out["page_url"].alias("page_url"))


def mask_config(s, d):
    m = F.create_map(F.lit("openai_key"), F.col("event_type"), F.lit("mode"), F.col("event_type"))
    out = S.mask_config(m)
    return table(s, d, "events").select("event_id", out["openai_key"].alias("openai_key"), out["mode"].alias("mode"))


def redact_urls(s, d):
    return table(s, d, "pages").select("page_id", S.redact_url(F.col("url")).alias("url"))


def url_safety(s, d):
    k = F.col("page_id")
    url = F.when(k % 6 == 0, F.lit("ftp://a.example.com/x")).when(k % 6 == 1, F.lit("http://10.0.0.1/x")).when(k % 6 == 2, F.lit("http://u:p@b.example.com/")).when(k % 6 == 3, F.lit("https://example.org/")).otherwise(F.col("url"))
    return table(s, d, "pages").select(k, S.url_verdict(url, ("example.com",)).alias("verdict"))


def address_labels(s, d):
    """Line items' keys as addresses, written in four ways, and the special networks that they are in."""
    n = F.pmod(F.col("l_partkey") * 2_654_435 + F.col("l_orderkey") * 69_069 + F.col("l_suppkey"), F.lit(1 << 32))
    part = lambda i: F.shiftright(n, 8 * i).bitwiseAND(255)
    dotted = F.format_string("%d.%d.%d.%d", part(3), part(2), part(1), part(0))
    way = F.col("l_linenumber") % 4
    host = F.when(way == 0, dotted).when(way == 1, n.cast("string")).when(way == 2, F.concat(F.lit("0x"), F.lower(F.hex(n)))).otherwise(F.concat(F.lit("[::ffff:"), dotted, F.lit("]")))
    rows = table(s, d, "lineitem").select(n.alias("n"), host.alias("host")).withColumn("address", A.address("host"))
    found = A.longest_match(rows, "address", A.prefixes(s)).withColumn("label", F.coalesce("label", F.lit("public")))
    return found.groupBy("label").agg(F.count("*").alias("hosts"), F.sum("n").alias("total"))


def numeric_facts(s, d):
    f = S.facts(F.col("text"))
    return _docs(s, d).select("doc_id", F.size(f).cast("long").alias("n_facts"), F.array_join(f, " ").alias("facts"))


def plain_links(s, d):
    f = S.links(F.col("html"))
    return table(s, d, "pages").select("page_id", F.size(f).cast("long").alias("n_links"), F.sha2(F.array_join(f, " "), 256).alias("sha256"))


def _name(k):
    return F.concat(F.when(k % 5 == 0, F.lit("..\\")).when(k % 3 == 0, F.lit("a/b/../")).otherwise(""), F.lit("Re port: "), k.cast("string"), F.when(k % 7 == 0, F.lit("*?.docx")).otherwise(".pdf"))


def safe_names(s, d):
    k = F.col("p_partkey")
    n = _name(k)
    return table(s, d, "part").select(k, S.safe_leaf(n).alias("leaf"), S.attachment_name(n, k).alias("attachment"), S.relative_path(n).alias("relative"))


def output_names(s, d):
    """Output names: the second and later of one stem get a number."""
    rows = table(s, d, "part").select("p_partkey", S.safe_stem(F.col("p_brand")).alias("stem"))
    n = F.row_number().over(W.partitionBy("stem").orderBy("p_partkey"))
    return rows.select("p_partkey", F.when(n == 1, F.concat("stem", F.lit(".md"))).otherwise(F.concat("stem", F.lit("-"), (n - 1).cast("string"), F.lit(".md"))).alias("file"))


def scalar_coercion(s, d):
    k = F.col("event_id")
    text = F.element_at(F.array(F.lit("True"), F.lit("none"), F.concat(F.lit("-"), k.cast("string")), F.concat(k.cast("string"), F.lit(".5e3")), F.lit("x1"), F.lit(" yes ")), (k % 6 + 1).cast("int"))
    return table(s, d, "events").select(k, S.coerce_kind(text).alias("kind"), S.truthy(text).alias("truthy"))


def page_range_counts(s, d):
    k = F.col("o_orderkey")
    spec = F.when(k % 4 == 0, F.concat(F.lit("1-"), (k % 9).cast("string"), F.lit(", 12"))).when(k % 4 == 1, F.lit("3;4")).otherwise(F.concat((k % 5).cast("string"), F.lit(",7 - 9")))
    return table(s, d, "orders").select(k, S.range_count(spec).alias("pages"))


def compression_ratio(s, d):
    return table(s, d, "part").select("p_partkey", F.round(S.compression_ratio(F.col("p_size") * 100, F.col("p_partkey") % 50 + 1), 6).alias("ratio"))


def token_estimates(s, d):
    return _docs(s, d).groupBy("lang").agg(F.count("*").alias("documents"), F.sum(S.token_estimate(F.col("text"))).alias("tokens"))


def chunk_ids(s, d):
    return _docs(s, d).select("doc_id", S.chunk_id(F.col("source"), F.lit(0), F.col("text")).alias("chunk_id"))


def stable_ids(s, d):
    lines = F.concat(F.lit("1-"), F.size(F.split("text", "\n")).cast("string"))
    chars = F.concat(F.lit("0-"), F.length("text").cast("string"))
    return _docs(s, d).select("doc_id", S.stable_id(F.sha2("text", 256), lines, chars, F.col("text")).alias("stable_id"), F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("content_hash"))


def paged_read(s, d):
    p = S.read_page(F.col("text"), 500, 1000)
    return _docs(s, d).select("doc_id", F.sha2(p["text"], 256).alias("page_sha256"), p["has_more"].alias("has_more"), p["next_offset"].alias("next_offset"))


def markdown_table(s, d):
    r = table(s, d, "nation")
    rows = r.select("n_regionkey", "n_nationkey", S.table_row([F.col("n_nationkey").cast("string"), F.concat("n_name", F.lit("|x\ny"))]).alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("n_regionkey").agg(F.concat(F.lit("| key | name |\n| --- | --- |\n"), body).alias("markdown"))


def output_manifest(s, d):
    return _docs(s, d).select("doc_id", F.to_json(F.struct(F.lit("output_manifest.v1").alias("schema_version"), F.col("doc_id").alias("job_id"), F.struct(F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("bytes")).alias("output"))).alias("manifest"))


def format_merge(s, d):
    """Cached outputs of a document: unknown formats go, later ones replace earlier ones."""
    k = F.col("doc_id")
    old = F.create_map(F.lit("markdown"), F.lit("a"), F.lit("weird"), F.lit("b"))
    new = F.create_map(F.when(k % 2 == 0, "markdown").otherwise("html"), k.cast("string"))
    both = F.map_filter(F.map_concat(F.map_filter(old, lambda key, _: ~F.map_contains_key(new, key)), new), lambda key, _: key.isin("markdown", "html", "json", "chunks"))
    return _docs(s, d).select("doc_id", F.array_join(F.array_sort(F.transform(F.map_entries(both), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("formats"))


def _whole_pairs(s, d):
    b = table(s, d, "benchmark").select("item_id", F.col("text").alias("reference"))
    return b.join(_docs(s, d).select(F.col("doc_id").alias("item_id"), F.col("text").alias("hypothesis")), "item_id")


def cer_report(s, d):
    return _whole_pairs(s, d).select("item_id", F.round(M.cer(F.col("reference"), F.col("hypothesis")), 6).alias("cer"))


def wer_report(s, d):
    return _whole_pairs(s, d).select("item_id", F.round(M.wer(F.col("reference"), F.col("hypothesis")), 6).alias("wer"))


def facts_recall(s, d):
    made = F.concat("reference", F.lit(" 12% and 3.5, "), F.col("item_id").cast("string"))
    other = F.concat("hypothesis", F.lit(" 12 "), (F.col("item_id") % 4).cast("string"))
    return _whole_pairs(s, d).select("item_id", F.round(M.fact_recall(made, other), 6).alias("recall"))


def combined_scores(s, d):
    k = F.col("doc_id")
    c, w, f = (k % 100) / 100.0, (k % 70) / 100.0, (k % 5) / 4.0
    return _docs(s, d).select("doc_id", M.combined(c, w, f, F.when(k % 3 == 0, (k % 11) / 10.0)).alias("combined"))


def table_cell_recall(s, d):
    li = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("a"), F.max("l_linestatus").alias("b"))
    cells = li.select("l_orderkey", F.col("l_linenumber").alias("row"), F.posexplode(F.array("a", "b")).alias("col", "value"))
    hyp = cells.withColumn("value", F.when(F.col("value") == "A", " a ").when(F.col("row") == 3, "?").otherwise(F.col("value"))).where("not (row = 2 and col = 1)")
    return M.cell_recall(cells, hyp, "l_orderkey")


def table_assignment(s, d):
    o = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.max("l_partkey") % 4).alias("v"))
    a, b = o.alias("a"), o.alias("b")
    scores = a.join(b, "l_orderkey").select("l_orderkey", F.col("a.l_linenumber").cast("long").alias("ref"), F.col("b.l_linenumber").cast("long").alias("hyp"), (F.pmod(F.col("a.v") + F.col("b.v"), F.lit(4)) / 4.0).alias("score"))
    return M.best_assignment(scores, "l_orderkey")


def _scores(s, d):
    lab = table(s, d, "labels")
    base = lab.join(_docs(s, d).select("doc_id", "lang"), "doc_id")
    k = F.col("doc_id")
    one = base.select(F.lit("base").alias("config"), F.concat_ws(":", "lang", k.cast("string")).alias("sample_id"), (F.col("quality") * 0.7 + (k % 30) / 100.0).alias("combined"))
    two = base.select(F.lit("new").alias("config"), F.concat_ws(":", "lang", k.cast("string")).alias("sample_id"), (F.col("quality") * 0.75 + (k % 25) / 100.0).alias("combined"))
    return one.union(two)


def benchmark_report(s, d):
    return M.report(_scores(s, d))


def config_compare(s, d):
    return M.compare(M.report(_scores(s, d)), "base", "new")


def class_gate(s, d):
    return M.class_gate(_scores(s, d).where("config = 'base'").withColumn("class", F.split_part("sample_id", F.lit(":"), F.lit(1))), ["en", "fr", "de", "it"])


def required_classes(s, d):
    want = s.createDataFrame([("en",), ("it",), ("pt",)], "lang string")
    return want.join(_docs(s, d), "lang", "left_anti")


def engine_verdicts(s, d):
    sc = _scores(s, d).groupBy("sample_id").pivot("config", ["base", "new"]).agg(F.first("combined"))
    return sc.select(F.split_part("sample_id", F.lit(":"), F.lit(1)).alias("class"), (F.round(F.col("new") - F.col("base"), 6)).alias("delta")).groupBy("class").agg(F.count("*").alias("samples"), F.count_if(F.col("delta") > 0).alias("better"), F.round(F.avg("delta"), 6).alias("mean_delta"))


def format_scores(s, d):
    k = F.col("page_id")
    found = S.links(F.concat("html", F.lit(" https://kept.example.com/a, ")))
    want = F.array(F.lit("https://kept.example.com/a"), F.concat(F.lit("https://lost.example.com/"), k.cast("string")))
    meta = F.to_json(F.struct(F.struct((k % 3).alias("pages"), F.lit(False).alias("needs_cloud")).alias("engine")))
    link = F.size(F.array_intersect(want, found)) / 2
    metadata = F.when(F.get_json_object(meta, "$.engine.pages") == "1", 1.0).otherwise(0.5)
    return table(s, d, "pages").select(k, link.alias("link_score"), metadata.alias("metadata_score"), F.round((link + metadata + 1.0 + 0.5) / 4, 6).alias("combined"))


def native_comparison(s, d):
    """Outputs without a counterpart are listed; the others are compared."""
    a = _docs(s, d).select("doc_id", F.length("text").alias("n"))
    b = a.where("doc_id % 9 <> 0").select(F.col("doc_id").alias("other"), (F.col("n") - F.col("doc_id") % 3).alias("m"))
    j = a.join(b, a.doc_id == b.other, "left")
    return j.select("doc_id", F.when(F.col("other").isNull(), "missing").when(F.col("n") > F.col("m"), "native_longer").otherwise("equal").alias("verdict"))


def router_eval(s, d):
    lab = table(s, d, "labels").join(_docs(s, d).select("doc_id", "n_chars"), "doc_id")
    expected, actual = F.when(F.col("quality") == 1, "fast").otherwise("deep"), F.when(F.col("n_chars") % 5 != 0, "fast").otherwise("deep")
    return lab.select(expected.alias("expected"), actual.alias("actual")).groupBy("expected", "actual").agg(F.count("*").alias("samples")).withColumn("ok", F.col("expected") == F.col("actual"))


def report_markdown(s, d):
    r = M.report(_scores(s, d))
    line = F.concat_ws(" | ", "config", F.col("samples").cast("string"), F.when(F.col("passing"), "pass").otherwise("fail"))
    return r.agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("| "), line, F.lit(" |")))), "\n").alias("report"))


def ocr_text(s, d):
    made = F.when(F.col("doc_id") % 10 == 0, F.repeat(F.lit("same "), 9)).when(F.col("doc_id") % 10 == 1, F.lit("  ")).otherwise(F.col("text"))
    c = M.ocr_checks(made)
    return _docs(s, d).select("doc_id", c["accepted"].alias("accepted"), c["score"].alias("score"), c["repeat_ratio"].alias("repeat_ratio"))


def ocr_tables(s, d):
    made = F.when(F.col("doc_id") % 3 == 0, F.lit("| a | b |\n| c | d |")).when(F.col("doc_id") % 3 == 1, F.lit("| a\nb")).otherwise(F.col("text"))
    rows = F.filter(F.split(made, "\n"), lambda r: r.contains("|"))
    cells = F.exists(rows, lambda r: F.size(F.filter(F.split(r, r"\|"), lambda c: F.trim(c) != "")) >= 2)
    return _docs(s, d).select("doc_id", ((F.size(rows) >= 2) & cells).alias("accepted"))


def ocr_formulas(s, d):
    made = F.when(F.col("doc_id") % 3 == 0, F.lit("\\frac{a}{b}")).when(F.col("doc_id") % 3 == 1, F.lit("\\sqrt{x")).otherwise(F.col("text"))
    n = lambda c: F.length(made) - F.length(F.replace(made, F.lit(c), F.lit("")))
    return _docs(s, d).select("doc_id", ((n("{") == n("}")) & (F.regexp_count(made, F.lit("[A-Za-z]{4,}")) <= 6)).alias("accepted"))


QUERIES = {f.__name__: f for f in (secret_scan, path_redaction, redact_flat, mask_config, redact_urls, url_safety, address_labels, numeric_facts, plain_links, safe_names, output_names, scalar_coercion, page_range_counts, compression_ratio, token_estimates, chunk_ids, stable_ids, paged_read, markdown_table, output_manifest, format_merge, cer_report, wer_report, facts_recall, combined_scores, table_cell_recall, table_assignment, benchmark_report, config_compare, class_gate, required_classes, engine_verdicts, format_scores, native_comparison, router_eval, report_markdown, ocr_text, ocr_tables, ocr_formulas)}

NETS = " ".join(f"when n in (3221225481, 3221225482) then 'public' when n between {int(net[0])} and {int(net[-1])} then '{label}'" for net, label in ((ip_network(t), x) for t, x in A.NETWORKS) if net.version == 4 and net.prefixlen < 32)
FACTS = "list_sort(list_distinct(list_transform(regexp_extract_all({t}, '[0-9]+(?:[.,][0-9]+)*%?'), lambda x: rtrim(x, '%'))))"
URLS = "list_sort(list_distinct(list_transform(regexp_extract_all({t}, 'https?://[^\\s)>\\]\"'']+'), lambda x: rtrim(x, '.,'))))"
PAIRS = "pr as (select b.item_id, b.text as r, d.text as h from benchmark b join documents d on d.doc_id = b.item_id)"
NAME = "n as (select p_partkey, (case when p_partkey % 5 = 0 then '..\\' when p_partkey % 3 = 0 then 'a/b/../' else '' end) || 'Re port: ' || p_partkey || (case when p_partkey % 7 = 0 then '*?.docx' else '.pdf' end) as name from part), lf as (select *, list_last(string_split(replace(name, '\\', '/'), '/')) as leaf from n)"
SCORES = "b as (select l.doc_id, l.quality, d.lang from labels l join documents d using (doc_id)), sc as (select 'base' as config, lang || ':' || doc_id as sample_id, quality * 0.7::double + (doc_id % 30) / 100.0::double as combined from b union all select 'new', lang || ':' || doc_id, quality * 0.75::double + (doc_id % 25) / 100.0::double from b), rp as (select config, count(*) as samples, round(avg(combined), 6) as mean_combined, avg(combined) >= 0.8 as passing, count(*) filter (combined < 0.8) as regressions, sha256(coalesce(string_agg(sample_id, ',' order by sample_id) filter (combined < 0.8), '')) as regression_ids from sc group by config)"

SQL = {
    "secret_scan": r"""with m as (select doc_id, text || case when doc_id % 5 = 0 then chr(10) || 'api_key=abcdef12345' when doc_id % 7 = 0 then chr(10) || '/home/me/x.txt' else '' end as t from documents), f as (select doc_id, regexp_matches(t, '(?i)([A-Za-z]:\\Users\\|/Users/|/home/|\\\\[^\\\s]+\\[^\\\s]+)') as private_path, regexp_matches(t, '(?i)(api[_-]?key|secret|token|password)\s*[:=]\s*[A-Za-z0-9_\-]{8,}') as secret from m) select doc_id, private_path, secret, case when private_path or secret then 0.0 else 1.0 end::double as privacy_score from f""",
    "path_redaction": r"""select doc_id, regexp_replace(text || ' see C:\data\a.txt in/home/user/' || lang || '.txt and /tmp/x', '(?i)\b(?:[a-z]:\\|\\\\[^\\\s]+\\|/users/|/home/|/var/|/tmp/)[^\s<>"]+', '[redacted-path]', 'g') as redacted from documents""",
    "redact_flat": "select event_id, '[REDACTED]' as token, '[REDACTED]' as header, case when event_id % 600 > 512 then 515 else event_id % 600 end as note_chars, 'https://example.com:8080/a/b' as page_url from events",
    "mask_config": "select event_id, '****' as openai_key, event_type as mode from events",
    "redact_urls": "select page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^(https?://)[^/@]*@', '\\1') as url from pages",
    "url_safety": "select page_id, case page_id % 6 when 0 then 'bad_scheme' when 1 then 'blocked_address' when 2 then 'credentials' when 3 then 'host_not_allowed' else case when regexp_matches(url, '^https?://([^/]*\\.)?example\\.com') then 'ok' else 'host_not_allowed' end end as verdict from pages",
    "address_labels": f"with a as (select (l_partkey * 2654435 + l_orderkey * 69069 + l_suppkey) % 4294967296 as n from lineitem), b as (select n, case {NETS} else 'public' end as label from a) select label, count(*) as hosts, sum(n)::bigint as total from b group by 1",
    "numeric_facts": f"select doc_id, len({FACTS.format(t='text')})::bigint as n_facts, array_to_string({FACTS.format(t='text')}, ' ') as facts from documents",
    "plain_links": f"select page_id, len({URLS.format(t='html')})::bigint as n_links, sha256(array_to_string({URLS.format(t='html')}, ' ')) as sha256 from pages",
    "safe_names": f"with {NAME} select p_partkey, regexp_replace(regexp_replace(leaf, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') as leaf, regexp_replace(leaf, '[<>:\"|?*]', '_', 'g') as attachment, array_to_string(list_filter(string_split(replace(name, '\\', '/'), '/'), lambda p: p not in ('', '.', '..')), '/') as relative from lf",
    "output_names": "with r as (select p_partkey, regexp_replace(p_brand, '[^A-Za-z0-9._-]+', '_', 'g') as stem, row_number() over (partition by p_brand order by p_partkey) as n from part) select p_partkey, stem || case when n = 1 then '' else '-' || (n - 1) end || '.md' as file from r",
    "scalar_coercion": "select event_id, (['bool', 'null', 'int', 'float', 'string', 'string'])[1 + event_id % 6] as kind, event_id % 6 in (0, 5) as truthy from events",
    "page_range_counts": "select o_orderkey, case o_orderkey % 4 when 0 then greatest(0, o_orderkey % 9) + 1 when 1 then -1 else 4 end as pages from orders",
    "compression_ratio": "select p_partkey, round(p_size * 100 / (p_partkey % 50 + 1)::double, 6) as ratio from part",
    "token_estimates": "select lang, count(*) as documents, sum(greatest(1, (length(text) + 3) // 4))::bigint as tokens from documents group by lang",
    "chunk_ids": "select doc_id, 'chunk_0000_' || substr(sha1(source || ':0:' || text), 1, 12) as chunk_id from documents",
    "stable_ids": "select doc_id, 'stable_' || substr(sha1(sha256(text) || ':1-' || len(string_split(text, chr(10))) || ':0-' || length(text) || ':' || sha256(text)), 1, 16) as stable_id, 'sha256:' || sha256(text) as content_hash from documents",
    "paged_read": "select doc_id, sha256(substr(text, 501, 1000)) as page_sha256, length(text) > 1500 as has_more, case when length(text) > 1500 then 1500 else -1 end as next_offset from documents",
    "markdown_table": "select n_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || '\\|x<br>y |', chr(10) order by n_nationkey) as markdown from nation group by 1",
    "output_manifest": "select doc_id, '{\"schema_version\":\"output_manifest.v1\",\"job_id\":' || doc_id || ',\"output\":{\"sha256\":\"' || sha256(text) || '\",\"bytes\":' || strlen(text) || '}}' as manifest from documents",
    "format_merge": "select doc_id, case when doc_id % 2 = 0 then 'markdown=' || doc_id else 'html=' || doc_id || ',markdown=a' end as formats from documents",
    "cer_report": f"with {PAIRS}, k as (select *, list_distinct(string_split(r, '')) as u from pr), m as (select item_id, r, array_to_string(list_transform(string_split(r, ''), lambda c: chr(33 + list_position(u, c)::int)), '') as a, array_to_string(list_transform(string_split(h, ''), lambda c: chr(33 + coalesce(list_position(u, c), 0)::int)), '') as b from k) select item_id, round(least(1.0, levenshtein(a, b) / length(r)::double), 6) as cer from m",
    "wer_report": f"with {PAIRS}, w as (select item_id, list_filter(string_split_regex(r, '[\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{1680}}]+'), lambda x: x <> '') as a, list_filter(string_split_regex(h, '[\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{1680}}]+'), lambda x: x <> '') as b from pr), k as (select *, list_distinct(a) as u from w), m as (select item_id, len(a) as n, array_to_string(list_transform(a, lambda c: chr(33 + list_position(u, c)::int)), '') as x, array_to_string(list_transform(b, lambda c: chr(33 + coalesce(list_position(u, c), 0)::int)), '') as y from k) select item_id, round(least(1.0, levenshtein(x, y) / n::double), 6) as wer from m",
    "facts_recall": f"with {PAIRS}, m as (select item_id, {FACTS.format(t='''(r || ' 12% and 3.5, ' || item_id)''')} as a, {FACTS.format(t='''(h || ' 12 ' || (item_id % 4))''')} as b from pr) select item_id, round(len(list_intersect(a, b)) / len(a)::double, 6) as recall from m",
    "combined_scores": "select doc_id, round(case when doc_id % 3 = 0 then ((doc_id % 11) / 10.0::double + (doc_id % 5) / 4.0::double) / 2 else (1 - (doc_id % 100) / 100.0::double + 1 - (doc_id % 70) / 100.0::double + (doc_id % 5) / 4.0::double) / 3 end, 6) as combined from documents",
    "table_assignment": "with recursive o as (select l_orderkey as k, l_linenumber::bigint as t, max(l_partkey) % 4 as v from lineitem group by 1, 2), sc as (select a.k, a.t as ref, b.t as hyp, ((a.v + b.v) % 4) / 4.0::double as score, dense_rank() over (partition by a.k order by a.t) as step from o a join o b on a.k = b.k), f as (select k, 0::bigint as step, null::bigint as ref, null::bigint as hyp, null::double as score, []::bigint[] as used from (select distinct k from o) union all select f.k, f.step + 1, sc.ref, arg_max(sc.hyp, {'s': sc.score, 'h': sc.hyp}), max(sc.score), list_append(any_value(f.used), arg_max(sc.hyp, {'s': sc.score, 'h': sc.hyp})) from f join sc on sc.k = f.k and sc.step = f.step + 1 and not list_contains(f.used, sc.hyp) group by f.k, f.step, sc.ref) select k as l_orderkey, ref, hyp, score from f where step > 0",
    "table_cell_recall": "with g as (select l_orderkey, l_linenumber as r, max(l_returnflag) as a, max(l_linestatus) as b from lineitem group by 1, 2), c as (select l_orderkey, r, 0 as c, a as v from g union all select l_orderkey, r, 1, b from g) select l_orderkey, count(*) as cells, round(avg(case when r = 2 and c = 1 then 0.0 when v = 'A' then 1.0 when r = 3 then 0.0 else 1.0 end), 6) as recall from c group by 1",
    "benchmark_report": f"with {SCORES} select * from rp",
    "config_compare": f"with {SCORES} select b.mean_combined as baseline, n.mean_combined as candidate, round(n.mean_combined - b.mean_combined, 6) as delta, n.passing and round(n.mean_combined - b.mean_combined, 6) > 0 as should_swap from rp b, rp n where b.config = 'base' and n.config = 'new'",
    "class_gate": f"with {SCORES}, w(class) as (values ('en'), ('fr'), ('de'), ('it')), o as (select split_part(sample_id, ':', 1) as class, count(*) as samples, bool_and(combined >= 0.8) as ok from sc where config = 'base' group by 1) select w.class, coalesce(samples, 0) as samples, case when samples is null then 'missing' when ok then 'ok' else 'regression' end as state from w left join o on o.class = w.class",
    "required_classes": "select * from (values ('it'), ('pt')) t(lang)",
    "engine_verdicts": f"with {SCORES}, p as (select sample_id, round(max(combined) filter (config = 'new') - max(combined) filter (config = 'base'), 6) as delta from sc group by 1) select split_part(sample_id, ':', 1) as class, count(*) as samples, count(*) filter (delta > 0) as better, round(avg(delta), 6) as mean_delta from p group by 1",
    "format_scores": "with p as (select page_id, 0.5::double as link_score, case when page_id % 3 = 1 then 1.0 else 0.5 end::double as metadata_score from pages) select page_id, link_score, metadata_score, round((link_score + metadata_score + 1.5) / 4, 6) as combined from p",
    "native_comparison": "select doc_id, case when doc_id % 9 = 0 then 'missing' when doc_id % 3 > 0 then 'native_longer' else 'equal' end as verdict from documents",
    "router_eval": "with x as (select case when quality = 1 then 'fast' else 'deep' end as expected, case when n_chars % 5 <> 0 then 'fast' else 'deep' end as actual from labels join documents using (doc_id)) select expected, actual, count(*) as samples, expected = actual as ok from x group by 1, 2",
    "report_markdown": f"with {SCORES} select string_agg('| ' || config || ' | ' || samples || ' | ' || case when passing then 'pass' else 'fail' end || ' |', chr(10) order by config) as report from rp",
    "ocr_tables": "select doc_id, case doc_id % 3 when 0 then true when 1 then false else len(list_filter(string_split(text, chr(10)), lambda r: contains(r, '|'))) >= 2 and len(list_filter(string_split(text, chr(10)), lambda r: len(list_filter(string_split(r, '|'), lambda c: trim(c) <> '')) >= 2 and contains(r, '|'))) > 0 end as accepted from documents",
    "ocr_formulas": "select doc_id, case doc_id % 3 when 0 then true when 1 then false else length(replace(text, '{', '')) = length(replace(text, '}', '')) and len(regexp_extract_all(text, '[A-Za-z]{4,}')) <= 6 end as accepted from documents",
    "ocr_text": "with m as (select doc_id, case when doc_id % 10 = 0 then repeat('same ', 9) when doc_id % 10 = 1 then '  ' else text end as t from documents), w as (select doc_id, regexp_replace(t, '^\\s+|\\s+$', '', 'g') as c, regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]+') as k from m), r as (select doc_id, c, case when len(k) < 6 then 0.0 else len(list_filter(range(1, len(k)), lambda i: k[i] = k[i + 1])) / (len(k) - 1)::double end as rr from w) select doc_id, c <> '' and rr < 0.25 as accepted, ((c <> '')::int + (rr < 0.25)::int + (c <> '')::int + 1) / 4.0::double as score, round(rr, 6) as repeat_ratio from r",
}
