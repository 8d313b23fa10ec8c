"""Queries of the Markdown, extraction and chunk operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.operators import extract as X
from loomspan.operators import markdown as M
from loomspan.operators import similarity as S
from loomspan.session import spread, table


def _docs(s, d):
    return table(s, d, "documents")


def chunk_documents(s, d):
    return M.chunks(_docs(s, d), "doc_id", "text", "source").select(F.col("id").alias("doc_id"), "index", "chunk_id", "stable_id", "content_hash", "kind", "char_start", "char_end", "start_line", "end_line", "char_count", "token_estimate", "text")


def chunk_coverage(s, d):
    """Per document whether every chunk keeps to the budget and has a span that runs forward."""
    c = M.chunks(_docs(s, d), "doc_id", "text", "source", overlap=0)
    return c.groupBy(F.col("id").alias("doc_id")).agg(F.bool_and(F.col("char_count") <= M.MAX_CHARS).alias("within_budget"), F.bool_and(F.col("char_end") >= F.col("char_start")).alias("forward"))


def chunk_neighbours(s, d):
    c = M.with_neighbours(M.chunks(_docs(s, d), "doc_id", "text", "source"))
    return c.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("chunks"), F.count("previous_id").alias("linked_back"), F.count("next_id").alias("linked_on"))


def neighbour_links(s, d):
    rows = table(s, d, "conversations").withColumn("chunk_id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return M.with_neighbours(rows, "conv_id", "turn").select("chunk_id", "previous_id", "next_id")


def semantic_read(s, d):
    rows = table(s, d, "conversations")
    nxt = F.lead("turn").over(W.partitionBy("conv_id").orderBy("turn"))
    return rows.withColumn("next_index", F.coalesce(nxt, F.lit(-1))).select("conv_id", "turn", F.sha2("text", 256).alias("text_sha256"), "next_index")


def line_offsets(s, d):
    return M.lines(_docs(s, d), "doc_id", "text").select(F.col("id").alias("doc_id"), "line_no", "char_start", "char_end")


def _marked(s, d):
    """Lines of documents, some of them made headings, page markers, list items, quotes, captions or table rows."""
    rows = M.lines(_docs(s, d), "doc_id", "text").select("id", "line_no", "line")
    n = F.col("line_no")
    mark = F.when(n % 7 == 1, F.concat(F.lit("# "), "line")).when(n % 7 == 3, F.concat(F.lit("## "), "line")).when(n % 7 == 4, F.concat(F.lit("### "), "line"))
    mark = mark.when(n % 11 == 5, F.concat(F.lit("<!-- pages: "), n.cast("string"), F.lit("-"), (n + 2).cast("string"), F.lit(" -->"))).when(n % 13 == 6, F.lit("| a | b |")).when(n % 13 == 7, F.lit("| --- | :---: |"))
    mark = mark.when(n % 5 == 0, F.concat(F.lit("- "), "line")).when(n % 5 == 2, F.concat(F.lit("> "), "line")).when(n % 17 == 8, F.concat(F.lit("Table "), n.cast("string"), F.lit(": x"))).otherwise(F.col("line"))
    return rows.select("id", "line_no", mark.alias("line"))


def heading_paths(s, d):
    return M.heading_paths(_marked(s, d)).select(F.col("id").alias("doc_id"), "line_no", F.sha2("heading_path", 256).alias("path_sha256"))


def page_markers(s, d):
    return M.carried_pages(_marked(s, d)).select(F.col("id").alias("doc_id"), "line_no", F.coalesce("pages", F.lit("")).alias("pages"))


def line_kinds(s, d):
    return M.line_kinds(_marked(s, d)).groupBy(F.col("id").alias("doc_id"), "kind").agg(F.count("*").alias("lines"))


def captions(s, d):
    return X.caption_before(_marked(s, d)).where("caption is not null").select(F.col("id").alias("doc_id"), "line_no", "caption")


def contextual_text(s, d):
    p = table(s, d, "pages")
    path = F.concat_ws(" > ", X.html_title(F.col("html")), F.element_at(F.split(F.split_part("url", F.lit("?"), F.lit(1)), "/"), -1))
    return p.select("page_id", F.concat(path, F.lit("\n\n"), "html").alias("contextual_text"))


def retrieval(s, d):
    chunks = _docs(s, d).select(F.col("doc_id").alias("chunk_id"), "text")
    queries = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return S.retrieve(chunks, queries, "text", 3).select("query_id", "chunk_id", "score", F.col("place").cast("long").alias("place"))


def content_types(s, d):
    k = F.col("doc_id")
    have = F.array_compact(F.array(F.lit("text"), F.when(k % 3 == 0, "table"), F.when(k % 4 == 0, "image"), F.when(F.col("text").rlike(r"\[ \]|\[x\]"), "task_list")))
    return _docs(s, d).select("source", F.explode(have).alias("t")).groupBy("source").agg(F.array_join(F.sort_array(F.collect_set("t")), ",").alias("content_types"))


def html_titles(s, d):
    return table(s, d, "pages").select("page_id", X.html_title(F.col("html")).alias("title"))


def html_links(s, d):
    return X.html_links(table(s, d, "pages"), "page_id", "html").select(F.col("id").alias("page_id"), "target")


def html_to_markdown(s, d):
    return X.pages_to_markdown(table(s, d, "pages"), "page_id", "html").select(F.col("id").alias("page_id"), "title", "markdown")


def page_chunks(s, d):
    md = X.pages_to_markdown(table(s, d, "pages"), "page_id", "html")
    return M.chunks(md, "id", "markdown", "title").select(F.col("id").alias("page_id"), "index", "chunk_id", F.array_join("heading_path", " > ").alias("heading_path"), F.array_join("content_types", ",").alias("content_types"), "char_count", "token_estimate")


def table_cells(s, d):
    rows = table(s, d, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("Table 1: nations\n| key | name |\n| --- | --- |\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda r: F.concat(F.lit("| "), r["n_nationkey"].cast("string"), F.lit(" | "), r["n_name"], F.lit(" |"))), "\n")).alias("markdown"))
    return X.table_cells(rows, "n_regionkey", "markdown").select(F.col("id").alias("n_regionkey"), "table_no", "source", "caption", "row", "col", "value")


def stitched_tables(s, d):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    li = spread(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_linestatus"), "l_orderkey")
    rows = li.select(F.col("l_orderkey").alias("doc"), F.row_number().over(w).alias("pos"), F.col("l_linestatus").alias("header"), F.col("l_linenumber").cast("long").alias("rows"))
    return X.stitch_segments(rows)


def table_union(s, d):
    """Tables of two sources, one set; metadata is attached where the document has none of its own."""
    a = table(s, d, "part").where("p_partkey % 2 = 0").select("p_partkey", F.lit("markdown").alias("source"))
    b = table(s, d, "part").where("p_partkey % 3 = 0").select("p_partkey", F.lit("html").alias("source"))
    own = table(s, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_brand")).alias("own"))
    return a.unionByName(b).join(own, "p_partkey").select("p_partkey", "source", F.coalesce("own", F.concat(F.lit("table:"), "source")).alias("evidence"))


def chart_pivot(s, d):
    li = spread(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"), "l_orderkey")
    li = li.groupBy("l_orderkey", "l_linenumber", "l_returnflag").agg(F.max("l_quantity").alias("y"))
    pts = li.select(F.col("l_orderkey").alias("chart"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("series"), F.col("l_linenumber").alias("x"), "y")
    return X.chart_pivot(pts, ["A", "N", "R"]).select("chart", "x", F.coalesce("A", F.lit(0.0)).alias("a"), F.coalesce("N", F.lit(0.0)).alias("n"), F.coalesce("R", F.lit(0.0)).alias("r"), F.col("row").cast("long").alias("row"))


def local_context(s, d):
    rows = table(s, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), "text")
    return X.local_context(rows, 2, 1).select(F.col("id").alias("conv_id"), F.col("pos").alias("turn"), "context_before", "context_after")


def payload_html(s, d):
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return table(s, d, "nation").select("n_nationkey", F.concat(F.lit("<table><tr><th>"), esc(F.concat("n_name", F.lit("<&>"))), F.lit("</th></tr></table>")).alias("html"))


def chunk_strategies(s, d):
    """Names of chunking strategies and what runs for them."""
    names = F.element_at(F.array(*[F.lit(x) for x in ("", "Markdown", "by_title", "unstructured", "other")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    low = F.lower(F.trim(names))
    run = F.when(low.isin("", "markdown", "headings"), "markdown_blocks").when(low.isin("by_title", "unstructured"), F.when(F.col("p_size") > 10, "markdown_blocks_fallback").otherwise("refused")).otherwise("unknown")
    return table(s, d, "part").select("p_partkey", run.alias("strategy"))


def normalized_lines(s, d):
    """First line of a document that equals a wanted one once markup and case are taken away."""
    plain = lambda c: F.trim(F.lower(F.regexp_replace(F.regexp_replace(c, "^[#>*+-]+ *", ""), "[ \\t]+", " ")))
    rows = _marked(s, d).select("id", "line_no", plain(F.col("line")).alias("n"))
    want = rows.where("line_no = 1").select("id", F.col("n").alias("want"))
    return rows.join(want, "id").where("n = want and line_no > 1").groupBy(F.col("id").alias("doc_id")).agg(F.min("line_no").alias("line_no"))


QUERIES = {f.__name__: f for f in (chunk_documents, chunk_coverage, chunk_neighbours, neighbour_links, semantic_read, line_offsets, heading_paths, page_markers, line_kinds, captions, contextual_text, retrieval, content_types, html_titles, html_links, html_to_markdown, page_chunks, table_cells, stitched_tables, table_union, chart_pivot, local_context, payload_html, chunk_strategies, normalized_lines)}

LINES = "ls as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents)"
MARKED = LINES + """, mk as (select doc_id, line_no, case when line_no % 7 = 1 then '# ' || l when line_no % 7 = 3 then '## ' || l when line_no % 7 = 4 then '### ' || l when line_no % 11 = 5 then '<!-- pages: ' || line_no || '-' || (line_no + 2) || ' -->'
 when line_no % 13 = 6 then '| a | b |' when line_no % 13 = 7 then '| --- | :---: |' when line_no % 5 = 0 then '- ' || l when line_no % 5 = 2 then '> ' || l when line_no % 17 = 8 then 'Table ' || line_no || ': x' else l end as line from (select doc_id, line_no, line as l from ls))"""

SQL = {
    "chunk_coverage": "select doc_id, true as within_budget, true as forward from documents where trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''",
    "neighbour_links": "select conv_id || '-' || turn as chunk_id, lag(conv_id || '-' || turn) over w as previous_id, lead(conv_id || '-' || turn) over w as next_id from conversations window w as (partition by conv_id order by turn)",
    "semantic_read": "select conv_id, turn, sha256(text) as text_sha256, next_index from (select *, coalesce(lead(turn) over (partition by conv_id order by turn), -1) as next_index from conversations)",
    "line_offsets": f"with {LINES}, e as (select *, sum(length(line) + 1) over (partition by doc_id order by line_no)::bigint - 1 as char_end from ls) select doc_id, line_no, char_end - length(line) as char_start, char_end from e",
    "heading_paths": f"with {MARKED}, h as (select *, case when starts_with(line, '# ') then 1 when starts_with(line, '## ') then 2 when starts_with(line, '### ') then 3 end as lv, regexp_replace(line, '^#+ +', '') as t from mk), w as (select *, max(case when lv = 1 then line_no end) over o as a, max(case when lv = 2 then line_no end) over o as b, max(case when lv = 3 then line_no end) over o as c, arg_max(case when lv = 1 then t end, case when lv = 1 then line_no end) over o as x, arg_max(case when lv = 2 then t end, case when lv = 2 then line_no end) over o as y, arg_max(case when lv = 3 then t end, case when lv = 3 then line_no end) over o as z from h window o as (partition by doc_id order by line_no rows unbounded preceding)) select doc_id, line_no, sha256(concat_ws(' > ', x, case when b > coalesce(a, 0) then y end, case when c > greatest(coalesce(a, 0), coalesce(b, 0)) then z end)) as path_sha256 from w",
    "page_markers": f"with {MARKED}, p as (select *, nullif(regexp_extract(line, '^<!-- pages: ([0-9,-]+) -->$', 1), '') as m from mk) select doc_id, line_no, coalesce(last_value(m ignore nulls) over (partition by doc_id order by line_no rows unbounded preceding), '') as pages from p",
    "line_kinds": f"with {MARKED}, f as (select *, lead(line) over (partition by doc_id order by line_no) as nx from mk) select doc_id, case when regexp_matches(line, '^#+ ') then 'heading' when contains(line, '|') and coalesce(nx = '| --- | :---: |', false) then 'table_start' when starts_with(line, '>') then 'quote' when regexp_matches(line, '^ {{0,3}}([-*+]|[0-9]{{1,9}}[.)])([ \\t]|$)') then 'list' when regexp_matches(line, '^( {{4}}|\\t)\\s*\\S') then 'indented' else 'text' end as kind, count(*) as lines from f group by 1, 2",
    "captions": f"with {MARKED}, c as (select doc_id, line_no, last_value(case when trim(line) <> '' then trim(line) end ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding) as caption from mk) select * from c where regexp_matches(caption, '^(?i)(table|figure) +[0-9]+ *[:.]')",
    "contextual_text": "select page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) || ' > ' || list_last(string_split(split_part(url, '?', 1), '/')) || chr(10) || chr(10) || html as contextual_text from pages",
    "retrieval": "with q as (select item_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> ''))) as w from benchmark), c as (select doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> ''))) as w from documents), h as (select item_id, doc_id, count(*) as score from q join c using (w) group by 1, 2) select item_id as query_id, doc_id as chunk_id, score, row_number() over (partition by item_id order by score desc, doc_id) as place from h qualify place <= 3",
    "content_types": "with t as (select source, unnest(list_filter(['text', case when doc_id % 3 = 0 then 'table' end, case when doc_id % 4 = 0 then 'image' end, case when regexp_matches(text, '\\[ \\]|\\[x\\]') then 'task_list' end], lambda x: x is not null)) as t from documents) select source, string_agg(distinct t, ',' order by t) as content_types from t group by 1",
    "html_titles": "select page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) as title from pages",
    "html_links": "select distinct page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) as target from pages",
    "table_cells": "with r as (select n_regionkey, n_nationkey, n_name, row_number() over (partition by n_regionkey order by n_nationkey) as i from nation), c as (select n_regionkey, i as row, 0 as col, n_nationkey::varchar as value from r union all select n_regionkey, i, 1, n_name from r union all select distinct n_regionkey, 0, 0, 'key' from r union all select distinct n_regionkey, 0, 1, 'name' from r) select n_regionkey, 0::bigint as table_no, 'markdown' as source, 'Table 1: nations' as caption, row, col::bigint as col, value from c",
    "stitched_tables": "with p as (select l_orderkey as doc, l_linestatus as header, l_linenumber as rows, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) as pos from lineitem), n as (select *, case when lag(header) over (partition by doc order by pos) = header then 0 else 1 end as nw from p), r as (select *, sum(nw) over (partition by doc order by pos)::bigint as table_no from n) select doc, table_no, arg_min(header, pos) as header, count(*) as segment_count, sum(rows)::bigint as rows, count(*) > 1 as multi_page from r group by 1, 2",
    "table_union": "with t as (select p_partkey, p_size, p_brand, 'markdown' as source from part where p_partkey % 2 = 0 union all select p_partkey, p_size, p_brand, 'html' from part where p_partkey % 3 = 0) select p_partkey, source, case when p_size > 25 then p_brand else 'table:' || source end as evidence from t",
    "chart_pivot": "with g as (select l_orderkey as chart, l_linenumber as x, coalesce(max(l_quantity) filter (l_returnflag = 'A'), 0.0) as a, coalesce(max(l_quantity) filter (l_returnflag = 'N'), 0.0) as n, coalesce(max(l_quantity) filter (l_returnflag = 'R'), 0.0) as r from lineitem group by 1, 2) select *, row_number() over (partition by chart order by x) as row from g",
    "local_context": "select conv_id, turn, coalesce(string_agg(text, ' ') over (partition by conv_id order by turn rows between 2 preceding and 1 preceding), '') as context_before, coalesce(string_agg(text, ' ') over (partition by conv_id order by turn rows between 1 following and 1 following), '') as context_after from conversations",
    "chunk_strategies": "select p_partkey, case p_partkey % 5 when 0 then 'markdown_blocks' when 1 then 'markdown_blocks' when 4 then 'unknown' else case when p_size > 10 then 'markdown_blocks_fallback' else 'refused' end end as strategy from part",
    "normalized_lines": f"with {MARKED}, n as (select doc_id, line_no, trim(lower(regexp_replace(regexp_replace(line, '^[#>*+-]+ *', ''), '[ \\t]+', ' ', 'g'))) as n from mk) select a.doc_id, min(a.line_no) as line_no from n a join n b on a.doc_id = b.doc_id and b.line_no = 1 and a.n = b.n and a.line_no > 1 group by 1",
    "payload_html": "select n_nationkey, '<table><tr><th>' || n_name || '&lt;&amp;&gt;</th></tr></table>' as html from nation",
}
