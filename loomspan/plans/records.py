"""Queries of JSON records, option contracts, error codes, references and probe rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import contracts as C
from loomspan.functions import records as R
from loomspan.operators import extract as X
from loomspan.operators import routing as G
from loomspan.plans.routing import QUALITY
from loomspan.session import table


def _filled(pattern: str, *columns):
    """The pattern with its {} replaced by the columns."""
    parts = pattern.split("{}")
    out = [F.lit(parts[0])]
    for c, p in zip(columns, parts[1:], strict=True):
        out += [c.cast("string"), F.lit(p)]
    return F.concat(*out)


def redact_nested(s, d):
    k = F.col("event_id")
    made = _filled('{"user": {"name": "n{}", "api_token": "t{}", "links": [{"page_url": "https://u:p@Example.com:80/x/{}?q=1#f"}, [1, {"password": 2}]]}, "note": "a", "n": {}}', k, k, k, k)
    return table(s, d, "events").select(k, R.redact_json(made).alias("redacted"))


def mask_nested(s, d):
    k = F.col("event_id")
    made = _filled('{"providers": [{"name": "p{}", "openai_api_key": "k{}", "api_keys": ["a", "", "b"]}], "token": "", "deep": {"secret": "{}"}}', k, k, k)
    return table(s, d, "events").select(k, R.mask_json(made).alias("masked"))


def request_keys(s, d):
    k = F.col("event_id")
    url = F.when(k % 2 == 0, F.lit("https://Api.example.com/v1/models/m-1:generate?key=x")).otherwise(F.lit("https://api.example.com/v1/messages"))
    headers = F.create_map(F.lit("accept"), F.lit("*/*"), F.lit("Authorization"), k.cast("string"), F.lit("a-b"), F.col("event_type"))
    body = _filled('{"stream": true, "q": {}, "model": "m{}", "a": [1, 2]}', k % 10, k)
    return table(s, d, "events").select(k, R.request_key(F.when(k % 7 == 0, "GET").otherwise("POST"), url, headers, body).alias("request_key"))


def media_probes(s, d):
    k = F.col("p_partkey")
    audio = _filled('{"codec_type": "audio", "codec_name": "aac", "sample_rate": "44100", "channels": 2, "duration": "{}.25"}', k)
    video = F.lit('{"codec_type": "video", "codec_name": "h264", "width": 640, "height": 360}')
    made = F.when(k % 4 == 0, F.lit("no json")).otherwise(F.concat(F.lit('{"streams": ['), F.when(k % 4 == 1, audio).when(k % 4 == 2, video).otherwise(F.concat(video, F.lit(", "), audio)), F.lit('], "format": {"format_name": "mp4", "duration": "7.5", "bit_rate": "128000"}}')))
    return table(s, d, "part").select(k, R.media_probe(made).alias("m")).where("m is not null").select("p_partkey", "m.*").fillna(0)


def error_codes(s, d):
    k = F.col("o_orderkey")
    names = [*C.EXIT_CODES, "never_heard_of"]
    code = F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int"))
    return table(s, d, "orders").select(k, C.exit_code(F.when(k % 5 != 0, F.when(k % 2 == 0, F.lower(code)).otherwise(code))).cast("long").alias("exit_code"))


def option_contracts(s, d):
    k = F.col("p_partkey")
    options = F.create_map(F.lit("chunk_max_tokens"), (k % 40).cast("string"), F.lit("dedup_max_distance"), F.when(k % 3 == 0, "x").otherwise((k % 80).cast("string")), F.lit("conversion_profile"), F.when(k % 2 == 0, "fast").otherwise("slow"), F.lit("unheard_of"), F.lit("1"))
    return table(s, d, "part").select(k, F.array_join(C.option_problems(options), ",").alias("problems"))


def mixed_gate(s, d):
    k = F.col("p_partkey")
    options = F.create_map(F.lit("page_range"), F.when(k % 3 == 0, "1-2").otherwise(""), F.lit("conversion_profile"), F.when(k % 5 == 0, "fast").otherwise("auto"), F.lit("enable_mixed_pdf_routing"), F.when(k % 2 == 0, "true").otherwise("false"))
    plan = C.mixed_plan(options, k % 4, F.lit(9), F.lit(9), F.when(k % 11 == 0, 10).otherwise(9))
    return table(s, d, "part").select(k, plan["accepted"].alias("accepted"), plan["confidence"].alias("confidence"), F.array_join(plan["blockers"], ",").alias("blockers"))


def answer_items(s, d):
    """Items of answers that stand in a fence, in prose or alone."""
    k = F.col("o_orderkey")
    items = _filled('[{"index": 0, "label": "a{}"}, {"index": 9, "label": "c"}]', k)
    raw = F.when(k % 3 == 0, F.concat(F.lit("```json\n"), items, F.lit("\n```"))).when(k % 3 == 1, F.concat(F.lit("Here it is: "), items, F.lit(" as asked."))).otherwise(items)
    got = F.from_json(R.json_part(raw), "array<struct<index:int,label:string>>")
    return table(s, d, "orders").select(k, F.explode(F.filter(got, lambda x: x["index"] < 3)).alias("i")).select("o_orderkey", "i.index", "i.label")


def token_usage(s, d):
    k = F.col("event_id")
    raw = F.when(k % 3 == 0, _filled('{"usage": {"prompt_tokens": {}, "completion_tokens": "{}"}}', k, k % 9)).when(k % 3 == 1, _filled('{"usage": {"input_tokens": {}, "output_tokens": "many"}}', k)).otherwise("{}")
    return table(s, d, "events").select(k, R.token_usage(raw).alias("u")).select("event_id", "u.*")


def eval_manifests(s, d):
    k = F.col("doc_id")
    sample = F.when(k % 4 == 0, '{"sample_id": " ", "golden_text": "a", "candidate_text": "b"}').when(k % 4 == 1, '{"sample_id": "s", "golden_text": "a"}').when(k % 4 == 2, '{"sample_id": "s", "golden_path": "g.md", "candidate_text": ""}').otherwise("")
    made = F.concat(F.lit('{"schema_version": "'), F.when(k % 5 == 0, "v0").otherwise("eval_manifest.v1"), _filled('", "name": "m{}", "samples": [', k), sample, F.lit("]}"))
    return table(s, d, "documents").select(k, R.eval_samples(made).alias("m")).select("doc_id", "m.name", "m.problem", F.size("m.samples").cast("long").alias("n_samples"))


def asset_references(s, d):
    k = F.col("page_id")
    made = _filled('see [a\\]b](http://x/({}) "t") and ![i](<p q.png>) or <https://auto/{}> <img src="z.png" alt="A" title=\'T\'> [a\\]b](http://x/({}) "u") <a href="/h">so <b>it</b> is</a> [no] (x)', k, k, k)
    return X.assets(table(s, d, "pages").select(k, made.alias("text")), "page_id", "text").select(F.col("id").alias("page_id"), "kind", "target", "label", "title")


def document_probes(s, d):
    """Documents as pages of their source: quality and text layer from their texts, short ones as full-page images, many short lines as layout; the source's name ends in the generator's."""
    text = F.col("text")
    docs = table(s, d, "documents").select("source", text, F.size(F.split(text, "\n")).alias("lines"))
    full, quality = F.length(text) < 400, G.text_quality(text)
    images = F.least(F.regexp_count(text, F.lit(r"\$\$\$|###")), F.lit(3))
    layout = F.least(F.lit(1.0), F.col("lines") * 40 / F.greatest(F.length(text), F.lit(1)))
    sandwich = G.sandwich_likelihood(G.visual_complexity(images, full), G.text_layer(text), quality)
    creator = F.when(F.col("source").endswith("1"), "Canon Copier").when(F.col("source").endswith("2"), "pdfTeX-1.40")
    pages = docs.select("source", F.length(text).alias("chars"), quality.alias("quality"), images.alias("images"), full.alias("full_page"), layout.alias("layout"), sandwich.alias("sandwich"), creator.alias("creator"), F.lit(None).cast("string").alias("producer"))
    return G.document_probe(pages, "source")


QUERIES = {f.__name__: f for f in (redact_nested, mask_nested, request_keys, media_probes, error_codes, option_contracts, mixed_gate, answer_items, token_usage, eval_manifests, asset_references, document_probes)}

_codes = [*C.EXIT_CODES, "never_heard_of"]
_exits = [*C.EXIT_CODES.values(), 1]
SQL = {
    "redact_nested": """select event_id, '{"n":' || event_id || ',"note":"a","user":{"api_token":"[REDACTED]","links":[{"page_url":"https://example.com:80/x/' || event_id || '"},[1,{"password":"[REDACTED]"}]],"name":"n' || event_id || '"}}' as redacted from events""",
    "mask_nested": """select event_id, '{"deep":{"secret":"****"},"providers":[{"api_keys":["****","****"],"name":"p' || event_id || '","openai_api_key":"****"}],"token":""}' as masked from events""",
    "request_keys": """select event_id, case when event_id % 7 <> 0 then sha256('POST' || chr(10) || 'api.example.com' || case when event_id % 2 = 0 then '/v1/models/<model>:generate' else '/v1/messages' end || chr(10) || '{"a-b":"' || event_type || '","accept":"*/*"}' || chr(10) || '{"a":[1,2],"q":' || event_id % 10 || '}') end as request_key from events""",
    "media_probes": "with k as (select p_partkey, p_partkey % 4 as m from part) select p_partkey, case when m > 0 then 'mp4' end as format, case m when 1 then p_partkey + 0.25 when 2 then 7.5 when 3 then p_partkey + 0.25 end::double as duration_s, case when m > 0 then 128000 end as bit_rate, case when m in (1, 3) then 'aac' end as audio_codec, case when m in (2, 3) then 'h264' end as video_codec, case when m in (1, 3) then 44100 else 0 end as sample_rate, case when m in (1, 3) then 2 else 0 end as channels, case m when 1 then 0 when 2 then 640 when 3 then 640 end as width, case m when 1 then 0 when 2 then 360 when 3 then 360 end as height, case when m > 0 then m in (1, 3) end as has_audio, case m when 1 then 1 when 2 then 1 when 3 then 2 end as stream_count from k where m > 0",
    "error_codes": f"select o_orderkey, case when o_orderkey % 5 = 0 then 0 else ({_exits})[1 + o_orderkey % {len(_codes)}] end::bigint as exit_code from orders",
    "option_contracts": "select p_partkey, array_to_string(list_filter([case when p_partkey % 40 < 16 then 'chunk_max_tokens' end, case when p_partkey % 2 = 1 then 'conversion_profile' end, case when p_partkey % 3 = 0 or p_partkey % 80 > 64 then 'dedup_max_distance' end], lambda x: x is not null), ',') as problems from part",
    "mixed_gate": "with k as (select p_partkey, list_filter([case when p_partkey % 3 = 0 then 'page_range' end, case when p_partkey % 5 = 0 then 'fast_profile' end], lambda x: x is not null) as b from part), a as (select *, (p_partkey % 2 = 0 or len(b) = 0) and p_partkey % 4 > 1 and p_partkey % 11 <> 0 as ok from k) select p_partkey, ok as accepted, case when ok then case when p_partkey % 2 = 0 then 0.8 else 0.86 end end::double as confidence, array_to_string(b, ',') as blockers from a",
    "answer_items": "select o_orderkey, 0 as index, 'a' || o_orderkey as label from orders",
    "token_usage": "select event_id, case event_id % 3 when 2 then 0 else event_id end as prompt_tokens, case event_id % 3 when 0 then event_id % 9 else 0 end as completion_tokens from events",
    "eval_manifests": "select doc_id, 'm' || doc_id as name, case when doc_id % 5 = 0 then 'version' when doc_id % 4 = 3 then 'no_samples' when doc_id % 4 = 0 then 'sample_id' when doc_id % 4 = 1 then 'text_or_path' end as problem, (doc_id % 4 <> 3)::bigint as n_samples from documents",
    "asset_references": "select page_id, unnest(['link', 'image', 'link', 'html_image', 'html_link']) as kind, unnest(['http://x/(' || page_id || ')', 'p q.png', 'https://auto/' || page_id, 'z.png', '/h']) as target, unnest(['a\\]b', 'i', '', 'A', 'so it is']) as label, unnest(['t', '', '', 'T', '']) as title from pages",
    "document_probes": f"""with d as (select source, text, length(text) as n, length(text) < 400 as full_page, least(len(regexp_extract_all(text, '\\$\\$\\$|###')), 3) as images, least(1.0, len(string_split(text, chr(10))) * 40 / greatest(length(text), 1)::double) as layout, least(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) / 900.0::double, 1.0) as own from documents),
s as (select *, {QUALITY} as quality, least(1.0, images / 3.0::double * 0.45 + case when full_page then 0.55 else 0.0 end) as seen from d),
p as (select source, count(*) as pages, avg(n)::double as chars, count(*) filter (n >= 80) / count(*)::double as held, avg(quality) as q, avg(images)::double as im, count(*) filter (full_page) / count(*)::double as f, avg(layout) as l, avg(greatest(0.0, least(1.0, seen * 0.55 + own * 0.25 + (1.0 - quality) * 0.20))) as sw,
  case right(source, 1) when '1' then 0.40 when '2' then -0.30 else 0.0 end::double as meta from s group by source),
y as (select *, held * 0.55::double + least(chars / 900, 1.0::double) * 0.45::double as layer from p),
e as (select *, case when meta >= 0 or layer >= 0.10 then meta else 0.0 end as eff from y),
x as (select *, greatest(0.0, least(1.0, (1 - layer) * 0.65::double + f * 0.35::double + eff)) as scan, least(1.0::double, im / 3 * 0.45::double + f * 0.55::double) as visual from e)
select source, pages, round(layer, 3) as text_layer_score, round(q, 3) as text_quality_score, round(scan, 3) as scan_likelihood, round(sw, 3) as sandwich_likelihood, round(l, 3) as layout_complexity_score, round(visual, 3) as visual_complexity_score,
  case when layer >= 0.70 and q >= 0.80 and scan <= 0.20 and sw <= 0.40 and visual <= 0.35 and l <= 0.45 then 'fast_pdf' else 'deep_pdf' end as recommended_engine,
  concat_ws(',', case when layer < 0.70 then 'text_layer' end, case when q < 0.80 then 'text_quality' end, case when scan > 0.20 then 'scan' end, case when sw > 0.40 then 'sandwich' end, case when visual > 0.35 then 'visual' end, case when l > 0.45 then 'layout' end, case when eff > 0 then 'metadata_scanner' when eff < 0 then 'metadata_digital' end) as reasons from x""",
}
