"""Queries over event streams and file scans."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from loomspan.sources import archives as A
from loomspan.sources import converters as C
from loomspan.sources import eventlog as G
from loomspan.sources import outputs as O
from loomspan.streaming import events as E
from loomspan.streaming import timers as K
from loomspan.session import shared_folder, table


def stream_changes(s, d):
    return E.drained(E.change_feed(E.read_events(s, d)))


def stream_idempotent(s, d):
    found = E.drained(E.idempotent(E.read_events(s, d), ["user_id", "props"], "100 days").select("event_id", "user_id", "props", "ts"))
    return found.groupBy("user_id", "props").agg(F.count("*").alias("kept"))


def stream_windows(s, d):
    """Counts per day and type of a stream that is read to its end."""
    return E.drained_windows(E.read_events(s, d)).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_leases(s, d):
    return E.drained(E.leases(E.read_events(s, d)))


def lease_expiries(s, d):
    """Leases of ten minutes that events renew: all that ran out by the last event of the table."""
    return K.drained(K.lease_expiries(E.read_events(s, d)))


def cache_ttl(s, d):
    """Requests of a user and an event type; an answer lives for a day."""
    return K.drained(K.cache_requests(E.read_events(s, d), ["user_id", "event_type"], 86_400_000))


def event_log_changes(s, d):
    """The change feed over the event log, read as a stream with offsets."""
    return E.drained(E.change_feed(G.follow(s, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))))


def event_replay(s, d):
    """Events behind a client's last one, here those of the second half of the log, counted by user."""
    log = f"{d}/events.parquet"
    half = G.replay(s, log).agg(F.max("event_id")).first()[0] // 2
    return G.replay(s, log, half).groupBy("user_id").agg(F.count("*").alias("events"), F.min("event_id").alias("first"))


def written_outputs(s, d):
    """Documents written as Markdown and JSON from one parse, and what the published manifest says of the Markdown."""
    folder = shared_folder(s)
    docs = table(s, d, "documents").select(F.format_string("doc-%d", "doc_id").alias("name"), F.col("source"), "text", F.to_json(F.struct("lang")).alias("metadata"))
    O.write_formats(docs, folder, ["markdown", "json"])
    return O.read_outputs(s, folder).where("format = 'markdown'").select("name", "source", "bytes", "sha256", "media_type")


def archive_members(s, d):
    """Conversations as archives of their turns, twenty of them in an outer archive, converted as far as its budget goes."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        outer = io.BytesIO()
        with zipfile.ZipFile(outer, "w", zipfile.ZIP_DEFLATED) as z:
            for conv, own in rows.sort_values(["conv_id", "turn"]).groupby("conv_id"):
                inner = io.BytesIO()
                with zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as y:
                    for turn, text in zip(own["turn"], own["text"], strict=True):
                        y.writestr(f"{turn}.txt", text or "")
                z.writestr(f"{conv}.zip", inner.getvalue())
        return pd.DataFrame({"path": [f"/in/{rows['pack'].iloc[0]}.zip"], "content": [outer.getvalue()]})

    packs = table(s, d, "conversations").withColumn("pack", F.floor(F.col("conv_id") / 20))
    files = packs.groupBy("pack").applyInPandas(pack, "path string, content binary")
    return A.convert_archives(files).select("root", "path", "depth", F.array_join(F.col("place").cast("array<string>"), "/").alias("place"), "action", F.when(F.col("depth") == 1, F.col("size")).otherwise(0).alias("size"))


def convert_rows(s, d):
    """Rows of several tables, written as files of their own formats in memory and converted."""
    n = table(s, d, "nation")
    name = F.col("n_name")
    body = F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("k,v\n1,"), name)).when(F.col("n_nationkey") % 5 == 1, F.concat(F.lit('{"name": "'), name, F.lit('"}'))).when(F.col("n_nationkey") % 5 == 2, F.concat(F.lit("<html><head><title>T</title></head><body><p>"), name, F.lit("</p></body></html>"))).when(F.col("n_nationkey") % 5 == 3, F.concat(F.lit("<a><b x='1'>"), name, F.lit("</b></a>"))).otherwise(F.lit("{broken"))
    ext = F.element_at(F.array(*[F.lit(e) for e in (".csv", ".json", ".html", ".xml", ".json")]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    files = n.select(F.concat(F.lit("in/"), F.col("n_nationkey").cast("string"), ext).alias("path"), body.cast("binary").alias("content"))
    return C.convert_files(files).select("path", "engine", "markdown", F.col("error").isNotNull().alias("failed"))


QUERIES = {f.__name__: f for f in (stream_changes, stream_idempotent, stream_windows, stream_leases, lease_expiries, cache_ttl, event_log_changes, event_replay, written_outputs, archive_members, convert_rows)}

TIMED = "t as (select event_id, user_id, event_type, epoch_us(ts) // 1000 as ms from events)"

SQL = {
    "stream_changes": "with b as (select *, lag(event_type) over (partition by user_id order by event_id) as p from events) select event_id, user_id, event_type from b where p is null or p <> event_type",
    "stream_idempotent": "select user_id, props, 1::bigint as kept from events group by 1, 2",
    "stream_windows": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events group by 1, 2",
    "stream_leases": "with b as (select event_id, user_id, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) over (partition by user_id order by event_id) as gap_ms from events) select * from b where gap_ms > 600000",
    "lease_expiries": f"with {TIMED}, n as (select *, lead(ms) over (partition by user_id order by ms, event_id) as next from t) select user_id, event_id, ms + 600000 as expired_ms from n where coalesce(next, (select max(ms) from t)) > ms + 600000",
    "cache_ttl": f"with recursive {TIMED}, r as (select *, row_number() over (partition by user_id, event_type order by ms, event_id) as n from t), fold as (select user_id, event_type, n, event_id, false as hit, event_id as answer, ms as stored from r where n = 1 union all select r.user_id, r.event_type, r.n, r.event_id, r.ms - f.stored < 86400000, case when r.ms - f.stored < 86400000 then f.answer else r.event_id end, case when r.ms - f.stored < 86400000 then f.stored else r.ms end from fold f join r on r.user_id = f.user_id and r.event_type = f.event_type and r.n = f.n + 1) select event_id, hit, answer from fold",
    "event_log_changes": "with b as (select *, lag(event_type) over (partition by user_id order by event_id) as p from events) select event_id, user_id, event_type from b where p is null or p <> event_type",
    "event_replay": "select user_id, count(*) as events, min(event_id) as first from events where event_id > (select max(event_id) // 2 from events) group by 1",
    "written_outputs": "select 'doc-' || doc_id as name, source, strlen(text) as bytes, sha256(text) as sha256, 'text/markdown' as media_type from documents",
    "archive_members": "with c as (select conv_id, conv_id // 20 as pack, dense_rank() over (partition by conv_id // 20 order by conv_id) - 1 as i, turn, row_number() over (partition by conv_id order by turn) - 1 as j, text from conversations), m as (select distinct pack, conv_id, i, -1 as j, null as turn, null as text from c union all select pack, conv_id, i, j, turn, text from c), n as (select *, row_number() over (partition by pack order by i, j) as n from m), a as (select *, min(n) over (partition by pack, conv_id) as first from n) select '/in/' || pack || '.zip' as root, case when j < 0 then conv_id || '.zip' else turn || '.txt' end as path, case when j < 0 then 0 else 1 end::int as depth, case when j < 0 then i::varchar else i || '/' || j end as place, case when n <= 25 then 'converted' else 'skipped' end as action, coalesce(strlen(text), 0) as size from a where j < 0 or first <= 25",
    "convert_rows": "select 'in/' || n_nationkey || (['.csv', '.json', '.html', '.xml', '.json'])[1 + n_nationkey % 5] as path, (['text_data', 'text_data', 'html', 'xml_rss', 'text_data'])[1 + n_nationkey % 5] as engine, case n_nationkey % 5 when 0 then '| k | v |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | ' || n_name || ' |' when 1 then '```json' || chr(10) || '{' || chr(10) || '  \"name\": \"' || n_name || '\"' || chr(10) || '}' || chr(10) || '```' when 2 then '# T' || chr(10) || chr(10) || n_name when 3 then '- a' || chr(10) || '  - b x=\"1\": ' || n_name end as markdown, n_nationkey % 5 = 4 as failed from nation",
}
