"""Queries of the relational operators, on orders as jobs and events as their log."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import lexicons as L
from loomspan.operators import jobs as J
from loomspan.session import table

NOW = "timestamp '2024-01-20 00:00:00'"


def _jobs(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    status = F.element_at(F.create_map(*[F.lit(x) for x in ("P", "pending", "F", "completed", "O", "processing")]), F.col("o_orderstatus"))
    return o.select("o_orderkey", "c_name", "o_orderpriority", status.alias("status"), "o_orderdate")


def history_page(s, d):
    page = J.history(_jobs(s, d), "1_r#", ["c_name"], None, [F.desc("o_orderdate"), F.desc("o_orderkey")], 2, 25)
    wide = J.history(_jobs(s, d), "URGENT", ["c_name", "o_orderpriority"], "queued", [F.desc("o_orderdate"), F.desc("o_orderkey")], 2, 25)
    return wide.select("o_orderkey", "c_name", "status").union(page.select("o_orderkey", "c_name", "status"))


def jobs_page(s, d):
    rows = _jobs(s, d).where("status = 'processing'")
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(100).limit(50).select("o_orderkey")
    return page.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > 150)


def status_metrics(s, d):
    return J.status_metrics(_jobs(s, d), "status")


def _queue(s, d):
    e = table(s, d, "events")
    k = F.col("event_id")
    status = F.when(k % 4 == 0, "pending").when(k % 4 == 1, "processing").when(k % 4 == 2, "completed").otherwise("processing")
    ts = F.col("ts").cast("timestamp")
    return e.select(k, "user_id", status.alias("status"), F.when(k % 3 == 0, ts + F.expr("interval 1 day")).alias("lease_until"), F.when(k % 5 != 0, ts).alias("started_at"), ts.alias("queued_at"))


def queue_recover(s, d):
    return J.recoverable(_queue(s, d), F.expr(NOW)).select("event_id", "status")


def recovery_actions(s, d):
    q = J.recoverable(_queue(s, d), F.expr(NOW))
    action = J.recovery_action(F.col("event_id") % 5, F.lit(3), F.col("event_id") % 7 != 0)
    return q.select("event_id", action.alias("action")).groupBy("action").agg(F.count("*").alias("jobs"))


def sweep_missing(s, d):
    q = _queue(s, d).where("status = 'processing'")
    files = table(s, d, "events").where("event_id % 6 <> 1").select("event_id")
    return q.join(files, "event_id", "left_anti").select("event_id", "user_id")


def latest_state(s, d):
    return J.latest_by(table(s, d, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "event_id"])


def settings_upsert(s, d):
    rows = table(s, d, "events").withColumn("value", F.when(F.col("event_id") % 4 == 0, None).otherwise(F.col("event_id")))
    kept = rows.where("value is not null")  # a masked value keeps the stored one
    return J.latest_by(kept, ["user_id", "event_type"], ["event_id"], ["value"])


def settings_grouped(s, d):
    rows = settings_upsert(s, d)
    return rows.groupBy(F.col("event_type").alias("category")).agg(F.count("*").alias("settings"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("user_id", "value"))), lambda r: F.concat_ws("=", r["user_id"].cast("string"), r["value"].cast("string"))), ";"), 256).alias("sha256"))


def guarded_transitions(s, d):
    e = table(s, d, "events").withColumn("state", F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("processing"))
    return J.guarded_transitions(e, ["user_id"], ["event_id"], "state").select("event_id", "user_id", "state")


def idempotent_events(s, d):
    e = table(s, d, "events")
    return e.groupBy("user_id", "props").agg(F.min("event_id").alias("event_id"))


def delete_actions(s, d):
    return _jobs(s, d).select("status", J.delete_action(F.col("status"), F.col("o_orderkey") % 10 == 0).alias("action")).groupBy("status", "action").agg(F.count("*").alias("jobs"))


def status_overlay(s, d):
    stored = _jobs(s, d).select("o_orderkey", "status", (F.col("o_orderkey") % 90).alias("progress"))
    live = _jobs(s, d).where("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "failed").otherwise("processing").alias("status"), (F.col("o_orderkey") % 97).alias("progress"))
    return J.overlay(stored, live, "o_orderkey")


def cache_lookup(s, d):
    e = table(s, d, "events").withColumn("key", F.col("event_id") % 500)
    latest = J.latest_by(e.withColumn("expires", F.unix_millis(F.col("ts").cast("timestamp")) + 7 * 86_400_000), ["key"], ["event_id"], ["event_id", "expires"])
    return latest.where(F.col("expires") >= F.unix_millis(F.expr(NOW))).select("key", "event_id")


def cache_keys(s, d):
    p = table(s, d, "pages")
    plain = F.regexp_replace("url", r"/models/[^/:?]+", "/models/*")
    return p.select("page_id", F.sha2(F.concat_ws("\n", F.lit("POST"), F.regexp_replace(plain, r"\?.*$", ""), F.lower(F.lit("Accept: */*"))), 256).alias("cache_key"))


def trace_ring(s, d):
    return J.ring_buffer(table(s, d, "events"), "user_id", ["event_id"], 50).select("event_id", "user_id")


def trace_truncation(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(J.truncated(F.col("text"), 500), 256).alias("shown_sha256"))


def schema_merge(s, d):
    a = table(s, d, "events").where("event_id % 2 = 0").select("event_id", F.col("user_id").cast("string").alias("user_id"))
    b = table(s, d, "events").where("event_id % 2 = 1").select("event_id", "event_type")
    return a.unionByName(b, allowMissingColumns=True)


def ordered_dedup(s, d):
    docs = table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    return docs.groupBy("text_sha256").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def rate_limit_streak(s, d):
    out = J.streaks(table(s, d, "events"), "user_id", "event_id", F.col("event_type") == "error", F.col("event_type") == "purchase")
    return out.where("is_limited").select("event_id", "user_id", F.col("streak").cast("long").alias("streak"), "signal")


def backoff_schedule(s, d):
    after = F.when(F.col("event_id") % 4 == 0, (F.col("event_id") % 90).cast("double"))
    return table(s, d, "events").select("event_id", J.backoff(F.col("event_id") % 8, after).alias("wait_s"))


def stage_progress(s, d):
    names = F.array(*[F.lit(n[0].title()) for n in L.PROGRESS_STAGES], F.lit("idle"))
    k = F.col("event_id")
    return table(s, d, "events").select(k, J.stage_progress(F.element_at(names, (k % 9 + 1).cast("int")), k % 11, F.lit(8)).alias("progress")).na.fill(-1)


def monotonic_progress(s, d):
    e = table(s, d, "events").withColumn("pct", F.col("event_id") % 120 - 10)
    return J.monotonic_progress(e, "user_id", "event_id", "pct").select("event_id", "shown")


def eta(s, d):
    k = F.col("event_id")
    return table(s, d, "events").select(k, J.eta_seconds(k % 110, (k % 300).cast("double")).alias("eta_s")).na.fill(-1)


def event_changes(s, d):
    return J.changes(table(s, d, "events"), "user_id", "event_id", "event_type").select("event_id", "user_id", "event_type")


def resume_batch(s, d):
    """Inputs that have no output yet are converted; the totals of a batch."""
    want = table(s, d, "documents").select("doc_id", (F.length("text") < 60).alias("too_short"))
    done = want.where("doc_id % 4 = 0").select("doc_id")
    todo = want.join(done, "doc_id", "left_anti")
    return todo.agg(F.count_if(~F.col("too_short")).alias("succeeded"), F.count_if("too_short").alias("failed")).crossJoin(F.broadcast(done.agg(F.count("*").alias("skipped"))))


def archive_budget(s, d):
    p = table(s, d, "part").select("p_brand", "p_partkey", (F.col("p_size").cast("long") * 50_000).alias("size"), (F.col("p_partkey") % 130).cast("double").alias("ratio"))
    return J.archive_admission(p, "p_brand", "p_partkey", "size", "ratio", 20_971_520, 25, 2_097_152, 100.0)


def archive_routing(s, d):
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 11 == 0, "../").when(k % 13 == 0, "/").otherwise(""), F.lit("f"), k.cast("string"), F.when(k % 3 == 0, ".pdf").otherwise(".txt"))
    suspicious = F.startswith(name, F.lit("/")) | F.contains(name, F.lit(".."))
    action = F.when(k % 17 == 0, "listed").when(k % 5 > 2, "depth").when(suspicious, "suspicious_name").when(F.col("p_size") > 42, "too_large").when(F.endswith(name, F.lit(".pdf")), "needs_models").otherwise("convert")
    return table(s, d, "part").select(k, action.alias("action"))


QUERIES = {f.__name__: f for f in (history_page, jobs_page, status_metrics, queue_recover, recovery_actions, sweep_missing, latest_state, settings_upsert, settings_grouped, guarded_transitions, idempotent_events, delete_actions, status_overlay, cache_lookup, cache_keys, trace_ring, trace_truncation, schema_merge, ordered_dedup, rate_limit_streak, backoff_schedule, stage_progress, monotonic_progress, eta, event_changes, resume_batch, archive_budget, archive_routing)}

JOBS = "jobs as (select o_orderkey, c_name, o_orderpriority, case o_orderstatus when 'P' then 'pending' when 'F' then 'completed' else 'processing' end as status, o_orderdate from orders join customer on o_custkey = c_custkey)"
QUEUE = f"q as (select event_id, user_id, case event_id % 4 when 0 then 'pending' when 2 then 'completed' else 'processing' end as status, case when event_id % 3 = 0 then ts + interval 1 day end as lease_until, case when event_id % 5 <> 0 then ts end as started_at from events), rec as (select * from q where status = 'pending' or (status = 'processing' and (lease_until < {NOW} or (lease_until is null and (started_at is null or started_at < {NOW} - interval 600 seconds)))))"
UPSERT = "u as (select user_id, event_type, max(event_id) filter (event_id % 4 <> 0) as value from events group by 1, 2 having max(event_id) filter (event_id % 4 <> 0) is not null)"
_stages = "[" + ", ".join(f"'{n[0].title()}'" for n in L.PROGRESS_STAGES) + ", 'idle']"

SQL = {
    "history_page": f"with {JOBS} select * from (select o_orderkey, c_name, status from jobs where (contains(lower(c_name), 'urgent') or contains(lower(o_orderpriority), 'urgent')) and status = 'pending' order by o_orderdate desc, o_orderkey desc limit 25 offset 25) union all select * from (select o_orderkey, c_name, status from jobs where contains(lower(c_name), '1_r#') order by o_orderdate desc, o_orderkey desc limit 25 offset 25)",
    "jobs_page": f"with {JOBS}, r as (select * from jobs where status = 'processing') select o_orderkey, (select count(*) from r) as total, (select count(*) from r) > 150 as has_more from r order by o_orderdate desc, o_orderkey limit 50 offset 100",
    "status_metrics": f"with {JOBS} select status, count(*) as jobs from jobs group by 1 union all select 'total', count(*) from jobs",
    "queue_recover": f"with {QUEUE} select event_id, status from rec",
    "recovery_actions": f"with {QUEUE} select case when event_id % 5 >= 3 then 'budget_exhausted' when event_id % 7 = 0 then 'missing_file' else 'resubmit' end as action, count(*) as jobs from rec group by 1",
    "sweep_missing": f"with {QUEUE} select event_id, user_id from q where status = 'processing' and event_id % 6 = 1",
    "latest_state": "select user_id, event_type, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "settings_upsert": f"with {UPSERT} select * from u",
    "settings_grouped": f"with {UPSERT} select event_type as category, count(*) as settings, sha256(string_agg(user_id || '=' || value, ';' order by user_id)) as sha256 from u group by 1",
    "guarded_transitions": "with e as (select event_id, user_id, case event_type when 'purchase' then 'completed' when 'error' then 'failed' else 'processing' end as state from events), f as (select *, coalesce(bool_or(state <> 'processing') over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), false) as over_ from e) select event_id, user_id, state from f where not over_",
    "idempotent_events": "select user_id, props, min(event_id) as event_id from events group by 1, 2",
    "delete_actions": f"with {JOBS} select status, case when status = 'completed' or o_orderkey % 10 = 0 then 'deleted' else 'refused' end as action, count(*) as jobs from jobs group by 1, 2",
    "status_overlay": f"with {JOBS} select o_orderkey, case when status <> 'completed' and o_orderkey % 3 = 0 then case when o_orderkey % 2 = 0 then 'failed' else 'processing' end else status end as status, case when o_orderkey % 3 = 0 then greatest(o_orderkey % 90, o_orderkey % 97) else o_orderkey % 90 end as progress from jobs",
    "cache_lookup": f"select event_id % 500 as key, max(event_id) as event_id from events group by 1 having max_by(ts, event_id) + interval 7 days >= {NOW}",
    "cache_keys": "select page_id, sha256('POST' || chr(10) || regexp_replace(regexp_replace(url, '/models/[^/:?]+', '/models/*', 'g'), '\\?.*$', '') || chr(10) || 'accept: */*') as cache_key from pages",
    "trace_ring": "select event_id, user_id from events qualify row_number() over (partition by user_id order by event_id desc) <= 50",
    "trace_truncation": "select doc_id, sha256(case when length(text) > 500 then substr(text, 1, 500) || '... [truncated ' || (length(text) - 500) || ' chars]' else text end) as shown_sha256 from documents",
    "schema_merge": "select event_id, case when event_id % 2 = 0 then user_id::varchar end as user_id, case when event_id % 2 = 1 then event_type end as event_type from events",
    "ordered_dedup": "select sha256(text) as text_sha256, min(doc_id) as doc_id, count(*) as copies from documents group by 1",
    "rate_limit_streak": "with r as (select *, sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by event_id) as run from events), t as (select *, sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id, run order by event_id)::bigint as streak from r) select event_id, user_id, streak, streak % 3 = 0 as signal from t where event_type = 'error'",
    "backoff_schedule": "select event_id, least(60.0, greatest(least(60.0, 2 * pow(2, event_id % 8)), case when event_id % 4 = 0 then event_id % 90 else 0 end))::double as wait_s from events",
    "stage_progress": f"with l as (select event_id, lower(({_stages})[1 + event_id % 9]) as label, least(1.0, (event_id % 11) / 8.0::double) as f from events) select event_id, case " + " ".join(f"when contains(label, '{n}') then round_even({a}::double + {b - a}::double * f, 0)::bigint" for n, a, b in L.PROGRESS_STAGES) + " else -1 end as progress from l",
    "monotonic_progress": "select event_id, max(least(96, greatest(0, event_id % 120 - 10))) over (partition by user_id order by event_id) as shown from events",
    "eta": "select event_id, case when event_id % 110 > 10 and event_id % 110 < 100 then greatest(1, floor((event_id % 300)::double * 100 / (event_id % 110) - (event_id % 300))::bigint) else -1 end as eta_s from events",
    "event_changes": "with b as (select *, lag(event_type) over (partition by user_id order by event_id) as p from events) select event_id, user_id, event_type from b where p is null or p <> event_type",
    "resume_batch": "select count(*) filter (doc_id % 4 <> 0 and length(text) >= 60) as succeeded, count(*) filter (doc_id % 4 <> 0 and length(text) < 60) as failed, count(*) filter (doc_id % 4 = 0) as skipped from documents",
    "archive_budget": "with recursive m as (select p_brand, p_partkey, p_size::bigint * 50000 as size, (p_partkey % 130)::double as ratio, row_number() over (partition by p_brand order by p_partkey) as i from part), f as (select p_brand, i, p_partkey, case when size > 2097152 then 'child_too_large' when ratio > 100 then 'ratio' when size > 20971520 then 'total_limit' else 'converted' end as action, case when size > 2097152 or ratio > 100 or size > 20971520 then 0 else size end as used, case when size > 2097152 or ratio > 100 or size > 20971520 then 0 else 1 end as n from m where i = 1 union all select m.p_brand, m.i, m.p_partkey, case when f.n >= 25 then 'count_limit' when size > 2097152 then 'child_too_large' when ratio > 100 then 'ratio' when f.used + size > 20971520 then 'total_limit' else 'converted' end, case when f.n >= 25 or size > 2097152 or ratio > 100 or f.used + size > 20971520 then f.used else f.used + size end, case when f.n >= 25 or size > 2097152 or ratio > 100 or f.used + size > 20971520 then f.n else f.n + 1 end from f join m on m.p_brand = f.p_brand and m.i = f.i + 1) select p_brand, p_partkey as at, action from f",
    "archive_routing": "select p_partkey, case when p_partkey % 17 = 0 then 'listed' when p_partkey % 5 > 2 then 'depth' when p_partkey % 11 = 0 or p_partkey % 13 = 0 then 'suspicious_name' when p_size > 42 then 'too_large' when p_partkey % 3 = 0 then 'needs_models' else 'convert' end as action from part",
}
