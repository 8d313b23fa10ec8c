"""Leases and cache entries against plain versions, over batches and restarts."""

import datetime as dt
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loomspan.streaming import events as E
from loomspan.streaming import timers as K

START = dt.datetime(2024, 3, 1)


def put(folder, name, rows):
    """Events (event_id, minute, user) as a file; files are read in the order of their times."""
    at = pa.array([START + dt.timedelta(minutes=m) for _, m, _ in rows], pa.timestamp("us"))
    columns = {"event_id": [i for i, *_ in rows], "ts": at, "user_id": [u for *_, u in rows], "event_type": ["a" for _ in rows], "value": [0.0 for _ in rows], "props": ["" for _ in rows]}
    pq.write_table(pa.table(columns), f"{folder}/{name}.parquet")


def rows_of(seed):
    draw = random.Random(seed)
    minutes = sorted(draw.randrange(400) for _ in range(120))
    return [(i, m, draw.randrange(12)) for i, m in enumerate(minutes)]


def expiries(rows, limit=10):
    base = int(START.replace(tzinfo=dt.UTC).timestamp() * 1000)
    end, out = max(m for _, m, _ in rows), []
    for user in {u for *_, u in rows}:
        own = [(m, i) for i, m, u in rows if u == user]
        for (m, i), after in zip(own, [*(m for m, _ in own[1:]), end], strict=True):
            if after > m + limit:
                out.append((user, i, base + (m + limit) * 60_000))
    return sorted(out)


@pytest.mark.parametrize("files", [1, 5])
def test_every_lease_that_ends_is_reported_once(spark, tmp_path, files):
    rows = rows_of(files)
    for k in range(files):
        put(tmp_path, f"e{k}", rows[k * len(rows) // files : (k + 1) * len(rows) // files])
    got = K.drained(K.lease_expiries(E.read_events(spark, str(tmp_path), "*.parquet")))
    assert sorted(map(tuple, got.collect())) == expiries(rows)


def test_leases_go_on_after_a_restart(spark, tmp_path):
    """Three runs with one checkpoint report what one run would; a late event before the watermark changes nothing."""
    rows, folder = rows_of(3), tmp_path / "in"
    folder.mkdir()
    out = str(tmp_path / "out")
    for k in range(3):
        put(folder, f"e{k}", rows[k * 40 : k * 40 + 40] + ([(900, 0, 99)] if k == 2 else []))
        got = K.drained(K.lease_expiries(E.read_events(spark, str(folder), "*.parquet")), out)
    assert sorted(map(tuple, got.collect())) == expiries(rows)


def test_cache_entries_expire(spark, tmp_path):
    rows = rows_of(4)
    want, stored = [], {}
    for i, m, u in rows:
        hit = u in stored and m - stored[u][1] < 30
        if not hit:
            stored[u] = (i, m)
        want.append((i, hit, stored[u][0]))
    for k in range(3):
        put(tmp_path, f"e{k}", rows[k * 40 : k * 40 + 40])
    got = K.drained(K.cache_requests(E.read_events(spark, str(tmp_path), "*.parquet"), ["user_id"], 30 * 60_000))
    assert sorted(map(tuple, got.collect())) == want


def test_cache_asks_for_its_state_once():
    """A key's first requests cost one read, one write and one timer; a later miss also takes back the timer that it knows."""
    from datetime import UTC, datetime

    from pyspark.sql import Row

    from loomspan.streaming.timers import Cache

    calls = []

    class Handle:
        held = None

        def __getattr__(self, name):
            def call(*args):
                calls.append((name, *args))
                if name == "update":
                    self.held = args[0]
                return self if name == "getValueState" else self.held if name == "get" else None
            return call

    cache = Cache(1000)
    cache.init(Handle())
    calls.clear()
    at = lambda ms: datetime.fromtimestamp(ms / 1000, UTC)
    assert [r.hit for r in cache.handleInputRows((1,), iter([Row(ts=at(0), event_id=1), Row(ts=at(500), event_id=2)]), None)] == [False, True]
    assert [c[0] for c in calls] == ["get", "update", "registerTimer"]
    calls.clear()
    assert [r.answer for r in cache.handleInputRows((1,), iter([Row(ts=at(5000), event_id=3)]), None)] == [3]
    assert calls == [("get",), ("deleteTimer", 1000), ("update", (3, 5000)), ("registerTimer", 6000)]
