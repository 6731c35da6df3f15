"""Queries: time windows, and streams over the events table read as files, run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.plans.base import ORACLE_SQL, query
from lakeloom.plans.extension import _scratch
from lakeloom.streaming import events as ev

_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
_HOUR = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"


def _ntz(df, *names):
    return df.select(*(F.col(c).cast("timestamp_ntz").alias(c) if c in names else F.col(c) for c in df.columns))


@query(_HOUR)
def tumbling_window(t):
    return _ntz(ev.tumbling(t.events, "1 hour", "event_type"), "start")


@query("SELECT date_trunc('hour', ts) - INTERVAL (k) HOUR AS start, count(*) AS n, round(sum(value), 2) AS total FROM events, (VALUES (0), (1)) v(k) GROUP BY 1")
def sliding_window(t):
    return _ntz(ev.tumbling(t.events, "2 hours", slide="1 hour"), "start")


@query(
    """
    WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
         b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a)
    SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n FROM b GROUP BY user_id, s"""
)
def session_windows(t):
    return _ntz(ev.sessions(t.events, "30 minutes", "user_id"), "start", "end")


def _collected(t, rows, mode: str, schema: str):
    """Runs a stream to its end; what its batches gave, as a table in the shared folder."""
    path = _scratch(t)
    # an idempotent sink: a batch that runs again overwrites its own folder
    ev.run_once(rows, f"{path}/state", mode, lambda df, k: df.write.mode("overwrite").parquet(f"{path}/out/batch={k}"))
    return t.spark.read.schema(f"{schema}, batch int").parquet(f"{path}/out")


def _source(t, parts: int = 4) -> str:
    """The events as files in order of time, one a batch."""
    path = f"{_scratch(t)}/in"
    by = t.events.repartitionByRange(parts, "ts").sortWithinPartitions("ts")
    by.write.parquet(path)
    return path


def _ordered(t, rows, path: str, at: int, parts: int = 8) -> int:
    """Adds rows to the files at path, each file later in time than those before it, as its time of writing says, which is
    the order a stream reads files in. Returns how many files there are so far."""
    more = _scratch(t)
    rows.repartitionByRange(parts, "ts").sortWithinPartitions("ts").write.parquet(more)
    jvm = t.spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(more), jvm.org.apache.hadoop.fs.Path(path)
    files = source.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(target)
    for name in sorted(f.getPath().getName() for f in files.listStatus(source) if f.getPath().getName().startswith("part-")):
        to = jvm.org.apache.hadoop.fs.Path(target, f"{at:06d}-{name}")
        files.rename(jvm.org.apache.hadoop.fs.Path(source, name), to)
        files.setTimes(to, 1_600_000_000_000 + 60_000 * at, -1)
        at += 1
    return at


def _end(t, time: str):
    """A row that lets the watermark pass all before it."""
    return t.spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(time).cast("timestamp_ntz").alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))


def _in_order(t) -> str:
    """The events as files in order of time, and at last a row far in the future that closes all windows. A watermark
    drops no row of files in this order."""
    path = f"{_scratch(t)}/in"
    _ordered(t, _end(t, "2100-01-01"), path, _ordered(t, t.events, path, 0), 1)
    return path


@query(_HOUR)
def stream_tumbling(t):
    rows = ev.tumbling(ev.stream(t.spark, _source(t), _SCHEMA), "1 hour", "event_type")
    out = _collected(t, rows, "complete", "start timestamp, event_type string, n long, total double")
    last = out.agg(F.max("batch").alias("batch"))
    return _ntz(out.join(F.broadcast(last), "batch").drop("batch"), "start")


@query("SELECT DISTINCT user_id FROM events")
def stream_deduplicated(t):
    rows = ev.deduplicated(ev.stream(t.spark, _source(t), _SCHEMA, delay="40 days"), "user_id").select("user_id")
    return _collected(t, rows, "append", "user_id long").select("user_id")


@query("SELECT DISTINCT user_id, date_trunc('hour', ts) AS hour FROM events")
def stream_deduplicated_hourly(t):
    """The time is part of the key, so the watermark lets the state of hours gone by go."""
    rows = ev.stream(t.spark, _in_order(t), _SCHEMA, files=2, delay="1 hour")
    rows = rows.select(F.window("ts", "1 hour").alias("w"), "user_id").dropDuplicates(["w", "user_id"])
    out = _collected(t, rows.select("user_id", F.col("w.start").alias("hour")), "append", "user_id long, hour timestamp")
    return _ntz(out.filter("user_id >= 0").drop("batch"), "hour")


@query("SELECT a.user_id, a.ts AS first_ts, b.ts AS then_ts FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'view' AND b.event_type = 'purchase'")
def stream_join(t):
    """Files come in order, so an hour's delay drops nothing and lets state go that no later row can join."""
    path = _in_order(t)
    read = lambda kind: ev.stream(t.spark, path, _SCHEMA, files=2, delay="1 hour").filter(F.col("event_type") == kind).select("user_id", "ts")
    rows = ev.followed(read("view"), read("purchase"), "user_id", "1 HOUR")
    return _ntz(_collected(t, rows, "append", "user_id long, first_ts timestamp, then_ts timestamp").drop("batch"), "first_ts", "then_ts")


_FOLLOWED = """
    SELECT coalesce(a.user_id, b.user_id) AS user_id, a.ts AS first_ts, b.ts AS then_ts
    FROM (SELECT * FROM events WHERE event_type = 'view') a {how} JOIN (SELECT * FROM events WHERE event_type = 'purchase') b
    ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR"""


def _followed(t, how: str):
    path = _in_order(t)
    # the last row stays on both sides: Spark filters below the watermark, which would never see it
    read = lambda kind: ev.stream(t.spark, path, _SCHEMA, files=2, delay="1 hour").filter(F.col("event_type").isin(kind, "end")).select("user_id", "ts")
    rows = ev.followed(read("view"), read("purchase"), "user_id", "1 HOUR", how)
    out = _collected(t, rows, "append", "user_id long, first_ts timestamp, then_ts timestamp")
    return _ntz(out.filter("user_id >= 0").drop("batch"), "first_ts", "then_ts")


@query(_FOLLOWED.format(how="LEFT"))
def stream_join_left(t):
    """Views without a purchase within the hour come too, when the watermark has passed it."""
    return _followed(t, "left_outer")


@query(_FOLLOWED.format(how="FULL"))
def stream_join_full(t):
    return _followed(t, "full_outer")


def _rocksdb(t, run):
    """run() with the state store that the newer interface of custom state needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(name)
    t.spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return run()
    finally:
        t.spark.conf.set(name, before)


@query(
    """
    WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
         b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a)
    SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) FILTER (WHERE event_type = 'view') AS views,
           count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) AS n, list_reverse(list(value ORDER BY ts DESC)[1:3]) AS last_values FROM b GROUP BY user_id, s"""
)
def stream_baskets(t):
    """Sessions with map and list state and timers."""
    rows = ev.baskets(ev.stream(t.spark, _in_order(t), _SCHEMA, files=2, delay="1 hour"), 30 * 60_000_000, "user_id")
    out = _rocksdb(t, lambda: _collected(t, rows, "append", "start timestamp, end timestamp, user_id long, kinds map<string,long>, last_values array<double>"))
    of = lambda kind: F.coalesce(F.try_element_at("kinds", F.lit(kind)), F.lit(0).cast("long")).alias(kind + "s")
    n = F.aggregate(F.map_values("kinds"), F.lit(0).cast("long"), lambda a, x: a + x).alias("n")
    return _ntz(out.filter("user_id >= 0").select("start", "end", "user_id", of("view"), of("purchase"), n, "last_values"), "start", "end")


@query("SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def stream_state(t):
    """Totals held as custom state; each user's last report is the whole."""
    rows = ev.running_totals(ev.stream(t.spark, _source(t), _SCHEMA).select("user_id", "value"), "user_id")
    out = _collected(t, rows, "update", "user_id long, n long, total double")
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 2).alias("total"))


@query("SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def stream_state_v2(t):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(name)
    t.spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = ev.running_totals_v2(ev.stream(t.spark, _source(t), _SCHEMA).select("user_id", "value"), "user_id")
        out = _collected(t, rows, "update", "user_id long, n long, total double")
    finally:
        t.spark.conf.set(name, before)
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 2).alias("total"))


@query(_HOUR)
def stream_tumbling_append(t):
    rows = ev.tumbling(ev.stream(t.spark, _in_order(t), _SCHEMA, files=2, delay="1 hour"), "1 hour", "event_type")
    out = _collected(t, rows, "append", "start timestamp, event_type string, n long, total double")
    return _ntz(out.filter("event_type <> 'end'").drop("batch"), "start")


@query(ORACLE_SQL["session_windows"])
def stream_sessions(t):
    rows = ev.sessions(ev.stream(t.spark, _in_order(t), _SCHEMA, files=2, delay="1 hour"), "30 minutes", "user_id")
    out = _collected(t, rows, "append", "start timestamp, end timestamp, user_id long, n long")
    return _ntz(out.filter("user_id >= 0").drop("batch"), "start", "end")


@query(ORACLE_SQL["session_windows"])
def stream_state_timeout(t):
    """Sessions in custom state that times out."""
    rows = ev.closing_sessions(ev.stream(t.spark, _in_order(t), _SCHEMA, files=2, delay="1 hour"), 30 * 60_000_000, "user_id")
    out = _collected(t, rows, "append", "start timestamp, end timestamp, user_id long, n long")
    return _ntz(out.filter("user_id >= 0").drop("batch"), "start", "end")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE ts >= (SELECT date_trunc('hour', min(ts) + (max(ts) - min(ts)) / 2) FROM events) GROUP BY 1, 2")
def stream_late_rows(t):
    """The later half of the events comes first, then rows that move the watermark past the earlier half, whose rows are
    late when they come and are dropped. A watermark takes effect a batch after the one that moves it."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    middle = F.date_trunc("hour", F.timestamp_micros((F.min(at) + (F.max(at) - F.min(at)) / 2).cast("long"))).cast("timestamp_ntz")
    middle = t.events.agg(middle.alias("middle")).scalar()
    later, earlier = t.events.filter(F.col("ts") >= middle), t.events.filter(F.col("ts") < middle)
    path = f"{_scratch(t)}/in"
    n = _ordered(t, later, path, 0, 2)
    for time in ("2100-01-01", "2100-01-02"):
        n = _ordered(t, _end(t, time), path, n, 1)
    n = _ordered(t, earlier, path, n, 2)
    _ordered(t, _end(t, "2100-01-03"), path, n, 1)
    found = ev.tumbling(ev.stream(t.spark, path, _SCHEMA, delay="1 hour"), "1 hour", "event_type")
    out = _collected(t, found, "append", "start timestamp, event_type string, n long, total double")
    return _ntz(out.filter("event_type <> 'end'").drop("batch"), "start")
