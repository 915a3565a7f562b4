"""Queries over build samples, traces and token streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import monitor as W
from lectern.sources.places import fresh_place
from lectern.streaming.monitor import PATIENCE, marker_stream, request_traces
from lectern.streaming.monitor import watchdog_stream as watchdog_stream_of

from . import adapters as A
from .registry import registry

QUERIES, ORACLES, query = registry()


def samples(spark, d):
    """Events as build samples: the user's last digit is the process, the event type the stage."""
    e, u = F.col("event_id"), F.col("user_id")
    return A.read(spark, d, "events").select(
        (u % 10).alias("pid"), e.alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("_m"), F.col("event_type").alias("stage"), F.when(e % 9 != 0, F.col("value")).alias("latency"),
        F.when(e % 8 != 0, F.floor(e / 50)).alias("progress"), (e % 23).cast("int").alias("gpu"), (e % 100).cast("int").alias("gpu_used"), F.lit(100).alias("gpu_total"), (90 + e % 11).cast("double").alias("cpu"),
    ).withColumn("ts", F.col("_m") / 1e6).drop("_m")


_SAMPLES = """sm AS (SELECT user_id % 10 AS pid, event_id AS seq, epoch_us(ts)::DOUBLE / 1e6 AS ts, event_type AS stage, CASE WHEN event_id % 9 <> 0 THEN value END AS latency, CASE WHEN event_id % 8 <> 0 THEN event_id // 50 END AS progress,
event_id % 23 AS gpu, event_id % 100 AS gpu_used, 100 AS gpu_total, (90 + event_id % 11)::DOUBLE AS cpu FROM events)"""
_RULES = """
n1 AS (SELECT *, sum((latency IS NOT NULL)::INT) OVER (PARTITION BY pid, stage ORDER BY ts, seq) AS nth FROM sm),
n2 AS (SELECT *, list(CASE WHEN nth <= 10 THEN latency END) FILTER (WHERE latency IS NOT NULL AND nth <= 10) OVER st AS firsts, list(latency) FILTER (WHERE latency IS NOT NULL) OVER st AS lasts,
 lag(gpu, 1) OVER o AS g1, lag(gpu, 2) OVER o AS g2, lag(cpu, 1) OVER o AS c1, lag(cpu, 2) OVER o AS c2, lag(cpu, 3) OVER o AS c3, lag(cpu, 4) OVER o AS c4,
 list({'s': seq, 'p': progress}) FILTER (WHERE progress IS NOT NULL) OVER (PARTITION BY pid ORDER BY ts RANGE BETWEEN 600 PRECEDING AND CURRENT ROW) AS near
 FROM n1 WINDOW o AS (PARTITION BY pid ORDER BY ts, seq), st AS (PARTITION BY pid, stage ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n3 AS (SELECT *, list_sort(firsts) AS f, list_filter(near, lambda x: x.s < seq) AS nr FROM n2),
n4 AS (SELECT *, CASE WHEN len(f) > 0 THEN (f[((len(f) - 1) // 2) + 1] + f[(len(f) // 2) + 1]) / 2 END AS baseline FROM n3),
n5 AS (SELECT *, coalesce(baseline > 0 AND latency / baseline >= 5 AND len(lasts) >= 2 AND lasts[-1] / baseline >= 5 AND lasts[-2] / baseline >= 5, false) AS e1,
 coalesce(progress IS NOT NULL AND len(nr) > 0 AND len(list_filter(nr, lambda x: x.p <> progress)) = 0, false) AS e2, coalesce(baseline > 0 AND latency / baseline >= 2, false) AS w1,
 coalesce(gpu < 20 AND g1 < 20 AND g2 < 20, false) AS w2, coalesce(gpu_used / gpu_total > 0.95, false) AS w3, coalesce(cpu > 95 AND c1 > 95 AND c2 > 95 AND c3 > 95 AND c4 > 95, false) AS w4 FROM n4)
"""


@query(f"""WITH {_SAMPLES}, {_RULES} SELECT pid, seq, stage, baseline, CASE WHEN e1 OR e2 THEN 'error' WHEN w1 OR w2 OR w3 OR w4 THEN 'warning' ELSE 'running' END AS status,
concat_ws(',', CASE WHEN e1 THEN 'latency' END, CASE WHEN e2 THEN 'stall' END, CASE WHEN w1 THEN 'latency' END, CASE WHEN w2 THEN 'gpu' END, CASE WHEN w3 THEN 'memory' END, CASE WHEN w4 THEN 'cpu' END) AS reasons FROM n5""")
def watchdog_rules(spark, d):
    return W.watchdog(samples(spark, d))


@query(f"WITH {_SAMPLES}, {_RULES} SELECT pid, seq, stage, CASE WHEN e1 OR e2 THEN 'error' WHEN w1 OR w2 OR w3 OR w4 THEN 'warning' ELSE 'running' END AS status FROM n5")
def watchdog_stream(spark, d):
    """The same samples replayed as a stream; state is kept for each process."""
    place = fresh_place(spark, "watchdog")
    rows = samples(spark, d)
    rows.write.parquet(f"{place}/in")  # one batch, in which each process is sorted
    source = spark.readStream.schema(rows.schema).parquet(f"{place}/in")
    out = watchdog_stream_of(source).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint")
    out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/out")


@query("""WITH t AS (SELECT 't' || (conv_id - conv_id % 2) || '-' || turn AS trace_id, conv_id AS seq, length(text) AS total_ms, CASE WHEN turn % 4 = 0 THEN 'error' ELSE 'ok' END AS status FROM conversations),
f AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY seq) AS n FROM t) SELECT trace_id, seq, total_ms, status FROM f WHERE n = 1""")
def trace_dedupe(spark, d):
    c = F.col("conv_id")
    rows = A.read(spark, d, "conversations").select(F.concat(F.lit("t"), c - c % 2, F.lit("-"), "turn").alias("trace_id"), c.alias("seq"), F.length("text").alias("total_ms"), F.when(F.col("turn") % 4 == 0, "error").otherwise("ok").alias("status"))
    return W.one_trace_each(rows)


@query("SELECT user_id, min(event_id) FILTER (WHERE event_type = 'click') AS first_token, max(event_id) AS last_event FROM events GROUP BY 1")
def first_token_time(spark, d):
    click = F.col("event_type") == "click"
    rows = A.read(spark, d, "events").select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("seq"), click.alias("token"))
    return W.first_tokens(rows).withColumnRenamed("trace_id", "user_id")


@query("""SELECT 'c' || conv_id || '-' || turn AS trace_id, text || '。' AS shown FROM conversations WHERE role = 'assistant'""")
def marker_stream_filter(spark, d):
    """Every answer as a stream of tokens, with a marker that arrives in three of them; open brackets are kept as state."""
    place = fresh_place(spark, "tokens")
    rows = A.read(spark, d, "conversations").filter("role = 'assistant'").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("trace_id"), F.array(F.col("text"), F.lit("["), F.concat(F.lit("s"), "turn"), F.lit("]。")).alias("ts"))
    tokens = rows.select("trace_id", F.posexplode("ts").alias("seq", "token")).select("trace_id", F.col("seq").cast("long").alias("seq"), "token", (F.col("seq") == 3).alias("final"))
    tokens.write.parquet(f"{place}/in")
    source = spark.readStream.schema(tokens.schema).parquet(f"{place}/in")
    out = marker_stream(source).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint")
    out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    parts = F.transform(F.sort_array(F.collect_list(F.struct("seq", "shown"))), lambda x: x["shown"])
    return spark.read.parquet(f"{place}/out").groupBy("trace_id").agg(F.array_join(parts, "").alias("shown"))


_TRACES = f"""
WITH m AS (SELECT 'r' || event_id AS trace_id, epoch_us(ts) AS started, CASE WHEN event_id % 7 = 3 THEN NULL
    ELSE epoch_us(ts) + round(value * 1e6)::BIGINT * (1 + 40 * (event_id % 13 = 5)::INT) END AS e,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS o, props FROM events),
d AS (SELECT *, e IS NULL OR e > started + {PATIENCE * 1000} AS lost FROM m)
SELECT trace_id, started, CASE WHEN lost THEN started + {PATIENCE * 1000} ELSE e END AS ended, CASE WHEN lost THEN 'disconnect' ELSE o END AS outcome,
    CASE WHEN NOT lost AND o = 'error' THEN props END AS message FROM d
"""


@query(_TRACES)
def request_trace_stream(spark, d):
    """Events as requests: a start, and after ``value`` seconds an end or an error; some end too late, some never.

    They're replayed as a stream in which every start and every second end comes twice, and ends with a mark of another
    day, whose time lets the last deadlines pass.
    """
    place = fresh_place(spark, "requests")
    e = F.col("event_id")
    events = A.read(spark, d, "events").select(F.concat(F.lit("r"), e).alias("trace_id"), e, F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type", "value", "props")
    length = F.round(F.col("value") * 1e6).cast("long") * F.when(e % 13 == 5, 41).otherwise(1)
    failed = F.col("event_type") == "error"
    start = F.struct(F.col("us"), F.lit("start").alias("kind"), F.lit(None).cast("string").alias("message"))
    end = F.struct((F.col("us") + length).alias("us"), F.when(failed, "error").otherwise("end").alias("kind"), F.when(failed, F.col("props")).alias("message"))
    marks = F.array(start, start, F.when(e % 7 != 3, end), F.when((e % 7 != 3) & (e % 2 == 0), end))
    rows = events.select("trace_id", F.inline(F.array_compact(marks)))
    last = events.agg(F.max("us").alias("us")).select(F.lit(None).cast("string").alias("trace_id"), (F.col("us") + 86_400_000_000).alias("us"), F.lit("clock").alias("kind"), F.lit(None).cast("string").alias("message"))
    rows.unionByName(last).select("trace_id", F.timestamp_micros("us").alias("ts"), "kind", "message").write.parquet(f"{place}/in")
    source = spark.readStream.schema("trace_id string, ts timestamp, kind string, message string").parquet(f"{place}/in")
    out = request_traces(source).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint")
    out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/out")
