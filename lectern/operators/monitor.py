"""Monitoring: watchdog rules over build samples, trace totals, first tokens. Windows by stage and by process."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BASELINE, STALL_SECONDS = 10, 600


def watchdog(samples: DataFrame) -> DataFrame:
    """Samples (pid, seq, ts, stage, latency, progress, gpu, gpu_used, gpu_total, cpu) with status and reasons.

    Every rule looks at the samples before: the baseline is the median of the first ten latencies of the stage; a stall
    is the same progress in all samples of the last ten minutes.
    """
    of = Window.partitionBy("pid").orderBy("ts", "seq")
    stage = Window.partitionBy("pid", "stage").orderBy("ts", "seq")
    past = stage.rowsBetween(Window.unboundedPreceding, -1)
    nth = F.sum(F.col("latency").isNotNull().cast("int")).over(stage)
    rows = samples.withColumn("_nth", nth)
    rows = rows.withColumn("_first", F.collect_list(F.when(F.col("_nth") <= BASELINE, F.col("latency"))).over(past))
    rows = rows.withColumn("_first", F.array_sort("_first"))
    n = F.size("_first")
    mid = lambda i: F.get("_first", i.cast("int"))
    base = F.when(n > 0, (mid(F.floor((n - 1) / 2)) + mid(F.floor(n / 2))) / 2)
    rows = rows.withColumns({"baseline": base})
    timed = Window.partitionBy("pid", "stage", F.col("latency").isNull()).orderBy("ts", "seq")
    rows = rows.withColumns({"_last": F.array(F.lag("latency", 1).over(timed), F.lag("latency", 2).over(timed))})
    ratio = F.when(F.col("baseline") > 0, F.col("latency") / F.col("baseline"))
    slow = F.forall(F.col("_last"), lambda x: x / F.col("baseline") >= 5)
    # a stall: the last progress before is the same, not older than the span, and what was different before it is older
    earlier = of.rowsBetween(Window.unboundedPreceding, -1)
    told = F.col("progress").isNotNull()
    rows = rows.withColumns({"_same": F.last("progress", True).over(earlier), "_when": F.last(F.when(told, F.col("ts")), True).over(earlier)})
    changed = told & ~F.col("_same").eqNullSafe(F.col("progress"))
    rows = rows.withColumn("_other", F.last(F.when(changed, F.struct(F.col("_when").alias("ts"))), True).over(of.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.col("ts") - STALL_SECONDS
    stalled = told & (F.col("_same") == F.col("progress")) & (F.col("_when") >= span) & (F.col("_other.ts").isNull() | (F.col("_other.ts") < span))
    low = lambda k: F.coalesce(F.lag("gpu", k).over(of) < 20, F.lit(False))
    busy = lambda k: F.coalesce(F.lag("cpu", k).over(of) > 95, F.lit(False))
    rules = {
        "e_latency": (ratio >= 5) & slow,
        "e_stall": stalled,
        "w_latency": ratio >= 2,
        "w_gpu": (F.col("gpu") < 20) & low(1) & low(2),
        "w_memory": F.col("gpu_used") / F.nullif(F.col("gpu_total"), F.lit(0)) > 0.95,
        "w_cpu": (F.col("cpu") > 95) & busy(1) & busy(2) & busy(3) & busy(4),
    }
    rows = rows.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in rules.items()})
    status = F.when(F.col("e_latency") | F.col("e_stall"), "error").when(F.col("w_latency") | F.col("w_gpu") | F.col("w_memory") | F.col("w_cpu"), "warning").otherwise("running")
    reasons = F.array_join(F.array_compact(F.array(*(F.when(F.col(k), F.lit(k[2:])) for k in rules))), ",")
    return rows.select("pid", "seq", "stage", "baseline", status.alias("status"), reasons.alias("reasons"))


def one_trace_each(traces: DataFrame) -> DataFrame:
    """The first row (by seq) of every trace_id."""
    w = Window.partitionBy("trace_id").orderBy("seq")
    return traces.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_tokens(events: DataFrame) -> DataFrame:
    """trace_id, first_token, last_event over (trace_id, seq, token): when its first token came, if one came, and its last event."""
    token = F.when(F.col("token"), F.col("seq"))
    return events.groupBy("trace_id").agg(F.min(token).alias("first_token"), F.max("seq").alias("last_event"))
