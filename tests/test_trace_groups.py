"""Many traces in few groups: each keeps its own state and deadline, and Python is called once a group, not once a trace."""

from lectern.streaming import monitor


def test_traces_share_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(monitor, "TRACE_GROUPS", 2)
    schema = "trace_id string, us long, kind string, message string"
    minute = 60_000_000
    first, second = [], []
    for i in range(60):
        at = (i + 6000) * 1_000_000
        first += [(f"t{i}", at, "start", None)] * 2
        if i % 3 == 1:
            first.append((f"t{i}", at + minute, "end", None))
        if i % 3 == 2:
            second.append((f"t{i}", at + minute, "error", "why"))
    second += [("t1", 6062 * 1_000_000, "end", None), (None, 200 * minute, "clock", None)]
    for n, rows in enumerate((first, second)):
        df = spark.createDataFrame(rows, schema).selectExpr("trace_id", "timestamp_micros(us) ts", "kind", "message")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{n}")
    source = spark.readStream.schema("trace_id string, ts timestamp, kind string, message string").parquet(f"{tmp_path}/in*")
    out = monitor.request_traces(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
    out.trigger(availableNow=True).start().awaitTermination()
    found = {r.trace_id: (r.started, r.ended, r.outcome, r.message) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(found) == 60
    for i in range(60):
        at = (i + 6000) * 1_000_000
        wanted = (at + minute, "ok", None) if i % 3 == 1 else (at + minute, "error", "why") if i % 3 == 2 else (at + 10 * minute, "disconnect", None)
        assert found[f"t{i}"] == (at, *wanted)
