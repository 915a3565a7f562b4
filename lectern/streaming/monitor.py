"""Structured Streaming: the watchdog over a stream of samples with bounded state, and the trace sink."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators.monitor import BASELINE, STALL_SECONDS

_OUT = "pid long, seq long, stage string, status string"
#: JSON of what is kept: of a group of traces each with its deadline; of a process the first latencies and the last two of each stage, last loads, recent progress.
_STATE = "kept string"


def judge(kept: dict, s) -> str:
    """Status of one sample; ``kept`` is brought up to date. Nothing kept grows beyond fixed lengths but ten minutes of progress."""
    first, last = kept["first"].setdefault(s.stage, []), kept["last"].setdefault(s.stage, [])
    bad, warn = False, False
    latency = None if pd.isna(s.latency) else float(s.latency)
    if latency is not None and first:
        f = sorted(first)
        base = (f[(len(f) - 1) // 2] + f[len(f) // 2]) / 2
        if base > 0:
            warn |= latency / base >= 2
            bad |= latency / base >= 5 and len(last) == 2 and all(x / base >= 5 for x in last)
    recent = [p for t, p in kept["progress"] if t >= s.ts - STALL_SECONDS]
    if not pd.isna(s.progress):
        bad |= bool(recent) and all(p == s.progress for p in recent)
    load = kept["load"]
    warn |= s.gpu < 20 and len(load) >= 2 and all(g < 20 for g, _ in load[-2:])
    warn |= s.cpu > 95 and len(load) >= 4 and all(c > 95 for _, c in load[-4:])
    warn |= bool(s.gpu_total) and s.gpu_used / s.gpu_total > 0.95
    if latency is not None:
        if len(first) < BASELINE:
            first.append(latency)
        kept["last"][s.stage] = [*last, latency][-2:]
    kept["load"] = [*load, (float(s.gpu), float(s.cpu))][-4:]
    kept["progress"] = [x for x in kept["progress"] if x[0] >= s.ts - STALL_SECONDS]
    if not pd.isna(s.progress):
        kept["progress"].append((float(s.ts), float(s.progress)))
    return "error" if bad else "warning" if warn else "running"


def watchdog_stream(samples: DataFrame) -> DataFrame:
    """pid, seq, stage, status of a stream of samples, each judged against the earlier ones of its process."""
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {"first": {}, "last": {}, "load": [], "progress": []}
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        status = [judge(kept, s) for s in rows.itertuples()]
        state.update((json.dumps(kept),))
        yield rows[["pid", "seq", "stage"]].assign(status=status)

    return samples.groupBy("pid").applyInPandasWithState(update, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


_MARKER = re.compile(r"\[S\d+\]", re.I)


def shown(held: str, token: str) -> tuple[str, str]:
    """What can be shown of ``held`` and a new token, and what is still held: from an open bracket that hasn't closed yet.

    Whole citation markers are left out; other brackets are shown once they close.
    """
    text = held + token
    closed = text.rfind("]") + 1
    opened = text.find("[", closed)
    end = len(text) if opened < 0 else opened
    return _MARKER.sub("", text[:end]), text[end:]


def marker_stream(tokens: DataFrame) -> DataFrame:
    """trace_id, seq, shown of a stream of (trace_id, seq, token, final): what each token adds to the display.

    The state of a trace is the text behind its open bracket; the final token shows what is left, unless it's a marker.
    Tokens of a trace come in order of seq within and between batches.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else ""
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for token, final in zip(rows["token"], rows["final"], strict=True):
            said, held = shown(held, token or "")
            if final:
                said, held = said + _MARKER.sub("", held), ""
            out.append(said)
        if bool(rows["final"].iloc[-1]):
            state.remove()
        else:
            state.update((held,))
        yield rows[["trace_id", "seq"]].assign(shown=out)

    return tokens.groupBy("trace_id").applyInPandasWithState(update, "trace_id string, seq long, shown string", "held string", "append", GroupStateTimeout.NoTimeout)


#: Milliseconds after which a request without an end counts as given up; its trace is known, so that replays are dropped, as long again.
PATIENCE = 600_000
#: Groups that traces are dealt over: what a group's state holds is the open traces divided by them.
TRACE_GROUPS = 2048


def request_traces(marks: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """One trace for each request of a stream of marks (trace_id, ts, kind, message), kind being start, end or error.

    trace_id, started, ended (microseconds), outcome and message: ``ok`` and ``error`` with their times, or ``disconnect``
    for a start whose end doesn't come within ``patience`` milliseconds of event time, ended at that deadline. An end whose
    start never came is a trace without a start. The earliest start and the earliest end or error count (ties: end, then
    the smaller message); what is replayed while the trace is known is dropped, and after that it's too late for the
    watermark. Marks without a trace_id, a time or a known kind are
    left out, but their times move the watermark, as those of a clock. Traces are dealt over groups, as a call of Python for
    each would cost far more than its work; a group's state holds each of its open traces with its own deadline.
    """

    def deadline(kept: list, now: int) -> int:
        first = min(x for x in kept[:2] if x is not None) // 1000
        return max(first + patience * (2 if kept[4] else 1) + 1, now + 1)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = json.loads(state.get[0]) if state.exists else {}
        now, out, heard = state.getCurrentWatermarkMs(), [], {}
        for b in () if state.hasTimedOut else batches:
            for trace, kind, at, said in zip(b["trace_id"], b["kind"], b["us"].tolist(), b["message"], strict=True):
                if isinstance(trace, str):  # a clock's marks have been read for their times
                    heard.setdefault(trace, []).append((at, kind == "error", said or "", kind, said))
        for trace, marks_ in heard.items():
            started, ended, outcome, message, told, _ = known.get(trace, (None, None, None, None, False, 0))
            for at, _, _, kind, said in () if told else sorted(marks_, key=lambda r: r[:3]):
                if kind == "start" and started is None:
                    started = at
                elif kind in ("end", "error") and ended is None:
                    ended, outcome, message = at, "ok" if kind == "end" else "error", said
            if not told and started is not None and ended is not None:
                late = ended > started + patience * 1000
                out.append((trace, started, *((started + patience * 1000, "disconnect", None) if late else (ended, outcome, message))))
                told = True
            if started is not None or ended is not None:
                known[trace] = [started, ended, outcome, message, told, 0]
                known[trace][5] = deadline(known[trace], now)
        for trace in [t for t, x in known.items() if x[5] < now and t not in heard]:
            started, ended, outcome, message, told, _ = kept = known[trace]
            if told:
                del known[trace]
                continue
            out.append((trace, started, ended if started is None else started + patience * 1000, outcome or "disconnect", message))
            kept[4] = True
            kept[5] = deadline(kept, now)
        if known:
            state.update((json.dumps(known),))
            state.setTimeoutTimestamp(max(min(x[5] for x in known.values()), now + 1))
        elif state.exists:
            state.remove()
        if out:
            frame = pd.DataFrame(out, columns=["trace_id", "started", "ended", "outcome", "message"])
            yield frame.astype({"started": "Int64", "ended": "Int64"})

    # a filter of trace_id or kind here would be pushed below the watermark, which then wouldn't see the clock
    rows = marks.withWatermark("ts", "0 seconds").filter("ts is not null").select("trace_id", "ts", F.unix_micros("ts").alias("us"), "kind", "message")
    rows = rows.withColumn("g", F.pmod(F.xxhash64("trace_id"), F.lit(TRACE_GROUPS)))
    result = "trace_id string, started long, ended long, outcome string, message string"
    return rows.groupBy("g").applyInPandasWithState(update, result, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def status_sink(samples: DataFrame, log: str, status: str, checkpoint: str) -> StreamingQuery:
    """Judged samples appended to ``log``, and the last status of each process, rewritten with every batch, in ``status``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("append").json(log)
        last = batch.groupBy("pid").agg(F.max(F.struct("seq", "stage", "status")).alias("last")).select("pid", "last.*")
        try:
            before = batch.sparkSession.read.schema("pid long, seq long, stage string, status string").json(f"{status}/{number - 1}")
            last = before.unionByName(last).groupBy("pid").agg(F.max(F.struct("seq", "stage", "status")).alias("last")).select("pid", "last.*")
        except AnalysisException as error:  # the first batch has none before it
            if "PATH_NOT_FOUND" not in str(error):
                raise
        last.write.mode("overwrite").json(f"{status}/{number}")

    return watchdog_stream(samples).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def trace_sink(traces: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each trace once, whatever is replayed within an hour of it; a batch that can't be written doesn't stop the service."""

    def append(batch: DataFrame, number: int) -> None:
        try:
            batch.write.mode("append").json(path)
        except Exception:  # noqa: BLE001  traces are best effort: requests go on without them
            logging.getLogger(__name__).exception("traces of batch %d are lost", number)

    unique = traces.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["trace_id"])
    return unique.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
