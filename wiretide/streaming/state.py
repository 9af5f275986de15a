"""Keyed state: flows in event order, and the alert cooldown.

Both processors keep what has arrived until the watermark has passed it, and only then go on, in event order. What they
publish therefore does not depend on how the input was cut into micro-batches or in which order it came, as long as it
came within the lateness.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wiretide.config import CooldownConfig, FlowConfig
from wiretide.operators.flows import finish, prepare
from wiretide.schema import FLAGS, FLOW_KEY

COUNTED = FLAGS[:5]
_TIMES = ("flow_start_us", "last_us")
_FIGURES = ("packet_count", "total_bytes", "payload_bytes", "length_squares", "pkt_len_min", "pkt_len_max", "gaps", "gap_sum", "gap_squares",
            "first_pkt", *[f"{flag}_count" for flag in COUNTED])
_LISTS = [T.StructField("splt", T.ArrayType(T.IntegerType())), T.StructField("payload_samples", T.ArrayType(T.BinaryType())),
          T.StructField("tls_client_hello", T.BinaryType())]
FLOW_STATE = T.StructType([*[T.StructField(name, T.LongType()) for name in (*_TIMES, *_FIGURES)], *_LISTS])
#: ``watermark_us`` is where the stream stood when the flow was closed
FLOW_OUTPUT = T.StructType([
    *[T.StructField(name, T.IntegerType() if name.endswith("port") else T.StringType()) for name in FLOW_KEY],
    *[T.StructField(name, T.IntegerType()) if name.startswith("pkt_len") else T.StructField(name, T.LongType()) for name in (*_TIMES, *_FIGURES)],
    *_LISTS, T.StructField("watermark_us", T.LongType())])
_WAITING = ["ts_us", "pkt_id", "packet_length", "payload_length", *COUNTED, "sample", "hello"]


@dataclass
class OpenFlow:
    """A flow of one 5-tuple, folded from packets in event order."""

    flow_start_us: int
    last_us: int
    figures: list[int] = field(default_factory=lambda: [0] * len(_FIGURES))
    splt: list[int] = field(default_factory=list)
    samples: list[bytes] = field(default_factory=list)
    hello: bytes | None = None

    @classmethod
    def of(cls, row) -> OpenFlow:
        row, n = list(row), len(_FIGURES)
        return cls(row[0], row[1], row[2:2 + n], list(row[2 + n]), [bytes(s) for s in row[3 + n]], None if row[4 + n] is None else bytes(row[4 + n]))

    def row(self) -> tuple:
        return (self.flow_start_us, self.last_us, *self.figures, self.splt, self.samples, self.hello)

    def add(self, part: pd.DataFrame, cfg: FlowConfig) -> None:
        """Fold packets that follow those seen so far."""
        ts, size = part["ts_us"].to_numpy(np.int64), part["packet_length"].to_numpy(np.int64)
        old, first = dict(zip(_FIGURES, self.figures)), not self.figures[0]
        gaps = np.diff(ts) if first else np.diff(ts, prepend=self.last_us)
        new = {"packet_count": len(ts), "total_bytes": int(size.sum()), "payload_bytes": int(part["payload_length"].sum()),
               "length_squares": int((size * size).sum()), "gaps": len(gaps), "gap_sum": int(gaps.sum()), "gap_squares": int((gaps * gaps).sum()),
               **{f"{flag}_count": int(part[flag].sum()) for flag in COUNTED}}
        merged = {name: old[name] + new.get(name, 0) for name in _FIGURES}
        for name, pick, value in (("pkt_len_min", min, size.min()), ("pkt_len_max", max, size.max()), ("first_pkt", min, part["pkt_id"].min())):
            merged[name] = int(value) if first else pick(old[name], int(value))
        self.figures, self.last_us = list(merged.values()), int(ts[-1])
        self.splt += size[:cfg.splt_length - len(self.splt)].tolist()
        self.samples += part["sample"].dropna().iloc[:cfg.max_samples - len(self.samples)].tolist()
        if self.hello is None:
            self.hello = next(iter(part["hello"].dropna()), None)


def fold(packets: pd.DataFrame, flow: OpenFlow | None, cfg: FlowConfig) -> tuple[list[OpenFlow], OpenFlow | None]:
    """The flows that packets in event order close, and the one left open."""
    ts, closed, at = packets["ts_us"].to_numpy(np.int64), [], 0
    idle = np.flatnonzero(np.diff(ts) >= cfg.idle_us) + 1
    while at < len(ts):
        if flow and (ts[at] - flow.last_us >= cfg.idle_us or (cfg.active_us is not None and ts[at] - flow.flow_start_us >= cfg.active_us)):
            closed.append(flow)
            flow = None
        flow = flow or OpenFlow(int(ts[at]), int(ts[at]))
        ends = [len(ts), *idle[np.searchsorted(idle, at, side="right"):][:1]]
        if cfg.active_us is not None:
            ends.append(np.searchsorted(ts, flow.flow_start_us + cfg.active_us))
        end = int(min(ends))
        flow.add(packets.iloc[at:end], cfg)
        at = end
    return closed, flow


def _packed(frame: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


def _set_timer(handle: StatefulProcessorHandle, due_us: int | None) -> None:
    """One event timer per key, at the first millisecond from ``due_us`` on."""
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
    if due_us is not None:
        handle.registerTimer(-(-due_us // 1000))


class FlowCutter(StatefulProcessor):
    """Idle and active timeout per 5-tuple. An event-time timer closes a flow that has gone quiet.

    State is one open flow, whose lists have a fixed bound, and the packets that the watermark has not passed.
    """

    def __init__(self, cfg: FlowConfig):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", FLOW_STATE)
        self.waiting = handle.getValueState("waiting", T.StructType([T.StructField("packets", T.BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [frame[_WAITING] for frame in rows]
        if self.waiting.exists():
            parts.append(_unpacked(self.waiting.get()[0]))
        waiting = pd.concat(parts, ignore_index=True)
        self.waiting.update((_packed(waiting),))
        due = [int(waiting["ts_us"].min())]
        if self.open.exists():
            due.append(self.open.get()[1] + self.cfg.idle_us)
        _set_timer(self.handle, min(due))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        flow, closed, left = OpenFlow.of(self.open.get()) if self.open.exists() else None, [], None
        if self.waiting.exists():
            waiting = _unpacked(self.waiting.get()[0])
            settled = waiting["ts_us"] <= now
            closed, flow = fold(waiting[settled].sort_values(["ts_us", "pkt_id"]), flow, self.cfg)
            left = waiting[~settled]
        if flow and flow.last_us + self.cfg.idle_us <= now:
            closed.append(flow)
            flow = None
        due = [] if flow is None else [flow.last_us + self.cfg.idle_us]
        if left is not None and len(left):
            self.waiting.update((_packed(left),))
            due.append(int(left["ts_us"].min()))
        else:
            self.waiting.clear()
        if flow is None:
            self.open.clear()
        else:
            self.open.update(flow.row())
        _set_timer(self.handle, min(due, default=None))
        if closed:
            yield pd.DataFrame([(*key, *done.row(), now) for done in closed], columns=FLOW_OUTPUT.names)

    def close(self) -> None:
        pass


def closed_flow_stream(packets: DataFrame, cfg: FlowConfig = FlowConfig(), lateness: str = "2 seconds") -> DataFrame:
    """Folded figures of the closed flows of a packet stream."""
    rows = prepare(packets.withWatermark("ts", lateness), cfg, True)
    rows = rows.select("ts", *FLOW_KEY, *_WAITING)
    return rows.groupBy(*FLOW_KEY).transformWithStateInPandas(
        statefulProcessor=FlowCutter(cfg), outputStructType=FLOW_OUTPUT, outputMode="Append", timeMode="EventTime")


def flow_stream(packets: DataFrame, cfg: FlowConfig = FlowConfig(), lateness: str = "2 seconds") -> DataFrame:
    """Closed flows of a packet stream, with the columns of the batch flow table and ``watermark_us``. Flows still open when
    a run ends stay in state for the next."""
    return finish(closed_flow_stream(packets, cfg, lateness), cfg, True)


ORDER = ("flow_id", "threat_class", "order_us", "id", "evidence")


class Cooldown(StatefulProcessor):
    """Publishes an alert unless one with its key was published less than the cooldown before, in event order."""

    def __init__(self, cooldown_us: int, schema: T.StructType):
        self.cooldown_us, self.schema = cooldown_us, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.published = handle.getValueState("published", T.StructType([T.StructField("us", T.LongType())]))
        self.waiting = handle.getListState("waiting", self.schema)

    def _frame(self, rows) -> pd.DataFrame:
        return pd.DataFrame(list(rows), columns=self.schema.names)

    def _due(self, waiting: pd.DataFrame) -> None:
        due = [int(waiting["ts_us"].min())] if len(waiting) else []
        if self.published.exists():
            due.append(self.published.get()[0] + self.cooldown_us)
        _set_timer(self.handle, min(due, default=None))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            self.waiting.appendList([tuple(None if pd.isna(v) else v for v in row) for row in frame[self.schema.names].astype(object).itertuples(index=False)])
        self._due(self._frame(self.waiting.get()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = self._frame(self.waiting.get()) if self.waiting.exists() else self._frame([])
        settled = waiting["ts_us"] <= now
        ready = waiting[settled].sort_values(["ts_us", *[c for c in ORDER if c in self.schema.names]])
        last, kept = self.published.get()[0] if self.published.exists() else None, []
        for position, ts in enumerate(ready["ts_us"]):
            if last is None or int(ts) - last >= self.cooldown_us:
                last = int(ts)
                kept.append(position)
        left = waiting[~settled]
        if len(left):
            self.waiting.put([tuple(row) for row in left.itertuples(index=False)])
        else:
            self.waiting.clear()
        if last is None or last + self.cooldown_us <= now:  # it can suppress nothing that is still to come
            self.published.clear()
        else:
            self.published.update((last,))
        self._due(left)
        if kept:
            yield ready.iloc[kept]

    def close(self) -> None:
        pass


def cooldown_stream(alerts: DataFrame, cfg: CooldownConfig = CooldownConfig(), lateness: str = "2 seconds", event_time: str = "ts") -> DataFrame:
    """Published alerts of a stream with ``ts`` and ``dedup_key``.

    ``event_time`` tells how far the stream is: once its watermark has passed an alert's ``ts``, no earlier alert may follow.
    """
    rows = (alerts.withWatermark(event_time, lateness) if lateness else alerts).withColumn("ts_us", F.unix_micros("ts"))
    kept = [f for f in rows.schema.fields if f.name not in ("ts", event_time)]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in kept])
    out = rows.select(event_time, *schema.names).groupBy("dedup_key").transformWithStateInPandas(
        statefulProcessor=Cooldown(cfg.cooldown_us, schema), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return out.withColumn("ts", F.timestamp_micros("ts_us")).drop("ts_us")
