"""STR6: flows labelled by start and end markers that are a stream themselves."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .features import with_event_time

#: At one time a start comes before flows, and flows before an end, since intervals are closed.
START, FLOW, END = 0, 1, 2


class Chain:
    """One key's open interval: its start, and the flows since its last end, whose label is not known yet."""

    def __init__(self, start: int | None, times: list[int], flows: list[str], longest: int):
        self.start, self.times, self.flows, self.longest = start, list(times), list(flows), longest
        self.out: list[tuple[str, int]] = []

    def settle(self, label: int) -> None:
        self.out += [(f, label) for f in self.flows]
        self.times, self.flows = [], []

    def pass_to(self, at: int) -> None:
        """An interval still open `longest` after its start takes nothing more."""
        if self.start is not None and at > self.start + self.longest:
            self.settle(0)
            self.start = None

    def take(self, at: int, kind: int, flow: str) -> None:
        self.pass_to(at)
        if kind == START:  # what followed the last end belongs to no interval
            self.settle(0)
            self.start = at
        elif kind == END:
            self.settle(2)  # the last end before the next start wins, so the interval stays open
        elif self.start is None:
            self.out.append((flow, 0))
        else:
            self.times.append(at)
            self.flows.append(flow)


def label_by_markers(
    flows: DataFrame, markers: DataFrame, ts: str = "ts", is_start: str = "is_start", by: Sequence[str] = (), delay: str = "10 minutes", longest: int = 7 * 86_400, buckets: int = 32
) -> DataFrame:
    """`flows` with `label`: 2 inside a closed interval from a start marker to the last end marker before the next start, else 0.

    Both are streams with the column `ts`; markers have the boolean `is_start`. With `by` a marker holds for flows of equal
    columns, without for all: flows are then dealt to `buckets` and markers go to each.

    Rows wait until the watermark of both streams has passed them and are then taken in order of time, so arrival and
    batches do not matter, and a flow that comes before its end is labelled once the end has come. A flow goes out when
    its label is sure: at once outside intervals, at the end marker inside, and at the next start or `longest` seconds
    after the start if no end follows. State is the rows of the last `delay` and the flows of an open interval. Rows
    without a time are dropped by the watermark. Equals pairing the markers and labelling in batch, where no interval is
    longer than `longest`.
    """
    micros = 1_000_000 * longest
    payload = F.to_json(F.struct(*[F.col(f"`{c}`") for c in flows.columns]), {"ignoreNullFields": "false"})
    key = list(by) or ["_bucket"]
    flow_rows = flows if by else flows.withColumn("_bucket", F.pmod(F.xxhash64(payload), F.lit(buckets)).cast("int"))
    marker_rows = markers if by else markers.withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    left = with_event_time(flow_rows, ts, delay).select(*key, F.col(ts).alias("_ts"), F.lit(FLOW).alias("_kind"), payload.alias("_flow"))
    kind = F.when(F.col(is_start), START).otherwise(END)
    right = with_event_time(marker_rows, ts, delay).select(*key, F.col(ts).alias("_ts"), kind.alias("_kind"), F.lit("").alias("_flow"))
    rows = left.unionByName(right).select(*key, "_ts", F.unix_micros("_ts").alias("_at"), "_kind", "_flow")

    def advance(_: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, chain = [], Chain(None, [], [], micros)
        if state.exists:
            at, kinds, waits, start, times, held = state.get
            waiting = list(zip(at, kinds, waits))
            chain = Chain(None if start < 0 else start, list(times), list(held), micros)
        if not state.hasTimedOut:
            for b in batches:
                waiting += zip(b["_at"].tolist(), b["_kind"].tolist(), b["_flow"].tolist())
        passed = 1000 * state.getCurrentWatermarkMs()
        waiting.sort()
        ready = sum(at <= passed for at, _, _ in waiting)
        for row in waiting[:ready]:
            chain.take(*row)
        chain.pass_to(passed)
        waiting = waiting[ready:]
        if not waiting and chain.start is None:
            if state.exists:
                state.remove()
        else:
            at, kinds, waits = (list(x) for x in zip(*waiting)) if waiting else ([], [], [])
            state.update((at, kinds, waits, -1 if chain.start is None else chain.start, chain.times, chain.flows))
            due = ([at[0]] if at else []) + ([] if chain.start is None else [chain.start + micros + 1000])
            state.setTimeoutTimestamp(max(-(-min(due) // 1000), state.getCurrentWatermarkMs() + 1))
        if chain.out:
            yield pd.DataFrame(chain.out, columns=["flow", "label"])

    found = rows.groupBy(*key).applyInPandasWithState(
        advance, "flow string, label int", "at array<bigint>, kind array<int>, flow array<string>, start bigint, times array<bigint>, held array<string>", "append", GroupStateTimeout.EventTimeTimeout
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flows.schema)
    return found.select(F.from_json("flow", schema).alias("f"), "label").select("f.*", "label")
