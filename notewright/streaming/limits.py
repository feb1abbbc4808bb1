"""A sliding limit on events by key: at most so many accepted in any window of time."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW_S, MOST = 60, 20


def admit(times: list[float], seen: deque, window: float = WINDOW_S, most: int = MOST) -> list[bool]:
    """Which events pass; those refused do not count.  ``seen`` holds the accepted ones in the window."""
    out = []
    for t in times:
        while seen and seen[0] <= t - window:
            seen.popleft()
        if ok := len(seen) < most:
            seen.append(t)
        out.append(ok)
    return out


def limited(events: DataFrame, key: str, at: str, order: str, window: float = WINDOW_S, most: int = MOST) -> DataFrame:
    """``key, order, allowed`` for a table of events, by key in order of time (epoch seconds).

    What is kept of a key are the accepted times of one window, at most ``most`` numbers; the events
    themselves are a sorted stream.
    """
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, order)}

    def run(batches):
        now, seen = None, deque()
        for batch in batches:
            allowed = []
            for k, t in zip(batch[key], batch[at], strict=True):
                if k != now:
                    now, seen = k, deque()
                allowed += admit([t], seen, window, most)
            yield pd.DataFrame({key: batch[key], order: batch[order], "allowed": allowed})

    rows = events.select(key, order, at).where(f"{key} is not null").repartition(key).sortWithinPartitions(key, at, order)
    return rows.mapInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, allowed boolean")


def limited_stream(events: DataFrame, key: str, at: str, order: str | None = None, window: float = WINDOW_S, most: int = MOST) -> DataFrame:
    """``key, at, order, allowed``: the same on a stream, with the accepted times of each key as state.

    A key's events of one micro-batch come in several frames in any order; they are put in order of
    time (then of ``order``) before any is admitted, so what is held is one key's events of a
    micro-batch, two columns wide.  Events that arrive in a later micro-batch than later ones are
    judged after these.
    """
    columns = [key, at] + [order] * bool(order)
    kinds = {c: "double" if c == at else events.schema[c].dataType.simpleString() for c in columns}

    def run(k, frames, state: GroupState):
        seen = deque(state.get[0] if state.exists else [])
        frame = pd.concat(list(frames), ignore_index=True).sort_values(columns[1:], kind="stable", ignore_index=True)
        frame["allowed"] = admit(frame[at].tolist(), seen, window, most)
        yield frame[[*columns, "allowed"]].astype({at: float})
        state.update((list(seen),))

    ddl = ", ".join(f"{c} {t}" for c, t in kinds.items())
    return events.select(*columns).groupBy(key).applyInPandasWithState(run, f"{ddl}, allowed boolean", "seen array<double>", "append", GroupStateTimeout.NoTimeout)
