"""Keyed state on streams: the last known value as of each event, and one event for each transaction, whatever the order of arrival.

Both wait for the watermark: what is older can't get company any more, so results are those of a batch over the same rows as long as no row
comes later than ``late``. State goes with it: events leave it when they are final, a key's last value when it is older than ``ttl``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ammlytics.session import ship

_STATE = "at array<long>, seq array<long>, value array<double>, payload array<string>, last_at long, last_value double"


def settle(events: list[tuple], final_ms: int, last_at: int | None, last_value: float | None, ttl_ms: int) -> tuple[list[tuple], list[tuple], int | None, float | None]:
    """Events (ms, seq, value or None, payload or None) before final_ms in order: (asked events with the value known then, events left, last time, last value)."""
    events.sort(key=lambda e: (e[0], e[3] is not None, e[1]))
    out, k = [], 0
    for at, seq, value, payload in events:
        if at >= final_ms:
            break
        k += 1
        if payload is None:
            last_at, last_value = at, value
        else:
            out.append((at, seq, payload, last_value if last_at is not None and at - last_at <= ttl_ms else None))
    return out, events[k:], last_at, last_value


def as_of_stream(events: DataFrame, key: str, time: str, seq: str, value: str, payload: str, *, late: str, ttl_seconds: int) -> DataFrame:
    """Of a stream of known values (payload null) and questions (payload not null): key, time (ms), seq, payload, value_as_of, the last value at or before the question's time, no older than ttl.

    At one time values come before questions, values among themselves by ``seq``. A row with a null value and a null payload is no row.
    State of a key: its events that the watermark hasn't passed, and one value.
    """
    ship(events.sparkSession)
    ttl_ms = ttl_seconds * 1000

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last_at, last_value = [], None, None
        if state.exists:
            at, sq, vs, ps, last_at, last_value = state.get
            held = [(a, s, v, p) for a, s, v, p in zip(at, sq, vs, ps, strict=True)]
        for frame in frames:
            for a, s, v, p in zip(frame["at"].tolist(), frame["seq"].tolist(), frame["value"].tolist(), frame["payload"].tolist(), strict=True):
                held.append((int(a), int(s), None if v is None or v != v else float(v), p))
        now = state.getCurrentWatermarkMs()
        out, held, last_at, last_value = settle(held, now, last_at, last_value, ttl_ms)
        if not held and (last_at is None or last_at + ttl_ms < now):
            if state.exists:
                state.remove()
        else:
            state.update(([e[0] for e in held], [e[1] for e in held], [e[2] for e in held], [e[3] for e in held], last_at, last_value))
            next_ms = min(e[0] for e in held) if held else last_at + ttl_ms
            state.setTimeoutTimestamp(max(next_ms, now) + 1)
        yield pd.DataFrame({"key": [k[0]] * len(out), "at": [o[0] for o in out], "seq": [o[1] for o in out], "payload": [o[2] for o in out], "value_as_of": pd.array([o[3] for o in out], dtype="Float64")})

    rows = events.where(F.col(value).isNotNull() | F.col(payload).isNotNull()).select(F.col(key).alias("key"), F.col(time).cast("timestamp").alias("time"), F.col(seq).cast("long").alias("seq"), F.col(value).cast("double").alias("value"), F.col(payload).cast("string").alias("payload"))
    rows = rows.withColumn("at", F.unix_millis("time")).withWatermark("time", late)
    return rows.groupBy("key").applyInPandasWithState(step, "key string, at long, seq long, payload string, value_as_of double", _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def first_of_transaction(events: DataFrame, keys: list[str], time: str, order: str, *, late: str) -> DataFrame:
    """Of the rows of one transaction (equal keys and time) the one that is first in ``order``, when the watermark has passed its time. Batch or stream; no Python."""
    rest = [c for c in events.columns if c not in (*keys, time)]
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    best = rows.groupBy(time, *keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_best"))
    return best.select(*keys, time, *[F.col(f"_best.{c}").alias(c) for c in rest])
