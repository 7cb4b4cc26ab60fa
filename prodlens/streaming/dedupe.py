"""Request caching: what was stored serves further requests of its key until its time to live, counted from storing, is over."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stored(times: np.ndarray, ttl: int, last: int | None = None) -> tuple[np.ndarray, int | None]:
    """Of ascending times those that find no valid entry and store one, and the last such time (`last` before them)."""
    out = np.zeros(len(times), bool)
    i = 0 if last is None else int(np.searchsorted(times, last + ttl))
    while i < len(times):
        out[i], last = True, int(times[i])
        i = int(np.searchsorted(times, last + ttl))
    return out, last


def first_in_window(events: DataFrame, key: str, time: str, seconds: int, tie: str = "event_id") -> DataFrame:
    """Batch form: the events that store an entry. A request that the cache serves does not renew it.

    A key's events are read in order as a stream, with one time kept for it, so a hot key needs no memory. Events without time or key go.
    """
    names, schema = events.columns, events.schema
    rows = events.filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    rows = rows.withColumns({"_key": F.col(key).cast("string"), "_at": F.unix_micros(F.col(time).cast("timestamp"))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for b in batches:
            if not b.num_rows:
                continue
            own, at = np.array(b.column(len(names)).to_pylist(), object), b.column(len(names) + 1).to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])).tolist() + [len(own)]
            keep = np.zeros(len(own), bool)
            for lo, hi in zip(cut, cut[1:]):
                if own[lo] != now:
                    now, last = own[lo], None
                keep[lo:hi], last = stored(at[lo:hi], seconds * 1_000_000, last)
            yield b.select(names).filter(pa.array(keep))

    return rows.repartition("_key").sortWithinPartitions("_key", "_at", tie).mapInArrow(run, schema)


def deduplicated(stream: DataFrame, key: str, time: str, ttl_seconds: int = 300, watermark: str = "5 minutes") -> DataFrame:
    """Streaming form, of rows (key, time): the same events as the batch form where they come in order within the watermark.

    The state of a key is the time of its entry, and goes when the watermark has passed the entry's end.
    """
    ttl = ttl_seconds * 1_000_000

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(time, kind="stable")
        at = rows[time].to_numpy("datetime64[us]").astype(np.int64)
        keep, last = stored(at, ttl, state.get[0] if state.exists else None)
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max((last + ttl) // 1000, state.getCurrentWatermarkMs() + 1))
        yield rows[keep]

    rows = stream.select(key, time).withWatermark(time, watermark)
    return rows.groupBy(key).applyInPandasWithState(run, rows.schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)
