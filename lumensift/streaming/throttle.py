"""Alert throttling: an alert is sent if the last *sent* one of its key is long enough ago.

Batch: a pass over each key's times in order. Streaming: the time of the last sent alert is the key's state.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from lumensift.operators.tables import ship


def _sent(batches: Iterator[pa.RecordBatch], interval: int) -> Iterator[pa.RecordBatch]:
    """The rows that go out, of rows sorted by key and time."""
    key = last = None
    begun = False
    for batch in batches:
        keep = []
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not begun or k != key:
                key, last, begun = k, None, True
            go = last is None or interval <= 0 or t - last >= interval
            if go:
                last = t
            keep.append(go)
        yield batch.filter(pa.array(keep, pa.bool_()))


def throttle(alerts: DataFrame, key: str, at: str, interval: int) -> DataFrame:
    """(key, sent_at) of alerts (key, at), at in whole units of the interval. State is what was sent, not what was seen.

    Each key's times stream by in order: linear, with one time as the state, however many alerts a key has.
    """
    ship(alerts.sparkSession)
    rows = alerts.select(key, F.col(at).cast("long").alias("sent_at")).where("sent_at is not null")
    rows = rows.repartition(key).sortWithinPartitions(key, "sent_at")
    return rows.mapInArrow(partial(_sent, interval=interval), rows.schema)


def _keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, interval: int) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    out = []
    for t in sorted(x for b in batches for x in b["at"]):
        if last is None or interval <= 0 or t - last >= interval:
            out.append(t)
            last = t
    if last is not None:
        state.update((int(last),))
    yield pd.DataFrame({"key": [key[0]] * len(out), "sent_at": out})


def throttle_stream(alerts: DataFrame, interval: int) -> DataFrame:
    """A streaming DataFrame (key long, at long) as (key, sent_at), in append mode."""
    ship(alerts.sparkSession)
    fn = lambda key, batches, state: _keep(key, batches, state, interval)
    return alerts.groupBy("key").applyInPandasWithState(fn, "key long, sent_at long", "last long", "append", "NoTimeout")
