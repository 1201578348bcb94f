"""Change feeds: debounce by key, index maintenance by micro-batch, batched delivery."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def debounced(events: DataFrame, key: str, time: str, tie: list[str], gap: int) -> DataFrame:
    """Events at least `gap` after the last accepted event of their key.

    The last accepted time is the fold's whole state, so that a key's events stream
    through its task in order, whatever their number: they are dealt by key, sorted, and
    passed once.  A null key is a key; an event without a time is never accepted.
    """
    names, schema = events.columns, events.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = object(), 0
        for batch in batches:
            keep = []
            for k, t in zip(batch.column(key).to_pylist(), batch.column(time).to_pylist(), strict=True):
                fresh = t is not None and (k != now or t - last >= gap)
                if fresh:
                    now, last = k, t
                keep.append(fresh)
            yield batch.filter(pa.array(keep, pa.bool_()))

    dealt = events.repartition(F.col(key)).sortWithinPartitions(key, time, *tie)
    return dealt.select(*names).mapInArrow(run, schema)


def debounced_stream(events: DataFrame, key: str, time: str, gap: int) -> DataFrame:
    """The same rule over an unbounded stream: accepted events with their key and time.

    The state of a key is its last accepted time, and is dropped when the key has been
    silent for ten gaps of processing time.
    """
    kind = events.schema[key].dataType.simpleString()

    def step(k, frames, state):
        last = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            return
        kept = []
        for t in sorted(t for frame in frames for t in frame[time].dropna().tolist()):  # of the batch as a whole
            if last is None or t - last >= gap:
                kept.append(t)
                last = t
        if last is not None:
            state.update((last,))
            state.setTimeoutDuration(max(1000, gap // 100))
        yield pd.DataFrame({key: [k[0]] * len(kept), time: kept})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {time} long", "last long", "append", "ProcessingTimeTimeout")


def maintain(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Run apply(batch, epoch) over a stream of changes; epochs make it repeatable."""
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def batches(df: DataFrame, size: int) -> Iterator[list]:
    """Rows in lists of `size`, partition by partition; the driver holds one partition."""
    held = []
    for row in df.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def route(extension: Column) -> Column:
    """What a changed file concerns: config, asset or source; null for the rest."""
    e = F.lower(extension)
    return F.when(e == "ini", "config").when(e.isin("uasset", "umap"), "asset").when(e.isin("h", "hpp", "inl", "cpp", "cc", "cxx", "c", "cs"), "source")
