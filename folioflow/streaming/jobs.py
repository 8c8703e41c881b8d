"""Job state from a stream of updates.

Keyed state follows the batch rules: updates of unknown jobs are ignored, a
recorded success is final, a failure may still turn into a success. A job
leaves the state 30 seconds of processing time after it ended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators.progress import HISTORY_ROWS, KEEP_SECONDS

_STATE = "progress int, message string, status string, seq long"
_OUT = f"job string, {_STATE}"


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state, evict: bool) -> Iterator[pd.DataFrame]:  # noqa: ANN001
    if evict and state.hasTimedOut:
        state.remove()
        return
    now = list(state.get) if state.exists else None
    rows = pd.concat(list(frames)).sort_values("seq")
    changed = False
    for added, ok, progress, message, seq in rows[["added", "ok", "progress", "message", "seq"]].itertuples(index=False):
        known = now is not None
        if added and not known:
            now = [0, None, "running", int(seq)]
        if now is None:
            continue
        changed = True
        now[3] = int(seq)
        if now[2] != "done":
            now[0] = int(progress) if pd.notna(progress) else now[0]
        now[1] = message if message is not None and pd.notna(message) else now[1]
        if known and ok is not None and pd.notna(ok) and now[2] != "done":
            now[2] = "done" if ok else "failed"
            now[0] = 100 if ok else now[0]
    if now is None or not changed:
        return
    state.update(tuple(now))
    if evict and now[2] != "running":
        state.setTimeoutDuration(KEEP_SECONDS * 1000)
    yield pd.DataFrame([[str(key[0]), *now]], columns=["job", "progress", "message", "status", "seq"])


def snapshots(updates: DataFrame, evict: bool = True) -> DataFrame:
    """A job's state after every batch that touched it. Rows in: job, seq, added, ok, progress, message.

    Timers for ``evict`` ask for batches without end, so a query that is to stop
    by itself does without.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        return _fold(key, frames, state, evict)

    lean = updates.select(F.col("job").cast("string").alias("job"), "seq", "added", "ok", "progress", "message")
    return lean.groupBy("job").applyInPandasWithState(fold, _OUT, _STATE, "update", "ProcessingTimeTimeout" if evict else "NoTimeout")


def push(updates: DataFrame, send: Callable[[list[dict]], None], every: str | None = "1 second", checkpoint: str | None = None):  # noqa: ANN201
    """Start a query that sends what changed, newest first and at most HISTORY_ROWS rows.

    It runs ``every`` so often, or once over what is there if that is None.
    """

    def each(batch: DataFrame, _: int) -> None:
        rows = batch.orderBy(F.desc("seq")).limit(HISTORY_ROWS).collect()
        if rows:
            send([r.asDict() for r in rows])

    writer = snapshots(updates, evict=every is not None).writeStream.outputMode("update").foreachBatch(each)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
