"""Incremental forms as Structured Streaming jobs; each has a batch twin among the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from tenderlake.sources.snapshot import Snapshot


class LateRows(StreamingQueryListener):
    """Counts rows that came behind the watermark, by name of the query; ``spark.streams.addListener`` it before the start."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(event.name or str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = p.name or str(p.id)
        self.dropped[name] = self.dropped.get(name, 0) + sum(op.numRowsDroppedByWatermark for op in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def stream_upsert(records: DataFrame, snapshot: Snapshot, upsert: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str):
    """Applies ``upsert`` of every micro-batch to those folders of the snapshot whose keys it has; the others keep their files.

    A batch that is in the snapshot already is left out, so a replay after a failure changes nothing. Batches are known
    by the stream's id, which goes with the checkpoint, and number: a new checkpoint is another stream.
    """

    def apply(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if snapshot.has(stream, number):
            return
        batch.persist()
        try:
            touched = [r[0] for r in batch.select(snapshot.key).distinct().collect()]  # of few values, see Snapshot
            if touched:
                current = snapshot.read(touched)
                snapshot.commit(upsert(batch.limit(0) if current is None else current, batch), touched, stream, number)
        finally:
            batch.unpersist()

    return records.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def stream_dedup(records: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Drops what was seen under the same keys within the delay, and what comes behind the watermark (see ``LateRows``); state goes as it passes."""
    return records.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def stream_daily_usage(executions: DataFrame, delay: str, time: str = "started_at") -> DataFrame:
    """As the batch ``daily_usage``. In append mode a day comes out once, when the watermark has passed its end; later rows are dropped and counted."""
    days = executions.withWatermark(time, delay).groupBy(F.window(time, "1 day"), "company_id").agg(F.count(F.lit(1)).alias("used"))
    return days.select("company_id", F.to_date("window.start").alias("usage_date"), "used")


class _LastStatus(StatefulProcessor):
    """Keeps a pair's last status and its rows ahead of the watermark; these are compared in order as it passes them.

    One timer at a time: the earliest row that waits, or the end of the last status's life.
    """

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, at long")
        self.waiting = handle.getListState("waiting", "at long, event_id long, status string")

    def _set_timer(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        waiting = [at for at, _, _ in self.waiting.get()]
        if waiting:
            self.handle.registerTimer(min(waiting) // 1000)
        elif self.last.exists():
            self.handle.registerTimer(self.last.get()[1] // 1000 + self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for chunk in rows:
            self.waiting.appendList([(int(at), int(i), s) for at, i, s in zip(chunk["at"], chunk["event_id"], chunk["status"], strict=True)])
        self._set_timer()
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get())
        due, later = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        old, at = self.last.get() if self.last.exists() else ("", None)
        changes = []
        for row_at, _, status in due:
            if at is not None and row_at - at > self.keep_ms * 1000:
                old = ""
            if status != old:
                changes.append((*key, old, status, row_at))
            old, at = status, row_at
        if due:
            self.last.update((old, at))
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        elif at is not None and now >= at + self.keep_ms * 1000:
            self.last.clear()
        self._set_timer()
        if changes:
            yield pd.DataFrame(changes, columns=["tender_id", "company_id", "old_value", "new_value", "at"])

    def close(self) -> None:
        pass


def stream_status_changes(updates: DataFrame, delay: str = "1 hour", keep_days: int = 3650) -> DataFrame:
    """As the batch ``status_changes``, for (tender_id, company_id, status, updated_at, event_id); needs the RocksDB state store.

    In order of (updated_at, event_id) whichever batch a row came in, once the watermark passes it; rows behind the
    watermark are dropped and counted (see ``LateRows``). A pair's status is forgotten ``keep_days`` after its last update
    in event time, and the next one counts as its first.
    """
    rows = updates.withWatermark("updated_at", delay).withColumn("at", F.unix_micros("updated_at"))
    found = rows.groupBy("tender_id", "company_id").transformWithStateInPandas(_LastStatus(keep_days * 86_400_000), "tender_id long, company_id long, old_value string, new_value string, at long", "Append", "EventTime")
    return found.select("tender_id", "company_id", "old_value", "new_value", F.timestamp_micros("at").alias("updated_at"))


class _Stale(StatefulProcessor):
    """Keeps the start of a job in processing and a timer of its end of patience."""

    def __init__(self, minutes: int) -> None:
        self.wait_ms = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.begun = handle.getValueState("begun", "started long, at long, event_id long, processing boolean")

    def _clear_timers(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.begun.get() if self.begun.exists() else None
        last = (known[1], known[2]) if known else None
        for chunk in rows:
            for started, at, event, status in zip(chunk["started"], chunk["at"], chunk["event_id"], chunk["status"], strict=True):
                if last is None or (at, event) > last:
                    last, known = (int(at), int(event)), (int(started), int(at), int(event), status == "processing" and started >= 0)
        self.begun.update(known)
        self._clear_timers()
        if known[3]:
            self.handle.registerTimer(max(known[0] // 1000 + self.wait_ms, timerValues.getCurrentProcessingTimeInMs()) + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        started, at, event, _ = self.begun.get()
        self.begun.update((started, at, event, False))
        yield pd.DataFrame([(*key, "pending", started)], columns=["id", "status", "was_started"])

    def close(self) -> None:
        pass


def stream_recover_stale(jobs: DataFrame, minutes: int = 30) -> DataFrame:
    """(id, status, was_started) of jobs that are in processing for longer than ``minutes``: pending, as in the batch ``recover_stale``.

    jobs: id, status, started_at, updated_at, event_id, a row for each change. A job's last row by (updated_at, event_id)
    counts. The clock is the batch's: a timer set at a job's start goes off in the first batch after its time, with new
    rows or without. So start it with a trigger by the clock; one that ends when all rows are read would wait for timers
    for ever. Needs the RocksDB state store.
    """
    rows = jobs.select("id", "status", F.coalesce(F.unix_micros("started_at"), F.lit(-1)).alias("started"), F.unix_micros("updated_at").alias("at"), "event_id")
    found = rows.groupBy("id").transformWithStateInPandas(_Stale(minutes), "id long, status string, was_started long", "Append", "ProcessingTime")
    return found.select("id", "status", F.timestamp_micros("was_started").alias("was_started"))
