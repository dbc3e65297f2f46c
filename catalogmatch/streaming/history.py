"""The event logs as streams: bounded scan history, saved items, and scans resolved as predictions arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from catalogmatch.operators.history import KEEP_DAYS, KEEP_ROWS


class LatestScans(StatefulProcessor):
    """Keeps the newest scans of a session as list state; emits the session's whole list after every batch that touches it.

    Rows older than ``KEEP_DAYS`` before the newest row seen leave the list, and a timer drops the state of sessions that stay silent.
    """

    SCHEMA = "id long, created_at timestamp, status string"

    def __init__(self, n: int = KEEP_ROWS, days: int = KEEP_DAYS):
        self.n, self.days = n, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", self.SCHEMA)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([x[["id", "created_at", "status"]] for x in rows])
        old = [(int(i), pd.Timestamp(t), s) for i, t, s in self.kept.get()] if self.kept.exists() else []
        merged = {i: (i, t, s) for i, t, s in old}
        merged |= {int(i): (int(i), pd.Timestamp(t), s) for i, t, s in new.itertuples(index=False)}
        ordered = sorted(merged.values(), key=lambda x: (x[1], x[0]), reverse=True)
        oldest = ordered[0][1].floor("s") - pd.Timedelta(days=self.days)
        kept = [x for x in ordered if x[1] >= oldest][: self.n]
        self.kept.put([(i, t.to_pydatetime(), s) for i, t, s in kept])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(ordered[0][1].timestamp() * 1000) + self.days * 86_400_000)
        frame = pd.DataFrame(kept, columns=["id", "created_at", "status"])
        frame.insert(0, "session", key[0])
        frame["place"] = range(1, len(kept) + 1)
        frame["newest"] = ordered[0][1]
        yield frame

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        yield pd.DataFrame(columns=["session", "id", "created_at", "status", "place", "newest"])

    def close(self) -> None:
        pass


def stream_history(scans: DataFrame, n: int = KEEP_ROWS, days: int = KEEP_DAYS) -> DataFrame:
    """(session, id, created_at, status, place, newest): after each batch the kept scans of the sessions it touched.

    Needs the RocksDB state store. ``scans`` has created_at as timestamp (cast TIMESTAMP_NTZ columns first). The watermark lies
    ``days`` behind the newest scan; for a session the list with the largest ``newest`` is the current one, and the cut at an
    exact moment is ``operators.history.history`` over it.
    """
    session_type = scans.schema["session"].dataType.simpleString()
    marked = scans.select("session", "id", "created_at", "status").withWatermark("created_at", f"{days} days")
    return marked.groupBy("session").transformWithStateInPandas(
        LatestScans(n, days), f"session {session_type}, id long, created_at timestamp, status string, place int, newest timestamp", "Update", "EventTime"
    )


class ClearedScans(StatefulProcessor):
    """As ``LatestScans``, over scans and clears: a session's last clear stays in state as a tombstone, and scans that are not newer
    stay out, whenever they arrive. Every emission is one row, the list as arrays, with a ``revision`` of its own; it starts with a row that
    is no scan, so that an empty list replaces an older one, too.

    Moments are microseconds. A session has one value in state, read and written once a batch, and one timer, which is moved when it fires
    before the session has been silent for long enough.
    """

    STATE = "cleared long, newest long, revision long, timer boolean, ids array<long>, times array<long>, statuses array<string>"
    EMITTED = "ids array<long>, times array<long>, statuses array<string>, revision long"

    def __init__(self, n: int = KEEP_ROWS, days: int = KEEP_DAYS):
        self.n, self.micros = n, days * 86_400_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", self.STATE)

    def _due(self, newest: int) -> int:
        """Milliseconds."""
        return (newest + self.micros) // 1000

    def _listed(self, key, newest, revision, ids=(), times=(), statuses=()) -> Row:
        return Row(session=key[0], ids=[None, *ids], times=[newest, *times], statuses=[None, *statuses], revision=revision)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        cleared, newest, revision, timer, *kept = self.session.get() or (None, None, 0, False, [], [], [])
        found = {i: (t, i, s) for i, t, s in zip(*kept, strict=True)}
        for row in rows:
            if row.clears:
                cleared = row.micros if cleared is None else max(cleared, row.micros)
            else:
                found[row.id] = (row.micros, row.id, row.status)
            newest = row.micros if newest is None else max(newest, row.micros)
        oldest = newest // 1_000_000 * 1_000_000 - self.micros
        last = sorted((x for x in found.values() if x[0] >= oldest and (cleared is None or x[0] > cleared)), key=lambda x: x[:2], reverse=True)[: self.n]
        ids, times, statuses = [x[1] for x in last], [x[0] for x in last], [x[2] for x in last]
        if not timer:
            self.handle.registerTimer(self._due(newest))
        self.session.update((cleared, newest, revision + 1, True, ids, times, statuses))
        yield self._listed(key, newest, revision + 1, ids, times, statuses)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        cleared, newest, revision, _, *kept = self.session.get()
        if self._due(newest) > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(self._due(newest))
            return
        self.session.update((None, newest, revision + 1, False, [], [], []))
        yield self._listed(key, newest, revision + 1)

    def close(self) -> None:
        pass


def stream_cleared_history(scans: DataFrame, clears: DataFrame, n: int = KEEP_ROWS, days: int = KEEP_DAYS, hide_demo: bool = False) -> DataFrame:
    """(session, id, created_at, status, place, revision): after each batch the kept scans of the sessions it touched, without those that a clear removed.

    ``scans`` (session, id, created_at, status) and ``clears`` (session, ts), both streams with timestamps; events may come in any order
    and more than once. Place 0 is no scan: it says that the list was made. ``current_lists`` keeps each session's last list. The
    watermark lies ``days`` behind the newest event; what is older than that is no part of a history, so dropped clears change none.
    """
    kinds = scans.schema["session"].dataType.simpleString()
    rows = scans.where("status <> 'demo'") if hide_demo else scans
    rows = rows.select("session", "id", "created_at", "status", F.lit(False).alias("clears"))
    both = rows.unionByName(clears.select("session", F.lit(0).cast("long").alias("id"), F.col("ts").alias("created_at"), F.lit("").alias("status"), F.lit(True).alias("clears")))
    both = both.withColumn("micros", F.unix_micros("created_at")).withWatermark("created_at", f"{days} days")
    lists = both.groupBy("session").transformWithState(ClearedScans(n, days), f"session {kinds}, {ClearedScans.EMITTED}", "Update", "EventTime")
    listed = lists.select("session", "revision", F.posexplode(F.arrays_zip("ids", "times", "statuses")).alias("place", "x"))
    return listed.select("session", F.col("x.ids").alias("id"), F.timestamp_micros("x.times").alias("created_at"), F.col("x.statuses").alias("status"), "place", "revision")


def current_lists(emitted: DataFrame) -> DataFrame:
    """(session, id, created_at, status, place): the rows of each session's last revision, from all that ``stream_cleared_history`` emitted."""
    last = emitted.groupBy("session").agg(F.max("revision").alias("revision"))
    return emitted.join(last, ["session", "revision"]).where("place > 0").select("session", "id", "created_at", "status", "place").distinct()


def stream_saved(events: DataFrame, delay: str = "30 days") -> DataFrame:
    """(user, slug, saved, ts): the state of every item a batch touched; the latest row of a key is current.

    ``events`` (user, slug, ts, id) with timestamps. An event is known by its id: delivered again, it does not toggle its item again,
    however many lie between; one that is older than the newest event by more than ``delay`` does not count, and its id is forgotten
    ``delay`` after that. State is an id for each event of that time, and a count and a moment for each item. Works in update mode.
    """
    seen = events.select("user", "slug", "ts", "id").withWatermark("ts", delay)
    counted = seen.dropDuplicatesWithinWatermark(["user", "slug", "id"]).withColumn("toggles", F.lit(1))
    both = counted.unionByName(seen.withColumn("toggles", F.lit(0)))  # items whose events all came before are emitted, too
    state = both.groupBy("user", "slug").agg(F.sum("toggles").alias("n"), F.max(F.when(F.col("toggles") == 1, F.col("ts"))).alias("ts"))
    return state.where("n > 0").select("user", "slug", (F.col("n") % 2 == 1).alias("saved"), "ts")


def stream_scans(predictions: DataFrame, catalog: DataFrame, path: str, checkpoint: str, sure: float = 0.45, suggest: float | None = 0.20, least_margin: float = 0.0) -> DataStreamWriter:
    """Resolves arriving predictions (query_id, session, created_at, abstain, candidates array<struct<slug,confidence>>) and appends them to the scan log.

    Each batch goes through the batch operator; the catalog is a static side. The log is kept by stream and batch: the id of a
    stream lives in its checkpoint, so several streams may share a log, and one that has lost its checkpoint is a new one. A scan that
    the log has, from whichever stream, is not appended again.
    """
    from catalogmatch.operators.resolve import resolve
    from catalogmatch.sources.sinks import append_scans

    def append(batch: DataFrame, number: int) -> None:
        listed = batch.select("query_id", F.posexplode("candidates").alias("at", "c")).select("query_id", (F.col("at") + 1).alias("rank"), "c.slug", "c.confidence")
        found = resolve(batch, listed, catalog, sure, suggest, least_margin)
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        append_scans(batch.select(F.col("query_id").alias("id"), "session", "created_at").join(found.withColumnRenamed("query_id", "id"), "id"), path, number, stream, "id")

    return predictions.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
