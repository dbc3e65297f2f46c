"""Scan history and saved items as batch views over event logs.

Scans: (id, session, created_at, status, result); clear events: (session, ts); save events: (user, slug, ts, id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP_DAYS, KEEP_ROWS, KEEP_SAVED = 30, 100, 500


def cutoff(as_of: Column, days: int = KEEP_DAYS) -> Column:
    """The first moment that is kept: whole seconds, ``days`` before."""
    return F.date_trunc("second", as_of.cast("timestamp")) - F.make_dt_interval(F.lit(days))


def latest(scans: DataFrame, n: int = KEEP_ROWS) -> DataFrame:
    """The ``n`` newest scans of every session, ``place`` from 1."""
    w = Window.partitionBy("session").orderBy(F.desc("created_at"), F.desc("id"))
    return scans.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def history(scans: DataFrame, as_of: Column, n: int = KEEP_ROWS, days: int = KEEP_DAYS, clears: DataFrame | None = None, hide_demo: bool = False) -> DataFrame:
    """The kept scans of every session, newest first: younger than the cut, newer than the last clear, at most ``n``."""
    rows = scans.where(F.col("created_at") >= cutoff(as_of, days))
    if hide_demo:
        rows = rows.where("status <> 'demo'")
    if clears is not None:
        last = clears.groupBy("session").agg(F.max("ts").alias("cleared"))
        rows = rows.join(last, "session", "left").where("cleared IS NULL OR created_at > cleared").drop("cleared")
    return latest(rows, n)


def without_demo(scans: DataFrame) -> DataFrame:
    return scans.where("status <> 'demo'")


def session_history(scans: DataFrame, session: str, as_of: Column, n: int = KEEP_ROWS) -> DataFrame:
    """One session's view; other sessions' rows cannot be in it."""
    return history(scans.where(F.col("session") == session), as_of, n).orderBy("place")


def session_listings(scans: DataFrame, requests: DataFrame, as_of: Column, n: int = KEEP_ROWS, days: int = KEEP_DAYS) -> DataFrame:
    """(request_id, session, id, status, created_at, place): the kept scans of every requested session, newest first.

    ``requests`` (request_id, session). The session is the only key that meets a request, so no other session's rows can.
    """
    asked = requests.select("session").distinct()
    return requests.join(history(scans.join(asked, "session", "left_semi"), as_of, n, days), "session").select("request_id", "session", "id", "status", "created_at", "place")


def saved_items(events: DataFrame, most: int = KEEP_SAVED) -> DataFrame:
    """(user, place, slug, saved_at): items toggled an odd number of times, in order of their last toggle, the first ``most``."""
    folded = events.groupBy("user", "slug").agg(F.count("*").alias("n"), F.max(F.struct("ts", "id")).alias("last")).where("n % 2 = 1")
    w = Window.partitionBy("user").orderBy("last", "slug")
    return folded.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("user", "place", "slug", F.col("last.ts").alias("saved_at"))
