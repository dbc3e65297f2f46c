"""What streams do with events that arrive late, in another order, or again."""

import random

import pytest
from pyspark.sql import functions as F

from catalogmatch.operators import history as H
from catalogmatch.sources.sinks import append_scans, compact_scans, ledger, read_scans
from catalogmatch.streaming import history as SH


def fed(spark, path, shape, batches, times):
    """Batches as a stream of files, the columns ``times`` from seconds."""
    raw = ", ".join(f"{c.split()[0]} long" if c.split()[0] in times else c for c in shape.split(", "))
    for k, rows in enumerate(batches):
        made = spark.createDataFrame(rows, raw).withColumns({t: F.timestamp_seconds(t) for t in times})
        made.coalesce(1).write.mode("append").parquet(f"{path}/{k:03}")
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def finished(spark, rows, path):
    writer = rows.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/out/batch={n}")).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


def test_redelivered_toggles_count_once(spark, tmp_path):
    batches = [[(1, "a", 10, 1), (1, "b", 11, 2), (1, "b", 12, 3)], [(1, "a", 10, 1), (1, "a", 10, 1)], [(1, "a", 10, 1), (1, "b", 13, 4), (1, "b", 13, 4)], [(2, "c", 14, 5), (2, "c", 14, 5)]]
    events = fed(spark, str(tmp_path / "in"), "user long, slug string, ts timestamp, id long", batches, ["ts"])
    now = finished(spark, SH.stream_saved(events), str(tmp_path)).groupBy("user", "slug").agg(F.max_by("saved", F.struct("ts", "batch")).alias("saved")).collect()
    assert {(r.user, r.slug): r.saved for r in now} == {(1, "a"): True, (1, "b"): True, (2, "c"): True}


def test_a_toggle_delivered_again_after_thousands_of_others_counts_once(spark, tmp_path):
    many = [(1, "a", 1000 + k, k) for k in range(2501)]
    day = 86_400
    batches = [many, [(1, "a", 1000, 0), (1, "a", 1007, 7)], [(2, "z", 40 * day, 9000)], [(2, "z", 40 * day + 1, 9001)], [(1, "a", 41 * day, 9002), (1, "a", 1000, 0)]]
    events = fed(spark, str(tmp_path / "in"), "user long, slug string, ts timestamp, id long", batches, ["ts"])
    rows = finished(spark, SH.stream_saved(events), str(tmp_path)).where("slug = 'a'").orderBy("batch").select("batch", "saved").collect()
    # 2,501 toggles; two of them again; 40 days later their ids are forgotten, and one that comes again is too late
    assert [r.saved for r in rows] == [True, True, False]


def test_toggles_need_no_call_to_python(spark, tmp_path):
    events = fed(spark, str(tmp_path / "in"), "user long, slug string, ts timestamp, id long", [[(1, "a", 10, 1)]], ["ts"])
    assert "Python" not in (plan := SH.stream_saved(events)._jdf.queryExecution().analyzed().toString()) and "Pandas" not in plan


SCANS = "session long, id long, created_at timestamp, status string"


def history_cases():
    rng = random.Random(6)
    scans = [(rng.randrange(6), k, rng.randrange(0, 3_000_000), rng.choice(["matched", "demo", "uncertain"])) for k in range(160)]
    clears = [(rng.randrange(5), rng.randrange(0, 2_500_000), k) for k in range(12)] + [(9, 5, 99)]
    return scans, clears


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cleared_history_as_a_stream_equals_the_batch(spark, tmp_path, seed):
    """Days are 35 here, so that no event is late; order, redelivery and the cut into batches do not matter."""
    scans, clears = history_cases()
    rng = random.Random(seed)
    again = [rng.choice(scans) for _ in range(40)], [rng.choice(clears) for _ in range(6)]
    mixed = rng.sample(scans + again[0], len(scans) + 40), rng.sample(clears + again[1], len(clears) + 6)
    cut = lambda rows, n: [rows[k::n] for k in range(n)]
    one = fed(spark, str(tmp_path / "scans"), SCANS, cut(mixed[0], 3), ["created_at"])
    two = fed(spark, str(tmp_path / "clears"), "session long, ts timestamp, id long", cut(mixed[1], 3), ["ts"])
    emitted = finished(spark, SH.stream_cleared_history(one, two, 8, 35, hide_demo=True), str(tmp_path))
    got = SH.current_lists(emitted).select("session", "id", "place").collect()
    batch = spark.createDataFrame(scans, "session long, id long, created_at long, status string").withColumn("created_at", F.timestamp_seconds("created_at"))
    gone = spark.createDataFrame(clears, "session long, ts long, id long").withColumn("ts", F.timestamp_seconds("ts"))
    want = H.history(batch, F.timestamp_seconds(F.lit(3_000_000)), 8, 35, gone, True).select("session", "id", "place").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 10


def test_scans_older_than_a_clear_stay_out_and_empty_lists_replace_others(spark, tmp_path):
    one = fed(spark, str(tmp_path / "scans"), SCANS, [[(1, 1, 100, "matched"), (2, 2, 100, "matched")], [(1, 3, 150, "matched")], [(1, 4, 250, "matched"), (1, 5, 200, "matched")]], ["created_at"])
    two = fed(spark, str(tmp_path / "clears"), "session long, ts timestamp, id long", [[(1, 200, 1)]], ["ts"])
    emitted = finished(spark, SH.stream_cleared_history(one, two), str(tmp_path))
    assert sorted((r.session, r.id) for r in SH.current_lists(emitted).collect()) == [(1, 4), (2, 2)]
    early = emitted.where("session = 1 AND revision = 1")
    assert early.count() == 1 and early.first().place == 0  # the scan and its clear came in one batch: the list is empty


def test_a_session_is_one_row_a_batch_and_its_timer_moves(spark, tmp_path):
    day = 86_400
    batches = [[(1, 1, 10 * day, "matched")], [(1, 2, 14 * day, "matched")], [(2, 3, 21 * day, "matched")], [(2, 4, 25 * day, "matched")], [(2, 5, 25 * day + 1, "matched")]]
    one = fed(spark, str(tmp_path / "scans"), SCANS, batches, ["created_at"])
    two = fed(spark, str(tmp_path / "clears"), "session long, ts timestamp, id long", [[(3, 10 * day, 1)]], ["ts"])
    rows = SH.stream_cleared_history(one, two, days=5)
    assert "Pandas" not in rows._jdf.queryExecution().analyzed().toString()
    emitted = finished(spark, rows, str(tmp_path))
    first = sorted((r.revision, r.place, r.id) for r in emitted.where("session = 1").collect())
    assert first == [(1, 0, None), (1, 1, 1), (2, 0, None), (2, 1, 2), (2, 2, 1), (3, 0, None)]  # the timer of day 15 moved to day 19
    assert sorted((r.session, r.id) for r in SH.current_lists(emitted).collect()) == [(2, 3), (2, 4), (2, 5)]


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "log")
    scans = spark.range(10).select("id", (F.col("id") % 3).alias("session"), F.timestamp_seconds(F.col("id") * 50_000).alias("created_at"))
    for rows, batch in ((scans.where("id < 5"), 0), (scans.where("id >= 5"), 1), (scans.where("id >= 5"), 1), (scans.where("id < 2"), 0)):
        append_scans(rows, path, batch)
    assert sorted(r.id for r in read_scans(spark, path).collect()) == [0, 1, 5, 6, 7, 8, 9]
    append_scans(scans.where("id = 9"), path)
    assert read_scans(spark, path).count() == 8 and read_scans(spark, path).columns == ["id", "session", "created_at"]


def test_a_log_of_several_writers(spark, tmp_path):
    path = str(tmp_path / "log")
    scans = spark.range(40).select("id", (F.col("id") % 3).alias("day"), F.lit("x").alias("batch"), F.timestamp_seconds(F.col("id") * 9_000).alias("created_at"))
    empty = read_scans(spark, path, scans.schema)
    assert empty.count() == 0 and empty.columns == scans.columns
    with pytest.raises(ValueError, match="no commit"):
        read_scans(spark, path)
    append_scans(scans.where("id < 20"), path, 0, "one", "id")
    append_scans(scans.where("id BETWEEN 10 AND 29").unionByName(scans.where("id = 25")), path, 0, "two", "id")
    append_scans(scans.where("id < 35"), path, 0, "one again", "id")
    append_scans(scans.where("id < 35"), path, 0, "one again", "id")  # the same batch once more
    append_scans(scans.where("id > 100"), path, 1, "two", "id")  # an empty batch
    want = [tuple(r) for r in scans.where("id < 35").orderBy("id").collect()]
    assert [tuple(r) for r in read_scans(spark, path).orderBy("id").collect()] == want
    scans.where("id >= 35").withColumn("_day", F.to_date("created_at")).write.partitionBy("_day").parquet(f"{path}/rows/_commit=lost")  # a writer that died before its commit
    assert read_scans(spark, path).count() == 35
    compact_scans(spark, path)
    assert [tuple(r) for r in read_scans(spark, path).orderBy("id").collect()] == want
    append_scans(scans, path, 1, "one", "id")
    assert read_scans(spark, path).count() == 40 and ledger(spark, path).count() == 7


def test_two_streams_and_a_lost_checkpoint_lose_and_repeat_nothing(spark, tmp_path):
    log = str(tmp_path / "log")
    catalog = spark.createDataFrame([("a",), ("b",)], "slug string")
    shape = "query_id long, session string, created_at timestamp, abstain boolean, candidates array<struct<slug:string,confidence:double>>"
    row = lambda k: (k, f"s{k % 3}", k * 20_000, False, [("a", 0.9), ("b", 0.1)])
    first = fed(spark, str(tmp_path / "one"), shape, [[row(k) for k in range(b, b + 5)] for b in (0, 5)], ["created_at"])
    second = fed(spark, str(tmp_path / "two"), shape, [[row(k) for k in range(b, b + 5)] for b in (100, 105)], ["created_at"])
    for stream, checkpoint in ((first, "c1"), (second, "c2"), (first, "c1"), (first, "new")):
        SH.stream_scans(stream, catalog, log, str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in read_scans(spark, log).collect()) == [*range(10), *range(100, 110)]
    assert {r.status for r in read_scans(spark, log).collect()} == {"matched"}
