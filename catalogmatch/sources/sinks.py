"""Writers of ranked results, of the scan log and of tables that several steps read."""

from __future__ import annotations

import json
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


MOST_CANDIDATES = 20


def work_dir(spark: SparkSession, tag: str) -> str:
    """A new folder name in ``spark.checkpoint.dir``, which driver and executors share; a temporary one where none is set and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{tag}-{uuid4().hex}"


def kept_table(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that several steps read it instead of computing it again."""
    path = work_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nested_results(ranked: DataFrame, key: str = "query_id", most: int = MOST_CANDIDATES) -> DataFrame:
    """One row per query with its ``most`` first candidates (rank, slug, score) in rank order."""
    return ranked.where(F.col("rank") <= most).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "slug", "score"))).alias("candidates"))


def write_results(ranked: DataFrame, path: str, key: str = "query_id") -> None:
    """UTF-8 JSON lines, one per query."""
    nested_results(ranked, key).write.json(path)


#: What a commit says: the writer and its batch, how often this batch was written before, the folder, the columns, and folders it stands for.
LEDGER = "writer string, batch string, turn long, folder string, columns string, replaces array<string>"
_COMMIT, _DAY = "_commit", "_day"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The commits of a scan log, a row each; no row where there is no log yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(LEDGER).json(f"{path.rstrip('/')}/ledger/*")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def _live(commits: DataFrame) -> list:
    """The commits that count: of each writer's batch the last, and none that another stands for."""
    rows = commits.collect()  # a row for each append since the last compaction
    replaced = {x for r in rows for x in r.replaces or ()}
    last: dict = {}
    for r in sorted((r for r in rows if r.folder not in replaced), key=lambda r: r.turn):
        last[r.writer, r.batch] = r
    return list(last.values())


def _commit(spark: SparkSession, path: str, writer: str, batch: str, folder: str, columns: str, replaces: list[str]) -> None:
    before = [r.turn for r in ledger(spark, path).where((F.col("writer") == writer) & (F.col("batch") == batch)).collect()]
    row = (writer, batch, max(before, default=-1) + 1, folder, columns, replaces)
    spark.createDataFrame([row], LEDGER).coalesce(1).write.json(f"{path}/ledger/{folder}")


def _write(scans: DataFrame, path: str) -> str:
    folder = uuid4().hex
    scans.withColumn(_DAY, F.to_date("created_at")).write.partitionBy(_DAY).parquet(f"{path}/rows/{_COMMIT}={folder}")
    return folder


def _read(spark: SparkSession, path: str, live: list, schema=None, days: tuple | None = None) -> DataFrame | None:
    """The rows of some commits, with their day; None where there is nothing to read and no schema is given."""
    from pyspark.sql.types import DateType, StructType

    shape = schema or (StructType.fromJson(json.loads(max(live, key=lambda r: r.turn).columns)) if live else None)
    if shape is None:
        return None
    shape = StructType([*shape.fields]).add(_COMMIT, "string").add(_DAY, DateType())
    if not live:
        return spark.createDataFrame([], shape)
    rows = spark.read.schema(shape).option("basePath", f"{path}/rows").parquet(*(f"{path}/rows/{_COMMIT}={r.folder}" for r in live))
    return rows.where(F.col(_DAY).between(*days)) if days else rows


def append_scans(scans: DataFrame, path: str, batch: int | str | None = None, writer: str = "", key: str | None = None) -> None:
    """Appends to the scan log, partitioned by day, and commits the append in the log's ledger; rows of an append without commit are never read.

    A writer's batch that is written again replaces what it wrote before; without a name a batch is new. With ``key``, of rows
    that share it one is appended, and none that the log has on the same day from other batches or writers.
    """
    spark, path = scans.sparkSession, path.rstrip("/")
    batch = uuid4().hex if batch is None else str(batch)
    columns = scans.schema.json()
    if key is not None:
        others = [r for r in _live(ledger(spark, path)) if (r.writer, r.batch) != (writer, batch)]
        scans = scans.dropDuplicates([key])
        if others:
            days = scans.agg(F.min(F.to_date("created_at")), F.max(F.to_date("created_at"))).first()
            known = _read(spark, path, others, days=tuple(days)) if days[0] else None
            scans = scans.join(known.select(key), key, "left_anti").select(*scans.columns) if known is not None else scans
    _commit(spark, path, writer, batch, _write(scans, path), columns, [])


def read_scans(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The committed rows of the scan log; a log without commits is empty, and needs a ``schema``."""
    path = path.rstrip("/")
    rows = _read(spark, path, _live(ledger(spark, path)), schema)
    if rows is None:
        raise ValueError(f"{path} has no commit; give a schema to read it as an empty log")
    return rows.drop(_COMMIT, _DAY)


def compact_scans(spark: SparkSession, path: str) -> None:
    """Writes what is committed once more as one append whose commit stands for all others, so that a log of many small appends reads fast.

    Readers see the log before or after. Not to be run beside a writer that may write one of its batches again.
    """
    path = path.rstrip("/")
    commits = ledger(spark, path)
    rows = _read(spark, path, _live(commits))
    if rows is not None:
        rows = rows.drop(_COMMIT, _DAY)
        folder = _write(rows.repartition(F.to_date("created_at"), F.pmod(F.xxhash64(*rows.columns), F.lit(8))), path)
        _commit(spark, path, "compaction", uuid4().hex, folder, rows.schema.json(), [r.folder for r in commits.select("folder").collect()])
