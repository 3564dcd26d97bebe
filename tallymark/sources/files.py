"""Readers of JSON lines, and Parquet ledgers by event date."""

from __future__ import annotations

import datetime
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.sources import schemas

EVENT_FILES = "*events*.jsonl"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where the master is local."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tallymark-"))
        configured = context.getCheckpointDir()
    return configured.rstrip("/")


def checkpointed(rows: DataFrame) -> DataFrame:
    """The rows, written where all executors read them; what they come from is not computed again."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def stored(rows: DataFrame) -> DataFrame:
    """The rows as compressed Parquet in the shared folder; what they come from is not computed again, and Spark knows their size."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/stored/{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def line_number() -> Column:
    """A number that grows with a line's place in its file: by split, and in it in order. Files are not told apart.

    Splits begin at multiples of 64 KB at least; a split has less than 2^33 lines. For a column next to a file source only.
    """
    block = F.shiftleft(F.shiftright(F.col("_metadata.file_block_start"), 16), 33)
    return (block + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).alias("line_no")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, source_file, line_no) of the lines of a file, folder or glob that are not blank."""
    reader = spark.read
    if not any(ch in path for ch in "*?[{") and not path.endswith((".jsonl", ".json")):
        reader = reader.option("pathGlobFilter", EVENT_FILES)
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("source_file"), line_number()).where("trim(value) <> ''")


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Envelopes as ``e``, null if a line is not an object; the line itself stays for validation."""
    return read_lines(spark, path).withColumn("e", F.from_json("value", schemas.ENVELOPE))


def read_adapter_events(spark: SparkSession, path: str) -> DataFrame:
    """Raw adapter events with line_no."""
    return spark.read.schema(schemas.ADAPTER).json(path).select("*", line_number())


def read_funnel_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FUNNEL).json(path)


def read_choice_events(spark: SparkSession, path: str) -> DataFrame:
    """Choice events with ``kind`` presentation or selection, by either name; rows without decision, tool or project go."""
    rows = spark.read.schema(schemas.CHOICE).json(path)
    kind = F.coalesce("observation_type", F.when(F.col("type") == "presented", "presentation").when(F.col("type") == "selected", "selection").otherwise(F.col("type")))
    return rows.withColumn("kind", kind).where("kind IN ('presentation', 'selection') AND decision_id <> '' AND tool <> '' AND project_id <> ''").drop("type", "observation_type")


def write_ledger(rows: DataFrame, path: str, at: str, mode: str = "append") -> None:
    """Parquet by event date, clustered by project within a date, so that dates and projects prune."""
    dated = rows.withColumn("event_date", F.to_date(at))
    dated.repartition("event_date", F.pmod(F.xxhash64("project_id"), F.lit(8))).sortWithinPartitions("event_date", "project_id").write.mode(mode).partitionBy("event_date").parquet(path)


def without_projects(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows of other projects. Deleted projects are a list of names, which goes to all tasks: rows of a project are never brought together."""
    return rows.join(F.broadcast(deleted.select("project_id").distinct()), "project_id", "left_anti")


def retention_prune(rows: DataFrame, as_of: str, days: int, deleted: DataFrame | None = None, at: str = "observed_at") -> DataFrame:
    """Rows of the last days, without those of deleted projects."""
    kept = rows.where(F.to_date(at) >= F.date_sub(F.to_date(F.lit(as_of)), days))
    return kept if deleted is None else without_projects(kept, deleted)


def retention_cascade(tables: dict[str, DataFrame], as_of: str, deleted: DataFrame | None = None, raw_days: int = 30, aggregate_months: int = 12) -> dict[str, DataFrame]:
    """The tables of a workspace as they are to stay: raw observations of the last days, aggregates (with ``day``) of the last months.

    What is derived from observations (attempts and operations, by ``started_at``) goes with them. A deleted project goes from all.
    """
    months_ago = F.add_months(F.to_date(F.lit(as_of)), -aggregate_months)
    out = {}
    for name, rows in tables.items():
        if name == "aggregates":
            kept = rows.where(F.to_date("day") >= months_ago)
            out[name] = kept if deleted is None else without_projects(kept, deleted)
        else:
            out[name] = retention_prune(rows, as_of, raw_days, deleted, "observed_at" if name == "observations" else "started_at")
    return out


def write_tables(spark: SparkSession, database: str, tables: dict[str, tuple[DataFrame, str]], buckets: int = 64) -> None:
    """Managed tables of a database, each (rows, time column), by event date and bucketed by project: a join of two by project needs no shuffle.

    Tables are replaced. What goes together in joins must have the same number of buckets.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, (rows, at) in tables.items():
        dated = rows.withColumn("event_date", F.to_date(at))
        # One file a date and bucket: rows come dealt out as the table holds them.
        dealt = dated.repartition(buckets, "project_id")
        dealt.sortWithinPartitions("event_date", "project_id").write.mode("overwrite").partitionBy("event_date").bucketBy(buckets, "project_id").sortBy("project_id").saveAsTable(f"{database}.{name}")


def dates_of(spark: SparkSession, path: str) -> dict[str, object]:
    """The date partitions of a ledger, by date, as folders; nothing is read."""
    context = spark.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(context._jsc.hadoopConfiguration())
    found = {}
    for status in store.listStatus(root):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith("event_date="):
            found[name.removeprefix("event_date=")] = status.getPath()
    return found


def drop_dates(spark: SparkSession, path: str, dates: Iterable[str]) -> list[str]:
    """Delete date partitions of a ledger as they stand, without reading them; returns those that there were."""
    folders = dates_of(spark, path)
    gone = sorted(set(dates) & set(folders))
    for date in gone:
        folders[date].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folders[date], True)
    return gone


def retain(spark: SparkSession, path: str, as_of: str, days: int) -> list[str]:
    """Drop the dates of a ledger that are older than so many days; rows without a date stay. Returns the dates that went."""
    first = (datetime.date.fromisoformat(as_of[:10]) - datetime.timedelta(days=days)).isoformat()
    return drop_dates(spark, path, [d for d in dates_of(spark, path) if d[:1].isdigit() and d < first])


def erase(spark: SparkSession, path: str, projects: DataFrame) -> list[str]:
    """Delete the rows of projects (project_id) from a ledger: only dates that hold some are rewritten. Returns these dates.

    Dates are found by a scan of project_id alone. Their other rows are written where all executors read them, then replace the dates
    in one overwrite of these partitions, each file's rows from where they lie; dates of which nothing is left are dropped. A repeated call finds nothing more to do.
    """
    rows = spark.read.parquet(path)
    mine = F.broadcast(projects.select("project_id").distinct())  # names: rows of a project are never brought together
    touched = [r["d"] for r in rows.select("project_id", F.col("event_date").cast("string").alias("d")).join(mine, "project_id", "left_semi").select("d").distinct().collect()]  # dates
    if not touched:
        return []
    named = [d for d in touched if d is not None]
    where = F.col("event_date").cast("string").isin(named) | (F.col("event_date").isNull() if None in touched else F.lit(False))
    kept = stored(rows.where(where).join(mine, "project_id", "left_anti").select(*rows.columns))
    left = {r["d"] for r in kept.select(F.col("event_date").cast("string").alias("d")).distinct().collect()}
    kept.sortWithinPartitions("event_date", "project_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)
    drop_dates(spark, path, [d if d is not None else "__HIVE_DEFAULT_PARTITION__" for d in touched if d not in left])
    return sorted(d or "" for d in touched)


def experiment_history(spark: SparkSession, path: str) -> DataFrame:
    """One row per report file: date, status, verdicts as variant=verdict, and hashes, in order of date."""
    rows = spark.read.schema(schemas.REPORT).option("multiLine", True).json(path)
    verdicts = F.array_join(F.transform("variants", lambda v: F.concat_ws("=", v["variant_id"], v["verdict"])), ", ")
    return rows.select("run_date", "status", verdicts.alias("verdicts"), "manifest_hash", "prereg_hash").orderBy("run_date", "manifest_hash")
