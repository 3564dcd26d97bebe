"""Queries that run a stream over the views and return what it wrote; equal to the batch operators on whole inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.plans.intake import envelope, scratch
from tallymark.plans.registry import query
from tallymark.plans.usage import observations
from tallymark.plans.views import view
from tallymark.streaming import jobs


def source(spark: SparkSession, sf_dir: str, name: str, condition: str = "true") -> DataFrame:
    """A view as a stream of Parquet files."""
    path = scratch(spark)
    rows = view(spark, sf_dir, name).where(condition)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def drained(spark: SparkSession, out: DataFrame) -> DataFrame:
    base = scratch(spark)
    return jobs.run_once(out, spark, f"{base}/out", f"{base}/checkpoint")


@query("stream_ingest", "SELECT observation_id, tool FROM fx_trace_obs")
def _ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(spark, jobs.stream_ingest(source(spark, sf_dir, "fx_trace_obs"), "400 days")).select("observation_id", "tool")


@query("stream_validated", "SELECT errors, count(*) AS n FROM s_faults GROUP BY errors")
def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted lines have empty errors here."""
    base, path = scratch(spark), scratch(spark)
    envelope(observations(spark, sf_dir)).select("value").write.option("compression", "gzip").text(path)
    jobs.stream_validated(spark.readStream.text(path), f"{base}/accepted", f"{base}/rejected", f"{base}/checkpoint").awaitTermination()
    good = spark.read.parquet(f"{base}/accepted").select(F.lit("").alias("errors"))
    return good.unionByName(spark.read.parquet(f"{base}/rejected").select(F.array_join("errors", "; ").alias("errors"))).groupBy("errors").agg(F.count("*").alias("n"))


@query("stream_attempts", "SELECT attempt_key, count(*) AS n_obs FROM s_keyed_trace GROUP BY attempt_key")
def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In three batches, by the event's number, so that sides come late."""
    base, path = scratch(spark), scratch(spark)
    rows = view(spark, sf_dir, "fx_trace_obs")
    for n in range(3):
        rows.where(F.col("line_no") % 3 == n).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    jobs.stream_attempts(stream, f"{base}/ledger", f"{base}/attempts", f"{base}/checkpoint").awaitTermination()
    return jobs.latest(spark, f"{base}/attempts").select("attempt_key", "n_obs")


@query("stream_attempts_bounded", "SELECT attempt_key, matched_by, count(*) AS n_obs, min(observed_at) AS started_at FROM s_keyed_trace GROUP BY attempt_key, matched_by")
def _bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All observations, then two far in the future, which let the sessions of the others end."""
    base, path = scratch(spark), scratch(spark)
    rows = view(spark, sf_dir, "fx_trace_obs")
    rows.coalesce(1).write.parquet(path)
    for year in (2100, 2101):
        far = rows.limit(1).withColumn("observed_at", F.lit(f"{year}-01-01").cast("timestamp_ntz")).withColumn("observation_id", F.lit(f"end-{year}")).withColumn("trace_id", F.lit(None).cast("string"))
        far.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = jobs.run_once(jobs.stream_attempts_bounded(stream, "5 minutes"), spark, f"{base}/out", f"{base}/checkpoint")
    return out.where("attempt_key NOT LIKE 's|end-%'").select("attempt_key", "matched_by", "n_obs", F.col("started_at").cast("timestamp_ntz").alias("started_at"))


@query("stream_daily_metrics")
def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.stream_daily_metrics(source(spark, sf_dir, "fx_trace_obs"))
    base, rows = scratch(spark), out.select(F.col("window.start").cast("string").alias("day"), "project_id", "n", "principals")
    return jobs.run_latest(rows, ["day", "project_id"], spark, f"{base}/out", f"{base}/checkpoint")


@query(
    "stream_sliding_metrics",
    """SELECT CAST(CAST(observed_at AS DATE) - CAST(k AS INT) AS VARCHAR) AS first_day, project_id, count(*) AS n FROM fx_trace_obs, (SELECT unnest(range(0, 30)) AS k) GROUP BY ALL""",
)
def _sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 30 days that slide by one, those still open included."""
    out = jobs.stream_daily_metrics(source(spark, sf_dir, "fx_trace_obs"), every="30 days", slide="1 day")
    base, rows = scratch(spark), out.select(F.col("window.start").cast("date").cast("string").alias("first_day"), "project_id", "n")
    return jobs.run_latest(rows, ["first_day", "project_id"], spark, f"{base}/out", f"{base}/checkpoint")


@query(
    "stream_consumption",
    """SELECT r.project_id, r.tool_use_id, q.line_no AS request_line FROM fx_consumption r JOIN fx_consumption q ON r.type = 'tool_result' AND q.type = 'request'
    AND q.project_id = r.project_id AND q.consumed_tool_use_id = r.tool_use_id AND q.ts >= r.ts AND q.ts <= r.ts + INTERVAL 400 DAY""",
)
def _consumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = source(spark, sf_dir, "fx_consumption", "type = 'tool_result'")
    requests = source(spark, sf_dir, "fx_consumption", "type = 'request' AND consumed_tool_use_id IS NOT NULL")
    return drained(spark, jobs.stream_consumption(results, requests, "400 days", "400 days"))


@query(
    "stream_gaps",
    """SELECT source_instance_id, sequence_epoch, p + 1 AS first_missing, source_sequence - 1 AS last_missing FROM
    (SELECT *, lag(source_sequence) OVER (PARTITION BY source_instance_id, sequence_epoch ORDER BY source_sequence) AS p FROM fx_sequence) WHERE source_sequence - p > 1""",
)
def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, rocks)
    try:
        return drained(spark, jobs.stream_gaps(source(spark, sf_dir, "fx_sequence")))
    finally:
        spark.conf.set(key, before)
