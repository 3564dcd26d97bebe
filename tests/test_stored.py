"""Ledgers as they are stored: dates dropped unread, projects erased in place, joins without a shuffle."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from tallymark.sources import files


def ledger(spark, path, n=60):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 6).cast("int"))
    rows = spark.range(n).select(F.concat(F.lit("p"), F.when(F.col("id") % 6 == 5, 0).otherwise(F.col("id") % 4)).alias("project_id"), day.cast("timestamp").alias("observed_at"), "id")
    files.write_ledger(rows, path, "observed_at")
    return rows


def files_of(tmp_path):
    return {p: p.stat().st_mtime_ns for p in tmp_path.glob("ledger/event_date=*/*.parquet")}


def test_old_dates_go_unread(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    ledger(spark, path)
    for p in tmp_path.glob("ledger/event_date=2024-01-01/*.parquet"):
        p.write_bytes(b"not a table")  # nobody may read it
    assert files.retain(spark, path, "2024-01-05 00:00:00", 2) == ["2024-01-01", "2024-01-02"]
    assert sorted(r[0] for r in spark.read.parquet(path).select(F.col("event_date").cast("string")).distinct().collect()) == ["2024-01-03", "2024-01-04", "2024-01-05", "2024-01-06"]
    assert files.retain(spark, path, "2024-01-05 00:00:00", 2) == []


def test_only_touched_dates_are_rewritten(spark, tmp_path):
    """p0 is the only project of the last date, which goes; p0 is in three dates, the others stay as they are."""
    path = f"{tmp_path}/ledger"
    rows = ledger(spark, path)
    before = files_of(tmp_path)
    gone = files.erase(spark, path, spark.createDataFrame([("p0",)], "project_id string"))
    touched = {r[0] for r in rows.where("project_id = 'p0'").select(F.to_date("observed_at").cast("string")).distinct().collect()}
    assert set(gone) == touched and "2024-01-06" in touched and len(touched) < 6
    after = files_of(tmp_path)
    assert {p for p in before if p.parent.name.removeprefix("event_date=") not in touched} == {p for p in after if before.get(p) == after[p]}
    assert not (tmp_path / "ledger" / "event_date=2024-01-06").exists()
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == sorted(r.id for r in rows.where("project_id <> 'p0'").collect())
    assert files.erase(spark, path, spark.createDataFrame([("p0",)], "project_id string")) == []


def test_tables_join_by_project_without_a_shuffle(spark):
    at = F.lit("2024-01-01").cast("timestamp")
    rows = spark.range(200).select(F.concat(F.lit("p"), F.col("id") % 9).alias("project_id"), "id", at.alias("at"))
    files.write_tables(spark, "stored_test", {"observations": (rows, "at"), "attempts": (rows.withColumnRenamed("id", "attempt"), "at")}, buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("stored_test.observations").join(spark.table("stored_test.attempts"), "project_id")
        counts = joined.groupBy("project_id").agg(F.count("*").alias("n"))
        with redirect_stdout(io.StringIO()) as plan:
            counts.explain()
        assert "Exchange" not in plan.getvalue()
        assert counts.agg(F.sum("n")).first()[0] == rows.groupBy("project_id").count().selectExpr("sum(count * count)").first()[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP DATABASE stored_test CASCADE")
