"""Pointer doubling, bitmaps of numbers and of days, sketches and additive fingerprints against plain versions."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tallymark.operators import correlate, experiment, metrics


def test_chains_branches_and_cycles(spark):
    """A chain of 40, a branch, a chain whose head nobody saw, a cycle of three with a tail, and an attempt that retries itself."""
    edges = [(f"c{k}", f"c{k - 1}") for k in range(1, 40)] + [("b1", "c3"), ("x1", "unseen"), ("r0", "r2"), ("r1", "r0"), ("r2", "r1"), ("t", "r0"), ("me", "me")]
    links = spark.createDataFrame(edges, "attempt_key string, retried string").withColumn("project_id", F.lit("p"))
    got = {r.attempt_key: (r.head, r.place, r.cyclic) for r in correlate.retry_ranks(links).collect()}
    want = {f"c{k}": ("c0", k, False) for k in range(40)} | {"b1": ("c0", 4, False), "unseen": ("unseen", 0, False), "x1": ("unseen", 1, False)}
    assert got == want | {k: (None, None, True) for k in ("r0", "r1", "r2", "t", "me")}
    assert correlate.retry_ranks(links.where("false")).collect() == []


def test_gaps_of_one_source_in_many_ranges(spark):
    rng = random.Random(3)
    there = sorted({rng.randrange(-70_000, 200_000) for _ in range(3000)} | {0, 32_767, 32_768, 65_535})
    rows = spark.createDataFrame([("s", "e", n) for n in there * 2] + [("s", "e", None), (None, "e", 1), (None, "e", 4)], "source_instance_id string, sequence_epoch string, source_sequence long")
    got = sorted((r.first_missing, r.last_missing) for r in correlate.sequence_gaps(rows).where("source_instance_id = 's'").collect())
    assert got == [(a + 1, b - 1) for a, b in zip(there, there[1:]) if b - a > 1]
    assert [tuple(r)[2:] for r in correlate.sequence_gaps(rows).where("source_instance_id IS NULL").collect()] == [(2, 3)]


def test_day_seven_is_not_any_later_day(spark):
    days = {"a": (0, 7), "b": (0, 151), "c": (0, 6, 8, 30), "d": (0, 9), "e": (0,)}
    rows = spark.createDataFrame([(c, d) for c, ds in days.items() for d in ds], "client_key string, d int")
    rows = rows.select("client_key", F.lit("p").alias("project_id"), F.date_add(F.lit("2023-12-20").cast("date"), F.col("d")).cast("timestamp").alias("started_at"))
    assert [tuple(r)[2:] for r in metrics.cohort_retention(rows).collect()] == [(5, 1, 1)]
    assert [tuple(r)[2:] for r in metrics.cohort_retention(rows, (7, 30), 3).collect()] == [(5, 3, 1)]


def test_any_window_is_a_merge_of_days(spark):
    """40,000 clients over 90 days: unions within 2 %, repeated clients within 3 % of all."""
    rows = spark.range(120_000).select(
        F.lit("p").alias("project_id"), (F.pmod(F.xxhash64("id"), F.lit(40_000))).cast("string").alias("client_key"), F.timestamp_seconds(1_700_000_000 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(90 * 86_400))).alias("started_at")
    )
    ledger = metrics.client_ledger(rows).cache()
    for first, last in ((None, None), ("2023-12-01", "2023-12-10")):
        day = F.to_date("started_at")
        part = rows if first is None else rows.where((day >= first) & (day <= last))
        exact = part.agg(F.count_distinct("client_key")).first()[0]
        assert abs(metrics.active_clients_sketched(ledger, first, last).first().clients / exact - 1) < 0.02
    exact, about = metrics.repeat_clients(rows, 30).first(), metrics.repeat_clients_sketched(ledger, 30).first()
    assert abs(about.clients / exact.clients - 1) < 0.03 and abs(about.repeat_clients - exact.repeat_clients) < 0.03 * exact.clients


def test_percentiles_from_merged_days(spark):
    rows = spark.range(50_000).select(F.lit("p").alias("project_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).alias("observed_at"), F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("duration_ms"))
    got = metrics.latency_sketched(metrics.latency_ledger(rows)).first()
    values = sorted(r[0] for r in rows.select("duration_ms").collect())
    for value, p in ((got.p50_ms, 0.5), (got.p95_ms, 0.95)):
        assert abs(sum(v <= value for v in values) / len(values) - p) < 0.01
    assert got.n == 50_000


def test_fingerprints_add_up(spark):
    rows = spark.range(300).select("id", F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("name"))
    whole = experiment.table_fingerprint(rows).first()
    assert experiment.table_fingerprint(rows.orderBy(F.desc("id")).repartition(7)).first() == whole
    assert experiment.table_fingerprint(rows.unionByName(rows.limit(1))).first() != whole
    assert experiment.table_fingerprint(rows.withColumn("name", F.coalesce("name", F.lit("-")))).first() != whole
    parts = [experiment.table_fingerprint(rows.where(f"id % 3 = {k}")) for k in range(3)]
    assert experiment.merged_fingerprint(parts[0].unionByName(parts[1]).unionByName(parts[2])).first() == whole
    assert experiment.merged_fingerprint(experiment.table_fingerprint(rows), parts[1]).first() == experiment.table_fingerprint(rows.where("id % 3 <> 1")).first()
    assert tuple(experiment.table_fingerprint(rows.where("false")).first()) == (0, 0, 0, 0, 0)
