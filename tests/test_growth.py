"""What keeps the queries' cost in step with their input: plans, rounds and files."""

from __future__ import annotations

import glob
import json

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.operators import consumption, correlate, ingest, metering, metrics
from tallymark.plans import intake, usage
from tallymark.sources import files
from tallymark.streaming import jobs

SF = "/root/testdata/sf0.001"


def plan(rows: DataFrame) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def test_lines_are_written_compressed(spark):
    root = files.shared_folder(spark).removeprefix("file://")
    before = set(glob.glob(f"{root}/*/part-*"))
    assert intake._read(spark, SF).collect()
    new = set(glob.glob(f"{root}/*/part-*")) - before
    assert new and all(name.endswith(".txt.gz") for name in new)


def test_choice_events_are_written_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(intake, "scratch", lambda spark: f"{tmp_path}/events")
    assert intake._read_choice(spark, SF).collect()
    names = [name for name in glob.glob(f"{tmp_path}/events/*") if "part-" in name]
    assert names and all(name.endswith(".json.gz") for name in names)


def test_a_batch_of_lines_is_not_kept(spark, tmp_path, monkeypatch):
    spark.createDataFrame([("{}",), ("x",)], "value string").write.text(f"{tmp_path}/in")
    kept = []
    monkeypatch.setattr(DataFrame, "persist", lambda self, *a: kept.append(1) or self)
    jobs.stream_validated(spark.readStream.text(f"{tmp_path}/in"), f"{tmp_path}/yes", f"{tmp_path}/no", f"{tmp_path}/c").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/no").count() == 2 and not kept


@pytest.mark.parametrize("least", ["none", "correlated"])
def test_events_of_one_kind_are_not_brought_together(spark, least):
    rows = spark.range(100).select(F.concat(F.lit("op-"), F.col("id") % 7).alias("operation_id"), F.lit("e").alias("billable_event"), F.lit("normal").alias("validity"), F.lit("explicit").alias("resolution"))
    policy = spark.createDataFrame([("e", "unit", 1, ["replay"])], "billable_event string, billable_unit string, billable_quantity long, exclusions array<string>")
    out = metering.meter_events(rows, policy, least)
    assert sorted(r.attempts for r in out.collect()) == [14] * 5 + [15] * 2
    assert "SortMergeJoin" not in plan(out)


def test_rounds_follow_the_longest_chain_beside_a_cycle(spark, monkeypatch):
    pairs = [(f"a{i}", f"a{i - 1}") for i in range(1, 6)] + [("x", "y"), ("y", "z"), ("z", "x"), ("w", "x")] + [(f"b{i}", f"c{i}") for i in range(2000)]
    links = spark.createDataFrame(pairs, "attempt_key string, retried string")
    calls, stored = [], files.stored
    monkeypatch.setattr(correlate, "stored", lambda rows: calls.append(1) or stored(rows))
    got = {r.attempt_key: (r.head, r.place, r.cyclic) for r in correlate.retry_ranks(links).collect()}
    assert len(calls) <= 3 + 4  # three tables, and rounds for 5 = log2 + 1, of which the last finds nothing
    assert got["a5"] == ("a0", 5, False) and got["b7"] == ("c7", 1, False) and got["a0"] == ("a0", 0, False)
    assert all(got[k] == (None, None, True) for k in "xyzw")


def test_retries_derive_attempts_once(spark):
    text = plan(correlate.retry_links(usage.retried(spark, SF)))
    assert "Join" not in text.replace("SortMergeJoin [l_orderkey", "").replace("BroadcastHashJoin [l_orderkey", "")
    # What is stored is read, not derived again.
    assert "observation_id" not in plan(correlate.retry_rate(usage.retried(spark, SF)))
    assert "observation_id" not in plan(correlate.retry_relation(usage.retried(spark, SF)))


def test_deleted_projects_bring_no_rows_together(spark, tmp_path):
    rows = spark.range(60).select(F.concat(F.lit("p"), F.col("id") % 3).alias("project_id"), F.lit("2024-01-02 00:00:00").cast("timestamp").alias("observed_at"))
    deleted = spark.createDataFrame([("p1",)], "project_id string")
    assert "SortMergeJoin" not in plan(files.retention_prune(rows, "2024-01-03", 5, deleted))
    files.write_ledger(rows, f"{tmp_path}/l", "observed_at")
    had = len(glob.glob(f"{tmp_path}/l/*/*.parquet"))
    assert files.erase(spark, f"{tmp_path}/l", deleted) == ["2024-01-02"]
    assert spark.read.parquet(f"{tmp_path}/l").count() == 40 and len(glob.glob(f"{tmp_path}/l/*/*.parquet")) <= had


def test_unsigned_observations_meet_no_verifier(spark):
    obs = spark.createDataFrame([("a", "s", "k"), ("b", "s", "k"), ("c", None, "k"), ("d", "", "k"), ("e", "s", None)], "observation_id string, signature string, key_id string").withColumn("signature_valid", F.lit(None).cast("boolean"))
    out = ingest.with_signatures(obs, spark.createDataFrame([("a", "k"), ("c", "k"), ("d", "k")], "observation_id string, key_id string"))
    assert {r.observation_id: r.signature_valid for r in out.collect()} == {"a": True, "b": False, "c": False, "d": False, "e": False}
    assert "Union" in plan(out)


def test_rows_are_dealt_out_plain_and_traces_alone_meet(spark):
    obs = usage.observations(spark, SF)
    assert "REPARTITION_BY_COL" in plan(obs)
    text = plan(correlate.keyed(obs))
    assert "Union" in text and text.count("Window") == 1


def test_attempts_are_derived_once(spark):
    attempts = correlate.attempts(usage.observations(spark, SF))
    assert plan(metrics.measurement_label(attempts, "2001-08-02", 10)).count("hashpartitioning(attempt_key") == 1
    obs = usage.observations(spark, SF)
    assert plan(consumption.consumed_rate(obs, obs.select("project_id", "tool_call_id"), strict=True)).count("hashpartitioning(attempt_key") == 1


def test_pads_go_to_all_tasks(spark):
    pads = ingest.monthly_pads(spark, b"k", ["2024-01"])
    rows = spark.createDataFrame([("u", "2024-01-05")], "raw string, at string")
    out = ingest.pseudonymize(rows, pads, "h", "raw", "at")
    assert "SortMergeJoin" not in plan(out) and out.collect()[0].client_key.startswith("p-")


LINE = {
    "spec_version": "0.4", "observation_id": "o", "observation_type": "attempt_completed", "observer": {"principal": "p", "side": "client"}, "observed_at": "2024-05-06T07:08:09Z", "deployment_context": {"project_id": "p"},
    "surface": {"surface_id": "mcp_tool:t", "provider_claim": None}, "caller": {"type": "unknown", "runtime": "r"}, "usage_context": "production", "validity": "normal", "provenance": "otel",
    "payload": {"tool_call_id": "c", "outcome": "success", "duration_ms": 12}, "signature": None,
}


def test_sound_lines_are_told_by_their_text_and_by_a_search_alike(spark, monkeypatch):
    """Each field in turn is taken away or gets other values: no line that a search finds fault with passes for sound."""
    odd = [None, "", "x", 5, 3.5, 10**18, 10**19, True, {}, [], {"zzz": 1}, "unknown", "a\"b", "é", "2024-05-06T07:08:09.5+02:00", "declared", "claimed_agent"]
    made = [LINE, {"zzz": 1} | LINE, LINE | {"zzz": 1}, dict(reversed(LINE.items())), LINE | {"sampling": {"rate": "1"}}, LINE | {"sampling": None}]
    for name in [*LINE, "client_key", "context_source", "collection_health"]:
        made += [LINE | {name: v} for v in odd] + [{k: v for k, v in LINE.items() if k != name}]
        if isinstance(LINE.get(name), dict):
            for inner in [*LINE[name], "identity_strength", "trace_id", "error_type", "trust_domain"]:
                made += [LINE | {name: LINE[name] | {inner: v}} for v in odd] + [LINE | {name: {k: v for k, v in LINE[name].items() if k != inner}}]
    payloads = [("attempt_started", {"tool_call_id": "c", "started_at": "s"}), ("selection", {"decision_id": "d", "rank": 1, "decision_authority": "model", "selection_constraint": "forced", "selection_reason_observable": True}), ("task_outcome", {"task_id": "t", "task_success": False, "ended_at": "e"})]
    made += [LINE | {"observation_type": kind, "payload": payload} for kind, payload in payloads]
    lines = [json.dumps(m, separators=(",", ":"), ensure_ascii=False) for m in made]
    lines += [json.dumps(LINE), lines[0] + "\n", " " + lines[0], lines[0][:-1], lines[0] + "}", lines[0].replace('"o"', '"o","observation_id":"o"'), "", "null", "[]"]
    rows = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "n long, value string")
    by_text = {r.n for r in rows.where(ingest.sound("value")).collect()}
    got = {r.n: r.errors for r in ingest.validate_envelope(rows, versions=("0.4",)).collect()}
    monkeypatch.setattr(ingest, "LONGEST", -1)
    monkeypatch.setattr(ingest, "typed", lambda shape: F.lit(False))  # nor is any line known to have no field of another type
    assert rows.where(ingest.sound("value")).count() == 0
    searched = {r.n: r.errors for r in ingest.validate_envelope(rows, versions=("0.4",)).collect()}
    assert got == searched and {0, len(made) - 1, len(made) - 2, len(made) - 3} <= by_text
    assert all(not searched[n] for n in by_text - {n for n, line in enumerate(lines) if '"spec_version":"0.4"' not in line})


def test_sound_lines_are_not_parsed(spark):
    """A line that is sound gets no variant and no envelope: both stand under a condition."""
    rows = spark.createDataFrame([("{}",)], "value string")
    text = plan(ingest.validate_envelope(rows).select("errors"))
    assert text.count("from_json(") == text.count("THEN from_json(") > 0 and text.count("try_parse_json(") == text.count("THEN try_parse_json(")


def test_only_ids_that_stand_twice_are_dealt_out(spark):
    ids = [f"o{i}" for i in range(50)] + ["o7", "o7", "", None]
    rows = spark.createDataFrame([(x, f"2024-01-{1 + n % 28:02}", n) for n, x in enumerate(ids)], "observation_id string, observed_at string, line_no long")
    out = correlate.dedup_observations(rows)
    alone, again = plan(out).split("LeftSemi")
    assert "LeftAnti" in alone and "hashpartitioning(observation_id" not in again
    assert alone.count("hashpartitioning") == 1 and alone.index("LeftAnti") < alone.index("hashpartitioning")
    assert sorted((r.observation_id, r.line_no) for r in out.collect()) == sorted((f"o{i}", i) for i in range(50))
