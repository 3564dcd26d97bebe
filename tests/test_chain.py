"""From JSON lines to the report, in batch and stream, and from adapters' events to attempts."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallymark.operators import correlate, ingest, metrics
from tallymark.sources import files
from tallymark.streaming import jobs


def line(n, kind="attempt_completed", side="client", call="c1", principal="claude-otel@a", domain="a", outcome="success", health=None, signature=None, **more):
    payload = {"tool_call_id": call, "outcome": outcome, "duration_ms": 100 * n} if kind == "attempt_completed" else {"tool_call_id": call, "operation_id": f"op-{call}", "task_id": "k1"}
    row = {
        "spec_version": "0.4", "observation_id": f"obs-{n}", "observation_type": kind, "observer": {"principal": principal, "trust_domain": domain, "side": side},
        "observed_at": f"2024-05-01T00:00:{n:02d}Z", "deployment_context": {"project_id": "p"}, "surface": {"surface_id": "mcp_tool:search", "surface_namespace": "ns"},
        "caller": {"type": "claimed_agent", "runtime": "claude", "identity_strength": "declared"}, "client_key": "p-1", "usage_context": "production", "validity": "normal", "validity_source": "collector_derived",
        "provenance": "otel", "payload": payload,
    }
    if health:
        row["collection_health"] = health
    if signature:
        row |= {"signature": signature, "key_id": "key-1"}
    return json.dumps(row | more)


LINES = [
    line(1, "attempt_started"),
    line(2),
    line(3, side="server", principal="mcp-wrapper@b", domain="b"),
    line(4, call="c2", outcome="failure", health={"source_instance_id": "s", "source_sequence": 1, "sequence_epoch": "e", "dropped_since_last_report": 5, "buffer_overflow": True}),
    line(5, call="c3", signature="sig"),
    line(6, call="c4", outcome="success", health={"dropped_since_last_report": 0, "buffer_overflow": False}),
    "",
    "not json",
    line(7, call="c5", usage_context="somewhere"),
]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x-events-1.jsonl").write_text("\n".join(LINES) + "\n")
    return str(tmp_path)


VERIFIED = [("obs-5", "key-1"), ("obs-2", "key-1")]


def check(rows):
    """What the attempts and the report must say of LINES."""
    by_call = {r.attempt_key.split("|")[-1].split(":")[-1]: r for r in rows.collect()}
    assert set(by_call) == {"c1", "c2", "c3", "c4"}
    c1 = by_call["c1"]
    assert (c1.n_obs, c1.evidence, c1.outcome, c1.lifecycle, c1.operation_id, c1.has_client, c1.has_server) == (3, "independently-corroborated", "success", "L2", "op-c1", True, True)
    assert [by_call[c].collection_flagged for c in ("c1", "c2", "c3", "c4")] == [False, True, False, False]
    assert by_call["c3"].evidence == "authenticated" and by_call["c4"].evidence == "observed"
    report = metrics.project_report(rows).first()
    assert (report.attempts, report.success, report.failure, report.flagged, report.authenticated, report.known_callers, report.qualified) == (4, 3, 1, 1, 1, 4, 4)
    assert (report.success_rate, report.collection_coverage, report.operation_coverage) == (0.75, 0.75, 0.25)


def test_lines_to_report(spark, folder):
    judged = ingest.validate_envelope(files.read_observations(spark, f"{folder}/in"))
    assert {r.reason: r.n for r in ingest.reject_reasons(judged).collect()} == {None: 6, "observation": 1, "observation.usage_context": 1}
    flat = ingest.flatten_observation(judged.where(F.size("errors") == 0))
    assert [r.observation_id for r in flat.orderBy("line_no").collect()] == [f"obs-{n}" for n in range(1, 7)]
    assert flat.where("surface_namespace = 'ns' AND caller_type = 'claimed_agent' AND provenance = 'otel'").count() == 6
    flat = ingest.with_signatures(flat, spark.createDataFrame(VERIFIED, "observation_id string, key_id string"))
    check(correlate.attempts(correlate.dedup_observations(flat)))


def test_lines_to_report_in_a_stream(spark, folder):
    jobs.stream_validated(spark.readStream.text(f"{folder}/in").where("trim(value) <> ''"), f"{folder}/accepted", f"{folder}/rejected", f"{folder}/c1").awaitTermination()
    assert spark.read.parquet(f"{folder}/rejected").count() == 2
    accepted = spark.read.parquet(f"{folder}/accepted")
    stream = spark.readStream.schema(accepted.schema).parquet(f"{folder}/accepted").drop("batch")
    signed = ingest.with_signatures(jobs.stream_ingest(stream), spark.createDataFrame(VERIFIED, "observation_id string, key_id string"))
    jobs.stream_attempts(signed, f"{folder}/ledger", f"{folder}/attempts", f"{folder}/c2").awaitTermination()
    check(jobs.latest(spark, f"{folder}/attempts"))


def test_adapters_to_attempts(spark, tmp_path):
    rows = [{"tool": "t", "tool_call_id": "c1", "outcome": "success", "duration_ms": "12", "session_key": "s", "observed_at": "2024-05-01T00:00:00Z"}, {"tool": "t", "tool_call_id": "c2", "observed_at": "2024-05-01T00:00:01Z"}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    raw = files.read_adapter_events(spark, str(tmp_path / "a.jsonl"))
    pads = ingest.monthly_pads(spark, b"secret", ["2024-05"])
    flat = ingest.normalize_adapter(raw, "mcp-wrapper", "p", "mcp-wrapper@b", pads, "b")
    client = ingest.normalize_adapter(raw.withColumn("tool_name", F.col("tool")).withColumn("tool_use_id", F.col("tool_call_id")), "codex-hook", "p", "codex-hook@a", pads, "a")
    assert {r.source_event_id for r in client.collect()} == {"c1", "c2"} and {r.source_event_id for r in flat.collect()} == {None}
    found = {r.n_obs: r for r in correlate.attempts(correlate.dedup_observations(flat.unionByName(client))).where("outcome = 'inconsistent' OR has_server").collect()}
    assert found[2].evidence == "independently-corroborated"


def test_lines_keep_their_order_over_splits(spark, tmp_path):
    (tmp_path / "e-events.jsonl").write_text("".join(f'{{"n": "{n:07d}", "pad": "{"x" * 90}"}}\n' for n in range(8_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 << 10))
    try:
        rows = files.read_lines(spark, str(tmp_path)).select(F.get_json_object("value", "$.n").cast("int").alias("n"), "line_no").orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.n for r in rows] == list(range(8_000))


def test_bounded_state_differs_only_beyond_the_gap(spark, tmp_path):
    """Sides within the gap are one attempt as in the ledger's form; a side after it is an attempt of its own."""
    at = "CAST('2024-01-01 00:00:00' AS TIMESTAMP) + make_interval(0, 0, 0, 0, 0, 0, CAST(s AS DECIMAL(18,6)))"
    rows = [("o1", 0, "client", "c1", None), ("o2", 200, "server", "c1", None), ("o3", 0, "client", "c2", None), ("o4", 2000, "server", "c2", None), ("o5", 10, "client", None, "t1"), ("o6", 20, "server", None, "t1"), ("o7", 30, "client", None, "t2"), ("o8", 40, "client", None, "t2"), ("o9", 50, "client", None, None)]
    obs = spark.createDataFrame(rows, "observation_id string, s int, observer_side string, tool_call_id string, trace_id string")
    obs = obs.selectExpr("observation_id", f"{at} AS observed_at", "CAST(s AS BIGINT) AS line_no", "observer_side", "observer_side AS observer_principal", "observer_side AS trust_domain", "'p' AS project_id", "'t' AS tool", "tool_call_id", "trace_id")
    obs.coalesce(1).write.parquet(f"{tmp_path}/in")
    for n, late in enumerate((1_000_000, 2_000_000)):
        end = spark.createDataFrame([(f"end{n}", late, "client", None, None)], "observation_id string, s int, observer_side string, tool_call_id string, trace_id string")
        end.selectExpr("observation_id", f"{at} AS observed_at", "CAST(s AS BIGINT) AS line_no", "observer_side", "observer_side AS observer_principal", "observer_side AS trust_domain", "'p' AS project_id", "'t' AS tool", "tool_call_id", "trace_id").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = jobs.run_once(jobs.stream_attempts_bounded(stream, "10 minutes"), spark, f"{tmp_path}/out", f"{tmp_path}/c")
    got = sorted((r.attempt_key, r.n_obs, r.evidence) for r in out.where("attempt_key NOT LIKE '%end%'").collect())
    batch = sorted((r.attempt_key, r.n_obs, r.evidence) for r in correlate.attempts(obs).collect())
    split = [x for x in batch if "c2" in x[0]]
    assert [x for x in got if "c2" not in x[0]] == [x for x in batch if "c2" not in x[0]]
    assert [x[1] for x in split] == [2] and [x[1:] for x in got if "c2" in x[0]] == [(1, "observed"), (1, "observed")]
