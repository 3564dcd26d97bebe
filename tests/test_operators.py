"""Hand-made cases: rules that the tables do not reach, and numbers that are known."""

from __future__ import annotations

import hashlib
import hmac
import json
import math

import pytest
from pyspark.sql import functions as F

from tallymark.functions import stats
from tallymark.operators import choice, consumption, correlate, experiment, ingest, metering, metrics
from tallymark.sources import schemas

OBS = "observation_id string, observed_at timestamp, line_no int, observation_type string, observer_principal string, observer_side string, trust_domain string, project_id string, tool string, tool_call_id string, trace_id string, outcome string, usage_context string, validity string, validity_source string, operation_id string, task_id string"


def observed(spark, *rows):
    base = dict(observation_type="attempt_completed", observer_principal="a", observer_side="client", trust_domain="t1", project_id="p", tool="x", tool_call_id=None, trace_id=None, outcome=None, usage_context="production", validity="normal", validity_source="none", operation_id=None, task_id=None)
    names = [c.split()[0] for c in OBS.split(", ")]
    import datetime

    full = [{**base, "observation_id": f"o{i}", "line_no": i, "observed_at": datetime.datetime(2024, 1, 1, 0, 0, i), **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], OBS)


def attempt(spark, *rows):
    return correlate.attempts(correlate.dedup_observations(observed(spark, *rows))).collect()


def test_both_sides_of_a_call_are_one_attempt(spark):
    (row,) = attempt(spark, dict(tool_call_id="c", observer_side="client", outcome="success"), dict(tool_call_id="c", observer_side="server", observer_principal="b", trust_domain="t2", outcome="success"))
    assert (row.evidence, row.outcome, row.n_obs) == ("independently-corroborated", "success", 2)


def test_conflicting_outcomes_are_inconsistent_and_unknown_is_a_value(spark):
    (row,) = attempt(spark, dict(tool_call_id="c", outcome="unknown"), dict(tool_call_id="c", outcome="success"))
    assert row.outcome == "inconsistent"


def test_a_trace_needs_two_sides(spark):
    assert len(attempt(spark, dict(trace_id="t"), dict(trace_id="t"))) == 2
    assert len(attempt(spark, dict(trace_id="t"), dict(trace_id="t", observer_side="server"))) == 1


def test_null_call_ids_never_meet(spark):
    assert len(attempt(spark, dict(), dict(), dict())) == 3


def test_provider_configuration_never_qualifies(spark):
    (row,) = attempt(spark, dict(tool_call_id="c", validity_source="provider_configuration"))
    assert (row.validity, row.qualification_status) == ("unknown", "unknown")
    both = dict(tool_call_id="c", observer_side="server", validity_source="collector_derived")
    provider = dict(tool_call_id="c", validity_source="provider_configuration")
    (row,) = attempt(spark, provider, both)
    assert (row.validity, row.qualification_status) == ("normal", "qualified")
    (row,) = attempt(spark, provider, {**both, "validity": "replay"})
    assert (row.validity, row.qualification_status) == ("replay", "partially_classified")


def test_bars_in_names_keep_attempts_apart(spark):
    assert len(attempt(spark, dict(tool_call_id="c", project_id="a|b", tool="x"), dict(tool_call_id="c", project_id="a", tool="b|x"))) == 2
    assert len(attempt(spark, dict(tool_call_id="c", tool=None), dict(tool_call_id="c", tool=""))) == 2


def test_tasks_without_a_name_or_a_start_do_not_chain(spark):
    rows = correlate.attempts(observed(spark, dict(task_id="", outcome="failure"), dict(task_id="", outcome="success"), dict(task_id="k", observed_at=None), dict(task_id="k")))
    assert sorted(r.resolution for r in correlate.operations_structural(rows).collect()) == ["structural", "unknown", "unknown", "unknown"]


def test_repeated_observation_counts_once(spark):
    rows = observed(spark, dict(tool_call_id="c"), dict(tool_call_id="c"))
    again = rows.withColumn("observation_id", F.lit("same"))
    assert correlate.dedup_observations(again).count() == 1


def test_chains_end_with_an_outcome_that_is_not_retried(spark):
    rows = correlate.attempts(observed(spark, *(dict(tool_call_id=f"c{i}", task_id="k", outcome=o) for i, o in enumerate(["failure", "success", "success"]))))
    found = correlate.operations_structural(rows).collect()
    assert len({r.operation_id for r in found}) == 2 and all(r.resolution == "structural" for r in found)


def test_percentiles_of_the_known_latency_sequence(spark):
    rows = spark.createDataFrame([("p", 20 + (i * 37) % 280) for i in range(42)], "project_id string, duration_ms int")
    (row,) = metrics.latency_stats(rows).collect()
    assert (row.n, row.min_ms, row.max_ms, row.p50_ms, row.p95_ms, round(row.mean_ms, 1)) == (42, 20, 295, 147, 279, 151.8)


def test_hmac_from_built_ins(spark):
    rows = spark.createDataFrame([("alice",), ("",), (None,)], "raw string").withColumn("at", F.to_timestamp(F.lit("2024-05-06")))
    got = [r.client_key for r in ingest.pseudonymize(rows, ingest.monthly_pads(spark, b"k", ["2024-05"]), "h", "raw", "at").collect()]
    key = hmac.new(b"k", b"2024-05", hashlib.sha256).digest()
    assert got == ["p-" + hmac.new(key, b"h:alice", hashlib.sha256).hexdigest()[:20], "", ""]


def test_unparsable_times_are_null(spark):
    rows = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("soon",), (None,)], "t string").select(ingest.parse_ts("t").alias("t")).collect()
    assert [r.t is None for r in rows] == [False, True, True]


def test_ambiguous_consumption_links_nothing(spark):
    rows = [(1, "tool_result", "u1", "x", None, None), (2, "tool_result", "u2", "x", None, None), (3, "request", None, None, None, "x"), (4, "request", None, None, "u1", None), (5, "request", None, None, None, "x"), (6, "request", None, None, None, "x")]
    data = spark.createDataFrame([(r[0], "p", *r[1:], r[0]) for r in rows], "line_no long, project_id string, type string, tool_use_id string, tool string, consumed_tool_use_id string, mcp_tool string, seq long")
    got = {r.request_line: (r.kind, r.tool_use_id) for r in consumption.consumption_inferred(data).collect()}
    assert got == {3: ("ambiguous", None), 5: ("linked", "u2"), 6: ("none", None)}


def test_wilson_and_z(spark):
    (row,) = spark.range(1).select(*(c.alias(n) for c, n in zip(stats.wilson(F.lit(50), F.lit(100)), "lh", strict=True)), stats.two_proportion_z(F.lit(50), F.lit(100), F.lit(70), F.lit(100)).alias("z")).collect()
    assert (round(row.l, 4), round(row.h, 4), round(row.z, 4)) == (0.4038, 0.5962, 2.8868)


def test_two_sided_p(spark):
    zs = [0.0, 0.3, -1.0, 1.959963985, 3.5, 6.0]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", stats.two_sided_p("z").alias("p")).collect()
    assert all(math.isclose(r.p, math.erfc(abs(r.z) / 2**0.5), rel_tol=2e-7) for r in rows)


def test_required_sample(spark):
    (row,) = spark.range(1).select(stats.required_n(F.lit(0.1), F.lit(0.15)).alias("n"), stats.required_n(F.lit(0.1), F.lit(0.1)).alias("none")).collect()
    assert (row.n, row.none) == (683, None)


def test_final_words_on_variants(spark):
    compared = spark.createDataFrame([(v, "significant", "improvement") for v in ("good", "broke", "both", "worse_money")] + [("down", "significant", "regression"), ("flat", "null_result", None), ("few", "undetermined", None)], "variant_id string, verdict string, direction string")
    flags = spark.createDataFrame([("both", True), ("flat", True)], "variant_id string, flagged boolean")
    breaches = spark.createDataFrame([(v, "breach") for v in ("broke", "both", "flat")], "variant_id string, status string")
    dominated = spark.createDataFrame([("worse_money", "good")], "variant_id string, dominated_by string")
    got = {r.variant_id: r for r in experiment.variant_verdicts(compared, flags, breaches, dominated).collect()}
    want = {"good": "adopt_candidate", "broke": "effective_not_qualified", "both": "unverified_growth", "worse_money": "adopt_candidate", "down": "regression_reject", "flat": "null_result", "few": "undetermined"}
    assert {v: r.final for v, r in got.items()} == want
    assert got["worse_money"].action == "do not pick: dominated by good" and got["good"].action == "ship behind a flag"


def test_connections_export_what_they_may(spark):
    rows = spark.createDataFrame([("v", "reach", None, None, None, None), ("v", "choice", True, None, None, None), ("v", "operation_result", None, "success", 3, None), ("v", "consumption", None, None, None, True), ("v", "other", None, None, None, None)], "variant_id string, event string, selected_subject boolean, outcome string, attempts int, consumed boolean")
    tiers = {"choice": "export", "execution": "local", "consumption": "off"}
    assert [tuple(r) for r in experiment.connector_aggregate(rows, tiers).collect()] == [("v", 1, 1, 1, 1, 3, 0, "consumption")]
    assert [tuple(r) for r in experiment.connector_aggregate(rows, tiers, export=True).collect()] == [("v", 1, 1, 0, 0, 0, 0, "consumption,execution")]
    for bad in (dict(tiers=tiers, revoked=True), dict(tiers={"choice": "local"})):
        with pytest.raises(ValueError, match=r"revoked|exported"):
            experiment.connector_aggregate(rows, export=True, **bad)


def test_wins_need_the_project_of_both_presentations(spark):
    p = spark.createDataFrame([("d1", "s", "m", "p1", "a", "2024-01-01"), ("d1", "s", "m", "p1", "b", "2024-01-01"), ("d2", "s", "m", "p1", "a", "2024-01-01"), ("d2", "s", "m", "p2", "b", "2024-01-01"), ("d3", "s", "m", "p1", "a", "2023-01-01"), ("d3", "s", "m", "p1", "b", "2023-01-01")], "decision_id string, candidate_set_id string, choice_mode string, project_id string, tool string, presented_at string")
    p = p.withColumn("context", F.lit("production")).withColumn("validity", F.lit("normal"))
    s = p.where("tool = 'a'").withColumnRenamed("presented_at", "selected_at")
    (row,) = choice.head_to_head(p, s, "b", "a", "2023-06-01").collect()
    assert (row.co_presented, row.a_selected, row.b_selected) == (2, 1, 0)


def test_sensitive_records_go_whatever_is_allowed(spark):
    lines = spark.createDataFrame([(f'{{"tool":"x","{k}":"v"}}',) for k in ("email", "File_Path", "command", "cwd", "username", "tool_input", "tool_output", "tool_response", "transcript", "result", "outcome")], "value string")
    got = ingest.redact(lines, ("tool", "email", "File_Path", "result")).collect()
    assert [(r.tool, r.result) for r in got] == [("x", "v"), ("x", None)]


GOOD = dict(spec_version="1", observation_id="o", observation_type="attempt_completed", observer=dict(principal="p", side="client"), observed_at="2024-01-01T00:00:00Z", surface=dict(surface_id="mcp:x"), usage_context="production", validity="normal", payload=dict(tool_call_id="c", outcome="success", duration_ms=3))


@pytest.mark.parametrize(
    ("change", "errors"),
    [
        ({}, []),
        ({"signature": None}, []),
        ({"client_key": None}, ["observation.client_key: expected string"]),
        ({"client_key": 5}, ["observation.client_key: expected string"]),
        ({"observer": "me"}, ["observation.observer: expected object"]),
        ({"observer": {"side": "client"}}, ["observation.observer.principal: required"]),
        ({"payload": {"tool_call_id": "c", "outcome": "success", "duration_ms": "3"}}, ["observation.payload.duration_ms: expected integer"]),
        ({"payload": {"tool_call_id": "c", "outcome": "success", "duration_ms": 3.5}}, ["observation.payload.duration_ms: expected integer"]),
        ({"payload": {"tool_call_id": "c", "outcome": "maybe", "trace_id": "t"}}, ["observation.payload: unexpected trace_id", "observation.payload.outcome: not allowed"]),
        ({"collection_health": {"buffer_overflow": "no"}}, ["observation.collection_health.buffer_overflow: expected boolean"]),
        ({"usage_context": "staging"}, ["observation.usage_context: not allowed"]),
        ({"validity": ...}, ["observation.validity: required"]),
        ({"caller": {"type": "claimed_agent"}}, ["observation: caller type and strength contradict"]),
    ],
)
def test_validation(spark, change, errors):
    line = json.dumps({k: v for k, v in (GOOD | change).items() if v is not ...})
    rows = spark.createDataFrame([(line,)], "value string").withColumn("e", F.from_json("value", schemas.ENVELOPE))
    assert ingest.validate_envelope(rows).first().errors == errors


def test_sessions_leave_under_a_pseudonym(spark):
    raw = spark.createDataFrame([("bash", None, "u1", None, None, "alice", None, None, None, None, None, "e1", "2024-05-06T00:00:00Z"), ("bash", None, "u2", None, None, None, None, None, None, None, None, "e2", "soon")], schemas.ADAPTER)
    pads = ingest.monthly_pads(spark, b"k", ["2024-05"])
    a, b = sorted(ingest.normalize_adapter(raw, "codex-hook", "p", "w", pads).collect(), key=lambda r: r.source_event_id)
    key = hmac.new(b"k", b"2024-05", hashlib.sha256).digest()
    assert a.session_key == "p-" + hmac.new(key, b"codex:alice", hashlib.sha256).hexdigest()[:20] and a.provenance == "hook" and a.observation_id != b.observation_id
    assert (b.session_key, b.observed_at) == (None, None)


def test_late_sides_join_in_the_stream(spark, tmp_path):
    from tallymark.streaming import jobs

    base = dict(tool="x", outcome="success")
    batches = [
        [dict(base, observation_id="a", trace_id="T"), dict(base, observation_id="b", tool_call_id="C")],
        [dict(base, observation_id="c", trace_id="T", observer_side="server"), dict(base, observation_id="d", tool_call_id="C", trace_id="T", observer_side="server")],
        [dict(base, observation_id="e", trace_id="U"), dict(base, observation_id="f", tool_call_id="C", outcome="failure")],
    ]
    for rows in batches:
        observed(spark, *rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.stream_attempts(stream, f"{tmp_path}/ledger", f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    names = ["attempt_key", "n_obs", "outcome", "matched_by"]
    got = jobs.latest(spark, f"{tmp_path}/out").select(names).collect()
    want = correlate.attempts(correlate.dedup_observations(spark.read.parquet(f"{tmp_path}/in"))).select(names).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 3


def test_empty_arm_is_undetermined(spark):
    cells = spark.createDataFrame([("v0", 0, 0, 0, 0, 0), ("v1", 500, 100, 50, 40, 30)], "variant_id string, reached long, selected long, operations long, succeeded long, consumed long").withColumn("cost", F.lit(1.0))
    (row,) = experiment.compare_arms(cells, "v0", []).collect()
    assert (row.verdict, row.z, row.low) == ("undetermined", None, None)


def test_replaying_a_ledger_changes_nothing(spark):
    rows = spark.createDataFrame([("m1", "e", 5, 1, 0, None, None), ("m1", "e", 7, 2, 0, None, None), ("m2", "e", 1, 1, 0, "m3", None), ("m3", "e", 9, 1, 0, None, None), ("m4", "e", 0, 1, 0, None, "m2")], "meter_event_id string, billable_event string, quantity long, revision int, tie int, supersedes string, reversal_of string")
    once = metering.ledger_balance(rows).collect()
    assert metering.ledger_balance(rows.union(rows).union(rows)).collect() == once
    assert (once[0].events, once[0].quantity) == (1, 7)


def test_hidden_below_threshold(spark):
    rows = spark.createDataFrame([(9, 0.5), (10, 0.5)], "n int, rate double")
    assert [r.rate for r in metrics.privacy_suppress(rows, "rate", "n").collect()] == [None, 0.5]


def test_empty_inputs_give_empty_results(spark):
    none = observed(spark, dict()).limit(0)
    assert correlate.attempts(none).count() == 0
    assert metrics.project_report(correlate.attempts(none)).count() == 0


def test_unknown_adapter_is_an_error(spark):
    with pytest.raises(ValueError, match="unknown source"):
        ingest.normalize_adapter(spark.range(1).withColumn("outcome", F.lit("")), "other", "p", "w", None)


def test_daily_metrics_of_a_stream_have_the_open_days(spark):
    from tallymark.plans import registry, streams  # noqa: F401
    from tallymark.plans.views import view

    sf = "/root/testdata/sf0.001"
    day = F.date_trunc("day", F.col("observed_at").cast("timestamp")).cast("string").alias("day")
    want = view(spark, sf, "fx_trace_obs").groupBy(day, "project_id").agg(F.count("*").alias("n"), F.approx_count_distinct("observer_principal").alias("principals"))
    got = registry.QUERIES["stream_daily_metrics"](spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_later_batches_replace_a_window(spark, tmp_path):
    from tallymark.streaming import jobs

    (tmp_path / "in").mkdir()
    keys, rows = ["day", "project_id"], "observed_at timestamp_ntz, project_id string, observer_principal string"
    out = jobs.stream_daily_metrics(spark.readStream.schema(rows).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    out = out.select(F.col("window.start").cast("string").alias("day"), "project_id", "n", "principals")
    for n in (1, 2):
        some = spark.sql(f"SELECT timestamp_ntz'2024-01-01 10:00:00' AS observed_at, p AS project_id, concat('c', {n}) AS observer_principal FROM VALUES ('p'), (NULL) AS t(p)")
        some.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = jobs.run_latest(out, keys, spark, f"file://{tmp_path}/out{n}", f"file://{tmp_path}/checkpoint{n}").collect()
        assert sorted(map(tuple, got), key=str) == sorted([("2024-01-01 00:00:00", p, n, n) for p in ("p", None)], key=str)
