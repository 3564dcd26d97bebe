"""Queries of reading, validation, privacy and migration, with their SQL.

JSON lines are made from the observation view by Spark, with faults in fixed shares of the rows, so that SQL can tell the
expected counts from the same shares.
"""

from __future__ import annotations

import hashlib
import hmac
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators import correlate, ingest
from tallymark.plans.registry import query
from tallymark.plans.usage import observations
from tallymark.plans.views import STEPS, key_part, view
from tallymark.sources import files, schemas

PREFIX = "tallymark-0.1"


def envelope(obs: DataFrame) -> DataFrame:
    """Observations as canonical JSON lines; by line and supplier number some are broken in one way."""
    n = F.regexp_extract("observation_id", r"^obs-(\d+)-", 1).cast("long")
    health = F.struct(F.concat(F.lit("src-"), F.col("tool")).alias("source_instance_id"), F.col("line_no").cast("long").alias("source_sequence"), F.lit("1").alias("sequence_epoch"), F.col("dropped").cast("long").alias("dropped_since_last_report"), F.col("buffer_overflow").alias("buffer_overflow"))
    caller = F.struct(F.lit("unknown").alias("type"), F.lit("rt").alias("runtime"), F.when(n % 29 == 0, "declared").otherwise("unknown").alias("identity_strength"))
    started = F.col("observation_type") == "attempt_started"
    only = lambda c: F.when(started, F.col(c)).alias(c)
    payload = F.struct("tool_call_id", only("trace_id"), only("operation_id"), only("task_id"), F.when(~started, F.coalesce("outcome", F.lit("unknown"))).alias("outcome"), F.when(~started, F.col("duration_ms")).alias("duration_ms"))
    row = F.struct(
        F.lit("0.4").alias("spec_version"), F.when(n % 31 != 0, F.col("observation_id")).alias("observation_id"), F.when(n % 37 == 0, "odd").otherwise(F.col("observation_type")).alias("observation_type"),
        F.struct(F.col("observer_principal").alias("principal"), "trust_domain", F.col("observer_side").alias("side")).alias("observer"),
        F.when(n % 41 == 0, "yesterday").otherwise(F.date_format(F.col("observed_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("observed_at"), F.struct("project_id").alias("deployment_context"),
        F.struct(F.concat(F.lit("mcp_tool:"), "tool").alias("surface_id")).alias("surface"), caller.alias("caller"), "client_key", "usage_context", "validity", F.col("validity_source"), health.alias("collection_health"), F.lit("otel").alias("provenance"), payload.alias("payload"), F.when(F.col("signature_valid"), "sig").alias("signature"), F.when(F.col("signature_valid"), "key-1").alias("key_id"),
    )
    line = F.to_json(row)
    line = F.when(n % 53 == 0, F.replace(line, F.lit('"spec_version":"0.4"'), F.lit('"spec_version":0.4'))).otherwise(line)
    line = F.when(n % 43 == 0, F.substring(line, 1, 20)).when(n % 47 == 0, F.concat(F.lit('{"zzz":1,'), F.substring(line, 2, 1_000_000))).otherwise(line)
    return obs.select(line.alias("value"), n.alias("n"), "line_no")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.validate_envelope(envelope(observations(spark, sf_dir)))


STEPS |= {
    "s_faults": """SELECT *, CASE WHEN n % 43 = 0 THEN 'observation: not a JSON object' ELSE concat_ws('; ', CASE WHEN n % 31 = 0 THEN 'observation.observation_id: required' END,
      CASE WHEN n % 53 = 0 THEN 'observation.spec_version: expected string' END, CASE WHEN n % 47 = 0 THEN 'observation: unexpected zzz' END, CASE WHEN n % 37 = 0 THEN 'observation.observation_type: not allowed' END,
      CASE WHEN n % 41 = 0 THEN 'observation.observed_at: not a timestamp' END, CASE WHEN n % 11 = 0 AND n % 37 <> 0 THEN 'observation.payload.tool_call_id: required' END,
      CASE WHEN n % 29 = 0 THEN 'observation: caller type and strength contradict' END) END AS errors FROM (SELECT *, CAST(regexp_extract(observation_id, '^obs-([0-9]+)-', 1) AS BIGINT) AS n FROM s_obs)""",
}


@query("reject_reasons", "SELECT CASE WHEN errors <> '' THEN substr(split_part(errors, ':', 1), 1, 40) END AS reason, count(*) AS n FROM s_faults GROUP BY ALL")
def _reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.reject_reasons(judged(spark, sf_dir))


@query("validate_envelope", "SELECT n, line_no, errors FROM s_faults")
def _validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("n", "line_no", F.array_join("errors", "; ").alias("errors"))


#: What the lines say of each observation; all else of a flat one is null here.
SAID = (
    "observation_id observation_type observed_at line_no observer_principal observer_side trust_domain provenance project_id surface_id tool tool_call_id trace_id operation_id task_id outcome duration_ms client_key lifecycle "
    "caller_type caller_runtime identity_strength usage_context validity context_source validity_source source_instance_id source_sequence sequence_epoch dropped buffer_overflow signature key_id signature_valid"
).split()
_STARTED = "observation_type = 'attempt_started'"


@query(
    "flatten_observation",
    f"""SELECT observation_id, observation_type, observed_at, line_no, observer_principal, observer_side, trust_domain, 'otel' AS provenance, project_id, concat('mcp_tool:', tool) AS surface_id, tool, tool_call_id,
    CASE WHEN {_STARTED} THEN trace_id END AS trace_id, CASE WHEN {_STARTED} THEN operation_id END AS operation_id, CASE WHEN {_STARTED} THEN task_id END AS task_id,
    CASE WHEN NOT {_STARTED} THEN coalesce(outcome, 'unknown') END AS outcome, CASE WHEN NOT {_STARTED} THEN duration_ms END AS duration_ms, client_key, CASE WHEN {_STARTED} THEN 'L1' ELSE 'L2' END AS lifecycle,
    'unknown' AS caller_type, 'rt' AS caller_runtime, 'unknown' AS identity_strength, usage_context, validity, 'none' AS context_source, validity_source, concat('src-', tool) AS source_instance_id, line_no AS source_sequence, '1' AS sequence_epoch,
    dropped, buffer_overflow, CASE WHEN signature_valid THEN 'sig' END AS signature, CASE WHEN signature_valid THEN 'key-1' END AS key_id, coalesce(signature_valid, false) AS signature_valid, true AS rest_is_null FROM s_faults WHERE errors = ''""",
)
def _flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = judged(spark, sf_dir).where(F.size("errors") == 0).withColumn("e", F.from_json("value", schemas.ENVELOPE))
    flat = files.stored(ingest.flatten_observation(good))  # lines are judged once
    flat = ingest.with_signatures(flat, flat.where("key_id = 'key-1'").select("observation_id", "key_id"))
    rest = [c for c in flat.columns if c not in SAID]
    return flat.select(*(F.col(c).cast("timestamp_ntz").alias(c) if c == "observed_at" else F.col(c) for c in SAID), (sum(F.col(c).isNotNull().cast("int") for c in rest) == 0).alias("rest_is_null"))


@query("default_project", "SELECT CASE WHEN n % 3 = 0 THEN 'fallback' ELSE project_id END AS project_id, count(*) AS n FROM (SELECT project_id, line_no AS n FROM s_obs) GROUP BY ALL")
def _project(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).select(F.when(F.col("line_no") % 3 != 0, F.col("project_id")).alias("p"))
    return rows.groupBy(ingest.default_project("p", "fallback").alias("project_id")).agg(F.count("*").alias("n"))


@query(
    "duration_bucket",
    """SELECT CASE WHEN s IS NULL THEN NULL WHEN s < 1 THEN '<1s' WHEN s < 10 THEN '1s-10s' WHEN s < 60 THEN '10s-60s' WHEN s < 600 THEN '1m-10m' ELSE '>10m' END AS bucket, count(*) AS n FROM (SELECT duration_ms / 1000 AS s FROM s_obs) GROUP BY ALL""",
)
def _bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy(ingest.duration_bucket(F.col("duration_ms") / 1000).alias("bucket")).agg(F.count("*").alias("n"))


@query("parse_ts", "SELECT line_no, CASE WHEN line_no % 3 = 0 THEN NULL ELSE observed_at END AS at, count(*) AS n FROM s_obs GROUP BY ALL")
def _parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("line_no") % 3 == 0, "soon").otherwise(F.date_format(F.col("observed_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return observations(spark, sf_dir).select("line_no", ingest.parse_ts(said).cast("timestamp_ntz").alias("at")).groupBy("line_no", "at").agg(F.count("*").alias("n"))


RAW = "tool AS tool_name, tool, tool_call_id AS tool_use_id, tool_call_id, trace_id, client_key AS session_id, CAST(NULL AS STRING) AS session_key, outcome, CAST(NULL AS STRING) AS duration_bucket, CAST(duration_ms AS STRING) AS duration_ms, CAST(NULL AS STRING) AS lifecycle_stage, observation_id AS event_id, CAST(observed_at AS STRING) AS observed_at, line_no"


@query("redact", "SELECT observation_id, tool FROM s_obs WHERE line_no % 3 <> 0 AND line_no % 5 <> 0")
def _redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    plain = F.to_json(F.struct("observation_id", "tool", "outcome"))
    leaky = F.to_json(F.struct("observation_id", "tool", F.lit("hello").alias("Prompt")))
    named = F.to_json(F.struct("observation_id", "tool", F.lit("a@b.c").alias("email")))
    lines = obs.select(F.when(F.col("line_no") % 3 == 0, leaky).when(F.col("line_no") % 5 == 0, named).otherwise(plain).alias("value"))
    return ingest.redact(lines, ("observation_id", "tool"))


SECRET = b"not a real secret"
MONTHS = [f"{y}-{m:02d}" for y in range(1992, 2003) for m in range(1, 13)]


def _pad_rows() -> str:
    rows = []
    for month in MONTHS:
        key = hmac.new(SECRET, month.encode(), hashlib.sha256).digest().ljust(64, b"\0")
        rows.append(f"('{month}', '{bytes(b ^ 0x36 for b in key).hex()}', '{bytes(b ^ 0x5C for b in key).hex()}')")
    return ", ".join(rows)


@query(
    "pseudonymize",
    f"""SELECT observation_id, CASE WHEN coalesce(client_key, '') = '' THEN '' ELSE concat('p-', substr(sha256(unhex(opad) || unhex(sha256(unhex(ipad) || encode(concat('host-1:', client_key))))), 1, 20)) END AS client_key
    FROM s_obs LEFT JOIN (VALUES {_pad_rows()}) AS pads(month, ipad, opad) ON strftime(observed_at, '%Y-%m') = month""",
)
def _pseudonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).withColumnRenamed("client_key", "raw")
    return ingest.pseudonymize(rows, ingest.monthly_pads(spark, SECRET, MONTHS), "host-1", "raw", "observed_at").select("observation_id", "client_key")


STEPS["s_padded"] = f"SELECT * FROM s_obs LEFT JOIN (VALUES {_pad_rows()}) AS pads(month, ipad, opad) ON strftime(observed_at, '%Y-%m') = month"


def _session(host: str) -> str:
    return f"CASE WHEN coalesce(client_key, '') <> '' THEN concat('p-', substr(sha256(unhex(opad) || unhex(sha256(unhex(ipad) || encode(concat('{host}:', client_key))))), 1, 20)) END AS session_key"


@query(
    "normalize_adapter",
    f"""SELECT tool_call_id AS source_event_id, line_no, 'td-9' AS trust_domain, 'codex' AS caller_runtime, 'client' AS observer_side, 'hook' AS provenance, tool, tool_call_id, CAST(NULL AS VARCHAR) AS trace_id, 'unknown' AS outcome, 'L1' AS lifecycle, CAST(NULL AS BIGINT) AS duration_ms, {_session("codex")} FROM s_padded UNION ALL
    SELECT NULL, line_no, 'td-9', 'mcp', 'server', 'wrapper', tool, tool_call_id, trace_id, coalesce(outcome, 'unknown'), CASE WHEN outcome IN ('success', 'failure') THEN 'L2' ELSE 'L1' END, duration_ms, {_session("mcp")} FROM s_padded UNION ALL
    SELECT observation_id, line_no, 'td-9', 'deepseek-harness', 'client', 'platform', tool, tool_call_id, trace_id, coalesce(outcome, 'unknown'), 'L2', NULL, {_session("deepseek-harness")} FROM s_padded""",
)
def _normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = observations(spark, sf_dir).selectExpr(*(RAW.split(", ")))
    every = [ingest.normalize_adapter(raw, s, "p", "who", ingest.monthly_pads(spark, SECRET, MONTHS), "td-9") for s in ("codex-hook", "mcp-wrapper", "dsh")]
    rows = every[0].unionByName(every[1]).unionByName(every[2])
    return rows.select("source_event_id", "line_no", "trust_domain", "caller_runtime", "observer_side", "provenance", "tool", "tool_call_id", "trace_id", "outcome", "lifecycle", "duration_ms", "session_key")


COMMITMENT = f"CASE WHEN coalesce(trace_id, '') <> '' OR coalesce(tool_call_id, '') <> '' THEN concat('c-', substr(sha256(concat_ws('||', '{PREFIX}', coalesce(project_id, ''), coalesce(trace_id, ''), coalesce(tool_call_id, ''))), 1, 32)) END"


@query("correlation_commitment", f"SELECT observation_id, {COMMITMENT} AS commitment FROM s_obs")
def _commitment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("observation_id", ingest.correlation_commitment(PREFIX).alias("commitment"))


@query(
    "build_receipts",
    f"""SELECT concat('r-', substr(sha256(observation_id), 1, 32)) AS receipt_id, observation_id, observed_at, observer_side, observer_principal, CAST(NULL AS VARCHAR) AS provenance, trust_domain, project_id, tool, tool_call_id, trace_id,
    client_key AS session_key, coalesce(outcome, 'unknown') AS outcome, coalesce(lifecycle, 'L0') AS lifecycle, {COMMITMENT} AS commitment, CAST(NULL AS VARCHAR) AS sampling FROM s_obs""",
)
def _receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.build_receipts(observations(spark, sf_dir), PREFIX)


@query(
    "receipts_correspond",
    f"""SELECT * FROM (SELECT commitment, count(*) FILTER (observer_side = 'client') AS client, count(*) FILTER (observer_side = 'server') AS server FROM (SELECT observer_side, {COMMITMENT} AS commitment FROM s_obs)
    WHERE commitment IS NOT NULL GROUP BY commitment) WHERE client > 0 AND server > 0""",
)
def _correspond(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.receipts_correspond(ingest.build_receipts(observations(spark, sf_dir), PREFIX))


@query(
    "migrate_legacy",
    """SELECT stage, evidence, validity, legacy_retry, count(*) AS n FROM (SELECT CASE lifecycle WHEN 'L1' THEN 'invoked' WHEN 'L2' THEN 'completed' END AS stage,
    CASE line_no % 4 WHEN 0 THEN 'observed' WHEN 1 THEN 'authenticated' WHEN 2 THEN 'corroborated' ELSE 'platform-attested' END AS evidence, CASE WHEN line_no % 5 = 0 THEN 'unknown' ELSE validity END AS validity,
    line_no % 5 = 0 AND operation_id IS NULL AS legacy_retry FROM s_obs) GROUP BY stage, evidence, validity, legacy_retry""",
)
def _migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).withColumn("evidence", F.concat(F.lit("E"), (F.col("line_no") % 4).cast("string"))).withColumn("retry_of", F.lit(None).cast("string"))
    rows = obs.withColumn("validity", F.when(F.col("line_no") % 5 == 0, "retry").otherwise(F.col("validity")))
    return ingest.migrate_legacy(rows).groupBy("stage", "evidence", "validity", "legacy_retry").agg(F.count("*").alias("n"))


@query(
    "map_otel_spans",
    f"""SELECT concat('obs-', substr(sha256(concat_ws('|', 'otel', {key_part("trace_id")}, {key_part("observation_id")})), 1, 32)) AS observation_id, observed_at, 'proj' AS project_id,
    trace_id, observation_id AS span_id, 'chat' AS operation_name, caller_runtime, CASE WHEN caller_runtime IS NULL THEN 'unknown' ELSE 'claimed_agent' END AS caller_type, tool, CASE WHEN outcome = 'failure' THEN 'failure' ELSE 'success' END AS outcome,
    duration_ms AS input_tokens, CASE WHEN line_no % 2 = 0 THEN line_no END AS cache_read_tokens, line_no AS reasoning_tokens, duration_ms - CASE WHEN line_no % 2 = 0 THEN line_no ELSE 0 END AS uncached_input,
    CASE WHEN line_no % 2 = 0 THEN 'split' ELSE 'unknown' END AS cache_allocation FROM s_obs""",
)
def _otel(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line_no").cast("string")
    pairs = {
        "gen_ai.tool.name": F.col("tool"), "gen_ai.usage.input_tokens": F.col("duration_ms").cast("string"), "error.type": F.when(F.col("outcome") == "failure", "timeout"), "gen_ai.operation.name": F.lit("chat"),
        "gen_ai.agent.name": F.col("caller_runtime"), "gen_ai.usage.reasoning.output_tokens": line, "gen_ai.usage.cache_read.input_tokens": F.when(F.col("line_no") % 2 == 0, line),
    }
    attributes = F.map_filter(F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
    spans = observations(spark, sf_dir).select("trace_id", F.col("observation_id").alias("span_id"), F.col("observed_at").alias("ended_at"), attributes.alias("attributes"))
    columns = "observation_id project_id trace_id span_id operation_name caller_runtime caller_type tool outcome input_tokens cache_read_tokens reasoning_tokens uncached_input cache_allocation".split()
    return ingest.map_otel_spans(spans, project="proj").select(*columns, F.col("observed_at").cast("timestamp_ntz").alias("observed_at"))


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(base or tempfile.gettempdir()).rstrip('/')}/tallymark-{uuid.uuid4().hex}"


@query("read_observations", "SELECT count(*) AS n, count(*) FILTER (n % 43 <> 0) AS objects FROM s_faults")
def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    envelope(observations(spark, sf_dir)).select("value").write.option("compression", "gzip").text(path)
    rows = files.read_observations(spark, f"{path}/*.txt.gz")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.json_object_keys("value").isNotNull()).alias("objects"))


@query("read_adapter_events", "SELECT tool, count(*) AS n FROM s_obs GROUP BY tool")
def _read_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    observations(spark, sf_dir).select("tool", F.col("tool_call_id").alias("tool_use_id"), "outcome").write.json(path)
    return files.read_adapter_events(spark, path).groupBy("tool").agg(F.count("*").alias("n"))


@query("read_funnel_events", "SELECT variant_id, event, count(*) AS n FROM fx_funnel GROUP BY ALL")
def _read_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    view(spark, sf_dir, "fx_funnel").write.json(path)
    return files.read_funnel_events(spark, path).groupBy("variant_id", "event").agg(F.count("*").alias("n"))


@query("read_choice_events", "SELECT kind, tool, count(*) AS n FROM (SELECT 'presentation' AS kind, tool FROM fx_presentations UNION ALL SELECT 'selection', tool FROM fx_selections WHERE line_no > 1) GROUP BY ALL")
def _read_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    view(spark, sf_dir, "fx_presentations").withColumn("type", F.lit("presented")).write.option("compression", "gzip").json(path)
    picked = view(spark, sf_dir, "fx_selections").withColumn("observation_type", F.lit("selection"))
    picked.withColumn("project_id", F.when(F.col("line_no") > 1, F.col("project_id"))).write.mode("append").option("compression", "gzip").json(path)
    return files.read_choice_events(spark, path).groupBy("kind", "tool").agg(F.count("*").alias("n"))


def _ledger_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dates go to a ledger, and are counted as it has them."""
    path = scratch(spark)
    files.write_ledger(observations(spark, sf_dir), path, "observed_at")
    return spark.read.parquet(path).groupBy(F.col("event_date").cast("string").alias("event_date"), "project_id").agg(F.count("*").alias("n"))


@query("write_ledger", "SELECT strftime(observed_at, '%Y-%m-%d') AS event_date, project_id, count(*) AS n FROM s_obs WHERE observed_at >= TIMESTAMP '1998-01-01 00:00:00' AND observed_at < TIMESTAMP '1998-02-01 00:00:00' GROUP BY ALL")
def _write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger_counts(spark, sf_dir).where("event_date >= '1998-01-01' AND event_date < '1998-02-01'")


@query("write_ledger_whole", "SELECT strftime(observed_at, '%Y-%m-%d') AS event_date, project_id, count(*) AS n FROM s_obs GROUP BY ALL")
def _write_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger_counts(spark, sf_dir)


@query(
    "retention_stored",
    """SELECT strftime(observed_at, '%Y-%m-%d') AS event_date, project_id, count(*) AS n FROM s_obs WHERE CAST(observed_at AS DATE) >= DATE '2001-08-02' - INTERVAL 1500 DAY AND project_id NOT IN ('proj-1', 'proj-3') GROUP BY ALL""",
)
def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of all dates; old dates are dropped, and two projects erased, as it stands."""
    path = scratch(spark)
    files.write_ledger(observations(spark, sf_dir), path, "observed_at")
    files.retain(spark, path, "2001-08-02", 1500)
    files.erase(spark, path, spark.createDataFrame([("proj-1",), ("proj-3",)], "project_id string"))
    return spark.read.parquet(path).groupBy(F.col("event_date").cast("string").alias("event_date"), "project_id").agg(F.count("*").alias("n"))


@query("retention_prune", "SELECT project_id, count(*) AS n FROM s_obs WHERE CAST(observed_at AS DATE) >= DATE '2001-08-02' - INTERVAL 900 DAY AND project_id NOT IN ('proj-1', 'proj-3') GROUP BY project_id")
def _prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    deleted = spark.createDataFrame([("proj-1",), ("proj-3",)], "project_id string")
    return files.retention_prune(observations(spark, sf_dir), "2001-08-02", 900, deleted).groupBy("project_id").agg(F.count("*").alias("n"))


@query(
    "retention_cascade",
    """SELECT 'observations' AS name, project_id, count(*) AS n FROM s_obs WHERE CAST(observed_at AS DATE) >= DATE '2001-08-02' - INTERVAL 1200 DAY AND project_id <> 'proj-1' GROUP BY project_id UNION ALL
    SELECT 'attempts', project_id, count(*) FROM s_attempts WHERE CAST(started_at AS DATE) >= DATE '2001-08-02' - INTERVAL 1200 DAY AND project_id <> 'proj-1' GROUP BY project_id UNION ALL
    SELECT 'aggregates', project_id, count(DISTINCT CAST(observed_at AS DATE)) FROM s_obs WHERE CAST(observed_at AS DATE) >= DATE '1997-08-02' AND project_id <> 'proj-1' GROUP BY project_id""",
)
def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    tables = {"observations": obs, "attempts": correlate.attempts(obs), "aggregates": obs.groupBy("project_id", F.to_date("observed_at").alias("day")).agg(F.count("*").alias("n"))}
    deleted = spark.createDataFrame([("proj-1",)], "project_id string")
    kept = files.retention_cascade(tables, "2001-08-02", deleted, 1200, 48)
    counts = [rows.groupBy(F.lit(name).alias("name"), "project_id").agg(F.count("*").alias("n")) for name, rows in kept.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    "experiment_history",
    "SELECT concat('2024-01-0', 1 + CAST(substr(task_id, 3) AS INT)) AS run_date, 'done' AS status, concat('v1=', count(*) FILTER (variant_id = 'v1'), ', v2=', count(*) FILTER (variant_id = 'v2')) AS verdicts, task_id AS manifest_hash, 'p' AS prereg_hash FROM fx_funnel GROUP BY task_id",
)
def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    n = lambda v: F.struct(F.lit(v).alias("variant_id"), F.count_if(F.col("variant_id") == v).cast("string").alias("verdict"))
    date = F.concat(F.lit("2024-01-0"), (F.substring("task_id", 3, 1).cast("int") + 1).cast("string"))
    runs = view(spark, sf_dir, "fx_funnel").groupBy("task_id").agg(F.array(n("v1"), n("v2")).alias("variants"))
    runs = runs.select(date.alias("run_date"), F.lit("done").alias("status"), F.col("task_id").alias("manifest_hash"), F.lit("p").alias("prereg_hash"), "variants")
    runs.repartition(5, "manifest_hash").write.option("maxRecordsPerFile", 1).json(path)
    return files.experiment_history(spark, path)
