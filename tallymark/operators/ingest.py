"""Envelope validation, flattening, privacy and receipts, as column functions."""

from __future__ import annotations

import hmac
import re
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallymark.sources.schemas import ENVELOPE

TYPES = ("presentation", "selection", "attempt_started", "attempt_completed", "result_consumed", "task_outcome")
#: Values that the schema fixes.
CONTEXTS = ("production", "development", "test", "benchmark", "evaluation", "synthetic", "ci", "demo", "unknown")
VALIDITIES = ("normal", "duplicate", "replay", "health_check", "load_test", "suspected_invalid", "unknown")
SIDES = ("client", "server", "platform")
SOURCES = ("none", "provider_configuration", "collector_derived", "runtime_propagated")
#: The values of each field that has a fixed set of them. The spec_version's are a parameter.
ENUMS = {
    "observation_type": TYPES,
    "observer.side": SIDES,
    "caller.type": ("unknown", "claimed_agent", "correlated_agent", "platform_attested"),
    "caller.identity_strength": ("unknown", "declared", "correlated", "attested"),
    "usage_context": CONTEXTS,
    "validity": VALIDITIES,
    "context_source": SOURCES,
    "validity_source": SOURCES,
    "provenance": ("hook", "otel", "wrapper", "platform"),
}
PAYLOAD_ENUMS = {
    "presentation": {"choice_mode": ("exclusive", "multi_select", "parallel", "sequential", "ordered_fallback", "router_preselected", "unknown")},
    "selection": {
        "decision_authority": ("model", "router", "workflow", "user", "policy", "platform", "unknown"),
        "selection_constraint": ("autonomous", "recommended", "required", "user_requested", "fallback", "forced", "unknown"),
    },
    "attempt_completed": {"outcome": ("success", "failure", "retry", "denied", "unknown")},
}
#: Fields that may be null.
NULLABLE = ("provider_claim", "capability_claim", "sampling", "signature", "key_id")
CALLERS = {"unknown": "unknown", "claimed_agent": "declared", "correlated_agent": "correlated", "platform_attested": "attested"}
REQUIRED = ("spec_version", "observation_id", "observation_type", "observer", "observed_at", "surface", "usage_context", "validity", "payload")
SUB_REQUIRED = ("observer.principal", "observer.side", "surface.surface_id")
KEYS = (
    "spec_version observation_id observation_type observer observed_at deployment_context surface caller client_key usage_context validity context_source validity_source collection_health sampling provenance payload signature key_id".split()
)
SUB_KEYS = {
    "observer": "principal trust_domain side".split(),
    "deployment_context": ["project_id"],
    "surface": "surface_id surface_namespace provider_claim capability_claim".split(),
    "caller": "type runtime identity_strength".split(),
    "collection_health": "source_instance_id source_sequence sequence_epoch dropped_since_last_report buffer_overflow".split(),
}
#: Of each type of observation: the fields of its payload, and those that are required.
PAYLOAD = {
    "presentation": ("decision_id candidate_set_id category_id category_version choice_mode rank_in_candidate_set", "decision_id candidate_set_id choice_mode"),
    "selection": ("decision_id selection_id rank decision_authority selection_constraint selection_reason_observable", "decision_id decision_authority selection_constraint"),
    "attempt_started": ("tool_call_id trace_id started_at operation_id task_id retry_of", "tool_call_id"),
    "attempt_completed": ("tool_call_id outcome duration_ms error_type", "tool_call_id outcome"),
    "result_consumed": ("tool_call_id consumed_by_request_seq", "tool_call_id"),
    "task_outcome": ("task_id task_success model task_type ended_at", "task_id task_success"),
}
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
#: Keys that no record may have, in any case; fixed values of the privacy rules.
SENSITIVE = (
    "prompt", "tool_input", "tool_response", "tool_output", "input", "output", "content", "file_path", "cwd", "command", "transcript", "email", "username", "api_key", "token", "password", "secret",
)


def _text(*items: str) -> Column:
    return F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")


def _kinds() -> list[tuple[str, str, str]]:
    """(path, JSON type, pattern of the type as a variant names it) of every field that the envelope's schema types."""
    names = {"string": ("string", "STRING"), "bigint": ("integer", "BIGINT"), "int": ("integer", "BIGINT"), "boolean": ("boolean", "BOOLEAN"), "double": ("number", "BIGINT|DOUBLE|DECIMAL.*"), "struct": ("object", "OBJECT.*"), "map": ("object", "OBJECT.*")}
    out = []

    def walk(fields: StructType, path: str) -> None:
        for f in fields.fields:
            kind, pattern = names[f.dataType.simpleString().split("<")[0]]
            out.append((f"{path}.{f.name}", kind, f"^({pattern}{'|VOID' if f.name in NULLABLE else ''})$"))
            if isinstance(f.dataType, StructType):
                walk(f.dataType, f"{path}.{f.name}")

    walk(StructType.fromDDL(ENVELOPE), "")
    return out


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row. Spark copies a column's expression to wherever it is used, filters below included;
    a generator of one row stops that, and these expressions are long."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


#: JSON types as a variant's schema names them, by a field's type.
SHAPES = {"string": "STRING", "bigint": "BIGINT", "int": "BIGINT", "boolean": "BOOLEAN", "double": r"(?:BIGINT|DOUBLE|DECIMAL\([^)]*\))", "map": "OBJECT<[^<>]*>"}


def shape_of(fields: StructType, path: str, required: tuple[str, ...], payload: str, known: tuple[str, ...] = ()) -> str:
    """A pattern of the schemas of all objects with these fields: a variant names its keys in order, each with its type."""
    out = []
    for f in sorted(fields.fields, key=lambda f: f.name):
        if known and f.name not in known:
            continue
        name = f"{path}{f.name}"
        if name == "payload":
            inner = payload
        elif isinstance(f.dataType, StructType):
            inner = shape_of(f.dataType, f"{name}.", required, payload)
        else:
            inner = SHAPES[f.dataType.simpleString().split("<")[0]]
        inner = f"(?:{inner}|VOID)" if f.name in NULLABLE else inner
        out.append(f"(?:{f.name}: {inner}(?:, |(?=>)))" + ("" if name in required else "?"))
    return f"OBJECT<{''.join(out)}>"


def typed(shape: Column) -> Column:
    """Whether all keys of a line's shape are known, in the payload to any type of observation, and all types right; anything may be absent."""
    envelope = StructType.fromDDL(ENVELOPE)
    payload = shape_of(envelope["payload"].dataType, "payload.", (), "")
    return shape.rlike(f"^{shape_of(envelope, '', (), payload)}$")


def well_formed(shape: Column, kind: Column) -> Column:
    """Whether a line's shape, the schema of its variant, is one that the schema allows: all keys known, all types right, nothing
    required absent. The schema is compiled to one pattern for each type of observation."""
    envelope = StructType.fromDDL(ENVELOPE)
    fields = envelope["payload"].dataType
    out = F.lit(False)
    for name, (known, required) in PAYLOAD.items():
        payload = shape_of(fields, "payload.", tuple(f"payload.{r}" for r in required.split()), "", tuple(known.split()))
        out = F.when(kind == name, shape.rlike(f"^{shape_of(envelope, '', (*REQUIRED, *SUB_REQUIRED), payload)}$")).otherwise(out)
    return F.coalesce(out, F.lit(False))


#: Values in compact JSON, by a field's type; strings with an escape are left to the parser.
PLAIN = {"string": r'"[^"\\\x00-\x1f]*+"', "bigint": r"-?(?:0|[1-9]\d{0,17})", "int": r"-?(?:0|[1-9]\d{0,8})", "boolean": "(?:true|false)"}
#: Bytes of the longest line that is held against a pattern.
LONGEST = 1 << 16


def _members(fields: dict[str, str], required: tuple[str, ...]) -> str:
    """A pattern of compact JSON objects that have these fields, each with the pattern of its value, in this order."""
    return r"\{" + "".join(f'(?:"{name}":{value}(?:,(?=")|(?=\\}})))' + ("" if name in required else "?+") for name, value in fields.items()) + r"\}"


def _sound_pattern(kind: str, versions: tuple[str, ...]) -> str:
    """A pattern of lines of this type of observation, compact and in the schema's order, in which nothing at all is wrong."""
    known, required = (x.split() for x in PAYLOAD[kind])
    enums = ENUMS | {f"payload.{name}": values for name, values in PAYLOAD_ENUMS.get(kind, {}).items()} | {"observation_type": (kind,)} | ({"spec_version": versions} if versions else {})
    one_of = lambda values: f'"(?:{"|".join(map(re.escape, values))})"'
    needed = (*REQUIRED, *SUB_REQUIRED, *(f"payload.{name}" for name in required))

    def members(fields: StructType, path: str) -> str:
        out = {}
        for f in fields.fields:
            name = f"{path}{f.name}"
            if f.name == "caller":
                # A caller that is not said is unknown, and so is its strength.
                said = lambda values: _members({"type": one_of(values[:1]), "runtime": PLAIN["string"], "identity_strength": one_of(values[1:])}, () if values[0] == "unknown" else ("type", "identity_strength"))
                out[f.name] = f"(?:{'|'.join(map(said, CALLERS.items()))})"
            elif name == "observed_at":
                out[f.name] = f'"{TIMESTAMP.strip("^$")}"'
            elif name in enums:
                out[f.name] = one_of(enums[name])
            elif isinstance(f.dataType, StructType):
                out[f.name] = members(f.dataType, f"{name}.")
            elif path != "payload." or f.name in known:
                inner = PLAIN.get(f.dataType.simpleString(), "null")
                out[f.name] = f"(?:{inner}|null)" if f.name in NULLABLE else inner
        return _members(out, tuple(name for name in out if f"{path}{name}" in needed))

    return f"^{members(StructType.fromDDL(ENVELOPE), '')}\\z"


def sound(value: str, versions: tuple[str, ...] = ()) -> Column:
    """Whether a line is known to be valid by its text alone: the schema and all its values are compiled to one pattern for each type of
    observation. Other orders of keys, blanks, escapes and samplings are not known to it; such lines are parsed."""
    out = F.lit(False)
    for kind in PAYLOAD:
        out = F.when(F.contains(value, F.lit(f'"observation_type":"{kind}"')), F.col(value).rlike(_sound_pattern(kind, versions))).otherwise(out)
    return F.coalesce((F.octet_length(value) <= LONGEST) & out, F.lit(False))


def validate_envelope(lines: DataFrame, value: str = "value", versions: tuple[str, ...] = ()) -> DataFrame:
    """Add ``errors``: the violations of each line, in the order of the schema; empty if it is valid.

    A line that is no JSON object has one error. A field of another JSON type than the schema's is one ("expected ..."), as are one
    that is required and absent, one that is unexpected, and one outside its values. Most valid lines are known by their text (``sound``).
    Any other is parsed to a variant, whose schema is held against the compiled one (``well_formed``), and to a typed envelope: only lines
    that differ from the schema are searched for what is wrong, and for fields of other types only where some field has one.
    """
    c = lambda name: F.col(f"_e.{name}")
    rows = once(lines, _sound=sound(value, versions))
    unknown = lambda x: F.when(~F.col("_sound"), x)
    rows = rows.withColumns({"_v": unknown(F.try_parse_json(value)), "_e": unknown(F.from_json(value, ENVELOPE))}).withColumn("_shape", F.schema_of_variant("_v"))
    rows = rows.withColumn("_fine", F.col("_sound") | well_formed(F.col("_shape"), c("observation_type")))
    rows = rows.withColumn("_typed", F.coalesce(unknown(F.when(~F.col("_fine"), typed(F.col("_shape")))), F.lit(False)))
    odd_only = lambda x: F.when(~F.col("_fine"), x)
    sub = lambda name: odd_only(F.json_object_keys(F.to_json(F.try_variant_get("_v", f"$.{name}", "variant"))))
    rows = rows.withColumns({"_keys": odd_only(F.json_object_keys(value)), **{f"_keys_{name}": sub(name) for name in (*SUB_KEYS, "payload")}})
    keys = F.col("_keys")
    some = keys.isNotNull()
    #: (whether it tells of a line's shape, the check)
    checks: list[tuple[bool, Column]] = [(True, F.when(keys.isNull(), "observation: not a JSON object"))]
    for name in REQUIRED:
        checks.append((True, F.when(some & ~F.array_contains(keys, name), f"observation.{name}: required")))
    for name in SUB_REQUIRED:
        outer, inner = name.split(".")
        checks.append((True, F.when(~F.array_contains(f"_keys_{outer}", inner), f"observation.{name}: required")))
    for path, kind, pattern in _kinds():
        found = F.schema_of_variant(F.try_variant_get("_v", f"${path}", "variant"))
        checks.append((True, F.when(some & ~F.col("_typed") & ~found.rlike(pattern), f"observation{path}: expected {kind}")))
    odd = lambda found, known: F.array_join(F.array_sort(F.array_except(found, _text(*known))), ",")
    strange = lambda found, known: F.when(F.size(F.array_except(found, _text(*known))) > 0, odd(found, known))
    checks.append((True, F.concat(F.lit("observation: unexpected "), strange(keys, KEYS))))
    for name, known in SUB_KEYS.items():
        checks.append((True, F.concat(F.lit(f"observation.{name}: unexpected "), strange(F.col(f"_keys_{name}"), known))))
    enum = lambda name, known: (False, F.when(c(name).isNotNull() & ~c(name).isin(*known), f"observation.{name}: not allowed"))
    checks += [enum(name, known) for name, known in (({"spec_version": versions} if versions else {}) | ENUMS).items()]
    checks.append((False, F.when(c("observed_at").isNotNull() & ~c("observed_at").rlike(TIMESTAMP), "observation.observed_at: not a timestamp")))
    for kind, (known, required) in PAYLOAD.items():
        mine = c("observation_type") == kind
        checks.append((True, F.when(mine, F.concat(F.lit("observation.payload: unexpected "), strange(F.col("_keys_payload"), known.split())))))
        checks += [(True, F.when(mine & ~F.array_contains("_keys_payload", r), f"observation.payload.{r}: required")) for r in required.split()]
        checks += [(False, F.when(mine & ~c(f"payload.{name}").isin(*values), f"observation.payload.{name}: not allowed")) for name, values in PAYLOAD_ENUMS.get(kind, {}).items()]
    caller, strength = F.coalesce(c("caller.type"), F.lit("unknown")), F.coalesce(c("caller.identity_strength"), F.lit("unknown"))
    fits = F.lit(False)
    for kind, needed in CALLERS.items():
        fits = fits | ((caller == kind) & (strength == needed))
    checks.append((False, F.when((F.col("_fine") | some) & ~fits, "observation: caller type and strength contradict")))
    none = F.array().cast("array<string>")
    errors = F.when(F.col("_sound"), none).when(F.col("_fine"), F.array_compact(F.array(*(check for of_shape, check in checks if not of_shape)))).otherwise(F.array_compact(F.array(*(check for _, check in checks))))
    return once(rows, errors=errors).drop("_sound", "_v", "_e", "_shape", "_fine", "_typed", "_keys", *(f"_keys_{name}" for name in (*SUB_KEYS, "payload")))


def reject_reasons(validated: DataFrame) -> DataFrame:
    """How many lines per first error, cut at its colon and at 40 characters; accepted ones have a null reason."""
    reason = F.substring(F.split(F.get("errors", F.lit(0)), ":")[0], 1, 40)
    return validated.groupBy(F.when(F.size("errors") > 0, reason).alias("reason")).agg(F.count("*").alias("n"))


#: The stage that each type of observation shows.
STAGES = {"selection": "L0", "attempt_started": "L1", "attempt_completed": "L2", "result_consumed": "L3"}
#: Fields of payloads that keep their names.
CARRIED = (
    "tool_call_id trace_id operation_id task_id retry_of outcome duration_ms error_type consumed_by_request_seq task_success model task_type "
    "decision_id candidate_set_id category_id category_version choice_mode rank_in_candidate_set selection_id rank decision_authority selection_constraint selection_reason_observable"
).split()


def flatten_observation(rows: DataFrame, e: str = "e", project: str | None = None) -> DataFrame:
    """The flat observation of each envelope, with its line_no; ``tool`` is what follows the first colon of the surface.

    All fields are carried: caller, surface and its claims, collection health (``dropped``, ``buffer_overflow``), sampling as JSON,
    provenance, signature and key, and those of every type's payload, times as timestamps. ``lifecycle`` is the stage that
    the type shows. ``signature_valid`` is null until ``with_signatures`` says what a verifier found.
    """
    c = lambda name: F.col(f"{e}.{name}")
    surface = c("surface.surface_id")
    tool = F.when(surface != "", F.regexp_replace(surface, "^[^:]*:", ""))
    default = lambda name, value: F.coalesce(c(name), F.lit(value)).alias(name.split(".")[-1])
    stage = F.lit(None).cast("string")
    for kind, code in STAGES.items():
        stage = F.when(c("observation_type") == kind, code).otherwise(stage)
    health = {"source_instance_id": "source_instance_id", "source_sequence": "source_sequence", "sequence_epoch": "sequence_epoch", "dropped": "dropped_since_last_report", "buffer_overflow": "buffer_overflow"}
    return rows.select(
        c("observation_id").alias("observation_id"), c("observation_type").alias("observation_type"), parse_ts(c("observed_at")).alias("observed_at"), F.col("line_no").cast("long").alias("line_no"), c("observer.principal").alias("observer_principal"),
        c("observer.side").alias("observer_side"), c("observer.trust_domain").alias("trust_domain"), c("provenance").alias("provenance"), default_project(c("deployment_context.project_id"), project).alias("project_id"),
        surface.alias("surface_id"), *(c(f"surface.{x}").alias(x) for x in ("surface_namespace", "provider_claim", "capability_claim")), tool.alias("tool"),
        *(c(f"payload.{x}").alias(x) for x in CARRIED), *(parse_ts(c(f"payload.{x}")).alias(f"attempt_{x}" if x == "started_at" else x) for x in ("started_at", "ended_at")), c("client_key").alias("client_key"), stage.alias("lifecycle"),
        default("caller.type", "unknown").alias("caller_type"), default("caller.runtime", "unknown").alias("caller_runtime"), default("caller.identity_strength", "unknown"),
        default("usage_context", "unknown"), default("validity", "unknown"), default("context_source", "none"), default("validity_source", "none"),
        *(c(f"collection_health.{field}").alias(name) for name, field in health.items()), F.to_json(c("sampling")).alias("sampling"), c("signature").alias("signature"), c("key_id").alias("key_id"), F.lit(None).cast("boolean").alias("signature_valid"),
    )


def with_signatures(obs: DataFrame, verified: DataFrame) -> DataFrame:
    """Set ``signature_valid``: there are a signature and a key, and a verifier lists the observation with that key (observation_id, key_id).

    Only what has both is looked up; all other observations stay where they are. Observations are read for each of the two kinds,
    so they had better be stored.
    """
    good = verified.select("observation_id", F.col("key_id").alias("_key")).distinct()
    claims = F.coalesce((F.col("signature") != "") & F.col("key_id").isNotNull() & F.col("observation_id").isNotNull(), F.lit(False))
    met = obs.where(claims).alias("o").join(good.alias("v"), (F.col("o.observation_id") == F.col("v.observation_id")) & (F.col("o.key_id") == F.col("v._key")), "left")
    signed = met.select(*(F.col("v._key").isNotNull().alias(c) if c == "signature_valid" else F.col(f"o.`{c}`") for c in obs.columns))
    return signed.unionByName(obs.where(~claims).withColumn("signature_valid", F.lit(False)))


def default_project(project: Column | str, fallback: str | None) -> Column:
    p = F.col(project) if isinstance(project, str) else project
    return F.coalesce(F.when(p != "", p), F.lit(fallback).cast("string"))


def parse_ts(value: Column | str) -> Column:
    """An ISO-8601 time; what does not parse is null, never now."""
    return F.try_to_timestamp(F.col(value) if isinstance(value, str) else value)


def duration_bucket(seconds: Column | str) -> Column:
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.when(s.isNull(), F.lit(None).cast("string")).when(s < 1, "<1s").when(s < 10, "1s-10s").when(s < 60, "10s-60s").when(s < 600, "1m-10m").otherwise(">10m")


def normalize_adapter(raw: DataFrame, source: str, project: str, principal: str, pads: DataFrame, trust_domain: str | None = None) -> DataFrame:
    """Raw adapter events as flat observations; each source says only what it can know.

    source_event_id is the source's own id of the event: the call's for codex, the event's for dsh, none for the wrapper. line_no is the
    reader's; events that come without one have null. Usage context and validity are unknown, as adapters can't tell them.

    The session leaves under a pseudonym of the event's month (see ``pseudonymize``; without a time there is none, and no session). The observation_id is
    a digest of the event and its source, so that reading a file twice gives the same observations.
    """
    cut = lambda c, n=120: F.when(F.col(c) != "", F.substring(F.col(c), 1, n))
    session = lambda a, b: F.coalesce(F.when(F.col(a) != "", F.col(a)), F.col(b))
    said = F.coalesce(F.when(F.col("outcome") != "", F.col("outcome")), F.lit("unknown"))
    none = F.lit(None).cast("string")
    if source == "codex-hook":
        fields = (cut("tool_name"), cut("tool_use_id"), none, F.col("session_id"), F.lit("unknown"), none, F.lit(None).cast("long"), F.lit("L1"), "client", "hook", "codex")
    elif source == "mcp-wrapper":
        stage = F.when(said.isin("success", "failure"), "L2").otherwise("L1")
        fields = (cut("tool"), cut("tool_call_id"), cut("trace_id", 64), session("session_key", "session_id"), said, F.when(F.col("duration_bucket") != "", F.col("duration_bucket")), F.col("duration_ms").try_cast("long"), stage, "server", "wrapper", "mcp")
    elif source == "dsh":
        stage = F.when(F.col("lifecycle_stage").isin("L0", "L1", "L2", "L3"), F.col("lifecycle_stage")).otherwise("L2")
        fields = (cut("tool"), cut("tool_use_id"), cut("trace_id", 64), session("session_id", "session_key"), said, F.when(F.col("duration_bucket") != "", F.col("duration_bucket")), F.lit(None).cast("long"), stage, "client", "platform", "deepseek-harness")
    else:
        raise ValueError(f"unknown source: {source}")
    own = {"codex-hook": cut("tool_use_id"), "dsh": cut("event_id")}.get(source, none)
    line = (F.col("line_no").cast("long") if "line_no" in raw.columns else F.lit(None).cast("long")).alias("line_no")
    names = "tool tool_call_id trace_id _session outcome duration_bucket duration_ms lifecycle".split()
    columns = [F.coalesce(fields[0], F.lit("unknown")), *fields[1:8]]
    rest = {"observation_type": "attempt_completed", "observer_side": fields[8], "observer_type": fields[9], "provenance": fields[9], "caller_runtime": fields[10], "project_id": project, "observer_principal": principal, "usage_context": "unknown", "validity": "unknown", "context_source": "none", "validity_source": "none"}
    digest = F.sha2(F.concat_ws("|", F.lit(source), F.lit(principal), F.to_json(F.struct(*sorted(set(raw.columns) - {"line_no"})))), 256)
    rows = raw.select(F.concat(F.lit("obs-"), F.substring(digest, 1, 32)).alias("observation_id"), parse_ts("observed_at").alias("observed_at"), own.alias("source_event_id"), line, F.lit(trust_domain).cast("string").alias("trust_domain"), *(c.alias(n) for c, n in zip(columns, names, strict=True)), *(F.lit(v).alias(k) for k, v in rest.items()))
    named = pseudonymize(rows, pads, fields[10], "_session", "observed_at").drop("_session")
    return named.withColumn("session_key", F.when(F.col("client_key") != "", F.col("client_key"))).drop("client_key")


def redact(lines: DataFrame, allowed: tuple[str, ...], value: str = "value") -> DataFrame:
    """Drop records with a sensitive key, whatever its case and even if it is allowed; keep only allowed fields of the others."""
    keys = F.transform(F.json_object_keys(value), F.lower)
    clean = lines.where(F.json_object_keys(value).isNotNull() & ~F.arrays_overlap(keys, _text(*SENSITIVE)))
    return clean.select(*(F.get_json_object(value, f"$.{a}").alias(a) for a in allowed))


def monthly_pads(spark: SparkSession, secret: bytes, months: list[str]) -> DataFrame:
    """(month, ipad, opad) in hex for HMAC under each month's key; a handful of rows."""
    rows = []
    for month in months:
        key = hmac.new(secret, month.encode(), sha256).digest().ljust(64, b"\0")
        rows.append((month, bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()))
    return spark.createDataFrame(rows, "month string, ipad string, opad string")


def pseudonymize(rows: DataFrame, pads: DataFrame, host: str, raw: str, at: str) -> DataFrame:
    """Add client_key: p- and 20 hex digits of HMAC-SHA256 of host:raw under the key of the event's month; empty stays empty.

    The pads are one row a month and go to all tasks, so that rows stay where they are.
    """
    met = rows.withColumn("month", F.date_format(at, "yyyy-MM")).join(F.broadcast(pads), "month", "left")
    message = F.concat(F.lit(host + ":"), F.col(raw)).cast("binary")
    inner = F.unhex(F.sha2(F.concat(F.unhex("ipad"), message), 256))
    key = F.concat(F.lit("p-"), F.substring(F.sha2(F.concat(F.unhex("opad"), inner), 256), 1, 20))
    return met.withColumn("client_key", F.when(F.coalesce(F.col(raw), F.lit("")) == "", "").otherwise(key)).drop("ipad", "opad", "month")


def correlation_commitment(prefix: str, project: str = "project_id", trace: str = "trace_id", call: str = "tool_call_id") -> Column:
    """c- and 32 hex digits of SHA-256 of prefix, project, trace and call; null if both ids are empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    digest = F.sha2(F.concat_ws("||", F.lit(prefix), text(project), text(trace), text(call)), 256)
    return F.when((text(trace) != "") | (text(call) != ""), F.concat(F.lit("c-"), F.substring(digest, 1, 32)))


def build_receipts(obs: DataFrame, prefix: str, session: str = "client_key") -> DataFrame:
    """What one side may show the other: no content, ids cut, a pseudonymous session, and a commitment to join on.

    A receipt's id is a digest of the observation's, so that building receipts twice gives the same ones. ``session`` names a column that
    holds a pseudonym already (see ``pseudonymize``). Receipts are unsigned.
    """
    cut = lambda c, n: F.when(F.col(c) != "", F.substring(F.col(c), 1, n)).alias(c)
    other = lambda c, value: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(value)).alias(c)
    here = lambda c: (F.col(c) if c in obs.columns else F.lit(None).cast("string")).alias(c)
    return obs.select(
        F.concat(F.lit("r-"), F.substring(F.sha2("observation_id", 256), 1, 32)).alias("receipt_id"), "observation_id", "observed_at", "observer_side", "observer_principal", here("provenance"), "trust_domain", "project_id",
        F.substring(F.coalesce(F.when(F.col("tool") != "", F.col("tool")), F.lit("unknown")), 1, 120).alias("tool"), cut("tool_call_id", 120), cut("trace_id", 64), F.when(F.col(session) != "", F.col(session)).alias("session_key"),
        other("outcome", "unknown"), other("lifecycle", "L0"), correlation_commitment(prefix).alias("commitment"), here("sampling"),
    )


def migrate_legacy(rows: DataFrame) -> DataFrame:
    """Old codes as words; validity ``retry`` becomes a relation where there is one, and a flag elsewhere."""
    related = F.col("operation_id").isNotNull() | F.col("retry_of").isNotNull()
    retry = F.col("validity") == "retry"
    stage = F.when(F.col("lifecycle") == "L0", "selected").when(F.col("lifecycle") == "L1", "invoked").when(F.col("lifecycle") == "L2", "completed").when(F.col("lifecycle") == "L3", "consumed")
    grade = F.when(F.col("evidence") == "E0", "observed").when(F.col("evidence") == "E1", "authenticated").when(F.col("evidence") == "E2", "corroborated").when(F.col("evidence") == "E3", "platform-attested").otherwise(F.col("evidence"))
    out = rows.withColumn("legacy_retry", F.coalesce(retry & ~related, F.lit(False))).withColumn("stage", stage).withColumn("evidence", grade)
    return out.withColumn("validity", F.when(retry, "unknown").otherwise(F.col("validity")))


def map_otel_spans(spans: DataFrame, principal: str = "otel", project: str | None = None, side: str = "client") -> DataFrame:
    """GenAI spans (trace_id, span_id, ended_at, attributes: a map of texts) as observations of attempts with their usage.

    A span is an attempt, never an operation; its ids are evidence for correlation, and observation_id is a digest of them. An agent's name
    is a claim. Reasoning is part of output. Without a split of the cache, uncached input is all input and the split stays null, as
    ``cache_allocation`` says; with one it is what the cache did not give.
    """
    a = lambda key: F.try_element_at("attributes", F.lit(key))
    n = lambda *keys: F.coalesce(*(a(k).try_cast("long") for k in keys))
    outcome = F.when(a("error.type").isNotNull(), "failure").otherwise("success")
    given, read, made = n("gen_ai.usage.input_tokens"), n("gen_ai.usage.cache_read.input_tokens"), n("gen_ai.usage.cache_creation.input_tokens")
    none = F.lit(0).cast("long")
    split = read.isNotNull() | made.isNotNull()
    at = (F.col("ended_at").cast("timestamp") if "ended_at" in spans.columns else F.lit(None).cast("timestamp")).alias("observed_at")
    agent = a("gen_ai.agent.name")
    return spans.select(
        F.concat(F.lit("obs-"), F.substring(F.sha2(F.concat_ws("|", F.lit("otel"), part_of("trace_id"), part_of("span_id")), 256), 1, 32)).alias("observation_id"), F.lit("attempt_completed").alias("observation_type"), at,
        F.lit(principal).alias("observer_principal"), F.lit(side).alias("observer_side"), F.lit("otel").alias("provenance"), F.lit(project).cast("string").alias("project_id"),
        "trace_id", "span_id", a("gen_ai.operation.name").alias("operation_name"), F.coalesce(a("gen_ai.provider.name"), a("gen_ai.system")).alias("provider_claim"), agent.alias("caller_runtime"),
        F.when(agent.isNotNull(), "claimed_agent").otherwise("unknown").alias("caller_type"), F.when(agent.isNotNull(), "declared").otherwise("unknown").alias("identity_strength"),
        a("gen_ai.tool.name").alias("tool"), a("gen_ai.tool.call.id").alias("tool_call_id"), a("gen_ai.request.model").alias("model"), outcome.alias("outcome"), F.lit("L2").alias("lifecycle"),
        given.alias("input_tokens"), n("gen_ai.usage.output_tokens").alias("output_tokens"), n("gen_ai.usage.reasoning.output_tokens", "gen_ai.usage.reasoning_tokens").alias("reasoning_tokens"), read.alias("cache_read_tokens"), made.alias("cache_creation_tokens"),
        (given - F.coalesce(read, none) - F.coalesce(made, none)).alias("uncached_input"), F.when(split, "split").otherwise("unknown").alias("cache_allocation"),
    )


def part_of(name: str) -> Column:
    """A value in a digest: its length before it; null is a dash."""
    return F.coalesce(F.concat(F.length(name).cast("string"), F.lit(":"), F.col(name)), F.lit("-"))
