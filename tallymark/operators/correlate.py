"""Observations to attempts and operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.sources.files import stored

BUCKET_SECONDS = 300
ATTEMPT_TYPES = ("attempt_started", "attempt_completed")
#: Validity values from the weakest to the strongest reason to exclude; fixed by the qualification rules.
SEVERITY = ("normal", "health_check", "load_test", "duplicate", "replay", "suspected_invalid")
RETRYABLE = ("failure", "retry", "denied")


def dedup_observations(obs: DataFrame) -> DataFrame:
    """The first row of each observation_id by observed_at, line_no, then all other columns; null and empty ids go.

    Hashes of the ids tell first which of them stand twice, and are stored; only rows with such a hash are dealt out by their id, all
    others stay where they are. Where the hashes are few, Spark broadcasts them; rows are read once for the hashes and again after.
    """
    rest = [F.col(c).cast("string") for c in sorted(obs.columns)]
    tie = F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in rest))
    rows = obs.where("observation_id IS NOT NULL AND observation_id <> ''")
    hashed = F.xxhash64("observation_id").alias("_hash")
    twice = stored(rows.select(hashed).groupBy("_hash").agg(F.count("*").alias("n")).where("n > 1").select("_hash"))
    rows = rows.select(*(F.col(f"`{c}`") for c in obs.columns), hashed)
    alone, again = (rows.join(twice, "_hash", how).select(*(F.col(f"`{c}`") for c in obs.columns)) for how in ("left_anti", "left_semi"))
    first = F.min_by(F.struct(*(F.col(f"`{c}`") for c in obs.columns if c != "observation_id")), F.struct("observed_at", "line_no", tie))
    firsts = again.repartition("observation_id").groupBy("observation_id").agg(first.alias("_first")).select("observation_id", "_first.*")
    return alone.unionByName(firsts.select(*(F.col(f"`{c}`") for c in obs.columns)))


def attempt_events_only(obs: DataFrame) -> DataFrame:
    """Observations of attempts; without a type, as old rows are, each counts as one."""
    if "observation_type" not in obs.columns:
        return obs
    return obs.where(F.col("observation_type").isNull() | F.col("observation_type").isin(*ATTEMPT_TYPES))


def part(value: Column | str) -> Column:
    """A value as part of a key: its length goes before it, so that no character of it can end it; null is a dash."""
    v = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def grouped(obs: DataFrame) -> DataFrame:
    """Add matched_by and group_key: the attempt that an observation can belong to.

    A call id names it in its project and tool; else a trace id per tool and bucket of 300 seconds does; everything else stands alone.
    """
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    bucket = F.floor(F.unix_timestamp(F.col("observed_at").cast("timestamp")) / BUCKET_SECONDS)
    kind = F.when(some("tool_call_id"), "call_id").when(some("trace_id") & F.col("observed_at").isNotNull(), "trace_window").otherwise("none")
    call = F.concat_ws("|", F.lit("c"), part("project_id"), part("tool"), part("tool_call_id"))
    trace = F.concat_ws("|", F.lit("t"), part("project_id"), part("trace_id"), part("tool"), bucket.cast("string"))
    alone = F.concat_ws("|", F.lit("s"), "observation_id")
    return obs.withColumn("matched_by", kind).withColumn("group_key", F.when(F.col("matched_by") == "call_id", call).when(F.col("matched_by") == "trace_window", trace).otherwise(alone))


def keyed(obs: DataFrame) -> DataFrame:
    """Add matched_by, group_key and attempt_key: the group, but a trace that one side alone saw falls apart.

    Only traces meet in a window; all other rows stay where they are, so a call id that is everywhere, or none, never fills a task.
    """
    alone = F.concat_ws("|", F.lit("s"), "observation_id")
    rows = grouped(obs)
    rest = rows.where("matched_by <> 'trace_window'").withColumn("attempt_key", F.col("group_key"))
    sides = Window.partitionBy("group_key")
    two = F.coalesce(F.min("observer_side").over(sides) != F.max("observer_side").over(sides), F.lit(False))
    traces = rows.where("matched_by = 'trace_window'").withColumn("_two", two)
    traces = traces.withColumn("attempt_key", F.when(F.col("_two"), F.col("group_key")).otherwise(alone)).withColumn("matched_by", F.when(F.col("_two"), "trace_window").otherwise("none"))
    return rest.unionByName(traces.drop("_two"))


def outcome_of() -> Column:
    """No outcome is unknown, one is itself, several are inconsistent; ``unknown`` counts as a value."""
    value = F.when(F.col("outcome") != "", F.col("outcome"))
    low, high = F.min(value), F.max(value)
    return F.when(low.isNull(), "unknown").when(low != high, "inconsistent").otherwise(low)


def evidence_of() -> Column:
    """The display grade of an attempt's observations. Two of a kind are told by its least and largest, without a distinct count."""
    named = F.col("observer_principal") != ""
    two = lambda value: F.coalesce(F.min(value) != F.max(value), F.lit(False))
    several = two(F.when(named, F.concat(part("observer_principal"), part("trust_domain"))))
    domains = two(F.when(named & (F.col("trust_domain") != ""), F.col("trust_domain")))
    signed = F.coalesce(F.bool_or("signature_valid"), F.lit(False))
    return F.when(several & domains, "independently-corroborated").when(several, "corroborated").when(signed, "authenticated").otherwise("observed")


def severity_of(validity: str = "validity") -> Column:
    out = F.lit(None).cast("int")
    for rank, name in reversed(list(enumerate(SEVERITY))):
        out = F.when(F.col(validity) == name, rank).otherwise(out)
    return out


#: What a source of observations may leave out, and its type.
OPTIONAL = {"signature_valid": "boolean", "lifecycle": "string", "identity_strength": "string", "buffer_overflow": "boolean", "dropped": "int", "cost": "double", "operation_id": "string", "task_id": "string", "client_key": "string", "usage_context": "string", "validity": "string", "validity_source": "string", "observation_type": "string", "outcome": "string"}


def with_optional(obs: DataFrame) -> DataFrame:
    """The observations with nulls in what the source leaves out. Flat observations (ingest.flatten_observation) leave out the cost alone."""
    return obs.withColumns({name: F.lit(None).cast(kind) for name, kind in OPTIONAL.items() if name not in obs.columns})


def attempts(obs: DataFrame, **more: Column) -> DataFrame:
    """One row per attempt with all that metrics ask of its observations, in one aggregation; see ``with_optional`` for what may be absent.
    ``more`` are further aggregates of an attempt's observations, by name.

    Every state is a minimum, maximum, count or small distinct, so that a call id that a client uses for everything cannot
    fill a task's memory. An empty usage context says nothing, as an unknown one.
    """
    obs = with_optional(obs)
    context = F.when(~F.col("usage_context").isin("unknown", ""), F.col("usage_context"))
    configured = (F.col("validity") == "normal") & (F.col("validity_source") == "provider_configuration")
    rank = F.when(~F.coalesce(configured, F.lit(False)), severity_of())
    operation = F.when(F.col("operation_id") != "", F.col("operation_id"))
    out = keyed(attempt_events_only(obs)).groupBy("attempt_key").agg(
        F.min("group_key").alias("group_key"),
        F.min("matched_by").alias("matched_by"), F.min("project_id").alias("project_id"), F.min("tool").alias("tool"), F.count("*").alias("n_obs"),
        outcome_of().alias("outcome"), F.max(F.coalesce("lifecycle", F.lit("L0"))).alias("lifecycle"), F.min("observed_at").alias("started_at"), evidence_of().alias("evidence"),
        F.min(F.struct(operation.isNull().alias("none"), F.col("observed_at"), F.col("line_no"), operation.alias("id")))["id"].alias("operation_id"),
        F.coalesce(F.min(operation) != F.max(operation), F.lit(False)).alias("ambiguous"), F.min("task_id").alias("task_id"), F.min("client_key").alias("client_key"),
        F.min(context).alias("_low"), F.max(context).alias("_high"), F.bool_or(F.col("usage_context").isin("unknown", "")).alias("_context_unknown"),
        F.max(rank).alias("_rank"), F.min(rank).alias("_least_rank"), F.bool_or(configured).alias("_discarded"), F.bool_or(F.col("observation_type") == "attempt_completed").alias("has_completed"),
        F.bool_or(F.col("identity_strength").isin("declared", "correlated", "attested")).alias("caller_known"),
        F.bool_or(F.coalesce("buffer_overflow", F.lit(False)) | (F.coalesce("dropped", F.lit(0)) > 0)).alias("collection_flagged"),
        F.bool_or(F.col("observer_side") == "client").alias("has_client"), F.bool_or(F.col("observer_side") == "server").alias("has_server"), F.sum("cost").alias("cost"), *(c.alias(name) for name, c in more.items()),
    )
    none = F.lit(False)
    out = out.withColumn("usage_context", F.when(F.col("_low").isNull(), "unknown").when(F.col("_low") != F.col("_high"), "inconsistent").otherwise(F.col("_low")))
    names = F.array(*map(F.lit, SEVERITY))
    out = out.withColumn("validity", F.coalesce(F.get(names, F.col("_rank")), F.lit("unknown")))
    # A provider's own "normal" counts for nothing: it leaves the rest incomplete, unless somebody else says normal or nobody says anything.
    dropped = F.coalesce("_discarded", none) & F.coalesce(F.col("_least_rank") > 0, none)
    partial = (F.coalesce("_context_unknown", none) & ~F.col("usage_context").isin("unknown", "inconsistent")) | dropped
    status = F.when(F.col("usage_context") == "inconsistent", "inconsistent").when(partial, "partially_classified").when((F.col("usage_context") == "production") & (F.col("validity") == "normal"), "qualified").otherwise("unknown")
    out = out.withColumn("qualification_status", status).withColumn("eligible", F.lit(1)).withColumn("attempt_id", F.sha2("attempt_key", 256))
    out = out.withColumn("resolution", F.when(F.col("operation_id").isNotNull(), "explicit").otherwise("unknown"))
    for flag in ("has_completed", "caller_known", "collection_flagged", "has_client", "has_server"):
        out = out.withColumn(flag, F.coalesce(flag, none))
    return out.drop("_low", "_high", "_context_unknown", "_rank", "_least_rank", "_discarded")


def observation_links(obs: DataFrame) -> DataFrame:
    return keyed(attempt_events_only(obs)).select(F.sha2("attempt_key", 256).alias("attempt_id"), "observation_id")


def operations_structural(rows: DataFrame) -> DataFrame:
    """Retry chains of unresolved attempts of one project, tool and task: a chain ends with an outcome that is not retried.

    Adds operation_id (the first attempt of the chain) and resolution ``structural`` to attempts that have a task and a start.
    """
    chain = Window.partitionBy("project_id", "tool", "task_id").orderBy("started_at", "attempt_key")
    before = F.lag("outcome").over(chain)
    chained = F.col("operation_id").isNull() & (F.coalesce("task_id", F.lit("")) != "") & F.col("started_at").isNotNull()
    open_rows = rows.where(chained).withColumn("_new", F.when(before.isin(*RETRYABLE), 0).otherwise(1))
    open_rows = open_rows.withColumn("_chain", F.sum("_new").over(chain))
    first = Window.partitionBy("project_id", "tool", "task_id", "_chain").orderBy("started_at", "attempt_key")
    done = open_rows.withColumn("operation_id", F.first("attempt_id").over(first)).withColumn("resolution", F.lit("structural")).drop("_new", "_chain")
    return done.unionByName(rows.where(~chained))


def resolution_provenance(rows: DataFrame) -> DataFrame:
    """Per operation: status, method, rule and the attempts it comes from, sorted."""
    status = F.when(F.bool_or("ambiguous"), "ambiguous").otherwise("resolved")
    known = rows.where("operation_id IS NOT NULL").groupBy("operation_id", "resolution")
    return known.agg(status.alias("status"), F.count("*").alias("attempts"), F.array_sort(F.collect_list("attempt_id")).alias("source_attempt_ids")).withColumn("rule_id", F.concat(F.lit("op-"), "resolution")).withColumn("rule_version", F.lit("1"))


def receipts_correspond(receipts: DataFrame) -> DataFrame:
    """Commitments that both sides hold, with the receipts of each; one aggregation instead of a self-join."""
    sides = receipts.where("commitment IS NOT NULL").groupBy("commitment").agg(F.count_if(F.col("observer_side") == "client").alias("client"), F.count_if(F.col("observer_side") == "server").alias("server"))
    return sides.where("client > 0 AND server > 0")


#: Numbers of a bitmap; what Spark's bitmap functions take.
BITS = 1 << 15


def zero_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The least and greatest number of each bitmap, and the ranges missing in between."""
    for batch in batches:
        low, high, gaps = [], [], []
        for bucket, data in zip(batch["bucket"], batch["bitmap"], strict=True):
            there = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")) + int(bucket) * BITS
            low.append(there[0])
            high.append(there[-1])
            after = np.flatnonzero(np.diff(there) > 1)
            gaps.append([{"first_missing": int(a), "last_missing": int(b)} for a, b in zip(there[after] + 1, there[after + 1] - 1, strict=True)])
        yield batch[["source_instance_id", "sequence_epoch", "bucket"]].assign(low=low, high=high, gaps=gaps)


def sequence_gaps(rows: DataFrame) -> DataFrame:
    """Missing ranges of source_sequence per source instance and epoch, as the numbers that are there leave them.

    Numbers become bitmaps of ``BITS`` by a partial aggregate, so a source that has all rows of the table is spread over as many groups
    as it has ranges of numbers. Gaps inside a range are read from its bitmap, those between ranges from one row each. Numbers that
    repeat count once, and null ones not at all; rows without a source or an epoch are one source of their own.
    """
    n = F.col("source_sequence").cast("long")
    bucket = F.shiftright(n, 15)
    keys = ["source_instance_id", "sequence_epoch"]
    maps = rows.where("source_sequence IS NOT NULL").select(*keys, bucket.alias("bucket"), (n - bucket * BITS).alias("place")).groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("place").alias("bitmap"))
    read = maps.mapInPandas(zero_runs, "source_instance_id string, sequence_epoch string, bucket long, low long, high long, gaps array<struct<first_missing:long,last_missing:long>>")
    before = F.lag("high").over(Window.partitionBy(*keys).orderBy("bucket"))
    read = read.withColumn("before", before)
    edge = F.when(F.col("low") - F.col("before") > 1, F.array(F.struct((F.col("before") + 1).alias("first_missing"), (F.col("low") - 1).alias("last_missing")))).otherwise(F.array().cast("array<struct<first_missing:bigint,last_missing:bigint>>"))
    return read.select(*keys, F.explode(F.concat("gaps", edge)).alias("gap")).select(*keys, "gap.first_missing", "gap.last_missing")


#: Columns of an evidence vector but the class.
EVIDENCE = ("authentication", "corroboration", "independence", "attestation")


def evidence_vector(obs: DataFrame) -> DataFrame:
    """Per attempt: attempt_key, evidence and the axes that it is condensed from.

    authentication (signed or none), corroboration (how many principals in their domains), independence (distinct-domains,
    single-domain, or unknown without any domain), attestation (UNSUPPORTED: nothing attests yet).
    """
    named = F.col("observer_principal") != ""
    observers = F.count_distinct(F.when(named, F.concat(part("observer_principal"), part("trust_domain"))))
    domain = F.when(named & (F.col("trust_domain") != ""), F.col("trust_domain"))
    independence = F.when(F.min(domain) != F.max(domain), "distinct-domains").when(F.min(domain).isNotNull(), "single-domain").otherwise("unknown")
    signed = F.when(F.coalesce(F.bool_or("signature_valid"), F.lit(False)), "signed").otherwise("none")
    return keyed(attempt_events_only(obs)).groupBy("attempt_key").agg(
        evidence_of().alias("evidence"), signed.alias("authentication"), F.concat(observers.cast("string"), F.lit(" observers")).alias("corroboration"), independence.alias("independence"), F.lit("UNSUPPORTED").alias("attestation")
    )


def retried_call() -> Column:
    """The attempt that an attempt says it retries: that of the call in their project and tool, the least of several; null if it names none."""
    call = F.concat_ws("|", F.lit("c"), part("project_id"), part("tool"), part("retry_of"))
    return F.min(F.when(F.col("retry_of") != "", call))


def retry_links(obs: DataFrame) -> DataFrame:
    """(attempt_key, retried, project_id) of the attempts that say which call they retry: see ``retried_call``. What is retried need not be there."""
    return attempts(obs, retried=retried_call()).where("retried IS NOT NULL").select("attempt_key", "retried", "project_id")


def retry_ranks(links: DataFrame) -> DataFrame:
    """(attempt_key, head, place, cyclic) of every attempt on a chain: the first attempt, and how many retries lie between.

    Pointer doubling: in each round an attempt's pointer becomes its target's, so the longest chain's n attempts take about log n
    rounds of one join, in which only attempts move that have not met their head. Every attempt between one and its head is on that
    chain too, so while any has a head ahead, some meet theirs in the next round. After a round in which none does, all that are left go
    round a cycle, or lead into one: no head and no place, and ``cyclic``.
    """
    edges = stored(links.select("attempt_key", F.col("retried").alias("up")))
    heads = stored(edges.select(F.col("up").alias("attempt_key")).distinct().join(edges.select("attempt_key"), "attempt_key", "left_anti"))
    state = stored(edges.join(heads.select(F.col("attempt_key").alias("up"), F.lit(True).alias("done")), "up", "left").select("attempt_key", "up", F.lit(1).cast("long").alias("place"), F.coalesce("done", F.lit(False)).alias("done")))
    done, going = state.where("done"), state.where("NOT done")
    while not going.isEmpty():
        step = done.unionByName(going).select(F.col("attempt_key").alias("up"), F.col("up").alias("_up"), F.col("place").alias("_place"), F.col("done").alias("_done"))
        moved = stored(going.join(step, "up").select("attempt_key", F.col("_up").alias("up"), (F.col("place") + F.col("_place")).alias("place"), F.col("_done").alias("done")))
        met, going = moved.where("done"), moved.where("NOT done")
        if met.isEmpty():
            break
        done = done.unionByName(met)
    found = done.select("attempt_key", F.col("up").alias("head"), "place", F.lit(False).alias("cyclic"))
    found = found.unionByName(going.select("attempt_key", F.lit(None).cast("string").alias("head"), F.lit(None).cast("long").alias("place"), F.lit(True).alias("cyclic")))
    return found.unionByName(heads.select("attempt_key", F.col("attempt_key").alias("head"), F.lit(0).cast("long").alias("place"), F.lit(False).alias("cyclic")))


def retry_relation(obs: DataFrame) -> DataFrame:
    """One row per chain: project_id, head, attempts, length, final_outcome, succeeded_after, and whether its head was observed.

    Several attempts can retry the same one; length is that of the longest way, and final_outcome that of the last attempt on
    it, the latest by start and key where several are as far. succeeded_after is the least place with a success. A chain whose head nobody
    observed keeps its name, and does not count it as an attempt. Attempts on cycles have no chain: see ``retry_cycles``.
    Attempts are derived once, and stored with what they retry.
    """
    known = stored(attempts(obs, retried=retried_call()).select("attempt_key", "project_id", "outcome", "started_at", "retried"))
    ranks = retry_ranks(known.where("retried IS NOT NULL")).where("NOT cyclic")
    met = ranks.join(known.drop("retried"), "attempt_key", "left")
    there = F.col("outcome").isNotNull()
    last = F.max_by("outcome", F.when(there, F.struct("place", "started_at", "attempt_key")))
    return met.groupBy("head").agg(
        F.min("project_id").alias("project_id"), F.count_if(there).alias("attempts"), (F.max("place") + 1).alias("length"), last.alias("final_outcome"),
        F.min(F.when(F.col("outcome") == "success", F.col("place"))).alias("succeeded_after"), F.coalesce(F.bool_or(there & (F.col("place") == 0)), F.lit(False)).alias("observed"),
    )


def retry_cycles(obs: DataFrame) -> DataFrame:
    """The attempts (attempt_key) whose retries go round, or lead to some that do."""
    return retry_ranks(retry_links(obs)).where("cyclic").select("attempt_key")


def retry_rate(obs: DataFrame) -> DataFrame:
    """Per project: resolved operations, those in which an attempt retries another attempt of the same operation, and their share.

    Retries between operations, or of attempts without one, don't count: the rate is within resolved operations only. Attempts are
    derived once, and stored with what they retry.
    """
    known = stored(attempts(obs, retried=retried_call()).where("operation_id IS NOT NULL").select("attempt_key", "project_id", "operation_id", "retried"))
    both = known.where("retried IS NOT NULL").join(known.select(F.col("attempt_key").alias("retried"), F.col("attempt_key").alias("_of"), F.col("operation_id").alias("of"), F.col("project_id").alias("_p")), "retried")
    retried = both.where("operation_id = of AND project_id = _p AND attempt_key <> _of").select("project_id", "operation_id", F.lit(True).alias("again"))
    out = known.select("project_id", "operation_id", F.lit(False).alias("again")).unionByName(retried).groupBy("project_id", "operation_id").agg(F.bool_or("again").alias("again"))
    out = out.groupBy("project_id").agg(F.count("*").alias("operations"), F.count_if("again").alias("with_retries"))
    return out.withColumn("rate", F.col("with_retries") / F.col("operations"))


def discrepancy_report(rows: DataFrame) -> DataFrame:
    """Per tool what each side saw, the difference, and the share of attempts that both saw."""
    both = F.count_if(F.col("has_client") & F.col("has_server"))
    counts = rows.groupBy("tool").agg(F.count_if("has_client").alias("client"), F.count_if("has_server").alias("server"), both.alias("both_sides"), F.count_if(F.col("has_client") & F.col("has_server") & (F.col("outcome") != "inconsistent")).alias("agreeing"), F.count("*").alias("attempts"))
    return counts.withColumn("delta", F.col("client") - F.col("server")).withColumn("match_rate", F.col("both_sides") / F.col("attempts"))


def discrepancy_stages(obs: DataFrame) -> DataFrame:
    """Per tool and stage (invoked, completed, succeeded): attempts that the client saw there, the server, both; the difference, and the
    share of those that either saw which both did. An attempt is in a stage for a side if one of the side's observations shows it."""
    client, server = F.col("observer_side") == "client", F.col("observer_side") == "server"
    shows = {"invoked": F.lit(True), "completed": F.col("observation_type") == "attempt_completed", "succeeded": F.col("outcome") == "success"}
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    per = keyed(attempt_events_only(with_optional(obs))).groupBy("attempt_key").agg(F.min("tool").alias("tool"), *(some(side & shown).alias(f"{name}_{stage}") for stage, shown in shows.items() for name, side in (("client", client), ("server", server))))
    stages = F.explode(F.array(*(F.struct(F.lit(stage).alias("stage"), F.col(f"client_{stage}").alias("c"), F.col(f"server_{stage}").alias("s")) for stage in shows))).alias("x")
    rows = per.select("tool", stages).select("tool", "x.*").where("c OR s")
    out = rows.groupBy("tool", "stage").agg(F.count_if("c").alias("client"), F.count_if("s").alias("server"), F.count_if(F.col("c") & F.col("s")).alias("both_sides"), F.count("*").alias("attempts"))
    return out.withColumn("delta", F.col("client") - F.col("server")).withColumn("match_rate", F.col("both_sides") / F.col("attempts"))


def lineage_of_observations(obs: DataFrame) -> DataFrame:
    """Per project: observations of attempts, those with a call or trace, and those with a task too, whose operation is known as well; and the
    share of the last among those with a task. Observations without a task stay out of that share."""
    named = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    tied = named("tool_call_id") | named("trace_id")
    out = attempt_events_only(with_optional(obs)).groupBy("project_id").agg(F.count("*").alias("observations"), F.count_if(tied).alias("tied"), F.count_if(named("task_id")).alias("with_task"), F.count_if(tied & named("task_id") & named("operation_id")).alias("complete"))
    return out.withColumn("coverage", F.when(F.col("with_task") > 0, F.col("complete") / F.col("with_task")))


def lineage_coverage(rows: DataFrame) -> DataFrame:
    """Attempts with a task, and those with an operation too."""
    out = rows.groupBy("project_id").agg(F.count_if(F.col("task_id").isNotNull()).alias("with_task"), F.count_if(F.col("task_id").isNotNull() & F.col("operation_id").isNotNull()).alias("complete"))
    return out.withColumn("coverage", F.when(F.col("with_task") > 0, F.col("complete") / F.col("with_task")))


def retry_chains(rows: DataFrame) -> DataFrame:
    """Resolved operations, those with more than one attempt, and their share, per project."""
    per = rows.where("operation_id IS NOT NULL").groupBy("project_id", "operation_id").agg(F.count("*").alias("n"))
    out = per.groupBy("project_id").agg(F.count("*").alias("operations"), F.count_if(F.col("n") > 1).alias("chains"))
    return out.withColumn("rate", F.col("chains") / F.col("operations"))
