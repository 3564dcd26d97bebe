"""The same operators over streams. Inputs are file streams of observations; ``trigger`` is available-now or continuous."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tallymark.operators import correlate, ingest
from tallymark.sources.schemas import ENVELOPE

LATE = "10 minutes"
#: Parts of the ledger of observations by a hash of their group.
LEDGER_PARTS = 64


def with_event_time(stream: DataFrame, at: str = "observed_at", late: str = LATE) -> DataFrame:
    """Event time as a timestamp with a watermark; Parquet's zoneless timestamps can't carry one."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def stream_ingest(stream: DataFrame, late: str = LATE) -> DataFrame:
    """Observations with an id, each id once within the watermark."""
    valid = stream.where("observation_id IS NOT NULL AND observation_id <> ''")
    return with_event_time(valid, late=late).dropDuplicatesWithinWatermark(["observation_id"])


def stream_validated(lines: DataFrame, accepted: str, rejected: str, checkpoint: str, project: str | None = None) -> StreamingQuery:
    """JSON lines (``value``) to flat observations, and to lines with their errors: nothing is lost, nothing invalid goes on.

    Each batch writes both under its number, so a retry replaces them; it is read from its source for each, as keeping its lines
    on disk takes more than they do there. ``stream_ingest`` takes what is accepted. line_no grows
    with the batch, and in it with the place in the file.
    """

    def route(batch: DataFrame, number: int) -> None:
        placed = batch.withColumn("line_no", F.lit(number << 48) + F.monotonically_increasing_id())
        judged = ingest.validate_envelope(placed)
        good = judged.where(F.size("errors") == 0).withColumn("e", F.from_json("value", ENVELOPE))
        ingest.flatten_observation(good, project=project).write.mode("overwrite").option("compression", "zstd").parquet(f"{accepted}/batch={number}")
        judged.where(F.size("errors") > 0).select("value", "errors").write.mode("overwrite").option("compression", "zstd").parquet(f"{rejected}/batch={number}")

    return lines.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_attempts(stream: DataFrame, ledger: str, out: str, checkpoint: str) -> StreamingQuery:
    """Attempts that follow late sides: each batch goes to the ledger, and the groups it touches are derived anew.

    A group (see correlate.grouped) holds all observations that can be one attempt: a call, or a trace in its tool and five minutes,
    which is one attempt or several. Of a group the attempts of the last batch that touched it count, so singles that a late
    side joins vanish. The ledger is partitioned by a hash of the group, and a batch reads only the parts that it touches. Every
    batch writes under its number, so a retry replaces it. Repeated ids must be gone already: see ``stream_ingest``.
    """

    def derive(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = correlate.grouped(correlate.attempt_events_only(batch)).withColumn("part", F.pmod(F.xxhash64("group_key"), F.lit(LEDGER_PARTS)).cast("int"))
        rows.write.mode("overwrite").partitionBy("part").parquet(f"{ledger}/batch={number}")
        written = spark.read.schema(rows.schema).option("basePath", f"{ledger}/batch={number}").parquet(f"{ledger}/batch={number}")
        parts = [r["part"] for r in written.select("part").distinct().collect()]  # LEDGER_PARTS numbers at most
        whole = StructType([*rows.schema.fields, StructField("batch", LongType())])
        known = spark.read.schema(whole).option("basePath", ledger).parquet(ledger).where((F.col("batch") <= number) & F.col("part").isin(parts))
        mine = known.join(written.select("group_key").distinct(), "group_key", "left_semi").drop("batch", "part", "group_key", "matched_by")
        correlate.attempts(correlate.dedup_observations(mine)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(derive).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The attempts of each group as the last batch that touched it left them."""
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    newest = rows.groupBy("group_key").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["group_key", "batch"], "left_semi").drop("batch")


def stream_attempts_bounded(stream: DataFrame, gap: str = "10 minutes", late: str = LATE) -> DataFrame:
    """Attempts whose sides come within ``gap`` of each other, from state that the watermark bounds; nothing is read again.

    A session of a group (see correlate.grouped) ends when none of its observations came for the gap; then its attempts are given out,
    once. A trace's session that one side alone saw falls apart, as in the batch operator. Unlike the ledger's form
    (``stream_attempts``), a side that comes after the gap, or later than the watermark lets it, makes an attempt of its own. Repeated ids
    must be gone already. Per attempt: attempt_key, matched_by, project_id, tool, n_obs, outcome, lifecycle, started_at, evidence, has_client, has_server.
    """
    rows = correlate.grouped(correlate.with_optional(correlate.attempt_events_only(with_event_time(stream, late=late))))
    side = lambda name: F.coalesce(F.bool_or(F.col("observer_side") == name), F.lit(False)).alias(f"has_{name}")
    signed = F.when(F.coalesce("signature_valid", F.lit(False)), "authenticated").otherwise("observed")
    value = F.coalesce(F.when(F.col("outcome") != "", F.col("outcome")), F.lit("unknown"))
    own = F.struct("observation_id", value.alias("outcome"), F.coalesce("lifecycle", F.lit("L0")).alias("lifecycle"), F.col("observed_at").alias("started_at"), signed.alias("evidence"), (F.col("observer_side") == "client").alias("has_client"), (F.col("observer_side") == "server").alias("has_server"))
    out = rows.groupBy(F.session_window("observed_at", gap), "group_key").agg(
        F.min("matched_by").alias("matched_by"), F.min("project_id").alias("project_id"), F.min("tool").alias("tool"), F.count("*").alias("n_obs"), correlate.outcome_of().alias("outcome"),
        F.max(F.coalesce("lifecycle", F.lit("L0"))).alias("lifecycle"), F.min("observed_at").alias("started_at"), correlate.evidence_of().alias("evidence"), side("client"), side("server"),
        F.coalesce(F.min("observer_side") != F.max("observer_side"), F.lit(False)).alias("_two"), F.collect_list(F.when(F.col("matched_by") == "trace_window", own)).alias("_each"),
    )
    whole = ["outcome", "lifecycle", "started_at", "evidence", "has_client", "has_server"]
    apart = (F.col("matched_by") == "trace_window") & ~F.col("_two")
    alone = F.transform("_each", lambda o: F.struct(F.concat_ws("|", F.lit("s"), o["observation_id"]).alias("attempt_key"), F.lit("none").alias("matched_by"), F.lit(1).cast("long").alias("n_obs"), *(o[c].alias(c) for c in whole)))
    one = F.array(F.struct(F.col("group_key").alias("attempt_key"), "matched_by", "n_obs", *whole))
    return out.select("project_id", "tool", F.explode(F.when(apart, alone).otherwise(one)).alias("a")).select("a.attempt_key", "a.matched_by", "project_id", "tool", "a.n_obs", *(f"a.{c}" for c in whole))


def stream_daily_metrics(stream: DataFrame, late: str = LATE, every: str = "1 day", slide: str | None = None) -> DataFrame:
    """Observations and about how many clients per project and window: UTC days, or with ``slide`` sliding ones, such as 30 days by 1."""
    rows = with_event_time(stream, late=late)
    return rows.groupBy(F.window("observed_at", every, slide), "project_id").agg(F.count("*").alias("n"), F.approx_count_distinct("observer_principal").alias("principals"))


def stream_consumption(results: DataFrame, requests: DataFrame, within: str = "1 hour", late: str = LATE) -> DataFrame:
    """Results with the requests that name them within a time; the bound lets state go."""
    r = results.select("project_id", "tool_use_id", F.col("ts").cast("timestamp").alias("result_ts")).withWatermark("result_ts", late)
    q = requests.select(F.col("project_id").alias("p"), F.col("consumed_tool_use_id").alias("used"), F.col("line_no").alias("request_line"), F.col("ts").cast("timestamp").alias("request_ts")).withWatermark("request_ts", late)
    same = (F.col("tool_use_id") == F.col("used")) & (F.col("project_id") == F.col("p")) & (F.col("request_ts") >= F.col("result_ts")) & (F.col("request_ts") <= F.col("result_ts") + F.expr(f"interval {within}"))
    return r.join(q, same).select("project_id", "tool_use_id", "request_line")


class Consumption(StatefulProcessor):
    """The pending results of a project, and its events that the watermark has not passed yet.

    Events wait for the watermark and are then taken in order of time and line, so that late ones within it find their place. A result
    is forgotten once it has been pending for ``within``; a timer does it where no events come.
    """

    def __init__(self, within: float):
        self.within = within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, line_no long", "type string, tool_use_id string, tool string, consumed_tool_use_id string, mcp_tool string")
        self.pending = handle.getMapState("pending", "tool_use_id string", "tool string, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for part in rows:
            for at, line, *event in zip(part["at"], part["line_no"], part["type"], part["tool_use_id"], part["tool"], part["consumed_tool_use_id"], part["mcp_tool"], strict=True):
                self.waiting.updateValue((int(at), int(line)), tuple(None if pd.isna(v) or v == "" else v for v in event))
                first = int(at) if first is None else min(first, int(at))
        if first is not None:
            self.handle.registerTimer(first + 1)
        yield pd.DataFrame([], columns=LINKED)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, limit = timerValues.getCurrentWatermarkInMs(), int(self.within * 1000)
        times = list(self.waiting.keys())
        due, later = sorted(t for t in times if t[0] < now), [at + 1 for at, _ in times if at >= now]
        held = {use: tuple(value) for (use,), value in self.pending.iterator()}
        before, out = dict(held), []
        by_tool: dict[str, set[str]] = {}
        for use, (tool, _) in held.items():
            by_tool.setdefault(tool, set()).add(use)

        def forget(use: str) -> str:
            tool = held.pop(use)[0]
            by_tool[tool].discard(use)
            return tool

        for at, line in due:
            kind, use, tool, target, mcp_tool = self.waiting.getValue((at, line))
            self.waiting.removeKey((at, line))
            if kind == "tool_result" and use:
                if use in held:
                    forget(use)
                held[use] = (tool or "unknown", at)
                by_tool.setdefault(tool or "unknown", set()).add(use)
            elif kind == "request":
                if target in held and at - held[target][1] > limit:
                    forget(target)
                if target in held:
                    out.append((key[0], forget(target), line, "exact", target))
                elif mcp_tool:
                    for old in [u for u in by_tool.get(mcp_tool, ()) if at - held[u][1] > limit]:
                        forget(old)
                    found = sorted(by_tool.get(mcp_tool, ()))
                    out.append((key[0], mcp_tool, line, "linked" if len(found) == 1 else "ambiguous" if found else "none", found[0] if len(found) == 1 else None))
                    if len(found) == 1:
                        forget(found[0])
        for use in [u for u, (_, at) in held.items() if at + limit < now]:
            forget(use)
        for use in before.keys() - held.keys():
            self.pending.removeKey((use,))
        for use, value in held.items():
            if before.get(use) != value:
                self.pending.updateValue((use,), value)
            later.append(value[1] + limit + 1)
        if later:
            self.handle.registerTimer(max(min(later), now + 1))
        yield pd.DataFrame(out, columns=LINKED)

    def close(self) -> None:
        pass


LINKED = ["project_id", "tool", "request_line", "kind", "tool_use_id"]


def stream_consumption_ordered(events: DataFrame, within: str = "1 hour", late: str = LATE) -> DataFrame:
    """The rows of consumption.consumption but for repeated links, for requests by id and by tool, over a stream of both kinds of events.

    A result can be taken for the time ``within``; then its state goes. Events later than the watermark are dropped. State is by
    project; needs the RocksDB state store.
    """
    rows = with_event_time(events, "ts", late).where("project_id IS NOT NULL AND line_no IS NOT NULL AND ts IS NOT NULL")
    rows = rows.select("project_id", "ts", F.unix_millis("ts").alias("at"), "line_no", "type", "tool_use_id", "tool", "consumed_tool_use_id", "mcp_tool")
    seconds = pd.Timedelta(within).total_seconds()
    schema = "project_id string, tool string, request_line long, kind string, tool_use_id string"
    return rows.groupBy("project_id").transformWithStateInPandas(Consumption(seconds), schema, "append", "eventTime")


class GapFinder(StatefulProcessor):
    """The highest sequence number of a source and epoch; a jump over it is a gap."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.highest = handle.getValueState("highest", "seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        numbers = sorted(n for part in rows for n in part["source_sequence"])
        last = self.highest.get()[0] if self.highest.exists() else None
        gaps = []
        for n in numbers:
            if last is not None and n - last > 1:
                gaps.append((*key, last + 1, n - 1))
            last = n if last is None else max(last, n)
        if last is not None:
            self.highest.update((int(last),))
        yield pd.DataFrame(gaps, columns=["source_instance_id", "sequence_epoch", "first_missing", "last_missing"])

    def close(self) -> None:
        pass


def stream_gaps(stream: DataFrame) -> DataFrame:
    """Missing ranges per source and epoch, as they show; needs the RocksDB state store."""
    schema = "source_instance_id string, sequence_epoch string, first_missing long, last_missing long"
    return stream.groupBy("source_instance_id", "sequence_epoch").transformWithStateInPandas(GapFinder(), schema, "append", "none")


def run_once(out: DataFrame, spark: SparkSession, path: str, checkpoint: str) -> DataFrame:
    """Drain a stream into Parquet, and the result."""
    query = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


def run_latest(out: DataFrame, keys: list[str], spark: SparkSession, path: str, checkpoint: str) -> DataFrame:
    """Drain an aggregation into Parquet by batch, and the last row of each key: windows still open are in the result."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    spark.createDataFrame([], out.schema).write.mode("overwrite").parquet(f"{path}/batch=-1")
    out.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(StructType([*out.schema.fields, StructField("batch", LongType())])).option("basePath", path).parquet(f"{path}/batch=*")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*out.columns), "batch").alias("row")).select("row.*")
