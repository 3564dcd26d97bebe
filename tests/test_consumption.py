"""Results and requests against a plain walk, event by event, in batch and stream."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallymark.operators import consumption
from tallymark.streaming import jobs

EVENTS = "project_id string, line_no long, type string, tool_use_id string, tool string, consumed_tool_use_id string, mcp_tool string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def walk(events, within=None):
    """(project_id, tool, request_line, kind, tool_use_id) of each request, in order of lines; ``within`` in lines."""
    pending, done, out = {}, set(), []
    for project, line, kind, use, tool, target, mcp_tool in sorted(events, key=lambda e: e[1]):
        held = pending.setdefault(project, {})
        if within is not None:
            for old in [u for u, (_, at) in held.items() if line - at > within]:
                del held[old]
        if kind == "tool_result":
            if use:
                held.pop(use, None)
                held[use] = (tool or "unknown", line)
        elif kind == "request":
            found = [target] if target and target in held else []
            how = "exact" if found else None
            if not found and mcp_tool:
                found = [u for u, (t, _) in held.items() if t == mcp_tool]
                how = "linked" if len(found) == 1 else "ambiguous" if found else "none"
            if how in ("exact", "linked"):
                own = held.pop(found[0])[0]
                out.append((project, own, line, "repeated" if (project, found[0]) in done else how, found[0]))
                done.add((project, found[0]))
            elif how:
                out.append((project, mcp_tool, line, how, None))
    return sorted(out, key=str)


def random_events(seed, n=400, ids=60, tools=3):
    """Requests by id, by tool, by both; ids that come again, under another tool too."""
    rng = random.Random(seed)
    out = []
    for line in range(n):
        tool, use = f"t{rng.randrange(tools)}", f"u{rng.randrange(ids)}"
        project = rng.choice(["p", "p", "q"])
        match rng.randrange(6):
            case 0 | 1:
                out.append((project, line, "tool_result", rng.choice([use, use, use, "", None]), rng.choice([tool, tool, None]), None, None))
            case 2:
                out.append((project, line, "request", None, None, use, None))
            case 3:
                out.append((project, line, "request", None, None, use, tool))
            case 4:
                out.append((project, line, "request", None, None, None, tool))
            case 5:
                out.append((project, line, "other", use, tool, use, tool))
    return out


def got(df):
    return sorted((tuple(r) for r in df.select("project_id", "tool", "request_line", "kind", "tool_use_id").collect()), key=str)


@pytest.mark.parametrize(("seed", "ids", "tools", "size"), [(1, 60, 3, 16), (2, 300, 2, 8), (3, 12, 3, 64), (4, 2000, 1, 5), (5, 40, 5, 1 << 16)])
def test_equals_a_walk(spark, seed, ids, tools, size):
    events = random_events(seed, ids=ids, tools=tools)
    assert got(consumption.consumption(spark.createDataFrame(events, EVENTS), size)) == walk(events)


def test_a_result_taken_by_a_tool_is_not_taken_again(spark):
    events = [("p", 1, "tool_result", "a", "t", None, None), ("p", 2, "request", None, None, None, "t"), ("p", 3, "request", None, None, "a", None)]
    rows = spark.createDataFrame(events, EVENTS)
    assert got(consumption.consumption(rows)) == [("p", "t", 2, "linked", "a")]
    assert consumption.consumption_exact(rows).collect() == []


def test_a_request_whose_id_is_not_pending_goes_to_its_tool(spark):
    events = [("p", 1, "tool_result", "a", "t", None, None), ("p", 2, "request", None, None, "zzz", "t")]
    assert got(consumption.consumption(spark.createDataFrame(events, EVENTS))) == [("p", "t", 2, "linked", "a")]


def test_what_moves_can_move_more(spark):
    """A takes by tool what the second names, which takes what the third names, and so on through tools."""
    events = []
    for k in range(6):
        events += [("p", 10 * k, "tool_result", f"u{k}", f"t{k}", None, None)]
    events.append(("p", 100, "request", None, None, None, "t0"))
    events += [("p", 101 + k, "request", None, None, f"u{k}", f"t{k + 1}") for k in range(5)]
    assert got(consumption.consumption(spark.createDataFrame(events, EVENTS), 4)) == walk(events)


def test_no_events_and_no_project(spark):
    assert got(consumption.consumption(spark.createDataFrame([], EVENTS))) == []
    events = [(None, 1, "tool_result", "a", "t", None, None), (None, 2, "request", None, None, None, "t"), ("p", None, "request", None, None, None, "t")]
    assert got(consumption.consumption(spark.createDataFrame(events, EVENTS))) == []


def test_stream_takes_late_results_in_order(spark, tmp_path):
    """Three batches, of which the second brings results of the first one's time, equal the walk; then state is gone."""
    events = [e for e in random_events(7, n=240, ids=80) if e[2] != "other"]
    second = lambda line: F.timestamp_seconds(F.lit(1_700_000_000) + line)
    rows = spark.createDataFrame(events, EVENTS).withColumn("ts", second(F.col("line_no")))
    late = F.col("line_no") % 7 == 3
    first = rows.where((F.col("line_no") < 120) & ~late)
    then = rows.where((F.col("line_no") >= 120) | late)
    flush = spark.createDataFrame([(p, 100_000 + k, "request", None, None, "x", None) for k, p in enumerate("pq")], EVENTS).withColumn("ts", second(F.col("line_no")))
    after = spark.createDataFrame([(p, 200_000 + k, "request", None, None, "x", None) for k, p in enumerate("pq")], EVENTS).withColumn("ts", second(F.col("line_no")))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for part in (first, then, flush, after):
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
            out = jobs.stream_consumption_ordered(stream, "40 seconds", "200 seconds")
            query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
            progress = query.recentProgress
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want = sorted(((p, t, line, kind, use) for p, t, line, kind, use in walk(events, within=40)), key=str)
    found = got(spark.read.schema(out.schema).parquet(f"{tmp_path}/out"))
    assert [(*x[:3], x[4]) for x in found] == [(*x[:3], x[4]) for x in want]
    assert all(x[3] == y[3] or y[3] == "repeated" for x, y in zip(found, want, strict=True))
    rows_in_state = [s.get("numRowsTotal") for p in progress for s in p["stateOperators"]]
    assert rows_in_state and rows_in_state[-1] < 40
