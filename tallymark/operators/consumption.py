"""Which results were used later.

One ordered pass over results and requests, as joins and bounded segments. A result is pending until a request names its id, or a
request that names only its tool finds it alone. Such a request leaves nothing pending of its tool, so all that the tool's past
means to a later one is the line of the last that took something, the reset: what is pending are the results after it that no id
has claimed. A request for a tool therefore takes the latest unclaimed result if the reset lies between the two latest ones.

A segment of lines turns the reset before it into the reset after it, a step function of few steps. Segments are reduced to these
functions in parallel, the functions are applied in order, one number a tool, and the segments are replayed in parallel.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.operators import correlate
from tallymark.sources.files import checkpointed

#: Runtime of a principal's prefix, and what each runtime can observe; fixed by the adapters' manifests.
RUNTIMES = {"claude-otel": "claude-code", "codex-hook": "codex", "dsh": "deepseek-harness", "mcp-wrapper": "mcp"}
CONSUMED = {"claude-code": "OBSERVABLE", "codex": "UNOBSERVABLE", "deepseek-harness": "UNKNOWN"}

#: Lines of a segment.
SEGMENT = 1 << 16
#: Before all lines.
NEVER = -1
#: Segments are numbered below 2^LEVELS.
LEVELS = 48


def some(name: str) -> Column:
    """A text that is there and not empty."""
    return F.when(F.col(name) != "", F.col(name))


def claims(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ids say, whatever requests without an id take.

    Results (project_id, tool_use_id, line_no, tool, ends): each with the line of the next request for its id or result of the same
    id, null if there is none. Requests with an id (project_id, line_no, tool_use_id, mcp_tool, result_line, tool): with the result that
    is before them and that no other request names, if there is one.
    """
    used = F.when(F.col("type") == "tool_result", some("tool_use_id")).when(F.col("type") == "request", some("consumed_tool_use_id"))
    named = rows.select("project_id", "line_no", "type", used.alias("tool_use_id"), F.coalesce(some("tool"), F.lit("unknown")).alias("tool"), some("mcp_tool").alias("mcp_tool")).where("tool_use_id IS NOT NULL")
    by_id = Window.partitionBy("project_id", "tool_use_id").orderBy("line_no")
    named = named.withColumn("ends", F.lead("line_no").over(by_id)).withColumn("before", F.lag(F.struct("type", "line_no", "tool")).over(by_id))
    results = named.where("type = 'tool_result'").select("project_id", "tool_use_id", "line_no", "tool", "ends")
    hit = F.col("before.type") == "tool_result"
    requests = named.where("type = 'request'").select("project_id", "line_no", "tool_use_id", "mcp_tool", F.when(hit, F.col("before.line_no")).alias("result_line"), F.when(hit, F.col("before.tool")).alias("tool"))
    return results, requests


def runs_of(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The rows of each key, one after the other, from batches sorted by key; a key's rows may run over several batches."""
    held: list[pd.DataFrame] = []
    key = None
    for batch in batches:
        for own, rows in batch.groupby(keys, sort=False, dropna=False):
            if own != key and held:
                yield key, pd.concat(held)
                held = []
            key = own
            held.append(rows)
    if held:
        yield key, pd.concat(held)


class Unclaimed:
    """The unclaimed results of a tool, of which the two latest are wanted."""

    def __init__(self, lines: list[int]):
        self.lines, self.gone = sorted(lines), set()

    def latest(self) -> int | None:
        while self.lines and self.lines[-1] in self.gone:
            self.gone.discard(self.lines.pop())
        return self.lines[-1] if self.lines else None

    def two(self) -> tuple[int, int]:
        """Lines of the second latest and the latest, NEVER where there is none."""
        first = self.latest()
        if first is None:
            return NEVER, NEVER
        self.lines.pop()
        second = self.latest()
        self.lines.append(first)
        return NEVER if second is None else second, first


def placed(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """For each request for a tool, the lines between which the reset must lie for it to take the latest unclaimed result.

    Rows come by segment: results and the ends of results by their line, after the two results before the segment that outlive it.
    """
    for (project, tool, segment), rows in runs_of(batches, ["project_id", "tool", "segment"]):
        steps_of = list(zip(rows["kind"].tolist(), rows["line_no"].tolist(), rows["result_line"].tolist(), strict=True))
        held = Unclaimed([began for kind, _, began in steps_of if kind == OUTLIVES or (kind == ENDS and began < segment * size)])
        out = []
        for kind, line, began in steps_of:
            if kind == RESULT:
                held.lines.append(line)
            elif kind == ENDS:
                held.gone.add(began)
            elif kind == ASKS:
                out.append((project, tool, segment, line, *held.two()))
        yield pd.DataFrame(out, columns=["project_id", "tool", "segment", "line_no", "low", "high"])


def steps(first: int, asks: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(low, high, after): the reset after a segment that begins at line ``first``, for resets before it from low up to high.

    ``asks`` has (line, low, high) in order. Resets that the segment leaves as they are have no step.
    """
    early = sorted({NEVER, *(x for _, low, high in asks for x in (low, high) if x < first)})
    lines = [line for line, _, _ in asks]
    points = early + lines
    #: The first request that each point as a reset lets take something; a forest of points leads past those that have theirs.
    taken_by: list[int | None] = [None] * len(points)
    forest = list(range(len(points) + 1))

    def from_here(i: int) -> int:
        while forest[i] != i:
            forest[i] = forest[forest[i]]
            i = forest[i]
        return i

    for line, low, high in asks:
        i = from_here(bisect_left(points, low))
        while i < len(points) and points[i] < high:
            taken_by[i], forest[i] = line, i + 1
            i = from_here(i)
    after: dict[int, int] = {}
    for k in range(len(lines) - 1, -1, -1):
        then = taken_by[len(early) + k]
        after[lines[k]] = lines[k] if then is None else after[then]
    out: list[tuple[int, int, int]] = []
    for i, low in enumerate(early):
        if (line := taken_by[i]) is not None:
            until = early[i + 1] if i + 1 < len(early) else first
            if out and out[-1][1:] == (low, after[line]):
                out[-1] = (out[-1][0], until, after[line])
            else:
                out.append((low, until, after[line]))
    return out


def reduced(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """The steps of each segment."""
    for (project, tool, segment), rows in runs_of(batches, ["project_id", "tool", "segment"]):
        found = steps(segment * size, list(zip(rows["line_no"].tolist(), rows["low"].tolist(), rows["high"].tolist(), strict=True)))
        yield pd.DataFrame([(project, tool, segment, *s) for s in found], columns=["project_id", "tool", "segment", "low", "high", "after"])


def composed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The reset before each segment that has steps, and after it; one number is carried from row to row."""
    tool, segment, reset, then = None, None, NEVER, NEVER
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if (row.project_id, row.tool) != tool:
                tool, segment, reset, then = (row.project_id, row.tool), None, NEVER, NEVER
            if row.segment != segment:
                segment, reset = row.segment, then
            if row.low <= reset < row.high:
                then = row.after
                out.append((*tool, segment, reset, then))
        yield pd.DataFrame(out, columns=["project_id", "tool", "segment", "reset", "after"])


def replayed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each request for a tool finds: linked with a result, ambiguous, or none."""
    segment, reset = None, NEVER
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if (row.project_id, row.tool, row.segment) != segment:
                segment, reset = (row.project_id, row.tool, row.segment), row.reset
            if row.low <= reset < row.high:
                out.append((row.project_id, row.tool, row.line_no, "linked", row.high))
                reset = row.line_no
            else:
                out.append((row.project_id, row.tool, row.line_no, "none" if reset >= row.high else "ambiguous", NEVER))
        yield pd.DataFrame(out, columns=["project_id", "tool", "request_line", "kind", "result_line"])


#: Rows of a segment, in the order that they have within a line.
OUTLIVES, ENDS, RESULT, ASKS = range(4)
TOOL = ["project_id", "tool"]
#: The aligned ranges of 2^v segments that together are those from a up to b.
RANGES = f"""explode(filter(flatten(transform(sequence(0, {LEVELS}), v -> array(
  named_struct('level', v, 'node', shiftright(a + shiftleft(1L, v) - 1, v), 'ok', shiftright(a + shiftleft(1L, v) - 1, v) % 2 = 1 AND shiftright(a + shiftleft(1L, v) - 1, v) < shiftright(b, v)),
  named_struct('level', v, 'node', shiftright(b, v) - 1, 'ok', shiftright(b, v) % 2 = 1 AND shiftright(a + shiftleft(1L, v) - 1, v) < shiftright(b, v))))), x -> x.ok))"""


def outliving(results: DataFrame, asking: DataFrame, segment: Column, last: Column) -> DataFrame:
    """(project_id, tool, segment, line_no): for each segment of ``asking`` the two latest results before it that outlive it.

    A result outlives the segments between those of its line and its end. They are covered by few aligned ranges of segments;
    each range keeps its two latest results, and a segment looks into the ranges that hold it. So a result that nothing
    ever claims is written a few dozen times, not once for each later segment.
    """
    born = results.select(*TOOL, "line_no", (segment + 1).alias("a"), F.coalesce(last, F.lit(1 << LEVELS)).alias("b")).where("a < b")
    latest = lambda rows, *keys: rows.withColumn("nth", F.row_number().over(Window.partitionBy(*TOOL, *keys).orderBy(F.desc("line_no")))).where("nth <= 2").drop("nth")
    ranges = latest(latest(born, "a", "b").select(*TOOL, "line_no", F.expr(RANGES).alias("r")).select(*TOOL, "line_no", "r.level", "r.node"), "level", "node")
    over = asking.select(*TOOL, "segment", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level"))
    over = over.withColumn("node", F.expr("shiftright(segment, level)"))
    return latest(over.join(ranges, [*TOOL, "level", "node"]).select(*TOOL, "segment", "line_no"), "segment")


def asked(results: DataFrame, asks: DataFrame, size: int) -> DataFrame:
    """(project_id, tool, request_line, kind, result_line) of the requests for a tool ``asks`` (project_id, tool, line_no)."""
    segment = lambda c: F.expr(f"{c} div {size}")
    asks = asks.withColumn("segment", segment("line_no"))
    asking = asks.select(*TOOL, "segment").distinct()
    row = lambda rows, kind, line, began: rows.select(*TOOL, "segment", F.lit(kind).alias("kind"), line.cast("long").alias("line_no"), began.cast("long").alias("result_line"))
    none, line = F.lit(NEVER), F.col("line_no")
    parts = row(results.withColumn("segment", segment("line_no")), RESULT, line, none).unionByName(row(results.where("ends IS NOT NULL").withColumn("segment", segment("ends")), ENDS, F.col("ends"), line))
    parts = parts.join(asking, [*TOOL, "segment"], "left_semi").unionByName(row(asks, ASKS, line, none))
    parts = parts.unionByName(row(outliving(results, asking, segment("line_no"), segment("ends")), OUTLIVES, none, line))
    by_segment = parts.repartition(*TOOL, "segment").sortWithinPartitions(*TOOL, "segment", "line_no", "kind")
    bounds = by_segment.mapInPandas(lambda batches: placed(batches, size), "project_id string, tool string, segment long, line_no long, low long, high long")
    bounds = checkpointed(bounds)

    in_order = bounds.repartition(*TOOL, "segment").sortWithinPartitions(*TOOL, "segment", "line_no")
    functions = in_order.mapInPandas(lambda batches: reduced(batches, size), "project_id string, tool string, segment long, low long, high long, after long")
    resets = functions.repartition(*TOOL).sortWithinPartitions(*TOOL, "segment", "low").mapInPandas(composed, "project_id string, tool string, segment long, reset long, after long")
    # A segment begins with the reset that the last change before it left.
    changes = resets.select(*TOOL, (F.col("segment") + 1).alias("segment"), F.col("after").alias("reset"), F.lit(0).alias("rank"))
    every = changes.unionByName(asking.select(*TOOL, "segment", F.lit(None).cast("long").alias("reset"), F.lit(1).alias("rank")))
    sofar = Window.partitionBy(*TOOL).orderBy("segment", "rank").rowsBetween(Window.unboundedPreceding, 0)
    begins = every.withColumn("reset", F.coalesce(F.last("reset", ignorenulls=True).over(sofar), F.lit(NEVER))).where("rank = 1").drop("rank")
    met = bounds.join(begins, [*TOOL, "segment"]).repartition(*TOOL, "segment").sortWithinPartitions(*TOOL, "segment", "line_no")
    return met.mapInPandas(replayed, "project_id string, tool string, request_line long, kind string, result_line long")


def consumption(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(project_id, tool, request_line, kind, tool_use_id) of every request that names a result or a tool, in one ordered pass.

    ``rows``: project_id, line_no (the order, a different one for each row of a project), type (tool_result or request), tool_use_id,
    tool, consumed_tool_use_id, mcp_tool. A request that names a pending result takes it: ``exact``. One that doesn't, or whose
    result is not pending, takes the only pending result of its mcp_tool: ``linked``; with several it is ``ambiguous``, with none
    ``none``. An id links once; a result that comes again under a linked id and is taken again is ``repeated``. Requests that name
    a result that is not pending, and no tool, have no row. A result that comes again while it is pending replaces itself. Rows
    without a project or a line take no part.

    Whether a named result is pending can depend on what its tool's requests took, and then the request goes to its own tool. So
    tools are solved apart, and again with the requests that this moves, until nothing moves; each round is right for longer than the last.
    """
    rows = rows.where("project_id IS NOT NULL AND line_no IS NOT NULL")
    results, requests = claims(rows)
    plain = rows.where("type = 'request'").where(some("consumed_tool_use_id").isNull() & some("mcp_tool").isNotNull())
    asks = plain.select("project_id", F.col("mcp_tool").alias("tool"), "line_no").unionByName(requests.where("result_line IS NULL AND mcp_tool IS NOT NULL").select("project_id", F.col("mcp_tool").alias("tool"), "line_no"))
    movable = requests.where("result_line IS NOT NULL AND mcp_tool IS NOT NULL").select("project_id", "line_no", "result_line", "mcp_tool")
    results = results.select("project_id", "tool_use_id", "line_no", "tool", "ends")
    found, taken = asked(results, asks, size), None
    if not movable.isEmpty():
        moved = None
        while True:
            found = checkpointed(found)
            taken = found.where("kind = 'linked'").select("project_id", "result_line", "request_line")
            now = movable.join(taken, ["project_id", "result_line"]).where("request_line < line_no").select("project_id", F.col("mcp_tool").alias("tool"), "line_no")
            now = checkpointed(now)
            if (now if moved is None else now.exceptAll(moved).unionByName(moved.exceptAll(now))).isEmpty():
                break
            moved = now
            found = asked(results, asks.unionByName(moved), size)
    taken = found.where("kind = 'linked'").select("project_id", "result_line")
    ids = results.select("project_id", F.col("line_no").alias("result_line"), "tool_use_id")
    exact = requests.where("result_line IS NOT NULL").join(taken, ["project_id", "result_line"], "left_anti")
    exact = exact.select("project_id", "tool", F.col("line_no").alias("request_line"), F.lit("exact").alias("kind"), "tool_use_id")
    other = found.join(ids, ["project_id", "result_line"], "left").select(*TOOL, "request_line", "kind", "tool_use_id")
    both = exact.unionByName(other)
    first = F.min(F.when(F.col("kind").isin("exact", "linked"), F.col("request_line"))).over(Window.partitionBy("project_id", "tool_use_id"))
    linked = both.where("tool_use_id IS NOT NULL").withColumn("first", first)
    linked = linked.withColumn("kind", F.when(F.col("request_line") > F.col("first"), "repeated").otherwise(F.col("kind"))).drop("first")
    return linked.unionByName(both.where("tool_use_id IS NULL"))


def consumption_exact(rows: DataFrame) -> DataFrame:
    """(project_id, tool_use_id, request_line, tool) of the results that a request took by their id, once per id; see ``consumption``."""
    return consumption(rows).where("kind = 'exact'").select("project_id", "tool_use_id", "request_line", "tool")


def consumption_inferred(rows: DataFrame) -> DataFrame:
    """(project_id, tool, request_line, kind, tool_use_id) of the requests that went to a tool; see ``consumption``."""
    return consumption(rows).where("kind IN ('linked', 'ambiguous', 'none')")


def runtime_of(principal: str | Column) -> Column:
    p = F.col(principal) if isinstance(principal, str) else principal
    out = F.lit(None).cast("string")
    for prefix, runtime in RUNTIMES.items():
        out = F.when(p.startswith(prefix), runtime).otherwise(out)
    return out


def observable(principal: str | Column) -> Column:
    """OBSERVABLE, UNOBSERVABLE or UNKNOWN; a runtime without a manifest is UNKNOWN, never observable."""
    out = F.lit("UNKNOWN")
    for runtime, state in CONSUMED.items():
        out = F.when(runtime_of(principal) == runtime, state).otherwise(out)
    return out


def observable_runtimes(obs: DataFrame) -> DataFrame:
    rows = obs.select(runtime_of("observer_principal").alias("runtime"), observable("observer_principal").alias("consumed"))
    return rows.groupBy("runtime", "consumed").agg(F.count("*").alias("observations"))


def consumption_observed(obs: DataFrame, used: DataFrame) -> DataFrame:
    """Call ids of client observations whose result a later observation reports as consumed."""
    return obs.where("observer_side = 'client' AND tool_call_id IS NOT NULL").select("project_id", "tool_call_id").distinct().join(used, "tool_call_id", "left_semi")


def consumed_rate(obs: DataFrame, used: DataFrame, start: str | None = None, strict: bool = False) -> DataFrame:
    """Consumed of observable eligible attempts per project: (project_id, consumed, observable, unobservable, rate).

    An attempt with a client observation is observable if any of its client observers can see consumption; those that none can see are
    counted apart, never as unused. It is consumed if its project and call are in ``used`` (project_id, tool_call_id), and for that it
    needs a call id; without one it still counts in the denominator. ``start`` bounds when attempts began, ``strict`` takes only
    production attempts of normal validity. Both sides of the ratio count attempts, each once.
    """
    client = F.col("observer_side") == "client"
    rows = correlate.attempts(obs, seen=F.coalesce(F.bool_or(client & (observable("observer_principal") == "OBSERVABLE")), F.lit(False)), tool_call_id=F.min(some("tool_call_id")))
    seen = rows.where("has_client AND project_id IS NOT NULL")
    if strict:
        seen = seen.where("usage_context = 'production' AND validity = 'normal'")
    if start is not None:
        seen = seen.where(F.col("started_at").cast("timestamp") >= F.lit(start).cast("timestamp"))
    seen = seen.select("project_id", "tool_call_id", "seen")
    hits = used.select("project_id", "tool_call_id").distinct().withColumn("used", F.lit(True))
    met = seen.join(hits, ["project_id", "tool_call_id"], "left")
    out = met.groupBy("project_id").agg(F.count_if(F.col("seen") & F.coalesce("used", F.lit(False))).alias("consumed"), F.count_if("seen").alias("observable"), F.count_if(~F.col("seen")).alias("unobservable"))
    return out.withColumn("rate", F.when(F.col("observable") > 0, F.col("consumed") / F.col("observable")))


def observability_states(obs: DataFrame, used: DataFrame) -> DataFrame:
    """TRUE, FALSE, UNKNOWN or UNOBSERVABLE for each client observation with a call id."""
    rows = obs.where("observer_side = 'client' AND tool_call_id IS NOT NULL").select("project_id", "tool_call_id", observable("observer_principal").alias("o"))
    rows = rows.join(used.select("tool_call_id").distinct().withColumn("used", F.lit(True)), "tool_call_id", "left")
    state = F.when(F.coalesce("used", F.lit(False)) & (F.col("o") == "OBSERVABLE"), "TRUE").when(F.col("o") == "OBSERVABLE", "FALSE").otherwise(F.col("o"))
    return rows.groupBy("project_id", state.alias("state")).agg(F.count("*").alias("n"))
