"""Secrets in texts: key patterns, and a battery of randomness tests over other long tokens, with built-in functions only.

A token's encoding is inferred from its characters. Under the hypothesis that the token is random in that encoding, four
tests give p-values: chi-squared uniformity over character classes and over the alphabet, runs around the middle of the
alphabet, and serial correlation. Their Bonferroni minimum goes through a Benjamini-Hochberg step in each stratum of
encoding and length, so that the share of true random tokens among those ruled out is bounded at every length; tokens
too short for the battery to tell are no candidates. What is not ruled out is reported as ``random``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import staged

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Longer runs only: equal to dropping the shorter matches, as those runs are maximal.
LONG_HEX, LONG_ACCESS = r"[0-9a-f]{16,}", r"AKIA[A-Z0-9]{14,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: name: what all characters are, the alphabet in order, where its classes end in it, the least length.
ENCODINGS = {
    "hex": (r"^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef", (10, 16), 24),
    "base32": (r"^[A-Z2-7]+$", UPPER + "234567", (26, 32), 24),
    "base64": (r"^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/", (26, 52, 62, 64), 20),
    "base64url": (r"^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_", (26, 52, 62, 64), 20),
}
#: Bins of -ln p to a unit; the largest bin. A stratum's p-values are counted by bin.
BINS, LAST = 20, 2000


def placed(text: str, pattern: str, least: int, group: int = 0) -> Column:
    """array<struct<start,end>> of the leftmost matches, in code points, whose group has ``least`` characters or more."""
    t = F.col(text)
    found, value = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.regexp_extract_all(t, F.lit(pattern), F.lit(group))
    between = F.slice(F.split(t, pattern, -1), F.lit(1), F.size(found))
    rows = F.arrays_zip(found.alias("m"), value.alias("v"), between.alias("b"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,n:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), end.alias("end"), F.length(x["v"]).alias("n"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

    spans = F.filter(F.aggregate(rows, zero, step)["out"], lambda s: s["n"] >= least)
    spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return F.coalesce(F.when(t.rlike(pattern), spans), F.array().cast("array<struct<start:int,end:int>>"))


def upper_tail(z: Column) -> Column:
    """P(N(0,1) > z), within a few percent (Lin 1989)."""
    a = F.abs(z)
    tail = 0.5 * F.exp(-0.717 * a - 0.416 * a * a)
    return F.when(z > 0, tail).otherwise(1 - tail)


def two_sided(z: Column) -> Column:
    return 2 * upper_tail(F.abs(z))


def chi_tail(x: Column, degrees: Column) -> Column:
    """The upper tail of chi-squared, by Wilson and Hilferty's cube root."""
    v = 2 / (9 * degrees)
    return upper_tail((F.pow(x / degrees, F.lit(1 / 3)) - (1 - v)) / F.sqrt(v))


def pairs(values: str) -> Column:
    """Neighbours x and y of an array."""
    v = F.col(values)
    return F.arrays_zip(F.slice(v, F.lit(1), F.size(v) - 1).alias("x"), F.slice(v, F.lit(2), F.size(v) - 1).alias("y"))


def tested(tokens: DataFrame) -> DataFrame:
    """Add stratum and bin to rows with a ``token``; rows of no encoding, or too short for it, go.

    bin is -ln p in steps of 1 / BINS, p four times the least of the four p-values, 1 at most.
    """
    kind, alphabet, cuts = F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(None).cast("array<int>")
    out = tokens.withColumn("s", F.rtrim("token", F.lit("=")))
    for k, (every, letters, ends, least) in reversed(list(enumerate(ENCODINGS.values()))):
        fits = F.col("s").rlike(every) & (F.length("s") >= least)
        kind, alphabet = F.when(fits, k).otherwise(kind), F.when(fits, letters).otherwise(alphabet)
        cuts = F.when(fits, F.array(*map(F.lit, (0, *ends)))).otherwise(cuts)
    out = out.withColumn("kind", kind).withColumn("alphabet", alphabet).withColumn("cuts", cuts).where("kind IS NOT NULL")
    n, size = F.col("n"), F.col("size")
    out = out.withColumn("s", F.when(F.col("kind") == 0, F.lower("s")).otherwise(F.col("s")))
    out = out.withColumn("n", F.length("s").cast("double")).withColumn("size", F.length("alphabet").cast("double"))
    out = out.withColumn("v", F.transform(F.split("s", ""), lambda c: F.instr(F.col("alphabet"), c).cast("double")))
    squares = F.aggregate(F.transform(F.split("alphabet", ""), lambda c: n - F.length(F.replace(F.col("s"), c, F.lit("")))), F.lit(0.0), lambda a, x: a + x * x)
    out = out.withColumn("fine", size / n * squares - n)

    def share(i: Column) -> Column:
        low, high = F.get("cuts", i - 1), F.get("cuts", i)
        expected = n * (high - low) / size
        off = F.size(F.filter("v", lambda v: (v > low) & (v <= high))) - expected
        return off * off / expected

    out = out.withColumn("coarse", F.aggregate(F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), share), F.lit(0.0), lambda a, x: a + x))
    out = out.withColumn("high", F.transform("v", lambda v: v > size / 2))
    out = out.withColumn("up", F.size(F.filter("high", lambda h: h)).cast("double"))
    out = out.withColumn("runs", 1.0 + F.size(F.filter(pairs("high"), lambda p: p["x"] != p["y"])))
    out = out.withColumn("mean", 2 * F.col("up") * (n - F.col("up")) / n + 1)
    spread = F.sqrt(F.greatest((F.col("mean") - 1) * (F.col("mean") - 2) / (n - 1), F.lit(1e-9)))
    out = out.withColumn("middle", F.aggregate("v", F.lit(0.0), lambda a, v: a + v) / n)
    out = out.withColumn("square", F.aggregate("v", F.lit(0.0), lambda a, v: a + (v - F.col("middle")) * (v - F.col("middle"))))
    out = out.withColumn("lag", F.aggregate(pairs("v"), F.lit(0.0), lambda a, p: a + (p["x"] - F.col("middle")) * (p["y"] - F.col("middle"))))
    serial = (F.col("lag") / F.greatest("square", F.lit(1e-9)) + 1 / n) * F.sqrt(n)
    p = F.least(chi_tail(F.col("fine"), size - 1), chi_tail(F.col("coarse"), F.size("cuts") - 2.0), two_sided((F.col("runs") - F.col("mean")) / spread), two_sided(serial))
    out = out.withColumn("p", F.least(F.lit(1.0), 4 * p))
    binned = F.least(F.floor(-F.log(F.greatest("p", F.lit(1e-300))) * BINS), F.lit(LAST)).cast("int")
    stratum = F.col("kind") * 64 + F.floor(F.log2("n")).cast("int")
    return out.select(*tokens.columns, stratum.alias("stratum"), binned.alias("bin"))


def candidates(text: str, base: list[str]) -> Column:
    """array<struct<start,end,token>> of the long tokens that no base span touches."""
    free = F.filter(placed(text, TOKEN, 20), lambda s: ~F.exists(F.concat(*base), lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])))
    return F.transform(free, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(F.col(text), s["start"] + 1, s["end"] - s["start"]).alias("token")))


def ruled_out(candidates: DataFrame, rate: float) -> dict[int, int]:
    """By stratum, the first bin that Benjamini and Hochberg's step rejects. At most 256 strata come to the driver."""
    counts = candidates.groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    total = counts.groupBy("stratum").agg(F.sum("n").alias("m"))
    steps = counts.alias("a").join(counts.alias("b"), F.expr("a.stratum = b.stratum AND b.bin >= a.bin")).groupBy("a.stratum", "a.bin").agg(F.sum("b.n").alias("k"))
    passed = steps.join(total, "stratum").where(F.exp(-F.col("bin") / BINS) <= rate * F.col("k") / F.col("m"))
    return {r["stratum"]: r["first"] for r in passed.groupBy("stratum").agg(F.min("bin").alias("first")).collect()}


def scanned(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """doc_id, and the spans of each kind as arrays of (start, end) in code points, one row for each row of ``docs``.

    A null text counts as empty and has no spans; null doc_ids and repeated rows pass through one by one. An empty table gives
    an empty result. Texts are read once, whole; nothing is shuffled but counts of p-value bins.
    """
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    found = t.withColumn("assign", placed("t", ASSIGN, 12, 2)).withColumn("access", placed("t", LONG_ACCESS, 18)).withColumn("hex", placed("t", LONG_HEX, 16))
    found = found.withColumn("c", candidates("t", ["assign", "access", "hex"]))
    found = staged(found.drop("t").withColumn("row", F.monotonically_increasing_id()), "spans")
    rows = staged(tested(found.select("row", F.explode("c").alias("c")).select("row", "c.*")).drop("token"), "tested")
    limits = ruled_out(rows, rate)
    first = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair)) if limits else F.create_map().cast("map<int,int>")
    kept = rows.where(F.col("bin") < F.coalesce(first[F.col("stratum")], F.lit(LAST + 1)))
    kept = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("random"))
    out = found.drop("c").join(kept, "row", "left").drop("row")
    return out.withColumn("random", F.coalesce("random", F.array().cast("array<struct<start:int,end:int>>")))


def joined(*kinds: str) -> Column:
    """kind:start:end of all spans, by start and then by kind, comma-joined."""
    def tagged(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))

    each = [tagged(k) for k in kinds]
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base kind, their digest and all spans; odd rows as in ``scanned``, other columns play no part."""
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return scanned(docs).select("doc_id", *counts, F.sha2(joined(*KINDS[:3]), 256).alias("base_sha256"), joined(*KINDS).alias("spans"))
