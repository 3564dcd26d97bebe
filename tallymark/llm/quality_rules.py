"""Quality rules as a short-circuit cascade, ordered by rejection per cost as a sample shows them.

Everything is built-in column functions. The verdict of a cascade does not depend on the order of its rules; the order only
decides how much is computed.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import BLANK, staged

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``rejects`` may use the measured columns and the text column ``t``."""

    name: str
    rejects: Column = field(compare=False)


def rules() -> list[Rule]:
    """The production rules. Counts are compared as integers, so that every engine agrees on ties."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return [
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("word_length", (chars < 3 * n) | (chars > 12 * n)),
        Rule("dup_lines", 10 * F.col("n_dup_lines") > 4 * F.col("n_lines")),
        Rule("capitals", 10 * F.regexp_count("t", F.lit(r"\p{Lu}")) > 3 * chars),
        Rule("alphabetic", 10 * F.regexp_count("t", F.lit(r"\p{L}[^\x20\x09-\x0D]*")) < 8 * n),
        Rule("ellipsis", 10 * F.regexp_count("t", F.lit(r"(\.\.\.|…)[\x20\x09\x0B-\x0D]*(\n|\z)")) > 3 * F.col("n_lines")),
        Rule("bullets", 10 * F.regexp_count("t", F.lit(r"(\A|\n)[\x20\x09\x0B-\x0D]*[-•*] ")) > 9 * F.col("n_lines")),
    ]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add t (the text, null as empty), n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed.

    A line counts if it has a word. A word repeats if it lies in a window of three words that the text has twice or more;
    windows are compared by a 64-bit hash within one text. The work per text is a sort at most, whatever repeats.
    """
    n = F.col("n_words")
    out = docs.withColumn("t", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn("word_chars", F.length(F.translate("t", BLANK, "")).cast("long"))
    out = out.withColumn("n_symbols", (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long"))
    out = out.withColumn("_lines", F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(BLANK)) != ""))
    out = out.withColumn("n_lines", F.size("_lines").cast("long"))
    out = out.withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("_lines")))
    # The hashes of the words; of a text without words, the one empty string is dropped.
    out = out.withColumn("_trimmed", F.btrim("t", F.lit(BLANK)))
    out = out.withColumn("_h", F.transform(F.split("_trimmed", r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w)))
    out = out.withColumn("n_words", F.when(F.col("_trimmed") == "", 0).otherwise(F.size("_h")).cast("long"))
    windows = F.transform(F.slice("_h", F.lit(1), (n - 2).cast("int")), lambda h, i: F.xxhash64(h, F.get("_h", i + 1), F.get("_h", i + 2)))
    out = out.withColumn("_w", F.when(n < 3, F.array().cast("array<bigint>")).otherwise(windows))
    placed = F.array_sort(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_s", F.when(F.size(F.array_distinct("_w")) < F.size("_w"), placed))
    again = F.filter("_s", lambda e, i: (F.get("_s", i + 1)["h"] == e["h"]) | F.coalesce(F.get("_s", i - 1)["h"] == e["h"], F.lit(False)))
    out = out.withColumn("_p", F.array_sort(F.transform(again, lambda e: e["i"])))
    covered = F.aggregate(F.transform("_p", lambda p, i: F.least(F.lit(3), F.get("_p", i + 1) - p)), F.lit(0), lambda a, x: a + x)
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    out = out.withColumn("base_failed", (n < 50) | (100 * F.col("n_repeat_words") > 50 * n))
    return out.drop("_lines", "_trimmed", "_h", "_w", "_s", "_p")


def ordered(docs: DataFrame, candidates: list[Rule], sample_rows: int = 1000) -> list[Rule]:
    """The rules by rows rejected per second, each timed over a sample of at most ``sample_rows`` measured rows.

    Only the order comes from the sample. An empty table leaves the rules as they are.
    """
    sample = staged(measured(docs.select("text").limit(sample_rows)), "rule-sample")

    def seconds(what: Column) -> tuple[float, float]:
        began = time.perf_counter()
        share = sample.agg(F.avg(what.cast("int")).alias("share")).first()["share"]
        return time.perf_counter() - began, share or 0.0

    seconds(F.lit(True))
    floor = seconds(F.lit(True))[0]
    rate = {}
    for rule in candidates:
        spent, share = min((seconds(rule.rejects) for _ in range(2)), key=lambda x: x[0])
        rate[rule.name] = share / max(spent - floor, 1e-3)
    return sorted(candidates, key=lambda r: (-rate[r.name], r.name))


def verdict(cascade: list[Rule]) -> Column:
    """True if the base rules and every rule of the cascade pass; what comes after the first rejection is not evaluated."""
    out = F.when(F.col("base_failed"), False)
    for rule in cascade:
        out = out.when(rule.rejects, False)
    return out.otherwise(True)


def judged(docs: DataFrame, candidates: list[Rule] | None = None) -> DataFrame:
    """Every row of ``docs`` with its measures and ``kept``; nothing is shuffled.

    A null or empty text has no words and fails the base rules. Rows that repeat are judged alike. Columns of ``docs``
    named like a measure are replaced.
    """
    cascade = ordered(docs, candidates or rules())
    return measured(docs).withColumn("kept", verdict(cascade)).drop("t")


def kept_documents(docs: DataFrame, candidates: list[Rule] | None = None) -> DataFrame:
    """The rows that pass, with the columns of ``docs`` as they were, whatever their names.

    Null, empty and short texts fail; a null doc_id plays no part; rows that repeat pass or fail together; very long texts are
    measured whole; an empty table gives an empty one.
    """
    packed = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    # A filter would be pushed below the measures and compute them once for each mention; a generator is not.
    return judged(packed, candidates).select(F.inline(F.when(F.col("kept"), F.array("_row"))))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row; odd rows as in ``judged``, and other columns play no part."""
    return judged(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
u AS (SELECT r, unnest(words) AS x, unnest(range(len(words))) AS i FROM w),
p AS (SELECT r, i, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, x, y, z) AS k FROM p WHERE z IS NOT NULL),
c AS (SELECT r, count(DISTINCT i + j) AS n FROM g, (VALUES (0), (1), (2)) AS o(j) WHERE k > 1 GROUP BY r),
m AS (SELECT w.r, doc_id, t, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines FROM w LEFT JOIN c ON w.r = c.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 12 * n_words
    OR 10 * n_dup_lines > 4 * n_lines
    OR 10 * length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) > 3 * word_chars
    OR 10 * len(regexp_extract_all(t, '\p{L}[^\x20\x09-\x0D]*')) < 8 * n_words
    OR 10 * len(regexp_extract_all(t, '(\.\.\.|…)[\x20\x09\x0B-\x0D]*(\n|\z)')) > 3 * n_lines
    OR 10 * len(regexp_extract_all(t, '(\A|\n)[\x20\x09\x0B-\x0D]*[-•*] ')) > 9 * n_lines) AS kept
FROM b"""
