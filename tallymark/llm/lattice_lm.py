"""Document probability under a unigram model of subwords, summed over all segmentations.

The pieces and their first weights come from an existing vocabulary; one expectation-maximisation round over the counts of the
training words fits the weights. A piece never crosses the start of a word, so the lattice of a text falls apart into the
lattices of its words: the forward recursion runs once for each distinct word of the corpus, and documents sum the results.

The most frequent words, a bounded number, are looked up where a document lies; the others are joined by their hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import BLANK, bounded_batches, shared_dir, staged
from tallymark.llm.wordhash import word_hashes

SPACE = "▁"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOG10 = math.log(10)


@dataclass(frozen=True)
class Config:
    """``local`` words are looked up without a join; ``held`` of the old weights stays in each training round."""

    rounds: int = 1
    held: float = 0.05
    local: int = 1 << 18


def training(doc_id: str = "doc_id") -> Column:
    """The fold: documents whose crc32 of the decimal doc_id leaves 2 on division by 7 are held out; so is a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 != 2, F.lit(False))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[str, int], list[int], np.ndarray]:
    """(number of each piece, numbers of the 256 byte pieces, first log weights): a score is minus a rank, and weights fall with it as Zipf's law has it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and SPACE not in model.id_to_piece(i)[1:]]
    ranks = np.array([-model.get_score(i) for i in usable])
    is_byte = np.array([model.is_byte(i) for i in usable])
    ranks[is_byte | (ranks > 1e8)] = ranks[ranks < 1e8].max() + 1
    weights = 1 / (ranks + 2.7)
    pieces = {model.id_to_piece(i): k for k, i in enumerate(usable) if not is_byte[k]}
    return pieces, [k for k in range(len(usable)) if is_byte[k]], np.log(weights / weights.sum())


class Lattice:
    """All segmentations of a word; a character outside the vocabulary is spelled by its bytes."""

    def __init__(self, path: str, weights: np.ndarray):
        self.numbers, byte_numbers, _ = vocabulary(path)
        self.weights = weights.tolist()
        self.byte_weights = [self.weights[k] for k in byte_numbers]
        self.byte_numbers = byte_numbers
        self.longest = max(map(len, self.numbers))
        self.logs = {piece: self.weights[k] for piece, k in self.numbers.items()}

    def arcs(self, word: str) -> list[list[tuple[int, float, str]]]:
        """By end position: (start, log weight, piece), in the word with the mark of its start before it."""
        text, logs = SPACE + word, self.logs
        out = []
        for j in range(1, len(text) + 1):
            here = [(i, logs[s], s) for i in range(max(0, j - self.longest), j) if (s := text[i:j]) in logs]
            if text[j - 1] not in logs:
                here.append((j - 1, sum(self.byte_weights[b] for b in text[j - 1].encode()), ""))
            out.append(here)
        return out

    def forward(self, arcs: list) -> list[float]:
        """The log probability of each prefix."""
        a = [0.0]
        for here in arcs:
            terms = [a[i] + w for i, w, _ in here]
            top = max(terms)
            a.append(top + math.log(sum([math.exp(t - top) for t in terms])) if len(terms) > 1 else top)
        return a

    def marginal(self, word: str) -> float:
        return self.forward(self.arcs(word))[-1]

    def expect(self, word: str, count: float, into: np.ndarray) -> None:
        """Add the expected numbers of pieces in so many of the word."""
        arcs, text = self.arcs(word), SPACE + word
        a = self.forward(arcs)
        b = [-math.inf] * (len(a) - 1) + [0.0]
        for j in range(len(arcs), 0, -1):
            for i, w, piece in arcs[j - 1]:
                t = w + b[j]
                top, low = (t, b[i]) if t > b[i] else (b[i], t)
                b[i] = top + math.log1p(math.exp(low - top))
                n = count * math.exp(a[i] + t - a[-1])
                if piece:
                    into[self.numbers[piece]] += n
                else:
                    for byte in text[j - 1].encode():
                        into[self.byte_numbers[byte]] += n


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, n): how often each word stands in the training documents, and in all."""
    lowered = F.translate("text", ASCII_UPPER + BLANK, ASCII_LOWER + " " * len(BLANK))
    words = docs.where("text IS NOT NULL").select(training().alias("train"), F.explode(F.split(lowered, " +")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.sum(F.col("train").cast("long")).alias("c"), F.count("*").alias("n"))


def fitted(words: DataFrame, path: str, config: Config) -> np.ndarray:
    """Log weights of the pieces after training."""
    weights = vocabulary(path)[2]
    for _ in range(config.rounds):

        def expected(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            lattice, into = Lattice(path, weights), np.zeros(len(weights))
            for batch in batches:
                for word, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    lattice.expect(word, count, into)
            seen = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(into[seen])], names=["i", "x"])

        total = words.where("c > 0").select("word", "c").mapInArrow(expected, "i long, x double").groupBy("i").agg(F.sum("x").alias("x"))
        counts = np.zeros(len(weights))
        for row in total.toLocalIterator():  # one row a piece of the vocabulary
            counts[row["i"]] = row["x"]
        if counts.any():
            weights = np.log((1 - config.held) * counts / counts.sum() + config.held * np.exp(weights))
    return weights


def priced(words: DataFrame, path: str, weights: np.ndarray) -> DataFrame:
    """(hash, c, n, lp) of each word: its log probability without an end, and the hash that word_hashes gives."""

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(path, weights)
        for batch in batches:
            hashes, _ = word_hashes(batch.column(0), lower=False)
            lp = [lattice.marginal(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(hashes.astype(np.int64)), batch.column(1), batch.column(2), pa.array(lp, pa.float64())], names=["hash", "c", "n", "lp"])

    return words.select("word", "c", "n").mapInArrow(price, "hash long, c long, n long, lp double")


def frequent(table: DataFrame, limit: int) -> DataFrame:
    """The words of at least some count, the least for which they are no more than ``limit``."""
    step = F.floor(16 * F.log2(F.col("n").cast("double")))
    bins = sorted(((r["b"], r["k"]) for r in table.groupBy(step.alias("b")).agg(F.count("*").alias("k")).collect()), reverse=True)  # at most 1024 rows
    least, taken = math.inf, 0
    for b, k in bins:
        if taken + k > limit:
            break
        least, taken = b, taken + k
    return table.where(step >= F.lit(float(least)))


def scored(docs: DataFrame, path: str, config: Config = Config()) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the text).

    A null or empty text is its end alone. A null doc_id is held out. Rows that repeat count as often as they stand there. With no
    training documents N is 0 and V is 0, and the pieces keep their first weights; an empty table gives an empty result. Very long texts are read whole; other
    columns play no part.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    words = staged(word_counts(docs), "words")
    sums = words.agg(F.sum("c").alias("tokens"), F.sum((F.col("c") > 0).cast("long")).alias("types")).first()
    ends = docs.where(training()).count()
    n, v = (sums["tokens"] or 0) + ends, (sums["types"] or 0) + (ends > 0)
    weights = fitted(words, path, config)
    # Before each word a document may end instead.
    p_stop = (ends + 1) / ((sums["tokens"] or 0) + ends + 2)
    table = staged(priced(words, path, weights), "priced")
    near = frequent(table, config.local).select("hash", "c", "lp").toPandas().sort_values("hash")
    keys, known, prices = near["hash"].to_numpy(np.int64), near["c"].to_numpy(np.int64), near["lp"].to_numpy(float)
    go, stop, floor = math.log(1 - p_stop), math.log(p_stop), math.log(n + v + 1)

    def sum_local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            hashes, at = word_hashes(batch.column(1))
            hashes = hashes.astype(np.int64)
            place = np.searchsorted(keys, hashes)
            place[place == len(keys)] = 0
            found = keys[place] == hashes if len(keys) else np.zeros(len(hashes), bool)
            c = np.where(found, known[place] if len(keys) else 0, 0)
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])  # noqa: E731, B023
            base = np.add.reduceat(np.append(np.where(found, np.log(c + 1.0) - floor, 0.0), 0.0), at[:-1]) * (np.diff(at) > 0)
            model = np.add.reduceat(np.append(np.where(found, (prices[place] if len(keys) else 0.0) + go, 0.0), 0.0), at[:-1]) * (np.diff(at) > 0)
            rare = hashes[~found]
            cuts = np.concatenate([[0], np.cumsum(total(~found))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(rare))
            rows = np.arange(row, row + len(batch))
            row += len(batch)
            yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column(0), pa.array(np.diff(at).astype(np.int64)), pa.array(total(c > 0).astype(np.int64)), pa.array(base), pa.array(model), lists], names=["row", "doc_id", "n", "known", "base", "model", "rare"])

    local = staged(docs.mapInArrow(sum_local, "row long, doc_id long, n long, known long, base double, model double, rare array<long>"), "local")
    rare = local.select("row", F.explode("rare").alias("hash")).groupBy("row", "hash").agg(F.count("*").alias("k"))
    met = rare.join(table.select("hash", "c", "lp"), "hash")
    met = met.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("known2"), F.sum(F.col("k") * (F.log(F.col("c") + F.lit(1.0)) - floor)).alias("base2"), F.sum(F.col("k") * (F.col("lp") + go)).alias("model2")
    )
    out = local.drop("rare").join(met, "row", "left")
    total = lambda a, b, end: F.col(a) + F.coalesce(b, F.lit(0)) + end
    return out.select(
        "doc_id", (~training()).alias("held_out"), (F.col("n") + 1).alias("n_tokens"), total("known", "known2", int(ends > 0)).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (total("base", "base2", math.log(ends + 1) - floor) / LOG10).alias("base_score"), (total("model", "model2", stop) / LOG10).alias("score"),
    )
