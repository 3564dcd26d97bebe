"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

A merge table is compiled into an automaton over bytes. Its states are built when a text first reaches them and are kept
in a transition table; a token leaves the transducer as soon as every boundary that can still be continued agrees on it,
which needs no more lookahead than the longest token.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import bounded_batches

#: Distinct pieces whose ids a worker remembers (of up to so many characters each), and transducer states that it keeps, before it
#: starts afresh.
PIECES_KEPT, PIECE_LENGTH, STATES_KEPT = 240_000, 48, 160_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A .tiktoken file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class MergeTransducer:
    """Bytes in, token ids out. A state is the bytes that no token has left for yet, with their live boundaries.

    A sequence of tokens is what the merges make of its bytes exactly if each neighbouring pair is; so the token that
    ends at a position is the one suffix that agrees with the token that ends before it. ``lasts[j]`` is the token that
    ends after j + 1 pending bytes, or -1 where no continuation can start there.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.longest = ranks, max(map(len, ranks))
        self.by_id = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.open = {token[:k] for token in ranks for k in range(len(token))}
        self.halves: dict[int, tuple[int, int]] = {}
        self.agrees: dict[int, bool] = {}
        self.keys: list[tuple[bytes, tuple[int, ...], int]] = []
        self.numbered: dict[tuple, int] = {}
        self.outs: list[tuple[int, ...]] = []
        self.out_at: dict[tuple[int, ...], int] = {}
        self.alike: dict[tuple[int, ...], tuple[int, ...]] = {}
        self.starts: list[tuple[int, ...]] = []  # by state, where in its pending bytes a token can start that goes on
        self.moves: dict[int, int] = {}  # state << 8 | byte: next state << 24 | number of what leaves; 0: came to once
        self.reset()

    def reset(self) -> None:
        """A state is its pending bytes, their last tokens, and the token before them if one can still cover them all."""
        for table in (self.keys, self.numbered, self.outs, self.out_at, self.starts, self.alike, self.moves):
            table.clear()
        self.keys.append((b"", (), -1))
        self.numbered[self.keys[0]] = 0
        self.outs.append(())
        self.starts.append(())
        self.out_at[()] = 0

    def merged(self, data: bytes, until: int = 1) -> list[int]:
        """The merges by definition, down to so many parts: again and again the neighbours whose union ranks first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens that the last merge of a token joins; a byte is its own halves, and what merges never make has -1."""
        if (found := self.halves.get(token)) is None:
            data = self.by_id[token]
            parts = self.merged(data, 2)
            found = (token, token) if len(data) == 1 else (parts[0], parts[1]) if len(parts) == 2 else (-1, -1)
            self.halves[token] = found
        return found

    def fits(self, before: int, token: int) -> bool:
        """Whether the merges keep the two tokens apart, and the token in one piece.

        The tokens are undone, the later of their merges first. They part if at some point what then meets at the boundary would
        have merged before the merge that was undone.
        """
        if before < 0:
            return self.split(token)[0] >= 0
        pair = before << 32 | token
        if (found := self.agrees.get(pair)) is not None:
            return found
        if self.split(token)[0] < 0:
            return False
        spelling, ranks, split = self.by_id, self.ranks, self.split
        left, right, limit, found = before, token, 1 << 60, True
        while True:
            if ranks.get(spelling[left] + spelling[right], 1 << 60) < limit:
                found = False
                break
            a, b = split(left)[1], split(right)[0]
            if a == left and b == right:
                break
            if b == right or (a != left and left > right):
                limit, left = left, a
            else:
                limit, right = right + 1, b
        if len(self.agrees) > 250_000:
            self.agrees.clear()
        self.agrees[pair] = found
        return found

    def number(self, key: tuple[bytes, tuple[int, ...], int], starts: tuple[int, ...]) -> int:
        if (found := self.numbered.get(key)) is None:
            found = self.numbered[key] = len(self.keys)
            self.keys.append(key)
            self.starts.append(self.alike.setdefault(starts, starts))
        return found

    def built(self, state: int, byte: int) -> int:
        """The transition that a state lacks. When there are too many states, only the present one is carried over."""
        key, starts = self.keys[state], self.starts[state]
        if len(self.keys) > STATES_KEPT:
            self.reset()
            state = self.number(key, starts)
        pending, lasts, before = key
        n, last, going, ranks, is_open = len(pending), -1, [], self.ranks, self.open
        pending += bytes((byte,))
        for start in (*starts, n) if not n or lasts[-1] >= 0 else starts:
            part = pending[start:]
            if last < 0 and (token := ranks.get(part)) is not None and self.fits(lasts[start - 1] if start else before, token):
                last = token
            if part in is_open:
                going.append(start)
        lasts, out = (*lasts, last), ()
        n += 1
        if not going or going[0]:  # else a token can still cover all that is pending
            # The boundaries that the tokenisation up to each live position runs through.
            size, through = self.size, []
            for j in (*going, n) if last >= 0 else going:
                chain = [j]
                while j := j - size[lasts[j - 1]]:
                    chain.append(j)
                through.append(chain[::-1])
            k, first = 0, through[0]
            for k, together in enumerate(zip(*through, strict=False)):  # noqa: B007
                if len(set(together)) > 1:
                    break
            else:
                k = min(map(len, through))
            if k:
                out, start = tuple([lasts[j - 1] for j in first[:k]]), first[k - 1]
                used = {j for c in through for j in c[k:]}
                before, pending = out[-1], pending[start:]
                lasts = tuple([lasts[j - 1] if j in used else -1 for j in range(start + 1, n + 1)])
                going = [s - start for s in going]
        number = self.number((pending, lasts, before if going and not going[0] else -1), tuple(going))
        if (at := self.out_at.get(out)) is None:
            at = self.out_at[out] = len(self.outs)
            self.outs.append(out)
        found = self.moves[state << 8 | byte] = number << 24 | at
        return found

    def finished(self, data: bytes, before: int) -> list[int]:
        """The tokens of a piece's last bytes after the token before them, without building states: depth first, longest token first.

        What leads to a position is one sequence, so a position from which the search came back is never entered again.
        """
        n, at, previous, ids, dead = len(data), 0, before, [], set()
        ranks, is_open, agrees, size, options = self.ranks, self.open, self.agrees, self.size, []
        while at < n:
            tokens = []
            for end in range(at + 1, n + 1):
                part = data[at:end]
                if (token := ranks.get(part)) is not None:
                    tokens.append(token)
                elif part not in is_open:
                    break
            options.append(tokens)
            while True:
                while tokens:
                    token = tokens.pop()
                    if at + size[token] not in dead and ((found := agrees.get(previous << 32 | token)) or (found is None and self.fits(previous, token))):
                        break
                else:
                    dead.add(at)
                    options.pop()
                    at -= size[ids.pop()]
                    previous, tokens = ids[-1] if ids else before, options[-1]
                    continue
                break
            ids.append(token)
            previous = token
            at += size[token]
        return ids

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """A transition is built when a text comes to it again; the first time, the piece is finished from the state before it."""
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        moves, outs, state, ids, left = self.moves, self.outs, 0, [], len(piece)
        for byte in piece:
            at = state << 8 | byte
            if not (found := moves.get(at)):
                if found is None and left <= self.longest:
                    rest = self.keys[state][0] + piece[-left:]
                    if len(moves) > 3 * STATES_KEPT:
                        self.reset()
                    else:
                        moves[at] = 0
                    return (*ids, *self.finished(rest, ids[-1] if ids else -1))
                found = self.built(state, byte)
            left -= 1
            state = found >> 24
            if found := found & 0xFFFFFF:
                ids += outs[found]
        lasts, tail, size = self.keys[state][1], [], self.size
        j = len(lasts)
        while j:
            tail.append(lasts[j - 1])
            j -= size[lasts[j - 1]]
        return (*ids, *reversed(tail))


class PieceCache(dict):
    """What pieces gave, in two generations: when the young one is full it becomes the old one, and hits move up."""

    def __init__(self, make, kept: int):
        super().__init__()
        self.make, self.half, self.old = make, kept // 2, {}

    def __missing__(self, piece):
        found = self.old.get(piece)
        if found is None:
            found = self.make(piece)
        if len(piece) <= PIECE_LENGTH:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found


class Utf8Stream:
    """Token ids in, text out: an incremental UTF-8 decoder holds back the bytes of a character that is not complete."""

    def __init__(self, spelling: tuple[np.ndarray, np.ndarray, np.ndarray], errors: str = "strict"):
        self.spelling, self.machine = spelling, codecs.getincrementaldecoder("utf-8")(errors)

    def push(self, ids: np.ndarray) -> str:
        data, begins, lengths = self.spelling
        n = lengths[ids]
        ends = np.cumsum(n)
        places = np.repeat(begins[ids] - (ends - n), n) + np.arange(n.sum())
        return self.machine.decode(data[places].tobytes())

    def close(self) -> str:
        return self.machine.decode(b"", True)


@lru_cache(maxsize=2)
def compiled(path: str) -> tuple[MergeTransducer, PieceCache]:
    """One transducer and one cache for all tasks of a worker."""
    machine = MergeTransducer(read_ranks(path))
    return machine, PieceCache(lambda piece: machine.encode(piece.encode()), PIECES_KEPT)


@lru_cache(maxsize=2)
def spelled(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens in one array, where each token's begin, and how many they are; by id."""
    by_id = {rank: token for token, rank in read_ranks(path).items()}
    lengths = np.array([len(by_id.get(i, b"")) for i in range(max(by_id) + 1)])
    return np.frombuffer(b"".join(by_id[i] for i in sorted(by_id)), np.uint8), np.cumsum(lengths) - lengths, lengths


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the token ids of each whole text as array<int>; a null text counts as empty and gives an empty array.

    Every column of ``docs`` stays (one already named ``ids`` is replaced), in the same partitions: there is no shuffle,
    and rows that repeat are encoded each for itself. ``ranks_path`` must exist on every executor.
    """

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import regex

        pieces, known = regex.compile(pattern), compiled(ranks_path)[1].__getitem__
        for texts in batches:
            rows = [np.fromiter(chain.from_iterable(map(known, pieces.findall(one))), np.int32) for one in texts.to_pylist()]
            ends = np.cumsum([0, *map(len, rows)])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32)))

    bounded_batches(docs.sparkSession)
    return docs.withColumn(ids, encoded(F.coalesce(F.col(text), F.lit(""))))


def decode(docs: DataFrame, ranks_path: str, ids: str = "ids", text: str = "decoded", chunk: int = 4096) -> DataFrame:
    """Add the text of token ids, decoded chunk by chunk; null ids give a null text, no ids an empty one."""

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        spelling = spelled(ranks_path)
        for rows in batches:
            every, ends, missing = rows.values.to_numpy(), rows.offsets.to_numpy(), rows.is_null().to_numpy(zero_copy_only=False)
            texts = []
            for k in range(len(rows)):
                if missing[k]:
                    texts.append(None)
                    continue
                stream = Utf8Stream(spelling)
                parts = [stream.push(every[i : min(i + chunk, ends[k + 1])]) for i in range(ends[k], ends[k + 1], chunk)]
                texts.append("".join(parts) + stream.close())
            yield pa.array(texts, pa.string())

    bounded_batches(docs.sparkSession)
    return docs.withColumn(text, decoded(ids))


def ids_digest(ids: str = "ids") -> Column:
    """SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256)


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per row what encoding and decoding gave: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null or empty text has no tokens and the digests of nothing. Null doc_ids, rows that repeat and very long texts pass one by one;
    other columns play no part; an empty table gives an empty result.
    """
    both = decode(encode(docs.select("doc_id", "text"), ranks_path, pattern), ranks_path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest().alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
