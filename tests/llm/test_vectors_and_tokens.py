"""Token alignment, exact top-k search and whitening against plain versions, and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import math

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallymark.llm import queries, token_alignment, topk, whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, x string, score long, part string"


@pytest.fixture(scope="module")
def pair():
    with open(queries.BPE_JSON, encoding="utf-8") as f, open(queries.PIECES, "rb") as g:
        return f.read(), g.read()


def plain_tokens(pair):
    """Ids of both libraries on a whole text, and their bytes."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_str(pair[0]), sentencepiece.SentencePieceProcessor(model_proto=pair[1])
    a.encode_special_tokens = True
    values = token_alignment.byte_of()

    def tokens(text):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        parts_a = [bytes(values[c] for c in a.id_to_token(k)) for k in ids_a]
        parts_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
        data = (" " + text).encode()
        return (list(zip(ids_a, parts_a)), list(zip(ids_b, parts_b))) if text and b"".join(parts_a) == data == b"".join(parts_b) else ([], [])

    return tokens


def plain_alignment(tokens, texts):
    """The contract's row of each text, by sets of ends and all overlapping spans."""
    spans = lambda side: [(k, e - len(p), e) for (k, p), e in zip(side, np.cumsum([len(p) for _, p in side]).tolist())]
    per, counts = [], collections.Counter()
    for text in texts:
        a, b = map(spans, tokens(text or ""))
        links, j = [], 0
        for x, low, high in a:
            while j and b[j][1] >= low:
                j -= 1
            while j < len(b) and b[j][2] <= low:
                j += 1
            k = j
            while k < len(b) and b[k][1] < high:
                links.append((x, b[k][0]))
                k += 1
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, low = [], 0
        for e in ends:
            groups.append(",".join(str(k) for k, s, t in a if low < t <= e) + "|" + ",".join(str(k) for k, s, t in b if low < t <= e))
            low = e
        per.append((len(a), len(b), groups, links))
        counts.update(links)
    highest = collections.Counter()
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    return [
        (n_a, n_b, len(groups), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for n_a, n_b, groups, links in per
    ]


ODD = [" ", "  ", "\n", "\na \n", "a\tb \t c ", "<|endoftext|> <s> hi", "x▁y", "\x1c!\x1c a", "é  b \n c", "日本語 テキスト\r\n\r\nfoo  bar\n\n", "don't 'S's 12 345", "a" * 3000, "ab " * 4000, "🙂🙂x🙂"]


@pytest.mark.parametrize("frequent", [1, 64, 1 << 18])
def test_alignment_equals_plain_overlaps(make, pair, monkeypatch, frequent):
    """However many pairs count as frequent."""
    monkeypatch.setattr(token_alignment, "FREQUENT", frequent)
    texts = [None, "", *ODD, "the same text", "the same text"]
    got = token_alignment.linked(make(*enumerate(texts)), queries.BPE_JSON, queries.PIECES, queries.PIECE_PATTERN).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == plain_alignment(plain_tokens(pair), texts)


def test_alignment_of_the_table(spark, pair):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 6000").collect()}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in token_alignment.linked(docs, queries.BPE_JSON, queries.PIECES, queries.PIECE_PATTERN).collect()}
    assert [got[k] for k in rows] == plain_alignment(plain_tokens(pair), rows.values())


def test_both_encoders_give_the_same_ids(pair):
    """By ranks and by the tokenizers library, at every code point."""
    own = token_alignment.Pair(*pair, public_tokenizers.PATTERN)
    assert own.plain(pair[0]) is not None
    some = [f"a{chr(c)}b {chr(c)}1{chr(c)} \n{chr(c)}  {chr(c)}" for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    assert own.encode_a(some) == own.plain(pair[0])(some)


def test_long_stretches_are_jumped():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 9, 5000).astype(np.uint8)
    b = a.tolist()
    for at in (4900, 3000, 2999, 400, 8, 0):
        b[at : at + 2] = [int(b[at]) + int(b[at + 1])]
    steps = token_alignment.aligned(a, np.array(b, np.uint8))
    times, p, q = np.array(steps).reshape(-1, 3).T
    assert (times @ p, times @ q) == (len(a), len(b))
    assert sum(times) == len(set(np.cumsum(a, dtype=int)) & set(np.cumsum(b)))
    assert len(times) <= 13


def test_odd_documents_have_no_tokens(odd):
    rows = token_alignment.linked(odd, queries.BPE_JSON, queries.PIECES, queries.PIECE_PATTERN).collect()
    assert len(rows) == odd.count()
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in rows if r.n_a == 0)
    assert sum(r.n_a == 0 for r in rows) == 3
    assert token_alignment.linked(odd.where("false"), queries.BPE_JSON, queries.PIECES, queries.PIECE_PATTERN).collect() == []


# Exact top-k


def plain_top(rows, k=5):
    """Every query against every other row in whole numbers."""
    x = {i: [math.floor(256 * float(c)) for c in v] for i, v in rows}
    out = {}
    for q in x:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x[q], x[o])), o) for o in x if o != q)
            out |= {(q, rank + 1): (o, -s) for rank, (s, o) in enumerate(scores[:k])}
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1, "p") for i, v in rows], VECTORS)


def answers(df):
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in df.collect()}


def test_top_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert answers(queries.op12_exact_topk(spark, SF)) == plain_top(rows)


@pytest.mark.parametrize("kind", ["lengths", "copies", "ties", "flat"])
def test_top_equals_brute_force(spark, kind):
    """Long and short vectors, half of them copies, few distinct scores; in many small blocks and parts."""
    rng = np.random.default_rng(len(kind))
    x = rng.normal(size=(700, 12)) * np.array([1.0] * 3 + [0.05] * 9)
    if kind == "lengths":
        x *= rng.pareto(1.5, (700, 1))
    if kind == "copies":
        x[::2] = x[4]
    if kind == "ties":
        x = rng.integers(-1, 2, (700, 12)) / 256
    if kind == "flat":
        x[:] = 0
    rows = [(k, v.tolist()) for k, v in enumerate(x.astype(np.float32).astype(float))]
    config = topk.Config(dims=3, queries=4, part=100, spread=7)
    assert answers(topk.top(vectors(spark, rows), F.col("vec_id") % 50 == 0, config)) == plain_top(rows)


def test_bounds_rule_out_nearly_all(spark):
    """Where lengths fall and a few dimensions hold most of them, few pairs are scored in whole."""
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(size=(20_000, 32)) * 0.7 ** np.arange(32) * rng.pareto(2, (20_000, 1))).astype(np.int64)
    x = x[np.argsort(-np.linalg.norm(x, axis=1))]
    rotation = np.linalg.svd(x[:5000].astype(float), full_matrices=False)[2].T
    best = topk.Best(np.arange(50) + 10**6, x[rng.integers(0, 20_000, 50)], np.full(50, np.iinfo(np.int64).min), rotation, topk.Config(dims=8))
    scored = 0
    exact = best.exact
    best.exact = lambda q, c, y: (exact(q, c, y), globals().__setitem__("SCORED", globals().get("SCORED", 0) + len(q)))[0]
    globals()["SCORED"] = 0
    for k in range(0, len(x), 5000):
        best.meet(np.arange(k, k + 5000), x[k : k + 5000])
    scored = globals()["SCORED"]
    assert scored < 0.02 * 50 * len(x)
    want = np.sort(best.x @ x.T, axis=1)[:, ::-1][:, :5]
    assert (best.scores == want).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [1.0, None]), (100, None), (150, [nan, 1.0]), (200, [inf, 1.0]), (250, []), (300, [1.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [3.0, 3.0]), (None, [9.0, 9.0]), (8, [1e30, 0.0])]
    got = answers(topk.report(vectors(spark, rows)))
    top = (1 << 63) - 1
    assert {q for q, _ in got} == {0, 250, 300}
    assert got[0, 1] == (8, top) and got[0, 2] == (7, 256 * 256 + 512 * 512) and got[0, 3] == (300, 256 * 256) and got[0, 4] == (250, 0) and (0, 5) not in got
    assert [got[250, k] for k in (1, 2, 3, 4)] == [(0, 0), (7, 0), (8, 0), (300, 0)]
    assert topk.report(vectors(spark, rows[:1])).collect() == []
    assert topk.report(vectors(spark, [])).collect() == []
    assert topk.report(vectors(spark, [(1, [1.0])])).collect() == []


# Whitening


def plain_whitening(rows):
    x = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows]
    fit = np.array(sorted({tuple(v) for _, v in x}), float)
    n, sums = len(fit), [int(s) for s in fit.sum(0)]
    centred = fit - fit.mean(0)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    order = [k for k in np.argsort(e)[::-1][:4] if e[k] > 1e-12 * e.sum()]
    return n, [(i, sum((n * a - s) ** 2 for a, s in zip(w, sums)), (np.array(w) - fit.mean(0)) @ v[:, order] / np.sqrt(e[order])) for i, w in x], e[order] / e.sum()


def same_whitening(got, rows):
    n, want, explained = plain_whitening(rows)
    found = collections.defaultdict(list)
    for r in got:
        assert r.n == n and r.identity_error < 1e-6 and abs(r.explained / explained[r.component - 1] - 1) < 1e-6
        found[r.vec_id, r.component, r.deviation].append(r.whitened)
    signs = {}
    expected = collections.defaultdict(list)
    for i, deviation, w in want:
        for k, value in enumerate(w):
            expected[i, k + 1, deviation].append(value)
    assert {k: len(v) for k, v in found.items()} == {k: len(v) for k, v in expected.items()}
    for key, values in expected.items():
        if abs(values[0]) > 0.5:
            signs.setdefault(key[1], np.sign(values[0] * found[key][0]))
    for key, values in expected.items():
        assert np.allclose(sorted(found[key]), sorted(signs.get(key[1], 1) * v for v in values), atol=1e-6)


def test_whitening_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    same_whitening(queries.op13_whitening(spark, SF).collect(), rows)


def test_whitening_in_many_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 6)) * [4, 2, 1, 0.5, 0.2, 0.1]
    x[::3] = x[0]
    rows = [(k, v.tolist()) for k, v in enumerate(x.astype(np.float32).astype(float))]
    same_whitening(whitening.whitened(vectors(spark, rows).repartition(5), whitening.Config(rows=16)).collect(), rows)


def test_odd_whitening(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, [1.0, None]), (3, [nan, 0.0]), (4, [inf, 0.0])]
    fine = [(5, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [3.0]), (None, [0.5, 0.25]), (7, [0.0, 1.0])]
    same_whitening(whitening.whitened(vectors(spark, odd + fine)).collect(), [(i, v if len(v) == 2 else [*v, 0.0]) for i, v in fine])
    assert whitening.whitened(vectors(spark, odd)).collect() == []
    assert whitening.whitened(vectors(spark, [])).collect() == []
    assert whitening.whitened(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    huge = whitening.whitened(vectors(spark, [(1, [1e30, 0.0]), (2, [0.0, 0.0])])).collect()
    assert {r.deviation for r in huge} == {None} and len(huge) == 2
