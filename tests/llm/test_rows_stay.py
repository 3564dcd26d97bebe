"""Stages and shards keep every row that is not judged away, whatever shares its doc_id or its folder."""

from __future__ import annotations

import pytest

from tallymark.llm import decontaminate, near_dup, training_order

A, B = (" ".join(f"{w}{i}" for i in range(30)) for w in "ab")


def test_texts_of_one_id_each_follow_their_own(make):
    docs = make((3, A), (7, A), (7, B), (None, A), (9, None), (9, A))
    kept = near_dup.kept_documents(docs)
    assert kept.columns == docs.columns
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(3, A), (7, B), (None, A), (9, None)}


def test_clean_texts_stay_beside_a_leak(spark, make):
    item = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions tonight"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = make((5, f"{A} {item} {B}"), (5, B), (6, A), (None, item), (7, None))
    clean = decontaminate.clean_documents(docs, items)
    assert clean.columns == docs.columns
    assert {(r.doc_id, r.text) for r in clean.collect()} == {(5, B), (6, A), (None, item), (7, None)}
    assert {r.doc_id for r in decontaminate.leaks(docs, items).collect()} == {5}


def test_columns_may_clash(make):
    docs = make((3, A), (7, A)).withColumnsRenamed({"lang": "h", "source": "_h"})
    assert near_dup.kept_documents(docs).columns == docs.columns


def test_another_table_in_the_folder_is_refused(spark, make, tmp_path):
    config, folder = training_order.Config(length=16, shard=20, waves=3), f"file://{tmp_path}/out"
    for name, text in {"one": "x", "two": "y"}.items():
        make(*((i, text * (7 * i)) for i in range(40))).write.parquet(f"{tmp_path}/{name}")
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    first = sorted(map(tuple, training_order.report(spark, read("one"), config, folder).collect()))
    with pytest.raises(ValueError, match="another table"):
        training_order.report(spark, read("two"), config, folder)
    assert sorted(map(tuple, training_order.report(spark, read("one"), config, folder).collect())) == first


def test_lines_without_spaces_are_compared_by_character(make):
    """40 pairs of 40 Han characters, one of them changed; and 10 of other lines stay."""
    import random

    from tallymark.llm import line_dedup

    rng = random.Random(1)
    han = [chr(0x4E00 + k) for k in range(5000)]
    rows = []
    for k in range(40):
        line = rng.sample(han, 40)
        other = list(line)
        other[rng.randrange(40)] = rng.choice(han)
        rows += [(2 * k, "".join(line)), (2 * k + 1, "".join(other))]
    rows += [(100 + k, "".join(rng.sample(han, 40))) for k in range(10)]
    got = {r.doc_id: r.n_dropped for r in line_dedup.deduplicated(make(*rows)).collect()}
    assert sum(got[2 * k + 1] for k in range(40)) == 40 and sum(got.values()) == 40
