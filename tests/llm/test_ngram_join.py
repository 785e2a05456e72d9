from __future__ import annotations

import random

import numpy as np
import pytest

from barloom.llm import ngram_join as op
from barloom.llm.queries import op9_ngram_join
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def by_id(df) -> dict:
    return {r.doc_id: (r.class_id, r.n_copies, r.n_links, r.group_id, r.kept) for r in df.collect()}


def test_bands_reach_the_recall():
    bands, rows = op.banding(0.8, 0.9999)
    assert bands * rows <= op.HASHES
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999


def test_query_against_all_pairs(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert by_id(op9_ngram_join(spark, sf_dir)) == brute.near(rows)


def variants(count: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    out = []
    for _ in range(count):
        own = list(base)
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("most", [1000, 7])
def test_large_group_in_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(op, "BLOCK_CLASSES", most)
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(variants(60) + variants(20, 2) + variants(20, 2))]
    found = by_id(op.op9_rows(spark.createDataFrame(rows, SCHEMA)))
    assert found == brute.near([r[:2] for r in rows])


@pytest.mark.parametrize("least", [0.8, 0.5])
def test_empty_blocks(spark, monkeypatch, least):
    monkeypatch.setattr(op, "BLOCK_GRAMS", 100)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(160)]
    texts = variants(9) + variants(9, 2) + [" ".join(base[: rng.randrange(90, 161)]) for _ in range(12)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    found = op.near_groups(spark.createDataFrame(rows, SCHEMA), least=least).collect()
    assert {r._g_id: (r.class_id, r.n_copies, r.n_links, r.group_id, r.kept) for r in found} == brute.near([r[:2] for r in rows], least)


def test_distance_of_size_classes():
    assert op.class_distance(0.8) == 2
    assert op.class_distance(0.5) == 4


def test_edges(spark):
    long = " ".join(f"w{k % 977}" for k in range(50_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one two"), (5, "one  two"), (6, "one two three"), (None, "a b c d e f g"), (8, "a b c d e f g"), (9, long), (10, long + " end")]
    docs = spark.createDataFrame([(i, t, "x", None, 0) for i, t in rows], SCHEMA).withColumn("kept", op.F.lit("clash"))
    found = op.op9_rows(docs).collect()
    assert len(found) == len(rows)
    of = {r.doc_id: r for r in found}
    assert of[1].group_id == of[2].group_id == of[3].group_id == 1
    assert of[4].class_id == of[5].class_id == 4 and of[6].n_links == 0
    assert of[None].class_id == 8 and of[None].kept is False and of[8].kept
    assert of[9].n_links == of[10].n_links == 1 and of[10].group_id == 9
    stay = op.drop_near_copies(docs.union(docs))
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == [1, 4, 6, 8, 9]
    assert op.op9_rows(docs.limit(0)).count() == 0


def test_counts_of_common_grams():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(50)]
    counts = op.common_counts(np.repeat(np.arange(50), [len(s) for s in sets]), np.concatenate(sets), 50)
    for a in range(50):
        for b in range(50):
            if a != b:
                assert counts[a, b] == len(np.intersect1d(sets[a], sets[b]))


def test_one_row_ten_thousand_times(spark):
    text = " ".join(f"word{k}" for k in range(400))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "other words stand here now and go")], "doc_id long, text string")
    docs = docs.union(docs.where("doc_id = 1").crossJoin(spark.range(10_000)).drop("id"))
    found = op.op9_rows(docs.repartition(6))
    rows = {(r.doc_id, r.n_copies, r.n_links, r.group_id, r["count"]) for r in found.groupBy("doc_id", "n_copies", "n_links", "group_id").count().collect()}
    assert rows == {(1, 10_001, 1, 1, 10_001), (2, 1, 1, 1, 1), (3, 1, 0, 3, 1)}
