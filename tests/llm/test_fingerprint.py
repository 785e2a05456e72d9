from __future__ import annotations

import hashlib

import numpy as np
import pytest

from barloom.llm import fingerprint as op
from barloom.llm.queries import op6_fingerprints


def jaccard(a: str, b: str) -> float:
    x, y = set(op.digests(a).tolist()), set(op.digests(b).tolist())
    return len(x & y) / len(x | y) if x | y else 1.0


def check(found, texts: dict) -> None:
    order = sorted(texts)
    assert sorted(r.doc_id for r in found) == order
    for r in found:
        own, following = texts[r.doc_id] or "", texts[order[(order.index(r.doc_id) + 1) % len(order)]] or ""
        half = len(own) // 2
        changed = own[: len(own) - half] + following[:half]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.near_edited == pytest.approx(jaccard(own, changed)) and r.near_next == pytest.approx(jaccard(own, following))
        assert (r.fingerprint == r.edited_fingerprint) == (set(op.digests(own).tolist()) == set(op.digests(changed).tolist()))


def test_query_against_sets(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    check(op6_fingerprints(spark, sf_dir).collect(), texts)


def test_edges(spark):
    texts = {5: None, 1: "", 7: "a b", 9: "one line\none line\none line", -3: "é𝒳 " * 50_001, 12: "\n".join(f"line {k} of very many" for k in range(3000)), 13: "a b"}
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, fingerprint string")
    found = op.op6_rows(docs).collect()
    check(found, texts)
    prints = {r.doc_id: r.fingerprint for r in found}
    assert prints[7] == prints[13] and prints[5] == prints[1]
    alone = op.op6_rows(docs.where("doc_id = 12")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    assert op.op6_rows(docs.limit(0)).count() == 0
    twice = op.op6_rows(docs.union(docs).union(spark.createDataFrame([(None, "z", "x")], docs.schema))).collect()
    assert len(twice) == 15 and sum(r.doc_id is None for r in twice) == 1


def test_peeling_recovers_and_retries():
    rng = np.random.default_rng(4)
    left = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (0, 1, 5, 40, 900)]
    right = [np.concatenate([s[: len(s) // 2], rng.integers(0, 1 << 63, 7).astype(np.uint64)]) for s in left]
    near = op.likeness(left, right, cells=6)
    for a, b, x in zip(left, right, near, strict=True):
        assert x == pytest.approx(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))


@pytest.mark.parametrize("parts", [4, 200])
def test_null_ids_and_the_largest_id(spark, parts):
    last = (1 << 63) - 1
    rows = [(1, "one text"), (last, "the last text of all"), (None, "b"), (None, "a longer text"), (None, None), (-last - 1, "the first"), (last, "the same id"), (7, "x\ny z")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for data in (rows, rows * 3, [(None, f"text {k}") for k in range(300)] + rows):
            docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
            found = op.op6_rows(docs).collect()
            order = [(r.n, r.a, r.k, r.text) for r in docs.selectExpr("doc_id is null n", "coalesce(doc_id, 0) a", "xxhash64(coalesce(text, '')) k", "coalesce(text, '') text").collect()]
            order.sort()
            hand = []
            for (none, i, _, own), (*_, following) in zip(order, order[1:] + order[:1], strict=True):
                changed = op.edited(own, following)
                hand.append((None if none else i, len(own), hashlib.sha256(changed.encode()).hexdigest(), round(jaccard(own, following), 9)))
            key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
            assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_next, 9)) for r in found), key=key) == sorted(hand, key=key)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_an_edit_changes_the_pieces_around_it():
    rng = np.random.default_rng(8)
    words = [f"word{k}" for k in rng.integers(0, 5000, 600)]
    changed = [*words[:5], "inserted", *words[5:]]
    a, b = set(op.digests(" ".join(words)).tolist()), set(op.digests(" ".join(changed)).tolist())
    assert len(a) > 20 and len(a - b) <= 2 and len(b - a) <= 2
