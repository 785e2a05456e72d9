from __future__ import annotations

import duckdb
import pytest

from barloom.llm import mixing as op
from barloom.llm.oracles import OP2
from barloom.llm.queries import op2_mix_sources


def levelled(sizes: dict) -> dict:
    """Targets by resharing the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, free, left = dict.fromkeys(order, 0.0), set(order), float(sum(sizes.values()))
    while free:
        share = left / sum(weights[s] for s in free)
        above = {s for s in free if share * weights[s] > 3 * sizes[s]}
        if not above:
            return target | {s: share * weights[s] for s in free}
        for s in above:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= above
    return target


def check(found) -> None:
    sizes: dict = {}
    for r in found:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    target = levelled(sizes)
    for source in sizes:
        own = [r for r in found if r.source == source]
        assert all(r.source_size == sizes[source] and r.target == pytest.approx(target[source]) for r in own)
        assert all(r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0) for r in own)
        largest = max(r.size for r in own)
        assert abs(sum(r.taken for r in own) - target[source]) <= max(3 * largest, 0.02 * target[source])


def rows(docs):
    drawn = op.draw(docs)
    return drawn.selectExpr("source", "_m_words as size", "_m_of as source_size", "_m_to as target", "_m_words * _m_copies as taken").collect()


def test_query_follows_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(rows(docs))
    again = {r.doc_id: r.taken for r in op2_mix_sources(spark, sf_dir).collect()}
    assert again == {r.doc_id: r.taken for r in op2_mix_sources(spark, sf_dir).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert again == {r[0]: r[4] for r in con.execute(OP2).fetchall()}


def test_edges(spark):
    data = [(k, "w " * (k % 50), ["big", "big", "big", "small", None, "\U0001f600", "z"][k % 7]) for k in range(700)]
    data += [(1000, None, "none"), (1001, "", "none"), (1, "twice here", "big"), (1, "twice", "big"), (None, "no id", "big")]
    docs = spark.createDataFrame([(*d, "clash") for d in data], "doc_id long, text string, source string, target string")
    found = rows(docs)
    assert len(found) == len(data)
    check(found)
    mixed = op.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(r.taken for r in found)
    assert op.op2_rows(docs.limit(0)).count() == 0 and op.mix(docs.limit(0)).count() == 0


def test_ids_of_one_remainder_are_spread(spark):
    docs = spark.createDataFrame([(64 * k, "w " * 9, "s") for k in range(20_000)], "doc_id long, text string, source string")
    assert op.spread_of(20_000) == 256 and op.spread_of(10**12) == 1 << 20
    parts = docs.select(op.part_of(op.F.col("doc_id"), 256).alias("p")).groupBy("p").count().collect()
    assert len(parts) == 256 and max(r["count"] for r in parts) < 160
    check(rows(docs))
