from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from barloom.llm import exact_dedup as op
from barloom.llm.queries import op1_exact_dedup
from tests.llm import brute


def result(df) -> dict:
    return {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()}


def test_query_against_grouping(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert result(op1_exact_dedup(spark, sf_dir)) == brute.exact(rows)


def test_levels_and_edges(spark):
    long = "abcdefg" * 50
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, long), (5, long + " "), (6, long + "h"), (7, "h" + long), (8, "x y"), (9, "xy"), (10, "é𝒳"), (11, "é 𝒳")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, _n int").withColumn("kept", F.lit("clash"))
    found = op.exact_groups(docs.select("doc_id", "text"), block=16)
    assert result(found) == brute.exact(rows)
    assert op.op1_rows(docs.limit(0)).count() == 0
    stay = op.drop_copies(docs)
    assert stay.columns == docs.columns and sorted(r.doc_id for r in stay.collect()) == [3, 5, 6, 7, 8, 9, 11]


def test_repeated_rows_keep_one(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, "z"), (2, "ab")], "doc_id long, text string")
    found = op.op1_rows(docs).collect()
    assert sorted(r.group_size for r in found) == [1, 4, 4, 4, 4]
    assert sum(r.kept for r in found) == 2 and {r.keep_id for r in found} == {1, None}
    assert sorted((r.doc_id or 0, r.text) for r in op.drop_copies(docs).collect()) == [(0, "z"), (1, "a b")]


def test_colliding_keys_are_noticed(spark):
    docs = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one")], "doc_id long, text string")
    same = lambda block: [F.lit(7).cast("long"), F.lit(8).cast("long")]
    assert {r.doc_id: r.group_size for r in op.exact_groups(docs, ways=(same, op.block_keys)).collect()} == {1: 2, 2: 1, 3: 2}
    with pytest.raises(RuntimeError):
        op.exact_groups(docs, ways=(same,)).collect()
