from __future__ import annotations

import corpus_pipeline
from barloom.llm import byte_bpe, mixing, toxicity
from tests.llm import brute
from tests.llm.test_byte_bpe import whole


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
        if name != "byte BPE":
            assert docs.columns == columns
            kept[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
        if name == "toxicity":
            labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
            assert kept[name] == sorted(r.doc_id for r in toxicity.op10_rows(before, labels).where("predicted = 0").collect())
        elif name == "exact dedup":
            assert kept[name] == sorted(i for i, x in brute.exact(rows).items() if x[2])
        elif name == "n-gram join":
            assert kept[name] == sorted(i for i, x in brute.near(rows).items() if x[4])
        elif name == "mix sources":
            drawn = mixing.draw(before).select("doc_id", "_m_copies").collect()
            assert kept[name] == sorted(i for r in drawn for i in [r.doc_id] * r._m_copies)
        else:
            assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in docs.collect()) == sorted((i, *whole(t)) for i, t in rows)
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()
    assert byte_bpe.PIECE > 0


def test_edges(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, clashing names and an empty table go through all stages."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, ids string"
    plain = [(k, f"some clean words number {k} and {k * 7} more of them here", "en", f"s{k % 3}", 9, "x", "y", "z") for k in range(40)]
    odd = [(None, None, None, None, None, None, None, None), (100, "", "en", "s0", 0, "x", "y", "z"), (101, "long words and 12 numbers " * 9000, None, None, 1, "x", "y", "z"), (102, " \t\n", "en", "s1", 3, "x", "y", "z")]
    labels = [(k, 1, int(k % 10 == 0)) for k in range(40)] + [(None, None, None), (3, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([*plain, *odd, *plain[:5], *odd], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for own in (docs, docs.limit(0)):
        stayed = own
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, stayed, str(tmp_path)).write.parquet(f"{tmp_path}/{own is docs}{k}")
            stayed = spark.read.parquet(f"{tmp_path}/{own is docs}{k}")
            assert k == 4 or stayed.columns == docs.columns
        assert stayed.count() > 30 if own is docs else stayed.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
