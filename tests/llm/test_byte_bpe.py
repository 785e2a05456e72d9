from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from barloom.llm import byte_bpe as op
from barloom.llm.queries import op8_byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def whole(text: str | None) -> tuple:
    ids = op.encoder(op.read_ranks(PATH), PATTERN).encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query_is_the_library_on_whole_texts(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    found = op8_byte_bpe(spark, sf_dir).collect()
    assert len(found) == len(texts)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == whole(texts[r.doc_id]) for r in found)


def test_pieces_have_the_ids_of_the_whole():
    own = op.encoder(op.read_ranks(PATH), PATTERN)
    samples = ["it's  a\n\n b don't 12 34 -- é 日本語 x \t y", " " * 50 + "a b" * 20, "a" * 400, "x 1 2 3 'll", "  a b c\x1cd e", "a\n b\r\n c"]
    for text in [s * 7 for s in samples]:
        for size in (1, 3, 10, 100):
            cut = op.pieces(text, size)
            assert "".join(cut) == text
            assert [i for p in cut for i in own.encode_ordinary(p)] == own.encode_ordinary(text)


def test_edges(spark):
    texts = {1: None, 2: "", 3: "<|endoftext|>", 4: "long words and 12 numbers, " * 9000, 5: "a" * 100_000, 6: " " * 5000 + "\n" * 5000}
    docs = spark.createDataFrame([(k, t, "clash") for k, t in texts.items()] * 2, "doc_id long, text string, ids string")
    found = op.op8_rows(docs).collect()
    assert len(found) == 12
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == whole(texts[r.doc_id]) for r in found)
    assert op.op8_rows(docs.limit(0)).count() == 0
    tokenizer = op.default_tokenizer(spark)
    back = docs.where("doc_id = 4").select("text", tokenizer.decode(tokenizer.encode(F.col("text"))).cast("string").alias("b")).first()
    assert back.b == back.text
