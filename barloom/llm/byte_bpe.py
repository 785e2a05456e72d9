"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The rank file (a fixed vocabulary, about 1 MB) is read once where the job starts and broadcast; each Python worker
builds one encoder from it. A text longer than PIECE is cut where a match of the pattern surely ends, so the ids are
those of the whole text, and no single call holds all of a very long one. Decoding joins the raw bytes of the ids.

Edge cases: a null text is an empty one, which has no ids; a text without a safe boundary is encoded in one call;
extra columns are kept, and the new columns replace columns of the same name; repeated rows are encoded each; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

#: Code points from which a text is cut.
PIECE = 1 << 16
#: Between a character that is no space and a space before a letter, one match ends and the next begins: no class of
#: the pattern joins a space to what stands before it, and only a space directly before a word starts that word.
SAFE = re.compile(r"(?<=\S) (?=[^\W\d_])")


def pieces(text: str, size: int = PIECE) -> list[str]:
    """text cut at safe boundaries into pieces of about size code points."""
    out, begin = [], 0
    while len(text) - begin > size:
        found = SAFE.search(text, begin + size)
        if not found:
            break
        out.append(text[begin : found.start()])
        begin = found.start()
    out.append(text[begin:])
    return out


@functools.lru_cache(maxsize=4)
def encoder(ranks: bytes, pattern: str):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks={base64.b64decode(token): int(rank) for token, rank in pairs}, special_tokens={})


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


class Tokenizer:
    """Column functions for one vocabulary: encode gives ids as little-endian unsigned 32-bit integers, decode gives bytes."""

    def __init__(self, spark: SparkSession, rank_path: str, pattern: str):
        ranks = spark.sparkContext.broadcast(read_ranks(rank_path))

        def ids(own, text: str) -> bytes:
            return b"".join(np.asarray(own.encode_ordinary(piece), dtype="<u4").tobytes() for piece in pieces(text))

        def raw(own, found: bytes) -> bytes:
            return own.decode_bytes(np.frombuffer(found, dtype="<u4").tolist())

        @F.pandas_udf("binary")
        def encode(texts: pd.Series) -> pd.Series:
            own = encoder(ranks.value, pattern)
            return texts.map(lambda text: ids(own, text))

        @F.pandas_udf("binary")
        def decode(found: pd.Series) -> pd.Series:
            own = encoder(ranks.value, pattern)
            return found.map(lambda one: raw(own, one))

        @F.pandas_udf("ids binary, decoded binary")
        def both(texts: pd.Series) -> pd.DataFrame:
            own = encoder(ranks.value, pattern)
            found = [ids(own, text) for text in texts]
            return pd.DataFrame({"ids": found, "decoded": [raw(own, one) for one in found]})

        self._encode, self._decode, self._both = encode, decode, both

    def encode(self, text: Column) -> Column:
        return self._encode(F.coalesce(text, F.lit("")))

    def decode(self, ids: Column) -> Column:
        return self._decode(ids)

    def encode_decode(self, text: Column) -> Column:
        """A struct of the ids and the bytes decoded from them, in one pass over the texts."""
        return self._both(F.coalesce(text, F.lit("")))


def default_tokenizer(spark: SparkSession) -> Tokenizer:
    import public_tokenizers

    return Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def encode_decode(docs: DataFrame, tokenizer: Tokenizer, text: str = "text") -> DataFrame:
    """docs with ids (binary) and decoded (binary)."""
    found = docs.withColumn("_b_both", tokenizer.encode_decode(text_of(text)))
    return found.withColumns({"ids": F.col("_b_both.ids"), "decoded": F.col("_b_both.decoded")}).drop("_b_both")


def op8_rows(docs: DataFrame) -> DataFrame:
    found = encode_decode(docs.select("doc_id", "text"), default_tokenizer(docs.sparkSession))
    count = (F.octet_length("ids") / 4).cast("long")
    return found.select("doc_id", count.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
