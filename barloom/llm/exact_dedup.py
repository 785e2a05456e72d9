"""Exact dedup by deterministic block naming, with DataFrame functions only.

A text without its white space is cut into blocks of a fixed number of code points. Distinct blocks are sorted and
numbered, so that each block is known by an integer. Adjacent names are then paired, distinct pairs are sorted and
numbered in their turn, and so on until each document is one integer. Two documents have the same number of levels
and the same integer if and only if their texts are equal.

Texts are moved once, when the distinct blocks are found; partial aggregation leaves each task at most one copy of a
block. After that only integers move. The occurrence of a block finds its name by a 128-bit key of the block; names
whose key is not unique (which has yet to be seen) are found by the text itself, so no collision can join two texts.

Edge cases: a null text is an empty one, and empty texts are one group; long texts only add levels; extra columns are
kept and internal ones start with "_n_"; repeated rows (same id and text) stay separate rows of one group, of which
exactly one is kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, cut, text_of

#: Code points of a block. Most documents are one or two blocks; a longer block only makes the sorted rows longer.
BLOCK = 4096
#: Stands for the missing right half of an odd last pair; names are never negative.
NONE = -1


def _numbered(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _n_name: the rank of each key in sorted order. Keys are unique, so a task that runs again numbers alike."""
    return cut(distinct.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_n_name", F.monotonically_increasing_id()), narrow=True)


def block_keys(block: Column) -> list[Column]:
    return [F.xxhash64(block), F.xxhash64(F.lit("barloom"), block)]


def long_keys(block: Column) -> list[Column]:
    return [F.xxhash64(block), F.sha2(block, 512)]


def name_documents(docs: DataFrame, text: str, block: int = BLOCK, ways: tuple[Callable[[Column], list[Column]], ...] = (block_keys, long_keys)) -> DataFrame:
    """docs without the text, but with _n_row (a row number), _n_levels, _n_name, _n_chars and _n_sha256."""
    keys, *longer = ways
    plain = F.translate(text_of(text), ASCII_SPACE, "")
    pieces = F.when(F.length(plain) <= block, F.array(plain)).otherwise(F.regexp_extract_all(plain, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))
    k1, k2 = (c.alias(n) for c, n in zip(keys(F.col("_n_block")), ("_n_k1", "_n_k2"), strict=True))
    texts = docs.select(F.explode(pieces).alias("_n_block")).distinct().select(k1, k2)
    names = _numbered(texts, ["_n_k1", "_n_k2"])
    if not names.groupBy("_n_k1", "_n_k2").count().where("count > 1").isEmpty():
        if not longer:
            raise RuntimeError("two blocks share a key of every kind")
        return name_documents(docs, text, block, tuple(longer))
    others = [c for c in docs.columns if c != text]
    key = lambda b: F.struct(*(c.alias(n) for c, n in zip(keys(b), ("_n_k1", "_n_k2"), strict=True)))
    rows = docs.select(*others, F.length(text_of(text)).cast("long").alias("_n_chars"), F.sha2(plain, 256).alias("_n_sha256"), pieces.alias("_n_pieces"))
    rows = cut(rows.withColumn("_n_keys", F.transform("_n_pieces", key)).drop("_n_pieces").withColumn("_n_row", F.monotonically_increasing_id()))
    held = rows.select("_n_row", F.size("_n_keys").alias("_n_blocks"), F.posexplode("_n_keys").alias("_n_at", "_n_key")).select("_n_row", "_n_blocks", "_n_at", "_n_key.*")
    named = cut(held.join(names, ["_n_k1", "_n_k2"]).select("_n_row", "_n_blocks", "_n_at", "_n_name"), narrow=True)
    done = named.where("_n_blocks = 1").select("_n_row", F.lit(0).alias("_n_levels"), "_n_name")
    left, level = named.where("_n_blocks > 1"), 0
    while not left.isEmpty():
        level += 1
        half = lambda side: F.max(F.when(F.col("_n_at") % 2 == side, F.col("_n_name")))
        pairs = left.groupBy("_n_row", "_n_blocks", F.floor(F.col("_n_at") / 2).cast("int").alias("_n_at")).agg(half(0).alias("_n_a"), F.coalesce(half(1), F.lit(NONE)).alias("_n_b"))
        names = _numbered(pairs.select("_n_a", "_n_b").distinct(), ["_n_a", "_n_b"])
        named = cut(pairs.join(names, ["_n_a", "_n_b"]).select("_n_row", F.ceil(F.col("_n_blocks") / 2).cast("int").alias("_n_blocks"), "_n_at", "_n_name"), narrow=True)
        done = done.union(named.where("_n_blocks = 1").select("_n_row", F.lit(level), "_n_name"))
        left = named.where("_n_blocks > 1")
    return rows.drop("_n_keys").join(done, "_n_row")


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """docs without the text, plus keep_id, group_size, kept, text_sha256, and the code points as _n_chars.

    Of equal texts the row with the most code points stays, then the least id (a null id last), then the first row.
    """
    named = name_documents(docs, text, **how)
    first = F.struct((-F.col("_n_chars")).alias("n"), F.col(doc_id).isNull().alias("z"), F.col(doc_id).alias("id"), F.col("_n_row").alias("r"))
    groups = cut(named.groupBy("_n_levels", "_n_name").agg(F.min(first).alias("_n_first"), F.count("*").alias("group_size")), narrow=True)
    found = named.join(groups, ["_n_levels", "_n_name"])
    found = found.withColumns({"keep_id": F.col("_n_first.id"), "kept": F.col("_n_first.r") == F.col("_n_row"), "text_sha256": F.col("_n_sha256")})
    return found.drop("_n_first", "_n_levels", "_n_name", "_n_sha256", "_n_row")


def op1_rows(docs: DataFrame) -> DataFrame:
    found = exact_groups(docs.select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256", F.col("_n_chars").alias("n_chars"))


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with their columns. A row that is there twice, with the same id and text, stays once."""
    stay = exact_groups(docs.select(doc_id, text), text, doc_id).where("kept")
    key = ["_n_id", "_n_sha256", "_n_chars"]
    stay = stay.select(F.xxhash64(doc_id).alias("_n_id"), F.col("text_sha256").alias("_n_sha256"), "_n_chars")
    plain = F.translate(text_of(text), ASCII_SPACE, "")
    marked = docs.withColumns({"_n_id": F.xxhash64(doc_id), "_n_sha256": F.sha2(plain, 256), "_n_chars": F.length(text_of(text)).cast("long")})
    return marked.join(stay, key, "left_semi").dropDuplicates(key).drop(*key)
