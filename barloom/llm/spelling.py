"""Spelling variants grouped without comparing words in pairs.

Words at an edit distance of one are found through what they share. Two words that differ in one replaced code point
are the same once that place is a wildcard: each word is in one group (position, prefix, suffix) a place. A group holds
at most one word for each character that may stand in the place (ALPHABET, 90 of them), so its size and its two words
of largest count are had from a bounded list, and a member takes "size - 1 neighbours, best other member" from it; no
pair is written out. Two words that differ in one inserted code point meet where a deletion of the longer one is itself
a word: deletions are joined to the vocabulary. Both kinds are combined a word at a time by a sum and a minimum, which
Spark aggregates before it shuffles.

Words travel as their place in code-point order, a number, not as text; the prefixes and suffixes of a word of more
than LONG code points as 128-bit sums of hashed (place, character), had for all places in one pass over the word. So a
word takes room in proportion to its length, not to its square, however long it is.

A word's form is its neighbour of largest count (ties: smallest in code-point order) if that count is FACTOR times its
own or more; roots follow forms. Counts grow by FACTOR at every step, so a chain has fewer steps than a count has
digits, and following is done by doubling: DOUBLINGS joins reach 2^DOUBLINGS steps.

Edge cases: null and empty texts have no words; a null doc_id is hashed as the empty string; repeated rows count each;
ties go by code points; very long texts are read whole; an empty table gives an empty result; extra columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

#: Code points of a word, and the characters that a place of a word can hold (lower-cased A-Z and the range after it).
RUN = r"[A-Za-zÀ-ÿ]"
ALPHABET = 26 + 64
LEAST_CHARS, LEAST_COUNT = 7, 2
#: A form is used at least so many times as often as the word.
FACTOR = 10
#: One of so many words of a document is misspelt on purpose by the contract of the query.
DROP_EACH = 31
#: Code points up to which prefixes and suffixes are compared as text.
LONG = 64
DOUBLINGS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def without(word: Column, place: Column) -> Column:
    """word without its code point at place, from 0."""
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word)))


def misspelt(run: Column, doc_id: Column) -> Column:
    """run, or run less one code point where the checksum of the document's id and the run is divisible by DROP_EACH."""
    checksum = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    return F.when(checksum % DROP_EACH == 0, without(run, (checksum % F.length(run)).cast("int"))).otherwise(run)


def runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, run): the lower-cased maximal runs of letters; shorter ones than least_chars are not extracted at all."""
    found = F.regexp_extract_all(F.translate(text_of(text), UPPER, LOWER), F.lit(RUN + "{%d,}+" % least_chars), F.lit(0))
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(found).alias("run"))


def vocabulary(words: DataFrame, word: str = "word", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n, rank) of the words that are long and frequent enough; ranks are in code-point order, with gaps.

    Ranks come from a sort by ranges, and the table is written, so that no later task sees others.
    """
    counted = words.where(F.length(word) >= least_chars).groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n"))
    frequent = written(counted.where(F.col("n") >= least_count))
    return written(frequent.orderBy("word").withColumn("rank", F.monotonically_increasing_id()))


def hashed(places: np.ndarray, characters: np.ndarray, seed: int) -> np.ndarray:
    x = places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + characters.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def sums(word: str) -> tuple[list, list, list]:
    """Twice 64 bits of word, of word with a wildcard at each place, and of word without the code point at each place."""
    characters = np.frombuffer(word.encode("utf-32-le"), dtype="<u4")
    places = np.arange(len(characters))
    own, wild, shorter = [], [], []
    for seed in (0x1B873593, 0x52DCE729):
        here, moved = hashed(places, characters, seed), hashed(places - 1, characters, seed)
        total, left, right = here.sum(dtype=np.uint64), np.cumsum(here) - here, np.cumsum(moved)
        own.append(int(total.astype(np.int64)))
        wild.append((total - here).view(np.int64))
        shorter.append((left + (right[-1] - right)).view(np.int64))
    return own, wild, shorter


#: kind 0: the word itself, 1: with a wildcard at place, 2: without the code point at place.
KEYS = "rank long, n long, kind int, place int, key1 long, key2 long"


def _long_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for word, rank, n in zip(*(batch.column(c).to_pylist() for c in ("word", "rank", "n")), strict=True):
            own, wild, shorter = sums(word)
            shorter = np.unique(np.stack(shorter, axis=1), axis=0)
            kinds = np.repeat([0, 1, 2], [1, len(word), len(shorter)]).astype(np.int32)
            places = np.concatenate([[0], np.arange(len(word)), np.zeros(len(shorter))]).astype(np.int32)
            keys = np.concatenate([np.array([own]), np.stack(wild, axis=1), shorter])
            columns = [np.full(len(kinds), rank), np.full(len(kinds), n), kinds, places, keys[:, 0], keys[:, 1]]
            for at in range(0, len(kinds), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in columns], [c.split()[0] for c in KEYS.split(", ")])


def long_keys(words: DataFrame) -> DataFrame:
    """The keys of words that have LONG code points or more, of those with exactly LONG only themselves (kind 0)."""
    found = words.where(F.length("word") >= LONG).select("word", "rank", "n", (F.length("word") > LONG).alias("longer"))
    own = found.select("rank", "longer").withColumnRenamed("rank", "own")
    keys = found.mapInArrow(_long_keys, KEYS)
    return keys.join(own, keys["rank"] == own["own"]).where("longer or kind = 0").drop("own", "longer")


def _best(n: str, rank: str) -> Column:
    """Orders by the largest count, then the smallest word: a minimum of these is the best."""
    return F.struct((-F.col(n)).alias("less"), F.col(rank).alias("near"))


def replacements(words: DataFrame, keys: DataFrame) -> DataFrame:
    """(rank, n_near, best): a row for each wildcard group with other members that a word is in."""
    place = F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("place")
    short = words.where(F.length("word") <= LONG).select("word", "n", "rank", place)
    short = short.select("place", F.substring("word", F.lit(1), F.col("place")).alias("prefix"), F.substring("word", F.col("place") + 2, F.length("word")).alias("suffix"), "n", "rank")
    keyed = short.union(keys.where("kind = 1").select("place", F.col("key1").cast("string"), F.col("key2").cast("string"), "n", "rank"))
    # at most ALPHABET members, as they differ in one character
    groups = keyed.groupBy("place", "prefix", "suffix").agg(F.sort_array(F.collect_list(_best("n", "rank"))).alias("members")).where(F.size("members") > 1)
    top, second = F.col("members")[0], F.col("members")[1]
    members = groups.select(F.explode("members.near").alias("rank"), F.size("members").alias("size"), top.alias("top"), second.alias("second"))
    return members.select("rank", (F.col("size") - 1).cast("long").alias("n_near"), F.when(F.col("top.near") == F.col("rank"), F.col("second")).otherwise(F.col("top")).alias("best"))


def indels(words: DataFrame, keys: DataFrame) -> DataFrame:
    """(rank, n_near, best): a row for either end of each deletion that is a word itself."""
    shorter = F.array_distinct(F.transform(F.sequence(F.lit(0), F.length("word") - 1), lambda p: without(F.col("word"), p)))
    own = F.col("rank").alias("rank_long"), F.col("n").alias("n_long")
    short = words.where(F.length("word") <= LONG).select(*own, F.explode(shorter).alias("word")).join(words.where(F.length("word") < LONG), "word").drop("word")
    long = keys.where("kind = 2").select(*own, "key1", "key2").join(keys.where("kind = 0").select("rank", "n", "key1", "key2"), ["key1", "key2"]).drop("key1", "key2")
    met = short.select("rank_long", "n_long", "rank", "n").union(long.select("rank_long", "n_long", "rank", "n"))
    either = F.array(F.struct("rank", _best("n_long", "rank_long").alias("best")), F.struct(F.col("rank_long").alias("rank"), _best("n", "rank").alias("best")))
    return met.select(F.explode(either).alias("one")).select("one.rank", F.lit(1).cast("long").alias("n_near"), "one.best")


def forms(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(rank, word, n, n_near, up, form_n) of a vocabulary: each word's number of near words, the rank and count of its form."""
    keys = written(long_keys(words))
    near = replacements(words, keys).union(indels(words, keys)).groupBy("rank").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    much = -F.col("best.less") >= factor * F.col("n")
    joined = words.join(near, "rank", "left")
    return joined.select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(much, F.col("best.near")).alias("up"), F.when(much, -F.col("best.less")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """(rank, top): of each word with a form the last one that following forms leads to."""
    up = found.where("up is not null").select("rank", "up")
    for _ in range(DOUBLINGS):
        up = written(up.join(up.select(F.col("rank").alias("up"), F.col("up").alias("top")), "up", "left").select("rank", F.coalesce("top", "up").alias("up")))
    return up.withColumnRenamed("up", "top")


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of words (word: one row an occurrence) that vocabulary() numbered."""
    found = written(forms(words, factor))
    named = found.join(roots(found), "rank", "left")
    for place, name in (("up", "form"), ("top", "root")):
        named = named.join(words.select(F.col("rank").alias(place), F.col("word").alias(name)), place, "left")
    return named.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op13_rows(docs: DataFrame) -> DataFrame:
    spelt = runs(docs.select("doc_id", "text")).select(misspelt(F.col("run"), F.col("doc_id")).alias("word"))
    return variants(vocabulary(spelt))
