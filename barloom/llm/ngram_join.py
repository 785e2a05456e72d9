"""N-gram Jaccard self-join by MinHash banding, verified on the full n-gram sets.

Words are runs of non-space characters (ASCII white space separates); an n-gram is WORDS of them in order, and a text of
fewer words has one n-gram, all its words. N-grams are known by 64-bit hashes. Rows of the same set are one class.

1. Each text is read once: its set gives a 128-bit class key and one hash for each band of its MinHash signature.
   Band and row counts follow from the threshold and the target recall (see banding).
2. One row a class goes on. Classes that share a band hash are a bucket. Buckets with the same members are one, the
   first, known by the count and 128 bits of the members' hashes; most copies of a pair meet in one bucket only.
3. The sets of n-grams of a bucket's classes are brought together, and its pairs are measured on the whole sets; a pair
   that shares several bands counts in the first of them. A bucket that is too large for one task is dealt into blocks
   by set size and a hash, each pair of blocks is one piece of work, and blocks whose sizes rule out the threshold are
   never paired. A piece returns one row for each member: its number of links, and the least member it is linked with
   over links.
4. Components of those rows are the groups.

No pair is ever a row, whatever a bucket's size, no link of a bucket is dropped, and pairs that share no band are never
measured, however long the chains of buckets are. A pair at the threshold shares no band with a probability of
1 - RECALL at most.

Edge cases: a null text is an empty one; texts without words are one class without links; repeated rows (same id and
text) are rows of one class, and where one of the group stays, one of them; extra columns are kept, internal ones
start with "_g_"; a null id is later than any other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, text_of

WORDS = 5
LEAST = 0.8
RECALL = 0.9999
#: Hashes that a signature may have at most.
HASHES = 100
#: N-grams and classes of a block, about; a piece of work is one block or two.
BLOCK_GRAMS = 1_000_000
BLOCK_CLASSES = 1_000
LAST_ID = (1 << 63) - 1

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def banding(least: float = LEAST, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which the bands needed for the recall at the threshold fit the hashes."""
    fits = []
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - least**rows))
        if bands * rows <= hashes:
            fits.append((bands, rows))
    return max(fits, key=lambda x: x[1])


def word_hashes(text: str) -> Column:
    """One long a word; the empty pieces of the split are left in and known by their hash."""
    return F.transform(F.split(text_of(text), r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(31))


def gram_sets(words: pa.ListArray, empty: int, size: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each row's word hashes."""
    bounds = words.offsets.to_numpy()
    flat = words.values.to_numpy(zero_copy_only=False).view(np.uint64)
    blank = np.uint64(empty % (1 << 64))
    for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
        own = flat[begin:end]
        own = own[own != blank]
        if not len(own):
            yield own
            continue
        n = min(size, len(own))
        grams = np.zeros(len(own) - n + 1, dtype=np.uint64)
        for k in range(n):
            grams = grams * _M1 + own[k : len(own) - n + 1 + k]
        yield np.unique(_mixed(grams * _M1 + np.uint64(n)))


def signature(grams: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The least of each seed's 32-bit hashes of the grams."""
    least = np.full(len(seeds), 0xFFFFFFFF, dtype=np.uint32)
    for begin in range(0, len(grams), 2048):
        x = grams[begin : begin + 2048].astype(np.uint32)[None, :] ^ seeds[:, None]
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        least = np.minimum(least, x.min(axis=1))
    return least


def band_hashes(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = least.reshape(bands, rows).astype(np.uint64)
    out = np.zeros(bands, dtype=np.uint64)
    for k in range(rows):
        out = (out ^ parts[:, k]) * _M1
    return _mixed(out).view(np.int64)


def _sketches(bands: int, rows: int, empty: int):
    seeds = np.random.default_rng(20).integers(0, 1 << 32, bands * rows, dtype=np.uint32)

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, hashes = [], [], []
            for grams in gram_sets(batch.column("_g_words"), empty):
                keys.append(np.frombuffer(hashlib.blake2b(grams.tobytes(), digest_size=16).digest(), dtype=np.int64))
                counts.append(len(grams))
                hashes.append(band_hashes(signature(grams, seeds), bands, rows) if len(grams) else np.zeros(0, dtype=np.int64))
            keys = np.array(keys, dtype=np.int64).reshape(-1, 2)
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, hashes)], dtype=np.int32), np.concatenate([np.zeros(0, dtype=np.int64), *hashes]))
            columns = [batch.column("_g_id"), batch.column("_g_none"), batch.column("_g_text"), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(np.array(counts, dtype=np.int64)), lists]
            yield pa.RecordBatch.from_arrays(columns, ["_g_id", "_g_none", "_g_text", "_g_k1", "_g_k2", "_g_n", "_g_bands"])

    return sketch


def _sets(empty: int):
    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(gram_sets(batch.column("_g_words"), empty))
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)], dtype=np.int32), np.concatenate([np.zeros(0, dtype=np.uint64), *found]).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_g_class", "_g_items", "_g_bands")), lists], ["_g_class", "_g_items", "_g_bands", "_g_grams"])

    return sets


def common_counts(owner: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
    """n x n counts of grams that two owners share. Rare grams are counted by their pairs, frequent ones by a product."""
    counts = np.zeros(n * n, dtype=np.float32)
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    begins = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, dtype=np.int64)
    held = np.diff(np.r_[begins, len(gram)])
    for m in np.unique(held[(held > 1) & (held <= 32)]):
        for part in np.array_split(begins[held == m], max(1, int((held == m).sum() * m * m) // 4_000_000)):
            own = owner[part[:, None] + np.arange(m)]
            codes = own[:, :, None] * n + own[:, None, :]
            counts += np.bincount(codes.ravel(), minlength=n * n).astype(np.float32)
    counts = counts.reshape(n, n)
    frequent = np.flatnonzero(held > 32)
    for part in np.array_split(frequent, max(1, len(frequent) // 2048 + 1)):
        if len(part):
            marks = np.zeros((n, len(part)), dtype=np.float32)
            for k, at in enumerate(part):
                marks[owner[begins[at] : begins[at] + held[at]], k] = 1
            counts += marks @ marks.T
    return counts


def linked(sets: list[np.ndarray], block: np.ndarray, across: bool, least: float = LEAST) -> np.ndarray:
    """Which pairs reach the threshold: of one block's members all; of two blocks' (across) those across, none if one is empty."""
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    common = common_counts(np.repeat(np.arange(len(sets)), sizes.astype(np.int64)), np.concatenate(sets), len(sets))
    links = common >= least * (sizes[:, None] + sizes[None, :] - common) - 1e-6
    links &= common > 0
    np.fill_diagonal(links, False)
    if across:
        links &= block[:, None] != block[None, :]
    return links


KEY = ["_g_root", "_g_left", "_g_right"]


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One batch for each piece of work, from batches that are sorted by KEY. Holds one piece at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in KEY], axis=1)
        cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)]
        for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            now = tuple(keys[begin])
            if held and now != last:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
                held = []
            held.append(batch.slice(begin, end - begin))
            last = now
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]


def lists_of(column: pa.ListArray) -> list[np.ndarray]:
    at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def met_before(bands: np.ndarray, band: int) -> np.ndarray:
    """Which pairs of rows share an earlier band than this one."""
    out = np.zeros((len(bands), len(bands)), dtype=bool)
    for own in bands[:, :band].T:
        out |= own[:, None] == own[None, :]
    return out


def _verified(least: float):
    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, ...]] = []

        def rows() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["_g_class", "_g_links", "_g_near"])

        for piece in pieces(batches):
            names, first = np.unique(piece.column("_g_class").to_numpy(), return_index=True)
            if len(names) < 2:
                continue
            sets, bands = lists_of(piece.column("_g_grams")), np.stack(lists_of(piece.column("_g_bands")))[first]
            left, right, band = (piece.column(c)[0].as_py() for c in ("_g_left", "_g_right", "_g_band"))
            second = piece.column("_g_second").to_numpy(zero_copy_only=False).astype(np.int64)[first]
            links = linked([sets[k] for k in first], second, left != right, least) & ~met_before(bands, band)
            root = np.arange(len(names))
            while True:  # the least member over links: a member takes the least of its neighbours' until none changes
                near = np.where(links, root[None, :], len(root)).min(axis=1, initial=len(root))
                new = np.minimum(root, near)
                new = new[new]
                if (new == root).all():
                    break
                root = new
            out.append((names, links.sum(axis=1), names[root]))
            if len(out) >= 1000:
                yield rows()
        if out:
            yield rows()

    return verify


def size_class(n: Column) -> Column:
    """Four classes between powers of two, one a number below 4."""
    digits = F.length(F.bin(n))
    return F.when(n < 4, n.cast("int") + 8).otherwise(digits * 4 + (F.floor(n / F.pow(F.lit(2.0), digits - 3)) % 4).cast("int"))


def class_distance(least: float) -> int:
    """How many classes the sizes of two sets may be apart that reach the Jaccard threshold; 2 for 0.8."""

    def of(n: int) -> int:
        digits = n.bit_length()
        return n + 8 if n < 4 else digits * 4 + (n >> (digits - 3)) % 4

    return max(of(n) - of(max(1, math.ceil(least * n - 1e-6))) for n in [*range(1, 257), *((4 + q) << k for q in range(4) for k in range(6, 30))])


def _items(members: DataFrame, least: float = LEAST) -> DataFrame:
    """Of members (root, band, class, n): _g_class and _g_items, the pieces of work in the bucket, as (left block, right block, is it of the right one)."""
    sized = members.withColumn("_g_size", size_class(F.col("_g_n")))
    blocks = F.greatest(F.ceil(F.sum("_g_n") / BLOCK_GRAMS), F.ceil(F.count("*") / BLOCK_CLASSES)).cast("int")
    sizes = sized.groupBy("_g_root", "_g_size").agg(F.sum("_g_n").alias("_g_sum"), F.count("*").alias("_g_count"), blocks.alias("_g_blocks"))
    whole = (F.sum("_g_sum") <= BLOCK_GRAMS) & (F.sum("_g_count") <= BLOCK_CLASSES)
    by_root = sizes.groupBy("_g_root").agg(whole.alias("_g_whole"), F.map_from_entries(F.collect_list(F.struct("_g_size", "_g_blocks"))).alias("_g_parts"))
    found = sized.join(by_root, "_g_root")  # a row a member of a bucket
    name = lambda size, part: (size.cast("long") * F.lit(1 << 32) + part).cast("long")
    own = name(F.col("_g_size"), F.pmod(F.xxhash64("_g_class"), F.element_at("_g_parts", F.col("_g_size"))))
    far = class_distance(least)
    near = F.filter(F.array(*((F.col("_g_size") + d) for d in range(-far, far + 1))), lambda s: F.map_contains_key("_g_parts", s))
    near = F.flatten(F.transform(near, lambda s: F.transform(F.sequence(F.lit(0), F.element_at("_g_parts", s) - 1), lambda q: name(s, q))))
    found = found.withColumn("_g_own", own)
    pieces = F.transform(near, lambda o: F.struct(F.least(F.col("_g_own"), o).alias("_g_left"), F.greatest(F.col("_g_own"), o).alias("_g_right"), (F.col("_g_own") > o).alias("_g_second")))
    alone = F.array(F.struct(F.lit(0).cast("long").alias("_g_left"), F.lit(0).cast("long").alias("_g_right"), F.lit(False).alias("_g_second")))
    return found.withColumn("_g_items", F.when(F.col("_g_whole"), alone).otherwise(pieces)).select("_g_class", F.struct(F.col("_g_root").alias("root"), F.col("_g_band").alias("band"), F.col("_g_items").alias("items")).alias("_g_items"))


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """A row for each row of docs: _g_id, _g_none (is the id null), _g_text (hash of the text), class_id, n_copies, n_links, group_id and kept.

    class_id is the least id of the rows of the same n-grams, n_links the number of other classes at the threshold,
    group_id the least id of all that hang together over links, kept whether the row is the one that stays of it.
    """
    spark = docs.sparkSession
    bands, rows = banding(least, recall)
    empty = spark.range(1).select(F.xxhash64(F.lit(""))).first()[0]
    keyed = docs.select(F.coalesce(F.col(doc_id), F.lit(LAST_ID)).cast("long").alias("_g_id"), F.col(doc_id).isNull().alias("_g_none"), F.xxhash64(text_of(text)).alias("_g_text"), word_hashes(text).alias("_g_words"))
    sketched = cut(keyed.mapInArrow(_sketches(bands, rows, empty), "_g_id long, _g_none boolean, _g_text long, _g_k1 long, _g_k2 long, _g_n long, _g_bands array<long>"))
    first = F.min(F.struct("_g_none", "_g_id", "_g_text")).alias("_g_first")
    classes = sketched.groupBy("_g_k1", "_g_k2", "_g_n").agg(first, F.count("*").alias("n_copies"), F.any_value("_g_bands").alias("_g_bands"))
    classes = cut(classes.withColumn("_g_class", F.monotonically_increasing_id()))
    banded = classes.select("_g_class", F.posexplode("_g_bands").alias("_g_band", "_g_hash"))
    members = [F.count("*").alias("_g_count"), F.min("_g_class").alias("_g_lead"), *(F.bit_xor(F.xxhash64(F.lit(k), "_g_class")).alias(f"_g_x{k}") for k in (1, 2))]
    buckets = banded.groupBy("_g_band", "_g_hash").agg(*members).where("_g_count > 1")
    buckets = buckets.groupBy("_g_count", "_g_lead", "_g_x1", "_g_x2").agg(F.min(F.struct("_g_band", "_g_hash")).alias("_g_bucket"))
    buckets = cut(buckets.select("_g_bucket.*").withColumn("_g_root", F.monotonically_increasing_id()), narrow=True)
    named = classes.select("_g_class", "_g_n", "_g_bands", F.col("_g_first._g_id").alias("_g_id"), F.col("_g_first._g_none").alias("_g_none"), F.col("_g_first._g_text").alias("_g_text"))
    members = cut(banded.join(buckets, ["_g_band", "_g_hash"]).join(classes.select("_g_class", "_g_n"), "_g_class").select("_g_root", "_g_band", "_g_class", "_g_n"), narrow=True)
    wanted = named.join(_items(members, least).groupBy("_g_class").agg(F.collect_list("_g_items").alias("_g_items")), "_g_class")  # at most a bucket a band
    texts = docs.select(F.coalesce(F.col(doc_id), F.lit(LAST_ID)).cast("long").alias("_g_id"), F.col(doc_id).isNull().alias("_g_none"), F.xxhash64(text_of(text)).alias("_g_text"), text_of(text).alias("_g_whole"))
    # of rows with one id and text one goes on: the join has brought them together, so this needs no other exchange
    texts = texts.join(wanted, ["_g_id", "_g_none", "_g_text"]).dropDuplicates(["_g_id", "_g_none", "_g_text"]).select("_g_class", "_g_items", "_g_bands", word_hashes("_g_whole").alias("_g_words"))
    item = "array<struct<root: long, band: int, items: array<struct<_g_left: long, _g_right: long, _g_second: boolean>>>>"
    sets = texts.mapInArrow(_sets(empty), f"_g_class long, _g_items {item}, _g_bands array<long>, _g_grams array<long>")
    work = sets.select("_g_class", "_g_grams", "_g_bands", F.explode("_g_items").alias("_g_item"))
    work = work.select("_g_class", "_g_grams", "_g_bands", F.col("_g_item.root").alias("_g_root"), F.col("_g_item.band").alias("_g_band"), F.explode("_g_item.items").alias("_g_item"))
    work = work.select("_g_root", "_g_band", "_g_item.*", "_g_class", "_g_grams", "_g_bands")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = work.repartition(parts, *KEY).sortWithinPartitions(*KEY).mapInArrow(_verified(least), "_g_class long, _g_links long, _g_near long")
    found = cut(found)
    links = found.groupBy("_g_class").agg(F.sum("_g_links").alias("n_links"))
    grouped = components(found, "_g_class", "_g_near").select(F.col("node").alias("_g_class"), F.col("root").alias("_g_root"))
    ends = classes.select("_g_class", "_g_first").join(grouped, "_g_class")
    ends = ends.join(cut(ends.groupBy("_g_root").agg(F.min("_g_first").alias("_g_stay")), narrow=True), "_g_root").select("_g_class", "_g_stay")
    placed = classes.drop("_g_bands").join(links, "_g_class", "left").join(ends, "_g_class", "left")
    placed = cut(placed.select("_g_k1", "_g_k2", "_g_n", "_g_first", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_g_stay", "_g_first").alias("_g_stay")), narrow=True)
    done = sketched.drop("_g_bands").join(placed, ["_g_k1", "_g_k2", "_g_n"])
    real = lambda s: F.when(~F.col(f"{s}._g_none"), F.col(f"{s}._g_id"))
    own = (F.col("_g_stay._g_none") == F.col("_g_none")) & (F.col("_g_stay._g_id") == F.col("_g_id")) & (F.col("_g_stay._g_text") == F.col("_g_text"))
    return done.select("_g_id", "_g_none", "_g_text", real("_g_first").alias("class_id"), "n_copies", "n_links", real("_g_stay").alias("group_id"), own.alias("kept"))


def op9_rows(docs: DataFrame) -> DataFrame:
    found = near_groups(docs.select("doc_id", "text"))
    return found.select(F.when(~F.col("_g_none"), F.col("_g_id")).alias("doc_id"), "class_id", "n_copies", "n_links", "group_id", "kept")


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each group, the least id; of rows with one id and text, one."""
    key = ["_g_id", "_g_none", "_g_text"]
    stay = near_groups(docs.select(doc_id, text), text, doc_id).where("kept").select(*key)
    marked = docs.withColumns({"_g_id": F.coalesce(F.col(doc_id), F.lit(LAST_ID)).cast("long"), "_g_none": F.col(doc_id).isNull(), "_g_text": F.xxhash64(text_of(text))})
    return marked.join(stay, key, "left_semi").dropDuplicates(key).drop(*key)
