"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line, cut after every word whose checksum ends in PIECE_BITS zero bits (or after MOST words), so that an
edit changes the pieces around it and no others; a repeated piece counts with its number. Its 64-bit digest is added to
HASHES cells of a sketch, each cell a count, a sum of digests and a sum of check values. Two sketches subtract cell by
cell, what the two texts share cancels, and peeling recovers the digests that differ: a cell whose sums fit one digest
is pure, that digest is taken out of its other cells, and so on. Where peeling sticks, both sketches are built anew at
twice the size. The likeness of two fingerprints is the share of digests in common.

Texts are dealt once, by ranges of (is the id null, id, hash of the text), so that the next document stands in the same
partition; the first document of each range goes to the range before it too. The bounds of the ranges are quantiles of a
random sample of SAMPLED keys a range; they only balance the tasks, and rows of one id, or without any, are spread over
ranges like others. Within a task, sketches of a batch are peeled abreast.

Edge cases: a null text is an empty one, whose sketch is empty and equals any other empty one; documents with one id
are in the order of their text's hash; null ids come last and stay null; a single document is its own next one; extra
columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: A piece ends after one word in 2^PIECE_BITS, about, and has MOST words at most.
PIECE_BITS, MOST = 4, 64
HASHES = 3
#: Cells of a fingerprint; retries double this until the difference peels.
CELLS = 30
#: Keys sampled for each range of ids.
SAMPLED = 50
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def digests(text: str, ends: dict[str, bool] | None = None) -> np.ndarray:
    """Distinct 64-bit digests of the paragraphs; a paragraph's second occurrence has another one. ends: known words."""
    ends = {} if ends is None else ends
    seen: dict[str, int] = {}
    out = []

    def add(words: list[str]) -> None:
        piece = " ".join(words)
        nth = seen[piece] = seen.get(piece, 0) + 1
        out.append(hashlib.blake2b(piece.encode(), digest_size=8, salt=nth.to_bytes(8, "little")).digest())

    for line in text.split("\n"):
        words = line.split()
        begin = 0
        for k, word in enumerate(words):
            end = ends.get(word)
            if end is None:
                end = ends[word] = not zlib.crc32(word.encode()) & ((1 << PIECE_BITS) - 1)
            if end or k - begin + 1 == MOST:
                add(words[begin : k + 1])
                begin = k + 1
        if begin < len(words):
            add(words[begin:])
    if len(ends) > 50_000:
        ends.clear()
    return np.frombuffer(b"".join(out), dtype="<u8")


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))) * _M1
        x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def places(keys: np.ndarray, cells: int) -> np.ndarray:
    """HASHES cells for each key, one in each third of the sketch."""
    part = cells // HASHES
    return np.stack([(mixed(keys, cells * 8 + j) % np.uint64(part)).astype(np.int64) + j * part for j in range(HASHES)])


def checks(keys: np.ndarray) -> np.ndarray:
    return mixed(keys, 5) & np.uint64(0xFFFFFFFF)


class Sketches:
    """Sketches of some sets of keys, one row each."""

    def __init__(self, count: np.ndarray, total: np.ndarray, check: np.ndarray):
        self.count, self.total, self.check = count, total, check

    @classmethod
    def of(cls, keys: np.ndarray, owner: np.ndarray, n: int, cells: int) -> Sketches:
        out = cls(np.zeros(n * cells, dtype=np.int64), np.zeros(n * cells, dtype=np.uint64), np.zeros(n * cells, dtype=np.uint64))
        out._add(owner * cells + places(keys, cells), keys, np.ones(len(keys), dtype=np.int64))
        for name in ("count", "total", "check"):
            setattr(out, name, getattr(out, name).reshape(n, cells))
        return out

    def _add(self, at: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> None:
        """Add keys (or take them out, where the sign is negative) at the flat cells, one row of cells a hash."""
        wide = sign.astype(np.uint64)
        with np.errstate(over="ignore"):
            for own in at:
                np.add.at(self.count.reshape(-1), own, sign)
                np.add.at(self.total.reshape(-1), own, keys * wide)
                np.add.at(self.check.reshape(-1), own, checks(keys) * wide)

    def minus(self, other: Sketches) -> Sketches:
        return Sketches(self.count - other.count, self.total - other.total, self.check - other.check)

    def peel(self) -> tuple[np.ndarray, np.ndarray]:
        """(how many keys only the left set has, did all cells empty), a row each. The sketches are used up."""
        n, cells = self.count.shape
        only = np.zeros(n, dtype=np.int64)
        flat = [x.reshape(-1) for x in (self.count, self.total, self.check)]
        live = np.flatnonzero(np.abs(flat[0]) == 1)
        while len(live):
            sign = flat[0][live]
            with np.errstate(over="ignore"):
                keys = flat[1][live] * sign.astype(np.uint64)
                pure = (np.abs(sign) == 1) & (checks(keys) == flat[2][live] * sign.astype(np.uint64))
            row, keys, sign = live[pure] // cells, keys[pure], sign[pure]
            if not len(keys):
                break
            _, first = np.unique(np.stack([row.astype(np.uint64), keys]), axis=1, return_index=True)
            row, keys, sign = row[first], keys[first], sign[first]
            np.add.at(only, row[sign > 0], 1)
            at = row * cells + places(keys, cells)
            self._add(at, keys, -sign)
            live = np.unique(at)
        return only, ~((self.count != 0).any(axis=1) | (self.total != 0).any(axis=1))

    def text(self) -> list[str]:
        packed = np.concatenate([self.count.astype("<u4").view(np.uint8), self.total.astype("<u8").view(np.uint8), self.check.astype("<u4").view(np.uint8)], axis=1)
        return [base64.b64encode(row.tobytes()).decode() for row in packed]


def flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, dtype=np.uint64), *sets]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])


def likeness(left: list[np.ndarray], right: list[np.ndarray], cells: int = CELLS) -> np.ndarray:
    """The share of digests in common, by subtracting and peeling; rows whose peeling sticks go on at twice the size."""
    out, todo = np.ones(len(left)), np.arange(len(left))
    sizes = np.array([[len(a), len(b)] for a, b in zip(left, right, strict=True)]).reshape(-1, 2)
    while len(todo):
        a, b = (Sketches.of(*flat([s[k] for k in todo]), len(todo), cells) for s in (left, right))
        only, done = a.minus(b).peel()
        good = todo[done]
        common = sizes[good, 0] - only[done]
        union = sizes[good].sum(axis=1) - common
        out[good] = np.where(union > 0, common / np.maximum(union, 1), 1.0)
        todo, cells = todo[~done], cells * 2
    return out


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    ends: dict[str, bool] = {}

    def rows(ids: list, texts: list[str]) -> pa.RecordBatch:
        """texts has one more than ids: what follows the last."""
        changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        own, other = [digests(t, ends) for t in texts], [digests(t, ends) for t in changed]
        prints = [Sketches.of(*flat(s), len(ids), CELLS).text() for s in (own[:-1], other)]
        columns = [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array(changed, pa.string()), *map(pa.array, prints)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(likeness(own[:-1], other)), pa.array(likeness(own[:-1], own[1:]))], names)

    ids, texts, held, ended = [], [], 0, False
    for batch in batches:
        for doc_id, text, tail in zip(*(batch.column(c).to_pylist() for c in ("_f_id", "_f_text", "_f_tail")), strict=True):
            if ended:
                continue
            texts.append(text)
            held += len(text)
            ended = tail == 1
            if not ended:
                ids.append(doc_id)
            if len(texts) > 500 or (held > 1 << 22 and len(texts) > 1):
                yield rows(ids[: len(texts) - 1], texts)
                ids, texts, held = ids[len(texts) - 1 :], texts[-1:], len(texts[-1])
    if len(texts) > 1:
        yield rows(ids, texts)


def range_bounds(keyed: DataFrame, parts: int) -> list[tuple]:
    """At most parts - 1 keys (is the id null, id, hash) that cut a sample of the rows into even parts."""
    have = keyed.count()
    share = min(1.0, SAMPLED * parts / max(1, have))
    sample = sorted(tuple(r) for r in keyed.select(*KEY).sample(share, seed=11).collect())
    return sorted({sample[len(sample) * k // parts] for k in range(1, parts)}) if sample else []


KEY = ["_f_none", "_f_at", "_f_key"]


def range_of(bounds: list[tuple]) -> Column:
    """How many bounds are below the row's key: first among every g-th bound, then among those of that stretch."""
    row = F.struct(*KEY)
    literal = lambda b: F.struct(F.lit(b[0]).alias("_f_none"), F.lit(b[1]).cast("long").alias("_f_at"), F.lit(b[2]).cast("long").alias("_f_key"))
    below = lambda a: F.size(F.filter(a, lambda b: b < row))
    if not bounds:
        return F.lit(0)
    g = math.isqrt(len(bounds)) + 1
    stretches = [bounds[k : k + g] for k in range(0, len(bounds), g)]
    at = below(F.array(*(literal(s[-1]) for s in stretches[:-1]))) if len(stretches) > 1 else F.lit(0)
    return at * g + below(F.element_at(F.array(*(F.array(*map(literal, s)) for s in stretches)), at + 1))


def with_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """_f_id, _f_text, _f_tail in order of id within each partition; the last row (_f_tail 1) of a partition is only what follows."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = F.col(doc_id).cast("long")
    keyed = docs.select(own.alias("_f_id"), own.isNull().alias("_f_none"), F.coalesce(own, F.lit(0)).alias("_f_at"), text_of(text).alias("_f_text")).withColumn("_f_key", F.xxhash64("_f_text"))
    bounds = range_bounds(keyed, parts) if parts > 1 else []
    keyed = keyed.withColumn("_f_range", range_of(bounds))
    heads = keyed.groupBy("_f_range").agg(F.min(F.struct(*KEY)).alias("h")).orderBy("_f_range").collect()  # a row a range
    to = [(*h["h"], heads[k - 1]["_f_range"]) for k, h in enumerate(heads)]
    wanted = spark.createDataFrame(to or [(False, 0, 0, 0)], "_f_none boolean, _f_at long, _f_key long, _f_to int")
    tails = keyed.join(F.broadcast(wanted), KEY).select(F.col("_f_to").alias("_f_range"), "_f_id", *KEY, "_f_text", F.lit(1).alias("_f_tail"))
    both = keyed.select("_f_range", "_f_id", *KEY, "_f_text", F.lit(0).alias("_f_tail")).union(tails)
    return both.repartitionById(len(bounds) + 1, F.col("_f_range")).sortWithinPartitions("_f_tail", *KEY).select("_f_id", "_f_text", "_f_tail")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next."""
    schema = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, text, doc_id).mapInArrow(_fingerprints, schema)


def op6_rows(docs: DataFrame) -> DataFrame:
    found = fingerprints(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
