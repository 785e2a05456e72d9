"""Cross-tokenizer alignment: which tokens of one tokenizer stand over which of another, and how often over a corpus.

Both token sequences of a text are byte ranges: cumsum gives their ends, intersect1d the offsets where both end (these
cut the text into groups), searchsorted the group of each token and the range of B tokens that each A token overlaps,
and a repeat-based expansion all links, without a loop over tokens.

Texts are cut where both tokenizers surely end a token: before a single space between two characters that are no
space. Such a piece is encoded and aligned once for all its occurrences in a run of texts; a text's tokens, groups and
links are those of its pieces one after the other, and a test holds them against whole texts. Pieces are forgotten
when MOST_PIECES are known, so a worker's memory is bounded.

Counts over the corpus: a task sums its links by id pair, rows (pair, salt) are added up first and pairs then, so that
no frequent pair is one task's work. Pairs are then looked up where they were found: a chunk's links lie in one block
for each of SLICES slices of the pairs, the slices' counts are sorted to the front of those blocks (each slice SALTS
times, so that many tasks share its blocks) and every block is answered by binary search. A worker holds one slice of
the pairs and one block at a time. What the pairs take is bounded by the vocabularies, not by the corpus.

Edge cases: null and empty texts, and those that either tokenizer doesn't render as they are (A or B bytes differ), have
no tokens: zeros and an empty groups_sha256; a text without spaces is one piece, encoded whole; repeated rows count and
are returned each; pairs of the same count are both a B id's best; an empty table gives an empty result; extra columns
are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, text_of

#: Between a character that is no space and a single space before another one, both tokenizers end a token.
CUT = re.compile(r"(?<=\S)(?= \S)")
#: Characters of the texts of one chunk, and the documents of one at most (their places are 16-bit numbers).
CHUNK_CHARS, CHUNK_DOCS = 3_000_000, 1 << 16
#: Pieces that a worker remembers; longer ones than PIECE_CHARS are not joined with others to be encoded.
MOST_PIECES, PIECE_CHARS = 300_000, 200
#: Characters that are encoded by one call, if they are of several pieces.
CALL_CHARS = 20_000
SLICES, SALTS = 32, 16
#: Blocks that a task of the look-up answers at most, on average.
BLOCKS_A_SALT = 512


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


@dataclass
class Tokenizers:
    """A (a byte-level BPE of the tokenizers library) and B (a sentencepiece model), from the contents of their files."""

    a_json: str
    b_model: bytes

    def open(self) -> Tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(self.a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=self.b_model)
        own = byte_of_character()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(own[c] for c in token) if all(c in own for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in own]) for own in (self.a_bytes, self.b_bytes))
        return self

    def encode(self, spaced: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """A ids and B ids of texts that each begin with a space, which A encodes and B adds itself."""
        a = [x.ids for x in self.a.encode_batch(spaced, add_special_tokens=False)]
        b = self.b.encode([x[1:] for x in spaced], num_threads=1)
        return [(np.array(x, dtype=np.int64), np.array(y, dtype=np.int64)) for x, y in zip(a, b, strict=True)]

    def renders(self, spaced: str, a: np.ndarray, b: np.ndarray) -> bool:
        whole = spaced.encode()
        return whole == b"".join(map(self.a_bytes.__getitem__, a.tolist())) and whole == b"".join(map(self.b_bytes.__getitem__, b.tolist()))


def from_files(a_path: str, b_path: str) -> Tokenizers:
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return Tokenizers(a.read(), b.read())


def default_tokenizers() -> Tokenizers:
    import public_tokenizers

    return from_files(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@dataclass
class Alignment:
    """Tokens with their ends in bytes, the offsets where both sequences end, and the linked places of A and B."""

    a_ends: np.ndarray
    b_ends: np.ndarray
    cuts: np.ndarray
    a_groups: np.ndarray
    b_groups: np.ndarray
    left: np.ndarray
    right: np.ndarray


def align(a_lengths: np.ndarray, b_lengths: np.ndarray) -> Alignment:
    """Aligns two sequences of token lengths that cover the same bytes."""
    a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
    a_starts, b_starts = a_ends - a_lengths, b_ends - b_lengths
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=bool(a_lengths.all() and b_lengths.all()))
    first, last = np.searchsorted(b_ends, a_starts, "right"), np.searchsorted(b_starts, a_ends, "left")
    left = np.repeat(np.arange(len(a_ends)), last - first)
    begins = np.cumsum(last - first) - (last - first)
    right = np.arange(len(left)) - np.repeat(begins - first, last - first)
    return Alignment(a_ends, b_ends, cuts, np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends), left, right)


def joined_ids(ids: np.ndarray, groups: np.ndarray, n: int) -> list[str]:
    """The decimal ids of each of n groups, joined by commas; every group has some."""
    own, ends = list(map(str, ids.tolist())), np.searchsorted(groups, np.arange(n), "right")
    begins = np.concatenate([[0], ends[:-1]])
    out = list(map(own.__getitem__, begins.tolist()))
    several = np.flatnonzero(ends - begins > 1)
    for k, begin, end in zip(several.tolist(), begins[several].tolist(), ends[several].tolist(), strict=True):
        out[k] = ",".join(own[begin:end])
    return out


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a << 32) | b


def expanded(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[k], starts[k] + 1, ... of each range, one range after the other."""
    return np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


class Numbers(dict):
    """A number for each piece, in order of the first meeting."""

    def __missing__(self, piece: str) -> int:
        self[piece] = k = len(self)
        return k


@dataclass
class Pieces:
    """What a worker knows of the pieces it has met: a number for each, and its counts, groups and links by number."""

    own: Tokenizers
    numbers: Numbers = field(default_factory=Numbers)
    alone: set[str] = field(default_factory=set)
    groups: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.counts, self.at, self.links = np.zeros((0, 5), dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def number(self, text: str) -> list[int]:
        """The numbers of the pieces of a text with a space before it."""
        pieces = CUT.split(text)
        # the rule of CUT leaves only the first one's begin and the last one's end to be white space next to other pieces
        for piece in {pieces[0], pieces[-1]}:
            if piece[1:2].isspace() or piece[-1:].isspace() or len(piece) < 2:
                self.alone.add(piece)
        return list(map(self.numbers.__getitem__, pieces))

    def learn(self):
        """Encodes and aligns the pieces that were numbered since the last call."""
        calls, held, chars = [], [], 0
        for piece in itertools.islice(self.numbers, len(self.groups), None):
            alone = len(piece) > PIECE_CHARS or piece in self.alone
            if held and (alone or chars > CALL_CHARS):
                calls.append(held)
                held, chars = [], 0
            if alone:
                calls.append([piece])
            else:
                held.append(piece)
                chars += len(piece)
        calls += [held] if held else []
        found = []
        for pieces, (a, b) in zip(calls, self.own.encode(["".join(c) for c in calls]) if calls else [], strict=True):
            if len(pieces) > 1 and not self.own.renders("".join(pieces), a, b):
                found += [([piece], *self.own.encode([piece])[0]) for piece in pieces]
            else:
                found.append((pieces, a, b))
        rows, links = [self.counts], [self.links]
        for pieces, a, b in found:
            if not self.own.renders("".join(pieces), a, b):
                rows.append(np.zeros((1, 5), dtype=np.int64))
                self.groups.append("")
                continue
            x = align(self.own.a_lengths[a], self.own.b_lengths[b])
            ends = np.cumsum([len(p.encode()) for p in pieces])
            # every end of a piece is one of the cuts; so many tokens, groups and links end at or before it
            upto = np.stack([np.searchsorted(x.a_ends, ends, "right"), np.searchsorted(x.b_ends, ends, "right"), np.searchsorted(x.cuts, ends, "right")], axis=1)
            upto = np.column_stack([upto, np.searchsorted(x.left, upto[:, 0], "left")])
            if not np.isin(ends, x.cuts).all():
                raise RuntimeError("a token goes beyond a safe boundary")
            each = np.diff(upto, axis=0, prepend=0)
            rows.append(np.column_stack([np.ones(len(each), dtype=np.int64), each]))
            names = [f"{p}|{q}" for p, q in zip(joined_ids(a, x.a_groups, len(x.cuts)), joined_ids(b, x.b_groups, len(x.cuts)), strict=True)]
            to = upto[:, 2].tolist()
            self.groups += [";".join(names[p:q]) for p, q in zip([0, *to[:-1]], to, strict=True)]
            links.append(pair(a[x.left], b[x.right]))
        self.counts, self.links = np.concatenate(rows), np.concatenate(links)
        self.at = np.concatenate([[0], np.cumsum(self.counts[:, 4])])


#: Rows of three kinds: 0 a document, 1 a block (the links of a chunk that are in a slice), 2 pairs counted in a task.
FOUND = "kind int, doc_id long, chunk long, pos int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, slice int, pairs array<long>, counts array<long>, docs binary, times binary"
COLUMNS = [c.split()[0] for c in FOUND.split(", ")]
SCHEMA = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("chunk", pa.int64()), ("pos", pa.int32()), *((c, pa.int64()) for c in COLUMNS[4:8]), ("groups_sha256", pa.string()), ("slice", pa.int32()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("docs", pa.binary()), ("times", pa.binary())])


def table_of(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in SCHEMA], schema=SCHEMA)


def slice_of(pairs: np.ndarray) -> np.ndarray:
    """The slice of each pair; the same as slice_column()."""
    return ((pairs >> 32) * 7919 + (pairs & 0xFFFFFFFF)) % SLICES


def slice_column(pairs):
    return ((F.shiftright(pairs, 32) * 7919 + pairs.bitwiseAND(F.lit(0xFFFFFFFF))) % SLICES).cast("int")


def smallest(x: np.ndarray) -> bytes:
    """x with a first byte that tells its width: 1, 2 or 4 bytes a number."""
    width = 1 if not len(x) or x.max() < 1 << 8 else 2 if x.max() < 1 << 16 else 4
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def numbers(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype=f"<u{packed[0]}", offset=1).astype(np.int64)


def sliced(pairs: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(slice, begin, end) of pairs that are in order of slices."""
    slices = slice_of(pairs)
    begins = np.flatnonzero(np.diff(slices, prepend=-1))
    yield from zip(slices[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(pairs)], strict=True)


def by_slice(pairs: np.ndarray) -> np.ndarray:
    return np.lexsort((pairs, slice_of(pairs)))


class Totals:
    """Links of one task, summed by pair."""

    def __init__(self, most: int = 1_000_000):
        self.most, self.pairs, self.counts = most, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, pairs: np.ndarray, counts: np.ndarray):
        self.pairs, at = np.unique(np.concatenate([self.pairs, pairs]), return_inverse=True)
        both, self.counts = np.concatenate([self.counts, counts]), np.zeros(len(self.pairs), dtype=np.int64)
        np.add.at(self.counts, at, both)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for begin in range(0, len(self.pairs), 100_000):
            own = slice(begin, begin + 100_000)
            yield table_of(1, kind=[2], pairs=[self.pairs[own]], counts=[self.counts[own]])
        self.pairs, self.counts = self.pairs[:0], self.counts[:0]


def chunk_rows(pieces: Pieces, texts: list[str], doc_ids: list, chunk: int, totals: Totals) -> Iterator[pa.RecordBatch]:
    """The documents of one chunk and its blocks; adds the chunk's links to totals."""
    numbered = [np.array(pieces.number(" " + t) if t else [], dtype=np.int64) for t in texts]
    pieces.learn()
    sizes = np.array([len(x) for x in numbered])
    own, of = np.concatenate([*numbered, np.zeros(0, dtype=np.int64)]), np.repeat(np.arange(len(texts)), sizes)
    good = np.ones(len(texts), dtype=bool)
    good[of[pieces.counts[own, 0] == 0]] = False
    good &= sizes > 0
    stay = good[of]
    own, of = own[stay], of[stay]
    sums = np.zeros((len(texts), 5), dtype=np.int64)
    np.add.at(sums, of, pieces.counts[own])
    hashes = [hashlib.sha256(";".join(map(pieces.groups.__getitem__, x.tolist())).encode()).hexdigest() if ok else "" for x, ok in zip(numbered, good, strict=True)]
    yield table_of(len(texts), kind=[0] * len(texts), doc_id=doc_ids, chunk=[chunk] * len(texts), pos=np.arange(len(texts)), n_a=sums[:, 1], n_b=sums[:, 2], n_groups=sums[:, 3], n_links=sums[:, 4], groups_sha256=hashes)
    lengths = pieces.counts[own, 4]
    links, of = pieces.links[expanded(pieces.at[own], lengths)], np.repeat(of, lengths)
    if not len(links):
        return
    pairs, at = np.unique(links, return_inverse=True)
    order = by_slice(pairs)
    pairs, place = pairs[order], np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    # one entry a pair and document, in order of slices, pairs and documents
    entries, times = np.unique(place[at] << 16 | of, return_counts=True)
    begins = np.searchsorted(entries, np.arange(len(pairs) + 1) << 16)
    totals.add(pairs, np.add.reduceat(times, begins[:-1]))
    docs = entries & 0xFFFF
    cut = list(sliced(pairs))
    spans = [(begins[i], begins[j]) for _, i, j in cut]
    columns = {"pairs": [pairs[i:j] for _, i, j in cut], "counts": [np.diff(begins[i : j + 1]) for _, i, j in cut], "docs": [smallest(docs[i:j]) for i, j in spans], "times": [smallest(times[i:j]) for i, j in spans]}
    yield table_of(len(cut), kind=[1] * len(cut), chunk=[chunk] * len(cut), pos=[len(texts)] * len(cut), slice=[k for k, _, _ in cut], **columns)


def _found(models):
    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = models.value.open()
        pieces, totals, chunk = Pieces(own), Totals(), TaskContext.get().partitionId() << 32
        for batch in batches:
            at = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // CHUNK_CHARS
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
            for begin, end in ((p, q) for b, e in zip(edges, edges[1:], strict=False) for p in range(b, e, CHUNK_DOCS) for q in [min(p + CHUNK_DOCS, e)]):
                part = batch.slice(begin, end - begin)
                yield from chunk_rows(pieces, [t or "" for t in part.column("text").to_pylist()], part.column("doc_id").to_pylist(), chunk, totals)
                chunk += 1
                if len(pieces.numbers) > MOST_PIECES:
                    pieces = Pieces(own)
                if len(totals.pairs) > totals.most:
                    yield from totals.rows()
        yield from totals.rows()

    return found


def links(docs: DataFrame, tokenizers: Tokenizers | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of FOUND, written: what each document has, and its links by pair in blocks."""
    spark = docs.sparkSession
    models = spark.sparkContext.broadcast(tokenizers or default_tokenizers())
    path = f"{shared_folder(spark)}/links-{os.urandom(8).hex()}"
    docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(_found(models), FOUND).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(FOUND).parquet(path)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, a, b, n, best): how many links of the corpus each id pair has, and whether its B id has none with more."""
    each = found.where("kind = 2").select(F.explode(F.arrays_zip("pairs", "counts")).alias("one"), (F.spark_partition_id() % SALTS).alias("salt"))
    salted = each.groupBy(F.col("one.pairs").alias("pair"), "salt").agg(F.sum("one.counts").alias("n"))
    counted = salted.groupBy("pair").agg(F.sum("n").alias("n"))
    counted = counted.withColumns({"a": F.shiftright("pair", 32), "b": F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))})
    # a B id has at most one row for each id of A
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    return counted.join(most, "b").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


LOOK_UP = "slice int, salt long, kind int, chunk long, n_docs int, pair long, n long, best boolean, pairs array<long>, counts array<long>, docs binary, times binary"
ANSWER = "chunk long, n_best binary, count_sum binary"


def _looked_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in order of slice, salt and kind: a slice's pairs (kind 0), then the blocks that ask for them."""
    held, key, known = [], None, None
    for batch in batches:
        columns = {c: batch.column(c) for c in batch.schema.names}
        keys = np.stack([columns[c].to_numpy() for c in ("slice", "salt", "kind")], axis=1)
        edges = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
        for begin, end in zip([0, *edges], [*edges, len(keys)], strict=True):
            if begin == end:
                continue
            own, kind = tuple(keys[begin, :2]), keys[begin, 2]
            if own != key:
                held, key, known = [], own, None
            if kind == 0:
                held.append(np.stack([columns[c].slice(begin, end - begin).cast(pa.int64()).to_numpy() for c in ("pair", "n", "best")]))
                continue
            if known is None:
                known = np.concatenate(held, axis=1)
                known = known[:, np.argsort(known[0])]
                held = []
            for k in range(begin, end):
                pairs, counts = (columns[c][k].values.to_numpy() for c in ("pairs", "counts"))
                place = np.searchsorted(known[0], pairs)
                docs, times = (numbers(columns[c][k].as_py()) for c in ("docs", "times"))
                best, total = np.zeros((2, columns["n_docs"][k].as_py()), dtype=np.int64)
                np.add.at(best, docs, times * np.repeat(known[2][place], counts))
                np.add.at(total, docs, times * np.repeat(known[1][place], counts))
                yield pa.RecordBatch.from_arrays([columns["chunk"].slice(k, 1), pa.array([best.tobytes()]), pa.array([total.tobytes()])], [c.split()[0] for c in ANSWER.split(", ")])


def _summed(answers: pa.Table, docs: pa.Table) -> pa.Table:
    """The documents of one chunk (CHUNK_DOCS at most) with the sums of its answers (SLICES at most)."""
    docs = docs.sort_by("pos")
    for name in ("n_best", "count_sum"):
        own = np.zeros(docs.num_rows, dtype=np.int64)
        for packed in answers.column(name).to_pylist():
            own += np.frombuffer(packed, dtype=np.int64)
        docs = docs.append_column(name, pa.array(own))
    return docs.drop_columns(["chunk", "pos"])


def op12_rows(docs: DataFrame, tokenizers: Tokenizers | None = None) -> DataFrame:
    found = links(docs, tokenizers)
    blocks = found.where("kind = 1")
    n_salts = max(1, -(-blocks.count() // (SLICES * BLOCKS_A_SALT)))
    pairs = pair_counts(found).select(slice_column(F.col("pair")).alias("slice"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_salts - 1).cast("long"))).alias("salt"), F.lit(0).alias("kind"), "pair", "n", "best")
    asked = blocks.select("slice", F.pmod(F.xxhash64("chunk"), F.lit(n_salts)).alias("salt"), "kind", "chunk", F.col("pos").alias("n_docs"), "pairs", "counts", "docs", "times")
    both = pairs.unionByName(asked, allowMissingColumns=True).select(*(c.split()[0] for c in LOOK_UP.split(", ")))
    answers = both.repartition("slice", "salt").sortWithinPartitions("slice", "salt", "kind").mapInArrow(_looked_up, ANSWER)
    own = found.where("kind = 0").select("doc_id", "chunk", "pos", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return answers.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(_summed, schema).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
