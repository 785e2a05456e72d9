"""Substring dedup by sliding sentence spans.

A text is cut into sentences. From every sentence onward, and from every sentence backward, the shortest run of
consecutive sentences that is long enough is a span (SENTENCES sentences and WORDS words, or LONG words in fewer).
Runs in both directions reach both ends of any repeated passage. Spans of all documents are joined by their hash; the
first occurrence (least id, then least place) stays, and every sentence that any later occurrence covers is removed.

Only hashes are counted in the first pass, summed up before their shuffle; the second pass takes the spans whose hash
may occur more than once, which a bit map of fixed size tells (false hits only cost rows), and joins them by 128 bits
with their first occurrences, a join that AQE can split where one passage is in a third of all documents. No group of
occurrences is ever gathered in a task. A document's own removals, each counted once however often the row is repeated,
are one row for the last step.

Passages that begin or end inside a sentence are found word by word: a word goes if it is in any run of PASSAGE words
that stands earlier, in another document or in the same one. Each such run is known by an anchor, the least hash of its
runs of ANCHOR words, so that equal runs have equal anchors; the runs in a row that share the place of their anchor are a
stretch. The same two passes count anchors (about one in 13 words) and take the stretches whose anchor may be repeated.
A stretch that stands earlier as a whole is one row; only stretches of an anchor that is there in different ones are
taken apart, the first of each sort, and joined run by run. A run is known by its own 64 bits and the 64 of its anchor,
which come from different hashes. The text of the spans keeps whole sentences, the cut text is without both.

Edge cases: a null text stays null and has no sentences; texts of fewer sentences than a span have none; a text that
repeats itself loses its later occurrences; rows repeated with one id and text are one document and change alike; a
null id is later than any other; extra columns are kept, internal ones start with "_s_"; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

SENTENCES, WORDS, LONG = 3, 25, 40
#: Words of a repeated passage at least, and of an anchor; a passage has PASSAGE - ANCHOR + 1 runs to take its anchor from.
PASSAGE, ANCHOR = 50, 25
#: Bits of a bit map for each hash at least, up to MOST_BITS (64 MB); of one segment, which one task makes.
SPARSE, MOST_BITS, SEGMENT = 16, 1 << 29, 1 << 22
WORD = re.compile(r"\S+")
#: What ends a sentence: white space after a full stop, question or exclamation mark, and line ends.
BREAK = re.compile(r"[.!?]\s+|\n\s*")
#: The same for Java's expressions, whose \s is ASCII alone: what Python takes for white space, and the breaks without their mark.
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
JAVA_BREAK = rf"(?<=[.!?])[{SPACE}]+|\n[{SPACE}]*"
_B, _C, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95), np.uint64(0xBF58476D1CE4E5B9)


def sentences(text: str) -> list[tuple[int, int, int]]:
    """(begin, end, end with the white space that follows) of each sentence."""
    out, begin = [], 0
    for m in BREAK.finditer(text):
        end = m.start() + 1 if text[m.start()] != "\n" else begin + len(text[begin : m.start()].rstrip())
        if end > begin:
            out.append((begin, end, m.end()))
        begin = max(begin, m.end())
    if text[begin:].strip():
        out.append((begin, len(text), len(text)))
    return out


#: The same breaks without their mark, to count what they leave.
PARTED = re.compile(r"(?<=[.!?])\s+|\n\s*")


def sentence_number(text: str) -> int:
    """How many sentences() finds, without their places."""
    return sum(1 for part in PARTED.split(text) if part and not part.isspace())


def sentence_count(text: Column) -> Column:
    """How many sentences() finds, by built-in functions."""
    return F.size(F.filter(F.split(text, JAVA_BREAK), lambda part: part.rlike(f"[^{SPACE}]"))).cast("long")


#: Words that a worker remembers, some 30 MB of them.
KNOWN = 200_000


class Known(dict):
    """Words with the place of their hash in one list; two halves of 128 bits a word."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes: list[bytes] = []
        self.ends = bytearray()  # is there a sentence's end after the word

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh3_128_digest(word.encode("utf-8", "surrogatepass")))
        self.ends.append(word[-1] in ".!?")
        return at

    def forget(self) -> None:
        if len(self) > KNOWN:
            self.clear()
            self.hashes.clear()
            self.ends.clear()


class Portion:
    """The words and sentences of some texts: the hashes of the words, and where texts and sentences begin (in words, with the end)."""

    def __init__(self, texts: list[str], known: Known):
        flat: list[int] = []
        text_at, line_at = [0], []
        for text in texts:
            for line in text.split("\n"):
                flat.extend(map(known.__getitem__, line.split()))
                line_at.append(len(flat))
            text_at.append(len(flat))
        at = np.array(flat, dtype=np.int64)
        both = np.frombuffer(b"".join(known.hashes), dtype="<u8").reshape(-1, 2)[at]
        ends = np.zeros(len(at) + 1, dtype=bool)
        ends[1:] = np.frombuffer(bytes(known.ends), dtype=bool)[at]
        ends[line_at] = True
        ends[0] = True
        known.forget()
        self.words, self.others = both[:, 0], both[:, 1]
        self.text_at, self.sentence_at = np.array(text_at, dtype=np.int64), np.flatnonzero(ends)
        self.first = np.searchsorted(self.sentence_at, self.text_at)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M
    return x ^ (x >> np.uint64(29))


def spans(part: Portion, halves: int = 2) -> tuple[np.ndarray, ...]:
    """(two hashes, text, first and last sentence within the text) of the spans of a portion; halves=1 leaves out the second hash."""
    at, n = part.sentence_at, len(part.sentence_at) - 1
    owner = np.repeat(np.arange(len(part.first) - 1), np.diff(part.first))
    every = np.arange(n)
    ahead = np.maximum(np.searchsorted(at, at[:-1] + WORDS, "left") - 1, every + SENTENCES - 1)
    ahead = np.minimum(ahead, np.maximum(np.searchsorted(at, at[:-1] + LONG, "left") - 1, every))
    back = np.minimum(np.searchsorted(at, at[1:] - WORDS, "right") - 1, every - SENTENCES + 1)
    back = np.maximum(back, np.minimum(np.searchsorted(at, at[1:] - LONG, "right") - 1, every))
    inside, after = ahead < part.first[1:][owner], back >= part.first[:-1][owner]
    pairs = np.unique(np.concatenate([(every * n + ahead)[inside], (back * n + every)[after]]))
    begin, end = pairs // max(n, 1), pairs % max(n, 1) + 1
    # a sentence's keys are sums of its words' hashes by their places, a run's keys the same of its sentences
    place = np.arange(len(part.words)) - np.repeat(at[:-1], np.diff(at))
    keys = []
    for words, base in ((part.words, _B), (part.others, _C))[:halves]:
        powers = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(max(n, int(place.max(initial=0)) + 1), base)]))
        undo = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n, np.uint64(pow(int(base), -1, 1 << 64)))]))
        own = _mixed(np.add.reduceat(words * powers[place], at[:-1]) + np.diff(at).astype(np.uint64) * _M) if n else words[:0]
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(own * powers[:n], dtype=np.uint64)])
        keys.append(_mixed((sums[end] - sums[begin]) * undo[begin] + (end - begin).astype(np.uint64) * _M))
    text = owner[begin] if n else begin
    return keys[0], keys[-1], text, begin - part.first[text], end - 1 - part.first[text]


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size words, by sums of runs of powers of two."""
    n = len(words) - size + 1
    if n < 1:
        return words[:0]
    out, twice, done = np.zeros(n, dtype=np.uint64), words, 0  # twice: runs of `have` words
    for k in range(size.bit_length()):
        have = 1 << k
        power = np.uint64(pow(int(_B), have, 1 << 64))
        if size & have:
            out = out * power + twice[done : done + n]
            done += have
        if size >> (k + 1):
            twice = twice[:-have] * power + twice[have:]
    return _mixed(out)


def least_places(x: np.ndarray, size: int) -> np.ndarray:
    """The place of the first least value in each window of size."""
    place, have = np.arange(len(x)), 1
    while have < size and len(x):
        step = min(have, size - have)
        place = np.where(x[step:] < x[:-step], place[step:], place[:-step])
        x, have = np.minimum(x[step:], x[:-step]), have + step
    return place


def anchors(part: Portion) -> tuple[np.ndarray, ...]:
    """(text, first word, anchor's hash, anchor's place) of each run of PASSAGE words in a text, the hash of the words' second half."""
    short = run_hashes(part.others, ANCHOR)
    n = len(part.words) - PASSAGE + 1
    if n < 1:
        none = np.zeros(0, dtype=np.int64)
        return none, none, short[:0], none
    owner = np.repeat(np.arange(len(part.text_at) - 1), np.diff(part.text_at))
    at = np.flatnonzero(owner[:n] == owner[PASSAGE - 1 :])
    place = least_places(short, PASSAGE - ANCHOR + 1)[at]
    return owner[at], at, short[place], place


def passages(part: Portion) -> tuple[np.ndarray, ...]:
    """(text, first word within the text, hash, anchor's hash, anchor's place) of each run of PASSAGE words."""
    owner, at, anchor, place = anchors(part)
    return owner, at - part.text_at[:-1][owner], run_hashes(part.words, PASSAGE)[at], anchor, place


def portions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about two million characters of text, or one longer text, so that a worker holds few words at a time."""
    for batch in batches:
        at = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("_s_text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)) >> 21
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if end > begin:
                yield batch.slice(begin, end - begin)


def _counts(words: bool):
    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The hashes of spans and anchors in a portion, each with its count."""
        known = Known()
        for batch in portions(batches):
            part = Portion(batch.column("_s_text").to_pylist(), known)
            found = [spans(part, 1)[0]]
            if words:
                *_, anchor, place = anchors(part)
                found.append(anchor[np.unique(place, return_index=True)[1]])
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["_s_hash", "_s_count"])

    return counts


def _segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each segment that has some of the bits. A task has all of a segment, and MOST_BITS at most."""
    own: dict[int, np.ndarray] = {}
    for batch in batches:
        bits = batch.column("bit").to_numpy()
        segments = bits // SEGMENT
        for k in np.unique(segments).tolist():
            bit = bits[segments == k] % SEGMENT
            np.bitwise_or.at(own.setdefault(k, np.zeros(SEGMENT // 8, dtype=np.uint8)), bit >> 3, np.uint8(128) >> (bit & 7).astype(np.uint8))
    if own:
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array([x.tobytes() for x in own.values()], pa.binary())], ["segment", "bits"])


class BitMap:
    """Marks among hashes: what it does not mark is surely not there. Its size follows their count, SPARSE bits or more for each."""

    def __init__(self, hashes: DataFrame):
        hashes = written(hashes.toDF("_s_hash"))
        n = hashes.count()
        self.bits = min(MOST_BITS, max(SEGMENT, 1 << (SPARSE * n).bit_length()))
        placed = hashes.select(F.col("_s_hash").bitwiseAND(F.lit(self.bits - 1)).alias("bit"))
        # a segment is made by one task and comes here once; together they have MOST_BITS at most
        ranged = placed.repartition(F.floor(F.col("bit") / SEGMENT))
        marks = np.zeros(self.bits // 8, dtype=np.uint8)
        for row in ranged.mapInArrow(_segments, "segment long, bits binary").collect():
            at = row.segment * (SEGMENT // 8)
            marks[at : at + SEGMENT // 8] = np.frombuffer(row.bits, dtype=np.uint8)
        self.shared = hashes.sparkSession.sparkContext.broadcast(marks.tobytes())

    def marked(self, hashes: np.ndarray) -> np.ndarray:
        bit = hashes.view(np.int64) & np.int64(self.bits - 1)
        marks = np.frombuffer(self.shared.value, dtype=np.uint8)[bit >> 3]
        return (marks >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)


#: Spans and stretches of one table. h1, h2: of a span its key, of a stretch its anchor and the sum of its runs' hashes.
FOUND = "_s_none boolean, _s_id long, _s_key long, _s_h1 long, _s_h2 long, _s_begin int, _s_end int, _s_runs array<long>"


def _occurrences(bits, words: bool):
    def rows(batch: pa.RecordBatch, text: np.ndarray, *columns) -> pa.RecordBatch:
        names = [c.split()[0] for c in FOUND.split(", ")]
        own = [batch.column(c).take(pa.array(text)) for c in names[:3]]
        h1, h2, begin, end, runs = columns
        return pa.RecordBatch.from_arrays([*own, *(pa.array(h.view(np.int64)) for h in (h1, h2)), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), runs], names)

    def occurrences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for batch in portions(batches):
            part = Portion(batch.column("_s_text").to_pylist(), known)
            h1, h2, text, begin, end = spans(part)
            own = bits.marked(h1)
            yield rows(batch, text[own], h1[own], h2[own], begin[own], end[own], pa.nulls(int(own.sum()), pa.list_(pa.int64())))
            if not words:
                continue
            text, begin, whole, anchor, place = passages(part)
            own = bits.marked(anchor)
            text, begin, whole, anchor, place = (x[own] for x in (text, begin, whole, anchor, place))
            starts = np.flatnonzero(np.diff(place, prepend=-1))
            if not len(starts):
                continue
            lengths = np.diff(np.r_[starts, len(whole)])
            nth = (np.arange(len(whole)) - np.repeat(starts, lengths)).astype(np.uint64)
            sums = _mixed(np.add.reduceat(_mixed(whole + nth * _B), starts) + lengths.astype(np.uint64) * _M)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(whole)].astype(np.int32)), pa.array(whole.view(np.int64)))
            yield rows(batch, text[starts], anchor[starts], sums, begin[starts], begin[starts] + lengths - 1, lists)

    return occurrences


KEY = ["_s_none", "_s_id", "_s_key"]


def only_marked(rows: DataFrame, bits, key: list[str]) -> DataFrame:
    """The rows whose key may be among those of the bit map: less to shuffle before a join with them."""

    def marked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bits.marked(batch.column("_s_hash").to_numpy())))

    hashed = rows.withColumn("_s_hash", F.xxhash64(*key))
    return hashed.mapInArrow(marked, hashed.schema).drop("_s_hash")


def key_bits(rows: DataFrame, key: list[str]):
    return BitMap(rows.select(F.xxhash64(*key)))


def place() -> Column:
    return F.struct(*KEY, "_s_begin")


def firsts(rows: DataFrame, key: list[str]) -> DataFrame:
    """The first place of each key that is there more than once."""
    found = rows.groupBy(*key).agg(F.min(place()).alias("_s_first"), F.count("*").alias("_s_count"))
    return written(found.where("_s_count > 1").drop("_s_count"))


def later_stretches(stretches: DataFrame) -> DataFrame:
    """(KEY, _s_begin, _s_end): from which to which word runs of PASSAGE words begin that stand earlier."""
    sort = ["_s_h1", "_s_h2"]
    kinds = stretches.groupBy(*sort).agg(F.min(F.struct(*KEY, "_s_begin", "_s_end")).alias("_s_first"), F.count("*").alias("_s_count"))
    kinds = written(kinds)
    again = kinds.where("_s_count > 1").select(*sort, F.struct(*(F.col(f"_s_first.{c}") for c in (*KEY, "_s_begin"))).alias("_s_first"))
    later = stretches.join(again, sort).where(place() != F.col("_s_first")).select(*KEY, "_s_begin", "_s_end")
    different = kinds.groupBy("_s_h1").agg(F.count("*").alias("_s_count")).where("_s_count > 1").select("_s_h1")
    heads = kinds.join(different, "_s_h1").select(*sort, F.col("_s_first.*")).select(*sort, *KEY, "_s_begin")
    one = [*sort, *KEY, "_s_begin"]
    runs = only_marked(stretches, key_bits(heads, one), one).join(heads, one).dropDuplicates(one)
    runs = runs.select(*KEY, "_s_h1", "_s_begin", F.posexplode("_s_runs").alias("_s_at", "_s_run")).select(*KEY, "_s_h1", "_s_run", (F.col("_s_begin") + F.col("_s_at")).alias("_s_begin"))
    single = runs.join(firsts(runs, ["_s_h1", "_s_run"]), ["_s_h1", "_s_run"]).where(place() != F.col("_s_first"))
    return later.union(single.select(*KEY, "_s_begin", F.col("_s_begin").alias("_s_end")))


#: Which characters are white space to Python's expressions; above the last of them none is.
IS_SPACE = np.array([chr(k).isspace() for k in range(0x3002)])


def word_starts(text: str) -> np.ndarray:
    """Where the matches of WORD begin."""
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"), 0x3001)
    space = IS_SPACE[codes]
    return np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(space) else np.zeros(0, dtype=np.int64)


def cut_text(text: str, gone: list[tuple[int, int]], later: list) -> tuple[str, int]:
    """The text without the gone ranges and the runs of PASSAGE words that begin in the later ranges of words, and how many words went."""
    starts = word_starts(text)
    edge = np.zeros(len(starts) + 1, dtype=np.int64)
    for own in later:
        edge[own["_s_begin"]] += 1
        edge[own["_s_end"] + PASSAGE] -= 1
    for sign, places in zip((1, -1), zip(*gone, strict=True), strict=False):
        np.add.at(edge, np.searchsorted(starts, places), sign)
    out = np.cumsum(edge[:-1]) > 0
    turns = np.flatnonzero(np.diff(np.concatenate([[True], out, [True]]).astype(np.int8)))  # words kept begin and end
    places = [*starts.tolist(), len(text)]
    lead = text[: places[0]] if len(out) and not out[0] else ""
    return (lead + "".join(text[places[a] : places[b]] for a, b in turns.reshape(-1, 2))).rstrip(), int(out.sum())


def _removed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        texts, counts, gone, cuts, words = [], [], [], [], []
        for text, covers, later in zip(*(batch.column(c).to_pylist() for c in ("_s_text", "_s_spans", "_s_words")), strict=True):
            if not covers:
                counts.append(sentence_number(text or ""))
                texts.append(text)
                gone.append(0)
                own = cut_text(text, [], later) if later else (text, 0)
                cuts.append(own[0])
                words.append(own[1])
                continue
            places = sentences(text)
            counts.append(len(places))
            edge = np.zeros(len(places) + 1, dtype=np.int64)
            for own in covers:
                edge[own["_s_begin"]] += 1
                edge[own["_s_end"] + 1] -= 1
            covered = np.cumsum(edge[:-1]) > 0
            gone.append(int(covered.sum()))
            texts.append("".join(text[a:c] for (a, _, c), out in zip(places, covered, strict=True) if not out).rstrip())
            own = cut_text(text, [(a, c) for (a, _, c), out in zip(places, covered, strict=True) if out], later or [])
            cuts.append(own[0])
            words.append(own[1])
        at = batch.schema.get_field_index("_s_text")
        done = batch.set_column(at, "_s_text", pa.array(texts, pa.string())).drop_columns(["_s_spans", "_s_words"])
        done = done.append_column("_s_cut", pa.array(cuts, pa.string())).append_column("_s_cut_words", pa.array(words, pa.int64()))
        yield done.append_column("_s_sentences", pa.array(counts, pa.int64())).append_column("_s_gone", pa.array(gone, pa.int64()))


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: bool = False) -> DataFrame:
    """docs with the text cleaned, and _s_sentences (how many it had) and _s_gone (how many were removed).

    words: also _s_cut, the text without the words of repeated passages, too, and _s_cut_words (how many words went).
    """
    names: dict[str, Column] = {"_s_none": F.col(doc_id).isNull(), "_s_id": F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), "_s_key": F.xxhash64(text_of(text))}
    keyed = docs.select(*(c.alias(n) for n, c in names.items()), text_of(text).alias("_s_text"))
    counts = keyed.select("_s_text").mapInArrow(_counts(words), "_s_hash long, _s_count long").groupBy("_s_hash").agg(F.sum("_s_count").alias("_s_count"))
    bits = BitMap(counts.where("_s_count > 1").select("_s_hash"))
    found = written(keyed.mapInArrow(_occurrences(bits, words), FOUND))
    own = found.where("_s_runs is null").select(*KEY, "_s_h1", "_s_h2", "_s_begin", "_s_end")
    later = own.join(firsts(own, ["_s_h1", "_s_h2"]), ["_s_h1", "_s_h2"]).where(place() != F.col("_s_first")).select(*KEY, "_s_begin", "_s_end", F.lit(True).alias("_s_is_span"))
    if words:
        later = later.union(later_stretches(found.where("_s_runs is not null")).withColumn("_s_is_span", F.lit(False)))
    listed = lambda c: F.collect_set(F.when(c, F.struct("_s_begin", "_s_end")))
    gone = later.groupBy(*KEY).agg(listed(F.col("_s_is_span")).alias("_s_spans"), listed(~F.col("_s_is_span")).alias("_s_words"))
    others = [c for c in docs.columns if c != text]
    gone = written(gone)
    changed = key_bits(gone, KEY)

    @F.arrow_udf("boolean")
    def is_marked(hashes: pa.Array) -> pa.Array:
        return pa.array(changed.marked(hashes.to_numpy(zero_copy_only=False)))

    named = docs.withColumns(names).withColumn("_s_hit", is_marked(F.xxhash64(*(names[k] for k in KEY))))
    columns = [*others, F.col(text).alias("_s_text"), "_s_spans", "_s_words"]
    marked = named.where("_s_hit").join(gone, KEY, "left").select(*columns)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text]
    done = marked.mapInArrow(_removed, ", ".join([*kept, "_s_text string", "_s_cut string", "_s_cut_words long", "_s_sentences long", "_s_gone long"]))
    # the rows that the bit map rules out stay as they are, without a Python worker for their texts
    zero, whole = F.lit(0).cast("long"), F.col(text)
    same = named.where("not _s_hit").select(*others, whole.alias("_s_text"), whole.alias("_s_cut"), zero.alias("_s_cut_words"), sentence_count(text_of(text)).alias("_s_sentences"), zero.alias("_s_gone"))
    done = done.union(same)
    return done.select(*(F.col("_s_text").alias(text) if c == text else c for c in docs.columns), "_s_sentences", "_s_gone", *(["_s_cut_words", "_s_cut"] if words else []))


def op5_rows(docs: DataFrame) -> DataFrame:
    found = without_repeats(docs.select("doc_id", "text"), words=True)
    return found.select("doc_id", F.col("_s_sentences").alias("n_sentences"), F.col("_s_gone").alias("n_removed"), (F.col("_s_gone") > 0).alias("changed"), "text", F.col("_s_cut_words").alias("n_cut_words"), F.col("_s_cut").alias("cut_text"))
