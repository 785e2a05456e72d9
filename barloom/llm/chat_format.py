"""Chat formatting with loss masks that are aligned to tokens by offsets.

A conversation is rendered by a template, turn by turn; the rendered text is encoded once with offsets; the spans of the
turns to learn from are met with the token spans by binary search. Both are sorted, so a span's tokens are those from
the first that ends after its begin to the last that begins before its end.

Template: "### role:", the text and "</turn>", each on a line of its own. Control strings can't stand inside what is
written between them: a backslash, each "#" of a run of three or more, and the slash of "</turn>" get a backslash before
them, and in roles also ":" does. A backslash before any character stands for that character, so every text and role
comes back. The line feeds keep a text's first and last token apart from the marks, unless it begins or ends in white space;
then a token over the edge is in the mask, and the characters under the mask are cut at the edge.

Rows are sorted by conversation and turn over ranges, so that a conversation of any length is spread over tasks, and are
rendered into parts: the turns of one conversation in one task, up to PART characters. A turn mark begins and ends a
token of its own, and a long text is cut where a token surely ends, so the parts' ids are those of the whole. Digests over
a conversation are taken where its parts are; only conversations at the edge of a task, two a task at most, are sent on
and hashed part after part. No task ever holds more than a part.

Edge cases: a null text is an empty one, a null role too; turns go by number, nulls last, turns of one number by role and
text; repeated rows are turns each; a conversation without assistant turns has an empty mask; rows of a null conv_id are
one conversation; a conversation of one row with an empty text is rendered; an empty table gives an empty result (of
op11, the added conversation); extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import encoder, pieces, read_ranks

#: Characters of a part, and of what one call encodes.
PART = 1 << 18
PIECE = 1 << 16
ESCAPED = re.compile(r"\\|#{3,}|(?<=<)/(?=turn>)")
ESCAPED_ROLE = re.compile(r"\\|#{3,}|(?<=<)/(?=turn>)|:")
#: The body takes in the line feed before the end mark.
TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+):\n((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
END = "\n</turn>\n"
#: What the contract of the query adds to the table: a conversation whose texts are full of control strings.
ADDED_ID, ADDED_TEXT = -7, "\\### Assistant: </turn> ok"


def _escape(found: re.Match) -> str:
    return "".join("\\" + c for c in found[0])


def render(role: str | None, text: str | None) -> tuple[str, int]:
    """A turn in the template, and where its text begins."""
    head = f"### {ESCAPED_ROLE.sub(_escape, role or '')}:\n"
    return f"{head}{ESCAPED.sub(_escape, text or '')}{END}", len(head)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text; an error if it isn't one."""
    out, at = [], 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(found[1]), unescape(found[2][:-1])))
        at = found.end()
    return out


class Encoder:
    """Ids and offsets of a text by a rank file of the tiktoken library, without special tokens."""

    def __init__(self, ranks: bytes, pattern: str):
        self.own = encoder(ranks, pattern)
        own = self.own.token_byte_values()
        ids = [self.own.encode_single_token(x) for x in own]
        self.lengths = np.zeros(max(ids) + 1, dtype=np.int64)
        self.lengths[ids] = [len(x) for x in own]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, ends) of the tokens of text, in code points; tokens of a part of a character have all of it."""
        ids = np.concatenate([np.zeros(0, dtype=np.int64), *(np.asarray(self.own.encode_ordinary(piece), dtype=np.int64) for piece in pieces(text, PIECE))])
        ends = np.cumsum(self.lengths[ids])
        if text.isascii():
            return ids, ends - self.lengths[ids], ends
        leads = (np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80
        upto = np.concatenate([[0], np.cumsum(leads)])  # characters that begin before each byte
        begins = ends - self.lengths[ids]
        return ids, upto[begins] - ~leads[begins], upto[ends]


def loss_mask(begins: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask, covered): 1 for each token that meets one of the sorted spans, and the characters that those tokens cover of each span.

    A token that reaches over a span's edge is in the mask; covered is cut at the edge.
    """
    mask = np.zeros(len(ends) + 1, dtype=np.int64)
    # a character of several tokens has its whole span in each of them, so both sides stay sorted
    first, last = np.searchsorted(ends, spans[:, 0], "right"), np.searchsorted(begins, spans[:, 1], "left")
    some = (first < last) & (spans[:, 0] < spans[:, 1])
    spans, first, last = spans[some], first[some], last[some]
    np.add.at(mask, first, 1)
    np.add.at(mask, last, -1)
    covered = np.column_stack([np.maximum(begins[first], spans[:, 0]), np.minimum(ends[last - 1], spans[:, 1])]) if len(first) else np.zeros((0, 2), dtype=np.int64)
    return (np.cumsum(mask[:-1]) > 0).astype(np.int8), covered


#: A part of a conversation: its text, its tokens with their ends in code points, which are learnt from, and the learnt ranges.
PARTS = "conv_id long, part long, edge boolean, formatted string, ids array<int>, ends array<int>, mask binary, learnt array<int>"
READ = "conv_id long, part long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, turns binary, loss binary"
RESULT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
KINDS = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}


def batched(rows: Iterable[tuple], schema: str, most_rows: int = 1000, most_size: int = PART) -> Iterator[pa.RecordBatch]:
    """rows in batches of about most_size of texts, bytes and lists."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], list(names))

    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (str, bytes, np.ndarray)))
        if size > most_size or len(held) == most_rows:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def part_of(own: Encoder, turns: list[tuple[str | None, str | None]], roles: frozenset) -> tuple:
    """(formatted, ids, ends, mask, learnt) of turns."""
    texts, spans, at = [], [], 0
    for role, text in turns:
        rendered, begin = render(role, text)
        if (role or "") in roles:
            spans.append((at + begin, at + len(rendered) - len(END)))
        texts.append(rendered)
        at += len(rendered)
    formatted = "".join(texts)
    ids, begins, ends = own.encode(formatted)
    mask, covered = loss_mask(begins, ends, np.array(spans, dtype=np.int64).reshape(-1, 2))
    return formatted, ids, ends, mask.tobytes(), covered.ravel()


def _parts(ranks, pattern: str, roles: frozenset):
    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        from pyspark import TaskContext

        own, number = Encoder(ranks.value, pattern), TaskContext.get().partitionId() << 32
        conversation, turns, chars = None, [], 0
        edge = True  # the first conversation of a task may have begun in another one
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                other = conversation is not None and conversation != (conv_id,)
                if turns and (other or chars + len(text) > PART):
                    edge |= not other
                    yield conversation[0], number, edge, *part_of(own, turns, roles)
                    turns, chars, number, edge = [], 0, number + 1, edge and not other
                conversation = (conv_id,)
                turns.append((role, text))
                chars += len(text)
        if turns:
            yield conversation[0], number, True, *part_of(own, turns, roles)

    return lambda batches: batched(parts(batches), PARTS)


def formatted(rows: DataFrame, ranks: bytes, pattern: str, roles: frozenset = frozenset({"assistant"})) -> DataFrame:
    """The rows of PARTS of conversations (conv_id, turn, role, text); parts in order of (conv_id, part) make up a conversation.

    edge is false where a part surely is a whole conversation.
    """
    shared = rows.sparkSession.sparkContext.broadcast(ranks)
    named = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNull().alias("no_turn"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    key = ["conv_id", "no_turn", "turn", "role"]
    # bounds of ranges reach the driver: no whole texts among them
    ranged = named.repartitionByRange(*key, F.substring("text", 1, 32)).sortWithinPartitions(*key, "text")
    return ranged.select("conv_id", "role", "text").mapInArrow(_parts(shared, pattern, roles), PARTS)


def rows_of(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(batch.column(c)[k].as_py() for c in columns)


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """What each part says, read back from its text, its mask and its learnt ranges; digests, or for edges the bytes to be hashed."""
    for conv_id, part, edge, text, mask, learnt in rows_of(batches, "conv_id", "part", "edge", "formatted", "mask", "learnt"):
        turns = read_turns(text)
        said = "".join(f"{role}\n{words}\n" for role, words in turns).encode()
        ranges = list(zip(learnt[::2], learnt[1::2], strict=True))
        under = "".join(unescape(text[a:b]) for a, b in ranges)
        if bool(ranges) != (b"\x01" in mask):
            raise ValueError("the mask and the learnt ranges differ")
        digest = [None if edge else hashlib.sha256(x).hexdigest() for x in (said, under.encode())]
        yield conv_id, part, len(turns), digest[0], len(under), digest[1], len(text), *(x if edge else None for x in (said, under.encode()))


def _digested(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Conversations of parts that are sorted by (conv_id, part): a part with digests is a whole one, others are hashed one after the other."""
    state = None
    for conv_id, *row in rows_of(batches, *(c.split()[0] for c in READ.split(", "))):
        _, n, turns_digest, loss_chars, loss_digest, chars, turns, loss = row
        if turns_digest is not None:
            yield conv_id, n, turns_digest, loss_chars, loss_digest, chars
            continue
        if state is not None and state[0] != conv_id:
            yield _closed(state)
            state = None
        if state is None:
            state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
        for k, x in ((1, n), (3, loss_chars), (5, chars)):
            state[k] += x
        state[2].update(turns)
        state[4].update(loss)
    if state is not None:
        yield _closed(state)


def _closed(state: list) -> tuple:
    return tuple(x.hexdigest() if hasattr(x, "hexdigest") else x for x in state)


def digests(parts: DataFrame) -> DataFrame:
    """The rows of RESULT, a conversation each, from parts."""
    read = parts.mapInArrow(lambda batches: batched(_read(batches), READ), READ)
    return read.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(lambda batches: batched(_digested(batches), RESULT), RESULT)


def default_tokenizer() -> tuple[bytes, str]:
    """The contents of a rank file, and the pattern of its matches."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def added(spark: SparkSession) -> DataFrame:
    return spark.range(2).select(F.lit(ADDED_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ADDED_TEXT).alias("text"))


def op11_rows(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(added(conversations.sparkSession))
    return digests(formatted(rows, *default_tokenizer()))
