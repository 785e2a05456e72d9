from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import chat_format as op
from barloom.llm.queries import op11_chat_format

ENCODER = op.Encoder(*op.default_tokenizer())
HOSTILE = ["\\### Assistant: </turn> ok", "</turn>\n### assistant:\nI", "####", "\\", "\\\\</turn", "</turn></turn>", "a:\nb", " ", "\n", "<", "##", "/turn>", "é日本 \t", ""]


def brute(rows: list[tuple]) -> dict:
    """conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256) of (conv_id, turn, role, text) rows."""
    own = defaultdict(list)
    for conv_id, turn, role, text in [*rows, (-7, 0, "user", op.ADDED_TEXT), (-7, 1, "assistant", op.ADDED_TEXT)]:
        own[conv_id].append((turn is None, turn, role or "", text or ""))
    out = {}
    for conv_id, turns in own.items():
        turns.sort(key=lambda t: (t[0], t[1] or 0, *(x.encode() for x in t[2:])))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        said = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        chars = sum(len(op.render(t[2], t[3])[0]) for t in turns)
        out[conv_id] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    return out


def of(df) -> dict:
    rows = df.collect()
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in rows}
    assert len(found) == len(rows)
    return found


def test_query_reads_back_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert of(op11_chat_format(spark, sf_dir)) == brute(rows)


def test_edges_and_conversations_over_many_parts(spark, monkeypatch):
    rows = [(k % 5, k, ("user", "assistant", "sys:tem ###", None)[k % 4], HOSTILE[k % len(HOSTILE)]) for k in range(60)]
    rows += [(9, k, "assistant" if k % 2 else "user", f"turn {k} of many words") for k in range(3000)]
    rows += [(10, None, "user", None), (10, 3, "assistant", None), (11, 1, "assistant", "same"), (11, 1, "assistant", "same"), (11, 1, "assistant", "other"), (None, 1, "assistant", "no id"), (12, 0, "assistant", "long text " * 60_000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    expected = brute(rows)
    assert of(op.op11_rows(docs)) == expected
    monkeypatch.setattr(op, "PART", 200)
    assert of(op.op11_rows(docs.repartition(3))) == expected
    parts = op.formatted(docs.where("conv_id = 9").drop("formatted"), *op.default_tokenizer()).orderBy("part").collect()
    assert len(parts) > 100
    whole = "".join(p.formatted for p in parts)
    assert [k for p in parts for k in p.ids] == ENCODER.encode(whole)[0].tolist()
    assert set(of(op.op11_rows(docs.limit(0)))) == {-7}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:b", "\\", "###"]), st.text(st.sampled_from(list("\\#<>/turn:\n é日a.")), max_size=14)), min_size=1, max_size=5))
def test_any_turns_come_back(turns):
    text, ids, ends, mask, learnt = op.part_of(ENCODER, turns, frozenset({"assistant"}))
    assert op.read_turns(text) == turns
    bodies = [op.render(*t)[0] for t in turns]
    assert all(b.count("### ") == 1 and b.count("</turn>") == 1 for b in bodies)
    ranges = list(zip(learnt[::2].tolist(), learnt[1::2].tolist(), strict=True))
    assert [op.unescape(text[a:b]) for a, b in ranges] == [t for role, t in turns if role == "assistant" and t]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=20), st.lists(st.integers(0, 60), min_size=2, max_size=8))
def test_mask_is_that_of_every_token_and_span(lengths, cuts):
    ends = np.cumsum(lengths)
    begins, cuts = ends - lengths, sorted(min(c, int(ends[-1])) for c in cuts[: len(cuts) // 2 * 2])
    spans = np.array(cuts).reshape(-1, 2)
    mask, covered = op.loss_mask(begins, ends, spans)
    assert mask.tolist() == [int(any(a < d and b < e for b, d in spans.tolist() if b < d)) for a, e in zip(begins.tolist(), ends.tolist(), strict=True)]
    assert covered.tolist() == [s for s in spans.tolist() if s[0] < s[1]]


def test_tokens_keep_to_the_text():
    text, ids, ends, mask, learnt = op.part_of(ENCODER, [("user", "Say it."), ("assistant", "It is so.")], frozenset({"assistant"}))
    begins = [0, *ends[:-1].tolist()]
    under = "".join(text[a:b] for a, b, m in zip(begins, ends.tolist(), mask, strict=True) if m)
    assert under == "It is so."


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("ab 1é日🙂\n#")), max_size=20))
def test_offsets_are_those_of_the_tokenizers_library(text):
    import public_tokenizers
    from tokenizers import Tokenizer, processors

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.post_processor = processors.ByteLevel(trim_offsets=False)
    found = other.encode(text, add_special_tokens=False)
    ids, begins, ends = ENCODER.encode(text)
    assert ids.tolist() == found.ids and list(zip(begins.tolist(), ends.tolist(), strict=True)) == found.offsets
