from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import token_alignment as op
from barloom.llm.queries import op12_token_alignment

OWN = op.default_tokenizers().open()


def whole(text: str | None):
    """Groups and linked id pairs of a text encoded in one go, token by token; None if its bytes don't come back."""
    if not text:
        return None
    ((a, b),) = OWN.encode([" " + text])
    if not OWN.renders(" " + text, a, b):
        return None
    spans = []
    for ids, own in ((a.tolist(), OWN.a_bytes), (b.tolist(), OWN.b_bytes)):
        at, out = 0, []
        for k in ids:
            out.append((at, at + len(own[k]), k))
            at += len(own[k])
        spans.append(out)
    left, right = spans
    cuts = sorted({e for _, e, _ in left} & {e for _, e, _ in right})
    groups, begin = [], 0
    for cut in cuts:
        groups.append("|".join(",".join(str(k) for s, e, k in side if begin < e <= cut) for side in (left, right)))
        begin = cut
    links, first = [], 0
    for s, e, k in left:
        while right[first][1] <= s:
            first += 1
        links += [(k, r[2]) for r in right[first : first + e - s] if r[0] < e and r[1] > s]
    return len(left), len(right), ";".join(groups), len(groups), links


def brute(rows: list[tuple]) -> list[tuple]:
    found = [whole(text) for _, text in rows]
    counts = Counter(link for f in found if f for link in f[4])
    most: dict = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for (doc_id, _), f in zip(rows, found, strict=True):
        if f is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((doc_id, f[0], f[1], f[3], len(f[4]), sum(counts[x] == most[x[1]] for x in f[4]), sum(counts[x] for x in f[4]), hashlib.sha256(f[2].encode()).hexdigest()))
    return sorted(out, key=str)


def of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_is_brute_force_over_the_table(spark, sf_dir):
    rows = [(r.doc_id, r.text if len(r.text) < 6000 else None) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    # the reference walks each text in time of its groups squared: long ones are in the next test
    assert of(op.op12_rows(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert op12_token_alignment(spark, sf_dir).count() == len(rows)


def test_long_texts_by_pieces(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect() if len(r.text) >= 6000]
    assert texts
    pieces = op.Pieces(OWN)
    for text in texts:
        numbered = np.array(pieces.number(" " + text))
        pieces.learn()
        ((a, b),) = OWN.encode([" " + text])
        x = op.align(OWN.a_lengths[a], OWN.b_lengths[b])
        names = [f"{p}|{q}" for p, q in zip(op.joined_ids(a, x.a_groups, len(x.cuts)), op.joined_ids(b, x.b_groups, len(x.cuts)), strict=True)]
        assert ";".join(pieces.groups[k] for k in numbered) == ";".join(names)
        assert pieces.counts[numbered].sum(axis=0).tolist() == [len(numbered), len(a), len(b), len(x.cuts), len(x.left)]


def test_edges(spark, monkeypatch):
    texts = [None, "", " ", "  a  b ", "a\n b\t c", "<|endoftext|> <s> </s> x", "a▁b and more", "日本語のテキスト 日本語", "\x00 nul \x1c sep", "é" * 50, "no" * 3000, "tab\tand  two  spaces ", "x", "ﬁ ½ ü", "the cat the cat"] * 2
    rows = list(enumerate(texts)) + [(None, "the cat"), (0, "the cat")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, pos int")
    expected = brute(rows)
    assert of(op.op12_rows(docs)) == expected
    assert [r for r in expected if r[0] == 6] == [(6, 0, 0, 0, 0, 0, 0, "")]
    assert op.op12_rows(docs.limit(0)).count() == 0
    monkeypatch.setattr(op, "BLOCKS_A_SALT", 1)
    assert of(op.op12_rows(docs.repartition(6))) == expected


def test_small_chunks_and_a_short_memory():
    texts = ["the cat sat on the mat.", "", "the dog, the cat", "▁", "a" * 300, "the cat sat on the mat."]
    own, totals = op.Pieces(OWN), op.Totals()
    rows = [r for k, t in enumerate(texts) for r in op.chunk_rows(own, [t], [k], k, totals)]
    documents = [r for r in rows if r.column("kind")[0].as_py() == 0]
    assert [r.column("n_links")[0].as_py() for r in documents] == [len(w[4]) if (w := whole(t)) else 0 for t in texts]
    counts = Counter(a << 32 | b for t in texts if (w := whole(t)) for a, b in w[4])
    assert dict(zip(totals.pairs.tolist(), totals.counts.tolist(), strict=True)) == counts
    blocks = [r for r in rows if r.column("kind")[0].as_py() == 1]
    assert sum(op.numbers(x).sum() for r in blocks for x in r.column("times").to_pylist()) == sum(counts.values())


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list(" ab.,'\n\t’é1ßZ<|>　\xa0世\x1f")), max_size=40))
def test_pieces_are_the_whole(text):
    own = op.Pieces(OWN)
    numbered = own.number(" " + text)
    own.learn()
    found = whole(text)
    if found is None:
        assert not text or any(own.counts[k, 0] == 0 for k in numbered)
    else:
        assert ";".join(own.groups[k] for k in numbered) == found[2]
        assert [x for k in numbered for x in own.links[own.at[k] : own.at[k + 1]].tolist()] == [a << 32 | b for a, b in found[4]]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=12), st.integers(0, 10**6))
def test_alignment_by_hand(a, seed):
    rng, b, left = np.random.default_rng(seed), [], sum(a)
    while left:
        b.append(int(rng.integers(1, min(5, left) + 1)))
        left -= b[-1]
    x = op.align(np.array(a), np.array(b))
    spans = lambda n: [(sum(n[:k]), sum(n[: k + 1])) for k in range(len(n))]
    expected = [(i, j) for i, (s, e) in enumerate(spans(a)) for j, (t, f) in enumerate(spans(b)) if s < f and t < e]
    assert list(zip(x.left.tolist(), x.right.tolist(), strict=True)) == expected
