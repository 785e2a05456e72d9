from __future__ import annotations

import random

from pyspark.sql import functions as F

from barloom.llm import sentence_spans as op
from barloom.llm.queries import op5_sentence_spans


def runs(text: str) -> set:
    """Spans by trying every run in both directions."""
    parts = [tuple(text[a:b].split()) for a, b, _ in op.sentences(text)]
    n = len(parts)

    def enough(i, j):
        words = sum(map(len, parts[i : j + 1]))
        return (j - i + 1 >= op.SENTENCES and words >= op.WORDS) or words >= op.LONG

    out = set()
    for i in range(n):
        out |= {(i, j, tuple(parts[i : j + 1])) for j in [next((j for j in range(i, n) if enough(i, j)), None)] if j is not None}
        out |= {(j, i, tuple(parts[j : i + 1])) for j in [next((j for j in range(i, -1, -1) if enough(j, i)), None)] if j is not None}
    return out


def brute(rows: list[tuple]) -> dict:
    first: dict = {}
    for doc_id, text in sorted(rows):
        for i, j, words in sorted(runs(text or "")):
            first.setdefault(words, (doc_id, i))
            first[words] = min(first[words], (doc_id, i))
    out = {}
    for doc_id, text in rows:
        gone = set()
        for i, j, words in runs(text or ""):
            if first[words] != (doc_id, i):
                gone |= set(range(i, j + 1))
        places = op.sentences(text or "")
        clean = "".join(text[a:c] for k, (a, _, c) in enumerate(places) if k not in gone).rstrip() if gone else text
        out[doc_id] = (len(places), len(gone), clean)
    return out


def result(df) -> dict:
    return {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in df.collect()}


def test_query_against_all_runs(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert result(op5_sentence_spans(spark, sf_dir)) == brute(rows)


def test_planted_passages_and_edges(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(10**6)}"
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    passage = " ".join(sentence(rng.randrange(3, 14)) for _ in range(8))
    lone = sentence(60)
    rows = [(k, f"{sentence(9)} {sentence(5)} {passage} {sentence(7)}\n{sentence(20)}") for k in range(1, 30)]
    rows += [(40, f"{sentence(4)}\n{lone}\n{sentence(4)}"), (41, f"{sentence(9)}\n{lone}"), (50, None), (51, ""), (52, "Short. Text."), (53, "Short. Text.")]
    rows += [(60, " ".join([sentence(8)] * 1) + " Same again and again here." * 400)]
    found = result(op.op5_rows(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_removed int")))
    expected = brute(rows)
    assert found == expected
    assert passage in found[1][2] and all(found[k][1] == 8 for k in range(2, 30))
    assert lone in found[40][2] and lone not in found[41][2] and found[53][1] == 0
    assert op.op5_rows(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"Number {k} of a long list of words that goes on and on." for k in range(9))
    rows = [(1, text, "a"), (1, text, "a"), (None, text, "b"), (2, text, None)]
    df = op.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    found = sorted((r.doc_id or 99, r._s_gone) for r in df.collect())
    assert found == [(1, 0), (1, 0), (2, 9), (99, 9)]
    assert df.columns == ["doc_id", "text", "source", "_s_sentences", "_s_gone"]


def kept_words(rows: list[tuple], cleaned: dict) -> dict:
    """The words that stay: not in a removed sentence, and in no run of PASSAGE words that stands earlier."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        words = (text or "").split()
        gone = [False] * len(words)
        for k in range(len(words) - op.PASSAGE + 1):
            run = tuple(words[k : k + op.PASSAGE])
            if run in seen:
                gone[k : k + op.PASSAGE] = [True] * op.PASSAGE
            seen.add(run)
        n = 0
        for a, b, out_too in cleaned[doc_id]:
            m = len(text[a:b].split())
            gone[n : n + m] = [True] * m if out_too else gone[n : n + m]
            n += m
        out[doc_id] = [w for w, g in zip(words, gone, strict=True) if not g]
    return out


def removed_sentences(rows: list[tuple]) -> dict:
    first: dict = {}
    for doc_id, text in sorted(rows):
        for i, _, words in sorted(runs(text or "")):
            first[words] = min(first.get(words, (doc_id, i)), (doc_id, i))
    out = {}
    for doc_id, text in rows:
        gone = {k for i, j, words in runs(text or "") if first[words] != (doc_id, i) for k in range(i, j + 1)}
        out[doc_id] = [(a, b, k in gone) for k, (a, b, _) in enumerate(op.sentences(text or ""))]
    return out


def test_passages_that_begin_and_end_inside_sentences(spark, sf_dir):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    some = lambda n: " ".join(word() for _ in range(n))
    long = some(55)  # no whole sentence in it
    mixed = f"{some(20)}. {some(12)}. {some(25)}"  # one whole sentence
    left, right = some(30), some(30)
    rows = [(1, f"{some(9)} {long} {some(8)}."), (2, f"{some(30)}\n{some(3)} {long} {some(4)}. {some(5)}."), (3, f"{some(4)} {mixed} {some(6)}."), (4, f"{some(7)} {mixed} {some(2)}.")]
    rows += [(5, f"{some(9)} {left} {some(9)}"), (6, f"{some(5)} {left} {right} {some(5)}"), (7, f" {some(3)} {left} {right} {some(2)}"), (8, None), (9, ""), (10, f"{left} {some(40)}")]
    rows += [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = {r.doc_id: r for r in op.op5_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = kept_words(rows, removed_sentences(rows))
    assert {k: (r.cut_text or "").split() for k, r in found.items()} == expected
    assert all(r.n_cut_words == len((t or "").split()) - len(expected[k]) for k, t in rows for r in [found[k]])
    assert [found[k].n_cut_words for k in (1, 2, 3, 4, 5, 6, 7, 10)] == [0, 55, 0, 57, 0, 0, 60, 0]
    assert found[8].cut_text is None and found[1].cut_text == rows[0][1] and found[2].n_removed == 0


def test_sentence_count_as_in_python(spark):
    marks = [".", "!", "?", "a", "b.", " ", "\n", "\t", "\r", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\u200b", "\u00e9"]
    rng = random.Random(8)
    texts = ["", " ", "\n", "One. Two! Three", *("".join(rng.choice(marks) for _ in range(rng.randrange(1, 30))) for _ in range(3000))]
    found = spark.createDataFrame([(t,) for t in texts], "text string").select("text", op.sentence_count(F.col("text")).alias("n")).collect()
    assert [r.n for r in found] == [len(op.sentences(r.text)) for r in found]


def test_word_starts_are_those_of_the_expression():
    for text in ("", " ", "a", "a b", "  a\x1c\xa0b\u3000c\u3001d 🙂\ue000 x\n", "ab\x85\u2028c\u200bd "):
        assert op.word_starts(text).tolist() == [m.start() for m in op.WORD.finditer(text)]


def test_sentences_are_counted_without_their_places(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    for text in [*texts, "", " ", ". . .", "a.\n\n b! c?d. ", "\n", "x\x85. y.\u3000z", "...", "a .\n. b"]:
        assert op.sentence_number(text) == len(op.sentences(text)), text[:80]
