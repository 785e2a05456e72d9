from __future__ import annotations

import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from barloom.llm import spelling as op
from barloom.llm.queries import op13_spelling


def counted(rows: list[tuple]) -> dict:
    words: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            words[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in words.items() if len(w) >= 7 and n >= 2}


def is_near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:p] + b[p + 1 :] == a for p in range(len(b)))


def brute(words: dict) -> dict:
    """word: (n, n_near, form, form_n, root) by comparing each word with each."""
    form, out = {}, {}
    for w, n in words.items():
        near = [v for v in words if abs(len(v) - len(w)) < 2 and is_near(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
        out[w] = (n, len(near))
    for w, (n, near) in out.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n, near, form[w], words.get(form[w]), root)
    return out


def of(df) -> dict:
    rows = df.collect()
    found = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(found) == len(rows)
    return found


def test_query_is_brute_force_over_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = of(op13_spelling(spark, sf_dir))
    assert found == brute(counted(rows))
    assert any(f[2] for f in found.values())


def test_chains_ties_and_edges(spark):
    text = " ".join(["letters"] * 2000 + ["letterz"] * 150 + ["lettterz"] * 12 + ["mettterz"] + ["letzers", "letxers"] * 11 + ["aaaaaaaa"] * 3 + ["aaaaaaa"] * 40 + ["àbcdefg ÀBCDEFG ×bcdefg"] * 2)
    rows = [(1, text), (None, "Letters mettterz"), (2, None), (3, ""), (1, text), (-4, "lettermen " * 60)]
    docs = spark.createDataFrame([(*r, "x", 9) for r in rows], "doc_id long, text string, word string, n long")
    expected = brute(counted(rows))
    assert of(op.op13_rows(docs)) == expected
    assert expected["mettterz"][4] == "letters" and expected["lettterz"][2] == "letterz"
    assert op.op13_rows(docs.limit(0)).count() == 0


def test_long_words(spark, monkeypatch):
    base = "abcdefghij" * 7
    kept = [base, base[:5] + "x" + base[6:], base[:69], base[1:], base + "z", base[:64], base[:63], base[:63] + "q", base[:62], "y" + base[:64], base[:30] + base[31:66]]
    words = [w for k, w in enumerate(kept) for _ in range(2 + 30 * (k % 3))]
    found = spark.createDataFrame([(w,) for w in words], "word string")
    assert of(op.variants(op.vocabulary(found))) == brute(dict(Counter(words)))
    monkeypatch.setattr(op, "LONG", 8)
    assert of(op.variants(op.vocabulary(found))) == brute(dict(Counter(words)))
    huge = spark.createDataFrame([(1, "ab" * 150_000), (2, "ab" * 150_000), (3, "ab" * 149_999 + "b"), (4, "ab" * 149_999 + "b")], "doc_id long, text string")
    assert op.op13_rows(huge).agg(F.sum("n_near")).first()[0] == 2
