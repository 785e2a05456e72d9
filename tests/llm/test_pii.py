from __future__ import annotations

import hashlib
import math
import random
import re
import time

import pytest

from barloom.llm import pii as op
from barloom.llm.queries import op3_pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def valid(kind: str, m: str) -> bool:
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def base(text: str | None) -> tuple[list[int], str]:
    found = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if valid(k, m[0])] for k, p in PATTERNS.items()}
    joined = ",".join(s for spans in found.values() for s in spans)
    return [len(s) for s in found.values()], joined


def check(found, texts: dict) -> None:
    for r in found:
        counts, joined = base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, (r.doc_id, joined, r.spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert r.spans.startswith(joined)


def test_query_against_patterns(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    found = op3_pii(spark, sf_dir).collect()
    assert len(found) == len(texts)
    check(found, texts)


def test_edges(spark):
    texts = {
        1: None,
        2: "",
        3: "é a@b.com@c.org x.y%z@d-e.co.uk. a@b a.@b.c_d@e.fr",
        4: "1.2.3.4.5.6.7.8 999.1.1.1 0001.00255.3.4 1.2.3 01.256.1.1 7777777777.1.1.1",
        5: "4111 1111 1111 1111, 4111-1111-1111-1112 41111111111111110000 4111111111111111",
        6: "+1 (469) 555-0306 +12 +1234567 +123456789012345678 ++1 22 33 44 55)",
        7: "a" * 20_000 + "@" + "9" * 20_000 + " +1" + " " * 20_000,
        8: "𝒳 mail: 𝒳a@b.io, 10.0.0.1",
        9: " ".join(f"user{k}@mail{k}.example.com 10.0.0.{k % 256}" for k in range(500)),
    }
    rows = [(k, t, "clash") for k, t in texts.items()] + [(9, texts[9], "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = op.op3_rows(docs).collect()
    assert len(found) == len(rows)
    check(found, texts)
    assert op.op3_rows(docs.limit(0)).count() == 0
    assert op.sanitised(docs).columns == docs.columns


def test_telling_terms(spark):
    filler = [f"plain text number{k} about weather and roads" for k in range(200)]
    rows = [f"part{k} of a letter from Hildegarda who writes as hg@mail.org on day{k} near roads" for k in range(4)]
    copies = ["only once copied Rarename wrote xx@mail.org here"] * 5
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(filler + rows + copies)], "doc_id long, text string")
    found = {r.doc_id: r for r in op.op3_rows(docs).collect()}
    text = rows[0]
    at = text.index("Hildegarda")
    assert f"removed:{at}:{at + 10}" in found[200].spans
    assert "roads" not in [text[int(a) : int(b)] for _, a, b in (s.split(":") for s in found[200].spans.split(","))]
    assert found[205].n_terms == 0, "copies of one passage are one piece of evidence"
    assert found[0].spans == ""
    clean = {r.doc_id: r.text for r in op.sanitised(docs).collect()}
    assert "Hildegarda" not in clean[200] and "[EMAIL]" in clean[200] and clean[0] == filler[0]


def class_terms(texts: list[str]) -> dict[str, float]:
    """Disclosure of each telling term of a class, counted a document at a time."""
    total, held, rows = len(texts), {}, []
    for text in texts:
        for w in set(re.findall(r"\w{3,}", text.lower())):
            held[w] = held.get(w, 0) + 1
        values = [(k, m[0]) for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m[0])]
        inside = set(re.findall(r"\w{3,}", " ".join(v for _, v in values).lower()))
        rows.append((values, set(re.findall(r"\w{3,}", text.lower())) - inside))
    out: dict[str, float] = {}
    for kind in (None, *PATTERNS):
        own = [(min(f"{k}:{v}" for k, v in values if kind in (None, k)), words) for values, words in rows if any(kind in (None, k) for k, _ in values)]
        rate = len(own) / total
        ones: dict[str, set] = {}
        docs: dict[str, int] = {}
        for one, words in own:
            for w in words:
                ones.setdefault(w, set()).add(one)
                docs[w] = docs.get(w, 0) + 1
        for w, found in ones.items():
            if len(found) < op.CLASS_SUPPORT or rate >= 1:
                continue
            n, z = len(found) + held[w] - docs[w], op.DEVIATIONS
            share = len(found) / n
            low = (share + z * z / (2 * n) - z * math.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
            d = math.log2(low / rate) / -math.log2(rate)
            if d >= op.GENERALISE:
                out[w] = max(d, out.get(w, 0))
    return out


def planted() -> list[str]:
    """400 documents: Corvalin stands with most different cards and hardly elsewhere, Dorwen with mails, common words everywhere."""
    rng = random.Random(6)
    words = [f"word{k}" for k in range(120)]
    texts = []
    for k in range(400):
        own = rng.choices(words, k=30)
        if k % 10 == 0:
            own[5:5] = [f"user{k}@mail.example.com", "Dorwen"]
        if k % 16 == 3:
            own[20:20] = ["corvalin", f"+1 (425) 555-{1000 + k}"]
        if k in (50, 51):
            own[3:3] = ["Corvalin"]
        texts.append(" ".join(own))
    return texts + ["Seldomly copied passage of zz@mail.org with its own rarest words"] * 30


@pytest.mark.parametrize("few", [1000, 0])
def test_terms_of_classes_against_counting(spark, monkeypatch, few):
    monkeypatch.setattr(op, "FEW", few)
    texts = planted()
    told = class_terms([*texts, texts[0], texts[0]])
    assert {"dorwen", "corvalin"} <= set(told) and not {"seldomly", "rarest", "word3"} & set(told)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (0, texts[0])], "doc_id long, text string")
    found = op.op3_rows(docs).collect()
    assert sum(r.n_terms for r in found) > 0
    for r in found:
        text = texts[r.doc_id or 0]
        _, joined = base(text)
        inside = [range(int(a), int(b)) for _, a, b in (x.split(":") for x in joined.split(",") if x)]
        hand = [("removed" if told[m[0].lower()] >= op.REMOVE else "general", m.start(), m.end()) for m in re.finditer(r"\w{3,}", text) if m[0].lower() in told and not any(m.start() in x for x in inside)]
        assert r.spans == ",".join([joined] * bool(joined) + [f"{k}:{a}:{b}" for k, a, b in sorted(hand)]), r.doc_id
    clean = {r.doc_id: r.text for r in op.sanitised(docs).collect()}
    assert "orvalin" not in clean[50] and "Dorwen" not in clean[10]


def test_query_tells_terms(spark):
    """On sf0.1 the corpus itself tells the word that stands with secrets; whole words only, and none of the words of prose."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = op3_pii(spark, "/root/testdata/sf0.1").where("n_terms > 0").join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) > 100
    terms = {r.text[int(a) : int(b)].lower() for r in rows for kind, a, b in (x.split(":") for x in r.spans.split(",")) if kind in ("removed", "general")}
    assert "token" in terms and len(terms) < 20


def test_long_text_with_a_telling_term(spark):
    filler = [f"plain text number{k} about weather and roads" for k in range(100)]
    rows = [f"part{k} of a letter from Hildegarda who writes as hg@mail.org on day{k} near roads" for k in range(4)]
    took = []
    for term in ("Nobody", "Hildegarda", "Nobody"):
        long = f"{' '.join(f'w{k}' for k in range(20_000))} hg@mail.org {f'{term} ' * 20_000}"
        docs = spark.createDataFrame([(k, t) for k, t in enumerate([*filler, *rows, long])], "doc_id long, text string").repartition(2)
        began = time.time()
        found = {r.doc_id: r for r in op.op3_rows(docs).collect()}
        took.append(time.time() - began)
        assert found[104].n_terms == (20_000 if term == "Hildegarda" else 0)
    assert took[1] < took[2] + 2


def test_a_term_of_both_sorts_tells_the_same_either_way(spark, monkeypatch):
    texts = [*planted(), *(f"number{k} before Dorwen and aa.bb@mail.org after day{k}" for k in range(6)), *("Dorwen stands here alone" for _ in range(3))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = []
    for few in (1000, 0):
        monkeypatch.setattr(op, "FEW", few)
        found.append(sorted((r.doc_id, r.spans) for r in op.op3_rows(docs).collect()))
    assert found[0] == found[1]
    assert any("removed" in spans or "general" in spans for _, spans in found[0][-9:])
