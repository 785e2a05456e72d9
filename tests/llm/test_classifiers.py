from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest

from barloom.llm import line_quality, toxicity
from barloom.llm.queries import op4_line_quality, op10_toxicity

SCHEMA = "doc_id long, text string"


def auc(score: np.ndarray, label: np.ndarray) -> float:
    a, b = score[label == 1][:, None], score[label == 0][None, :]
    return float(((a > b) + 0.5 * (a == b)).mean())


@pytest.mark.parametrize(("query", "column", "parts", "held", "least"), [(op4_line_quality, "quality", 3, 1, 0.95), (op10_toxicity, "toxic", 4, 2, 0.8)])
def test_held_out_ranking(spark, query, column, parts, held, least):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = query(spark, sf_dir).join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", column).toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % parts == held) for h, i in zip(found["held_out"], found["doc_id"], strict=True))
    assert found["score"].between(0, 1).all()
    assert (found["predicted"] == (found["score"] >= (0.5 if column == "quality" else 0.3))).all()
    own = found[found["held_out"]]
    assert auc(own["score"].to_numpy(), own[column].to_numpy()) >= least


@pytest.mark.parametrize("op", [line_quality.op4_rows, toxicity.op10_rows])
def test_edges(spark, op):
    rows = [(k, "good words in a line here\nand another one", 1, 0) for k in range(60)] + [(100 + k, f"BAD!! {'awful ' * 9}\nBAD!! XX!!", 0, 1) for k in range(60)]
    docs = spark.createDataFrame([*(r[:2] for r in rows), (500, None), (501, ""), (502, "\n" * 3000), (503, "x" * 50_000), (None, "good words")], SCHEMA)
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    found = op(docs.union(docs), labels).collect()
    assert len(found) == 2 * docs.count() and all(0 <= r.score <= 1 for r in found)
    of = {r.doc_id: r.score for r in found}
    bad, good = (of[100], of[0]) if op is toxicity.op10_rows else (of[0], of[100])
    assert bad > good
    assert op(docs.limit(0), labels).count() == 0
    assert len(op(docs, labels.limit(0)).collect()) == docs.count()


def test_rare_toxic_words_are_counted_over_all_documents(spark, monkeypatch):
    """A word in 12 of 2400 confirmed documents, which a fit on 40 documents of each kind can't see, is a feature."""
    monkeypatch.setattr(toxicity, "SUPPORT", 5)
    rows = [(k, f"awful words here{' rarebad' if k % 200 == 0 else ''}" if k < 2400 else "good words here") for k in range(9600)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    labels = spark.createDataFrame([(k, 0, int(k < 2400)) for k in range(0, 4800)], "doc_id long, quality int, toxic int")
    fitted, real = {}, toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda *args: fitted.setdefault("model", real(*args)))
    toxicity.train(docs, labels, 40, 40)
    assert toxicity.word_features("rarebad")[0] in fitted["model"][0]
    assert toxicity.POSITIVES == 4000 and toxicity.UNLABELLED == 8000


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(1)
    odds, tie = [rng.normal(size=n) for n in (1, 4, 6, 2)], rng.normal(size=(2, 2))
    good, expected = line_quality.marginals(odds, tie)
    counts = np.zeros((2, 2))
    for own, got in zip(odds, good, strict=True):
        n = len(own)
        total, p, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(1 << n):
            y = [(code >> k) & 1 for k in range(n)]
            weight = np.exp(sum(o for o, v in zip(own, y, strict=True) if v) + sum(tie[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += weight
            p += weight * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                pairs[a, b] += weight
        assert got == pytest.approx(p / total)
        counts += pairs / total
    assert expected == pytest.approx(counts)


def sparse_rows(rng, count: int, n: int) -> list[np.ndarray]:
    return [rng.integers(0, n, rng.integers(0, 6)).astype(np.int32) for _ in range(count)]


def risks_by_hand(w: np.ndarray, positive: list, unlabelled: list, prior: float) -> tuple[float, float]:
    """Confirmed part and negative part, a row at a time."""
    loss = lambda z, y: np.log(1 + np.exp(-z if y else z))
    scores = [[sum(w[f] for f in row) + w[-1] for row in rows] for rows in (positive, unlabelled)]
    means = {(side, y): sum(loss(z, y) for z in scores[side]) / len(scores[side]) for side in (0, 1) for y in (0, 1)}
    return prior * means[0, 1], means[1, 0] - prior * means[0, 0]


def test_toxicity_risk_and_gradient_by_hand():
    rng = np.random.default_rng(2)
    for bias, prior in ((0.3, 0.2), (-3.0, 0.9), (4.0, 0.95)):
        n = 7
        positive, unlabelled = sparse_rows(rng, 9, n), sparse_rows(rng, 14, n)
        w = np.r_[rng.normal(size=n), bias]
        if prior > 0.8:  # confirmed rows score high and the others low: the negative part is below zero
            w[:n], positive, unlabelled = np.abs(w[:n]), [np.arange(5, dtype=np.int32)] * 9, [np.zeros(0, dtype=np.int32)] * 14
        confirmed, negative, g = toxicity.risk(w, positive, unlabelled, prior)
        assert (confirmed, negative) == pytest.approx(risks_by_hand(w, positive, unlabelled, prior))
        of = (lambda x: sum(risks_by_hand(x, positive, unlabelled, prior))) if negative >= 0 else (lambda x: -risks_by_hand(x, positive, unlabelled, prior)[1])
        for k in range(n + 1):
            step = np.zeros(n + 1)
            step[k] = 1e-5
            assert g[k] == pytest.approx((of(w + step) - of(w - step)) / 2e-5, abs=1e-6)
    assert toxicity.risk(np.zeros(3), sparse_rows(rng, 4, 2), sparse_rows(rng, 4, 2), 0.5)[1] > 0


def test_a_few_sure_words_are_enough():
    """Toxic documents have one to six of ten words that no other has, all three features of each."""
    rng = np.random.default_rng(3)

    def row(toxic: bool) -> np.ndarray:
        words = rng.choice(10, rng.integers(1, 7), replace=False) if toxic else np.zeros(0, dtype=int)
        return np.sort(np.concatenate([rng.integers(30, 60, 8), words, words + 10, words + 20])).astype(np.int32)

    positive = [row(True) for _ in range(400)]
    _, weights, bias = toxicity.fit(np.arange(60), positive, [*positive, *(row(False) for _ in range(3600))], 0.1)
    caught, wrong = (np.mean([toxicity.sigmoid(weights[row(toxic)].sum() + bias) >= toxicity.THRESHOLD for _ in range(1000)]) for toxic in (True, False))
    assert caught > 0.83 and wrong < 0.01, (caught, wrong)


def test_toxicity_scores_by_hand(spark):
    """A text's score is the sum of its distinct words' features, whatever its length and repeats."""
    kept = np.unique(np.array([f for w in ("awful", "words", "dreadful") for f in toxicity.word_features(w)], dtype=np.int64))
    weights = np.linspace(-1, 2, len(kept))
    of = dict(zip(kept.tolist(), weights.tolist(), strict=True))
    texts = ["Awful words", "awful AWFUL awful, words. dreadfully dreadful", "nothing", "", "dreadful " * 5000]
    own = toxicity.scorer(spark, kept, weights, -0.5)
    found = [r.s for r in spark.createDataFrame([(t,) for t in texts], "text string").repartition(1).select(own("text").alias("s")).collect()]
    hand = [-0.5 + sum(of.get(f, 0.0) for w in set(toxicity.WORD.findall(t.lower())) for f in toxicity.word_features(w)) for t in texts]
    assert sorted(found) == pytest.approx(sorted(1 / (1 + np.exp(-np.array(hand)))))


@pytest.mark.parametrize(("op", "names"), [(line_quality.op4_rows, ("score", "held_out")), (toxicity.op10_rows, ("score", "predicted"))])
def test_labels_both_ways_and_clashing_names(spark, op, names):
    rows = [(k, "good words in a line here" if k % 2 else f"BAD!! {'awful ' * 9}!!") for k in range(120)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in names:
        docs = docs.withColumn(name, toxicity.F.lit("clash"))
    labels = spark.createDataFrame([(k, k % 2, 1 - k % 2) for k in range(120)] + [(0, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    found = op(docs.union(docs.where("doc_id < 10")), labels).collect()
    assert len(found) == 130 and all(0 <= r.score <= 1 for r in found)


def test_fit_takes_an_id_once(spark, monkeypatch):
    rows = [(k % 20, f"awful words{k % 7}" if k % 2 else "good words") for k in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(20)], "doc_id long, quality int, toxic int")
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda kept, positive, other, prior: seen.update(n=(len(positive), len(other))) or (kept, np.zeros(len(kept)), 0.0))
    toxicity.train(docs, labels)
    trained = [k for k in range(20) if zlib.crc32(str(k).encode()) % 4 != 2]
    assert seen["n"] == (sum(k % 2 for k in trained), len(trained))


def test_few_confirmed_rows_still_make_a_classifier(spark):
    rows = [(k, f"awful nasty words {k}", 1) for k in range(4)] + [(10 + k, f"good kind words {k}", 0) for k in range(20)]
    rows = [(next(i for i in range(100 * d, 100 * d + 99) if zlib.crc32(str(i).encode()) % 4 != 2), t, x) for d, t, x in rows]
    docs = spark.createDataFrame([*(r[:2] for r in rows), *((100_000 + k, f"good kind things {k}") for k in range(80))], SCHEMA)
    labels = spark.createDataFrame([(i, 1 - x, x) for i, _, x in rows], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r.score for r in toxicity.op10_rows(docs, labels).collect()}
    assert min(found[i] for i, _, x in rows if x) > max(found[i] for i, _, x in rows if not x)


def test_a_row_ten_thousand_times_is_fitted_once(spark):
    texts = [(k, "good words in a line here\nand another one" if k % 2 else f"BAD!! {'awful ' * 9}\nXX!!") for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    once = spark.createDataFrame(texts, SCHEMA)
    often = once.union(once.where("doc_id = 7").crossJoin(spark.range(10_000)).drop("id"))
    a, b = ({r.doc_id: r.score for r in line_quality.op4_rows(docs, labels).collect()} for docs in (once, often))
    assert a == b


def small_field(rng, sizes: list[int]):
    chains = [line_quality.with_neighbours(rng.normal(size=(n, line_quality.OWN))) for n in sizes]
    counts = [line_quality.shares(rng.integers(0, 90, n).astype(float)) for n in sizes]
    theta = np.r_[0.3 * rng.normal(size=line_quality.WIDTH + 4), 1.4, -0.2]
    return theta, chains, counts


def loss_by_hand(theta: np.ndarray, chains: list, counts: list, labels: np.ndarray) -> float:
    """The objective by going through all labellings of each document's lines."""
    w, tie, (a, b) = theta[: line_quality.WIDTH], theta[line_quality.WIDTH : -2].reshape(2, 2), theta[-2:]
    total = 0.0
    for x, c, y in zip(chains, counts, labels, strict=True):
        weights, share = [], []
        for lines in itertools.product((0, 1), repeat=len(x)):
            weights.append(np.exp(sum(k * (row @ w) for k, row in zip(lines, x, strict=True)) + sum(tie[i, j] for i, j in zip(lines, lines[1:], strict=False))))
            share.append(float(np.array(lines) @ c))
        q = float(np.dot(weights, share) / np.sum(weights))
        z = a * np.log(q / (1 - q)) + b
        total += np.log1p(np.exp(-z if y else z)) / len(labels)
    return total + float(line_quality.DECAYS @ (theta - line_quality.REST) ** 2) / 2


def test_line_quality_objective_and_gradient_by_hand():
    rng = np.random.default_rng(4)
    theta, chains, counts = small_field(rng, [1, 3, 5, 2, 4])
    labels = np.array([1, 0, 1, 1, 0])
    loss, g = line_quality.objective(theta, chains, counts, labels)
    assert loss == pytest.approx(loss_by_hand(theta, chains, counts, labels), rel=1e-9)
    for k in range(len(theta)):
        step = np.zeros(len(theta))
        step[k] = 1e-5
        rise = (loss_by_hand(theta + step, chains, counts, labels) - loss_by_hand(theta - step, chains, counts, labels)) / 2e-5
        assert g[k] == pytest.approx(rise, abs=2e-6), k


def test_line_quality_scores_by_hand(spark):
    rng = np.random.default_rng(5)
    theta, _, _ = small_field(rng, [1])
    w, tie, (a, b) = theta[: line_quality.WIDTH], theta[line_quality.WIDTH : -2].reshape(2, 2), theta[-2:]
    texts = ["One line of words.", "Two\nLINES!! 12", "a b\n\nc | d\nE\nf f f", ""]
    own = line_quality.scorer(spark, (w, tie, (a, b)))
    found = sorted(r.s for r in spark.createDataFrame([(t,) for t in texts], "text string").select(own("text").alias("s")).collect())
    hand = []
    for text in texts:
        x, n = line_quality.line_features(text)
        one = np.r_[theta[:-2], 1.0, 0.0]
        # the loss of a document labelled 1 under scale 1 and offset 0 is minus the logarithm of its quality
        q = np.exp(-(loss_by_hand(one, [line_quality.with_neighbours(x)], [line_quality.shares(n)], np.array([1])) - float(line_quality.DECAYS @ (one - line_quality.REST) ** 2) / 2))
        hand.append(1 / (1 + np.exp(-(a * np.log(q / (1 - q)) + b))))
    assert found == pytest.approx(sorted(hand))


def test_a_good_document_may_have_bad_lines(spark):
    """Lines of one kind stand only in good documents, of another in both: the field tells which lines make a document bad."""
    rng = np.random.default_rng(6)
    good, bad = "Plain words of a sentence stand here in order.", "BUY!!! NOW!!! $$$ 999 | 888 | 777 !!!"
    rows = [(k, "\n".join(good if rng.random() < (0.85 if k % 2 else 0.25) else bad for _ in range(12)), k % 2) for k in range(600)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], SCHEMA), spark.createDataFrame([(k, q, 0) for k, _, q in rows], "doc_id long, quality int, toxic int")
    found = line_quality.line_labels(docs, labels).toPandas()
    assert len(found) == 600 * 12
    lines = [line == good for _, text, _ in rows for line in text.split("\n")]
    own = found.sort_values(["doc_id", "line"])["is_good"].to_numpy()
    assert (own == np.array(lines)).mean() > 0.9
    mixed = [k for k, text, q in rows if q and bad in text]
    assert not found[found["doc_id"].isin(mixed)].groupby("doc_id")["is_good"].all().any()
