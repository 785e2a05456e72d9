"""Quality by a linear-chain conditional random field over the lines of a document.

Each line is good or bad. A line's evidence is its own features and those of the lines before and after it; a
transition matrix ties neighbours. Forward and backward sums give each line's probability of being good; a document's
quality is the mean of these, weighted by the lines' lengths, on a scale that is fitted to the labelled documents.

Lines have no labels of their own: the field is fitted so that the documents' qualities tell the documents' labels, by one
objective for evidence, transitions and scale, on a bounded sample of labelled rows of the training folds; so a good
document may have bad lines. What reaches the driver is a few numbers a line. Scoring is one
pass over the whole texts, without a shuffle, and runs all documents of a batch abreast.

Edge cases: a null or empty text is one empty line; every line counts, however many there are; rows repeated in
documents are scored each, and an id is fitted once, by the least of its rows' lines; null labels are ignored; a null id is in fold 0; without labels of both kinds every score
is 0.5; extra columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import share_of, text_of
from .learning import Adam, bounded_sample, sigmoid

#: Labelled documents that the field is fitted on, at most about.
SAMPLE = 6000
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.5
EPOCHS, RATE, DECAY = 25, 0.05, 1e-3
#: Qualities nearer to 0 or 1 than this count as this.
EDGE = 1e-4
#: Kinds of bytes: 1 lower case, 2 upper case, 3 digit, 4 white space, 5 bar, 6 exclamation or question mark, 7 full stop or comma, 8 other signs, 0 the rest.
KINDS = np.zeros(256, dtype=np.int64)
for _kind, _bytes in ((1, range(97, 123)), (2, range(65, 91)), (3, range(48, 58)), (4, b" \t\r\x0b\x0c"), (5, b"|"), (6, b"!?"), (7, b".,"), (8, b"\"#$%&'()*+-/:;<=>@[\\]^_`{}~")):
    KINDS[list(_bytes)] = _kind
OWN = 13


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines x OWN, the lines' lengths)."""
    lines = text.split("\n")
    x, seen = np.zeros((len(lines), OWN)), set()
    lengths = np.array([len(line) for line in lines], dtype=np.float64)
    for k, line in enumerate(lines):
        words = line.split()
        n = len(words)
        if not n:
            x[k, 0] = 1
            continue
        kinds = np.bincount(KINDS[np.frombuffer(line.encode(), dtype=np.uint8)], minlength=9)
        chars = kinds.sum() - kinds[4] + 1e-9
        x[k] = (
            0, np.log1p(n) / 5, kinds[2] / (kinds[1] + kinds[2] + 1), kinds[3] / chars, 5 * kinds[5] / chars, 5 * kinds[6] / chars, kinds[7] / chars, 5 * kinds[8] / chars,
            sum(map(operator.eq, words, words[1:])) / n, len(set(words)) / n, chars / n / 10, line in seen, n < 3,
        )
        seen.add(line)
    return x, lengths


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after, whether there is one, and a constant."""
    none = np.zeros((1, x.shape[1]))
    edge = np.zeros((len(x), 3))
    edge[0, 0], edge[-1, 1], edge[:, 2] = 1, 1, 1
    return np.hstack([x, np.vstack([none, x[:-1]]), np.vstack([x[1:], none]), edge])


WIDTH = 3 * OWN + 3
#: What holds each parameter back: neighbours and transitions more than a line's own features, so that lines differ within
#: a document as far as their own evidence goes; last the scale (from 1) and the offset (not at all).
NEAR_DECAY = 0.2
DECAYS = np.r_[np.full(OWN, DECAY), np.full(2 * OWN, NEAR_DECAY), np.full(3, DECAY), np.full(4, NEAR_DECAY), DECAY, 0.0]
REST = np.r_[np.zeros(WIDTH + 4), 1.0, 0.0]


def marginals(odds: list[np.ndarray], tie: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Each line's probability of good, and the expected counts of the four transitions, over all chains abreast.

    odds: log odds of good by each line's features, one array a document. tie: 2 x 2 transition scores.
    """
    order = sorted(range(len(odds)), key=lambda k: -len(odds[k]))
    sizes = np.array([len(odds[k]) for k in order])
    longest = int(sizes[0]) if len(sizes) else 0
    alive = [int((sizes > t).sum()) for t in range(longest)]
    at = np.cumsum([0, *alive])
    local = np.empty(at[-1])
    for rank, k in enumerate(order):
        local[at[: len(odds[k])] + rank] = odds[k]
    ahead, behind = np.zeros((at[-1], 2)), np.zeros((at[-1], 2))  # log messages from before and from after
    norm = lambda m: m - np.logaddexp(m[:, :1], m[:, 1:])
    own = np.stack([np.zeros(at[-1]), local], axis=1)
    for t in range(1, longest):
        n = alive[t]
        before = ahead[at[t - 1] : at[t - 1] + n] + own[at[t - 1] : at[t - 1] + n]
        ahead[at[t] : at[t] + n] = norm(np.logaddexp(before[:, :1] + tie[0], before[:, 1:] + tie[1]))
    expected = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        n = alive[t + 1]
        after = behind[at[t + 1] : at[t + 1] + n] + own[at[t + 1] : at[t + 1] + n]
        behind[at[t] : at[t] + n] = norm(np.logaddexp(after[:, :1] + tie[:, 0], after[:, 1:] + tie[:, 1]))
        before = ahead[at[t] : at[t] + n] + own[at[t] : at[t] + n]
        both = before[:, :, None] + tie[None] + after[:, None, :]
        both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
        expected += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    total = ahead + behind + own
    good = sigmoid(total[:, 1] - total[:, 0])
    out: list[np.ndarray] = [np.zeros(0)] * len(odds)
    for rank, k in enumerate(order):
        out[k] = good[at[: len(odds[k])] + rank]
    return out, expected


def shares(lengths: np.ndarray) -> np.ndarray:
    """What each line counts for in its document: its length and one, as shares."""
    return (lengths + 1) / (lengths + 1).sum()


def quality(good: np.ndarray, lengths: np.ndarray) -> float:
    return float((good * shares(lengths)).sum())


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, EDGE, 1 - EDGE)
    return np.log(p / (1 - p))


def objective(theta: np.ndarray, chains: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray) -> tuple[float, np.ndarray]:
    """The loss of documents' labels under the field, and its gradient; theta is weights, transitions, scale and offset.

    A document's quality q is the expected share of good lines, its score the sigmoid of scale * logit(q) + offset. Lines
    have no labels: what a line's evidence or a transition adds to q is its covariance with that share, and this is how
    fast the line's probability and the transitions' counts change as the evidence is tilted by the shares. So one pass
    gives the loss, and one tilted to either side the gradient.
    """
    w, tie, a, b = theta[:WIDTH], theta[WIDTH:-2].reshape(2, 2), theta[-2], theta[-1]
    odds = [x @ w for x in chains]
    good, _ = marginals(odds, tie)
    q = np.array([float(p @ c) for p, c in zip(good, counts, strict=True)])
    z = logit(q)
    s = sigmoid(a * z + b)
    loss = float(np.mean(np.logaddexp(0, np.where(labels == 1, -1, 1) * (a * z + b)))) + float(DECAYS @ (theta - REST) ** 2) / 2
    inside = (q > EDGE) & (q < 1 - EDGE)
    slope = np.where(inside, (s - labels) * a / np.maximum(q * (1 - q), EDGE / 2), 0.0) / len(labels)
    size = max((abs(g) * c.max() for g, c in zip(slope, counts, strict=True)), default=0.0)
    g = DECAYS * (theta - REST)
    g[-2:] += ((s - labels) * z).mean(), (s - labels).mean()
    if size > 0:
        step = 1e-3 / size
        tilt = [step * k * c for k, c in zip(slope, counts, strict=True)]
        more, many = marginals([o + t for o, t in zip(odds, tilt, strict=True)], tie)
        less, few = marginals([o - t for o, t in zip(odds, tilt, strict=True)], tie)
        for x, p, m in zip(chains, more, less, strict=True):
            g[:WIDTH] += (p - m) @ x / (2 * step)
        g[WIDTH:-2] += ((many - few) / (2 * step)).ravel()
    return loss, g


def fit(chains: list[np.ndarray], lengths: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> tuple[np.ndarray, np.ndarray, tuple[float, float]]:
    """(weights, transitions, scale) of the field, by the objective in small batches."""
    theta, counts = REST.copy(), [shares(n) for n in lengths]
    adam, rng = Adam(len(theta), RATE), np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(chains)), max(1, len(chains) // 256)):
            theta = theta - adam.step(objective(theta, [chains[k] for k in part], [counts[k] for k in part], labels[part])[1])
    return theta[:WIDTH], theta[WIDTH:-2].reshape(2, 2), (float(theta[-2]), float(theta[-1]))


def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [line_features(t) for t in batch["text"]]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "lines": [x.astype(np.float32).tobytes() for x, _ in found], "lengths": [n.astype(np.float32).tobytes() for _, n in found]})


def scorer(spark, model):
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if shared.value is None:
            return pd.Series(np.full(len(texts), 0.5))
        w, tie, (a, b) = shared.value
        odds, lengths = [], []
        for text in texts:
            x, n = line_features(text)
            odds.append(with_neighbours(x) @ w)
            lengths.append(n)
        good, _ = marginals(odds, tie)
        return pd.Series(sigmoid(a * logit(np.array([quality(p, n) for p, n in zip(good, lengths, strict=True)])) + b))

    return score


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """(weights, transitions, scale) learned from the training folds; None without labels of both kinds."""
    own = labels.where(share_of("doc_id", FOLDS) != HELD_OUT).where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = bounded_sample(own, "doc_id", sample, "quality")
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")
    found = rows.mapInPandas(featured, "doc_id long, quality int, lines binary, lengths binary")
    found = found.groupBy("doc_id").agg(F.min(F.struct("lines", "lengths", "quality")).alias("one")).select("one.*").toPandas()  # one row an id, however often it is there
    if found["quality"].nunique() < 2:
        return None
    own = sorted(zip(found["lines"], found["lengths"], found["quality"], strict=True))  # the fit does not depend on the order of arrival
    numbers = lambda raw: np.frombuffer(raw, dtype=np.float32).astype(np.float64)
    chains = [with_neighbours(numbers(x).reshape(-1, OWN)) for x, _, _ in own]
    return fit(chains, [numbers(n) for _, n, _ in own], np.array([q for _, _, q in own]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """A column function that scores a text."""
    return scorer(docs.sparkSession, fitted(docs, labels, sample))


def op4_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    score = train(docs, labels)
    held: Column = share_of("doc_id", FOLDS) == HELD_OUT
    found = docs.select("doc_id", held.alias("held_out"), score(text_of()).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def line_labels(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line, good, is_good): every line of every document with its probability of being good."""
    model = fitted(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, tie, _ = shared.value or (np.zeros(WIDTH), np.zeros((2, 2)), None)
        for batch in batches:
            good, _ = marginals([with_neighbours(line_features(t)[0]) @ w for t in batch["text"]], tie)
            sizes = [len(g) for g in good]
            out = pd.DataFrame({"doc_id": np.repeat(batch["doc_id"].to_numpy(), sizes), "line": np.concatenate([np.arange(n) for n in sizes]), "good": np.concatenate(good)})
            yield out.assign(is_good=out["good"] >= 0.5)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInPandas(told, "doc_id long, line long, good double, is_good boolean")
