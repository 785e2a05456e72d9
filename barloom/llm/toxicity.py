"""Toxicity by non-negative positive-unlabelled learning.

Features are chosen by their document counts over all documents of the training folds, confirmed ones and all, summed
up in each task before one shuffle. Only the gradient fit of a linear classifier with numpy weights takes bounded
samples, both of labelled rows: confirmed toxic documents, and documents whose labels are not looked at. The risk is
the class-prior-corrected one,

    prior * E_P[loss(z, 1)] + max(0, E_U[loss(z, 0)] - prior * E_P[loss(z, 0)]),

and where the estimate of the negative part falls below zero, the step goes against that part instead, as the
non-negative estimator asks. The prior is the share of toxic rows among the labelled rows of the training folds.

A document's features are its distinct lower-case words and their first four and five letters, hashed; every distinct
word adds its weights, so every part of a text counts, however long it is. Labels, language, source and id are no
features. Scoring is one pass over the texts, without a shuffle.

Edge cases: a null or empty text scores by the bias alone; rows repeated in documents are scored each, and an id that
is there more than once is fitted once, by the least of its rows' features; null labels are ignored, and an id that is
labelled both ways is a confirmed one; a null id is in fold 0; without any confirmed toxic row every score is that of a
bias of -60, below 1e-25; with a few confirmed rows a feature needs half of them; extra columns are kept, and
score and predicted replace columns of those names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, share_of, text_of
from .learning import Adam, bounded_sample, sigmoid

#: Labelled documents that the classifier is fitted on, at most about.
POSITIVES = 4000
UNLABELLED = 8000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Hash buckets of the features, the confirmed documents that a bucket needs, and how many buckets are fitted.
BUCKETS = 1 << 22
SUPPORT = 5
#: Ids of confirmed documents that are broadcast at most, 100 MB of them.
MOST_IDS = 5_000_000
SELECTED = 3000
STEPS, RATE, DECAY = 400, 0.05, 2e-3
WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> tuple[int, ...]:
    out = [zlib.crc32(b"w" + word.encode()) % BUCKETS]
    if len(word) >= 5:
        out.append(zlib.crc32(b"4" + word[:4].encode()) % BUCKETS)
    if len(word) >= 6:
        out.append(zlib.crc32(b"5" + word[:5].encode()) % BUCKETS)
    return tuple(out)


def features(text: str) -> np.ndarray:
    """Hashed features of the distinct words, one for each word that has it."""
    return np.fromiter((f for word in set(WORD.findall(text.lower())) for f in word_features(word)), dtype=np.int32)


def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(bucket, documents, confirmed documents) of a task's rows; bucket -1 stands for every document."""
    have, known = np.zeros((2, BUCKETS), dtype=np.int32), {}
    totals = [0, 0]
    for batch in batches:
        for text, positive in zip(batch["text"], batch["positive"], strict=True):
            found: set[int] = set()
            for word in set(WORD.findall(text.lower())):
                own = known.get(word)
                if own is None:
                    own = known[word] = word_features(word)
                found.update(own)
            own = np.fromiter(found, dtype=np.int64, count=len(found))
            have[0, own] += 1
            totals[0] += 1
            if positive:
                have[1, own] += 1
                totals[1] += 1
        if len(known) > 50_000:
            known.clear()
    at = np.flatnonzero(have[0])
    for begin in range(0, len(at), 100_000):
        part = at[begin : begin + 100_000]
        yield pd.DataFrame({"bucket": part, "documents": have[0, part].astype(np.int64), "confirmed": have[1, part].astype(np.int64)})
    yield pd.DataFrame({"bucket": [-1], "documents": totals[:1], "confirmed": totals[1:]})


def selected(rows: DataFrame, toxic: DataFrame) -> np.ndarray:
    """The buckets whose share of the confirmed documents differs most surely from their share of all, counted over all rows.

    A bucket needs SUPPORT confirmed documents, or half of them where there are fewer than twice as many. toxic: the ids of
    the confirmed ones, broadcast up to MOST_IDS of them and joined beyond.
    """
    ids = toxic.select("doc_id", F.lit(True).alias("positive"))
    ids = F.broadcast(ids) if toxic.count() <= MOST_IDS else ids
    marked = rows.join(ids, "doc_id", "left").select("text", F.coalesce("positive", F.lit(False)).alias("positive"))
    counts = marked.mapInPandas(counted, "bucket long, documents long, confirmed long").groupBy("bucket").agg(F.sum("documents").alias("documents"), F.sum("confirmed").alias("confirmed"))
    counts = cut(counts.where(F.col("confirmed") > 0), narrow=True)
    total = counts.where("bucket = -1").first()
    if total is None:
        return np.zeros(0, dtype=np.int64)
    every, own = float(total.documents), float(total.confirmed)
    counts = counts.where(F.col("confirmed") >= min(SUPPORT, math.ceil(own / 2)))
    p, u, both = F.col("confirmed") / own, F.col("documents") / every, (F.col("confirmed") + F.col("documents")) / (own + every)
    sure = F.abs((p - u) / F.sqrt(both * (1 - both) * (1 / own + 1 / every) + 1e-12))
    best = counts.where("bucket >= 0").withColumn("sure", sure).where("sure > 3").orderBy(F.desc("sure"), "bucket").limit(SELECTED)
    return np.sort(np.array([r.bucket for r in best.select("bucket").collect()], dtype=np.int64))


def featured(kept: np.ndarray):
    """Each text as the places of its features in kept, one for each word that has it."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                own = np.sort(features(text)).astype(np.int64)
                at = np.minimum(np.searchsorted(kept, own), max(0, len(kept) - 1))
                out.append((at[kept[at] == own] if len(kept) else at[:0]).astype(np.int32).tobytes())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "positive": batch["positive"], "features": out})

    return places


def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The features of the rows in one array, and the row of each."""
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([np.zeros(0, dtype=np.int32), *rows])


def risk(w: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[float, float, np.ndarray]:
    """(part of the confirmed ones, estimate of the negative part, gradient of the step) at w, whose last entry is the bias.

    The gradient is that of the sum of both parts; where the negative part is below zero, that of its opposite alone.
    """
    n = len(w) - 1
    parts = [flat(rows) for rows in (positive, unlabelled)]
    sizes = [max(1, len(positive)), max(1, len(unlabelled))]
    zp, zu = (np.bincount(o, weights=w[c], minlength=s)[:s] + w[n] for (o, c), s in zip(parts, sizes, strict=True))
    p, u = sigmoid(zp), sigmoid(zu)
    confirmed = prior * float(np.logaddexp(0, -zp).mean())
    negative = float(np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())
    gp, gu = -prior * p / sizes[0], u / sizes[1]
    gp, gu = (gp + prior * (p - 1) / sizes[0], gu) if negative >= 0 else (-gp, -gu)
    g = np.zeros(n + 1)
    for (o, c), own in zip(parts, (gp, gu), strict=True):
        g[:n] += np.bincount(c, weights=own[o], minlength=n)
        g[n] += own.sum()
    return confirmed, negative, g


def fit(kept: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature buckets, weights, bias) by minimising the non-negative risk; the rows hold places in kept.

    Every step takes all rows. A small batch's share of toxic documents strays from the prior, so that its negative part is
    often below zero by chance alone; steps against it then hold the weights of the surest words down.
    """
    if not positive or not unlabelled:
        return np.zeros(0, dtype=np.int64), np.zeros(0), -60.0
    w, n = np.zeros(len(kept) + 1), len(kept)
    w[n] = np.log(prior / (1 - prior))
    adam = Adam(n + 1, RATE)
    for k in range(STEPS):
        *_, g = risk(w, positive, unlabelled, prior)
        g[:n] += DECAY * w[:n]
        w -= adam.step(g) * (1 if k < STEPS // 2 else 0.2)
    return kept, w[:n], float(w[n])


def scorer(spark, kept: np.ndarray, weights: np.ndarray, bias: float):
    """A column function from text to score. The model is bounded by BUCKETS."""
    strong = np.abs(weights) > 1e-3
    model = spark.sparkContext.broadcast((dict(zip(kept[strong].tolist(), weights[strong].tolist(), strict=True)), bias))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of, bias = model.value
        known: dict[str, float] = {}
        for texts in batches:
            z = np.full(len(texts), bias)
            for k, text in enumerate(texts):
                words = set(WORD.findall(text.lower()))
                for word in words:
                    s = known.get(word)
                    if s is None:
                        s = known[word] = sum(of.get(f, 0.0) for f in word_features(word))
                    if s:
                        z[k] += s
            if len(known) > 50_000:
                known.clear()
            yield pd.Series(sigmoid(z))

    return score


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED):
    """A column function that scores a text, learned from the training folds."""
    own = labels.where(share_of("doc_id", FOLDS) != HELD_OUT).where("doc_id is not null and toxic is not null")
    prior = own.agg(F.avg("toxic")).first()[0]
    if not prior:
        return scorer(docs.sparkSession, np.zeros(0, dtype=np.int64), np.zeros(0), -60.0)
    toxic = own.where("toxic = 1").select("doc_id").distinct()
    rows = docs.where(share_of("doc_id", FOLDS) != HELD_OUT).select("doc_id", text_of().alias("text"))
    kept = selected(rows, toxic)
    plain = bounded_sample(own.select("doc_id").distinct(), "doc_id", unlabelled, "unlabelled").withColumn("positive", F.lit(False))
    chosen = bounded_sample(toxic, "doc_id", positives, "toxic").withColumn("positive", F.lit(True)).unionByName(plain)
    found = rows.join(F.broadcast(chosen), "doc_id").mapInPandas(featured(kept), "doc_id long, positive boolean, features binary")
    found = found.groupBy("doc_id", "positive").agg(F.min("features").alias("features")).drop("doc_id").toPandas()  # one row an id, however often it is there
    own = sorted(zip(found["features"], found["positive"], strict=True))  # the fit does not depend on the order of arrival
    sets = [[np.frombuffer(f, dtype=np.int32) for f, positive in own if positive == side] for side in (True, False)]
    return scorer(docs.sparkSession, *fit(kept, *sets, min(max(prior, 1e-4), 0.9)))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with score and predicted."""
    score = train(docs, labels)
    return docs.withColumn("score", score(text_of())).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op10_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = scored(docs.select("doc_id", "text"), labels)
    held: Column = share_of("doc_id", FOLDS) == HELD_OUT
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject, with their columns."""
    score = train(docs, labels)
    return docs.where(score(text_of()) < THRESHOLD)
