"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = logistic(cut_k - w . x): one weight vector for all grades, ascending cuts. x holds log(1 + count) of
each word of the vocabulary, or head of words, in the whole text. Labels have two marks only, so the grades are 0 (not toxic), 1 (toxic in an
otherwise good document) and 2 (toxic and of low quality). A bounded sample of SAMPLE labelled documents, chosen by hash
outside the held-out fifth, is all that reaches the driver; its FEATURES words that tell toxic from other documents best
form the vocabulary. The result is the expected grade, the likeliest grade, and whether a grade above 0 has a probability
of FLAG or more.

Defined results: a null or empty text has no features and gets what the cuts alone say; without labelled documents
every severity is 0; of several labels of a document the highest grade counts; labels without a doc_id or a toxic mark
count for nothing; of several texts of a labelled document one, by a hash, is learned from; rows that repeat a doc_id are graded
each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

SAMPLE, FEATURES = 8000, 600
#: A feature must occur in this share of the sample, and in three documents.
LEAST_SHARE = 0.004
RIDGE, STEPS, RATE = 3e-4, 400, 0.1
#: A document is flagged from this probability of a grade above 0.
FLAG = 0.3
GRADES = 3
#: Lengths of the heads of words that are features besides the words.
HEADS = (4, 5, 6, 7, 8)
#: Words whose features a worker remembers.
MEMO = 500_000
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def features_of(word: str) -> tuple[str, ...]:
    """A lower-cased word without the marks at its edges, and its heads, which stand for a stem with any ending."""
    if not word.isalpha():
        word = _EDGES.sub("", word)
    return (word, *(word[:n] + "-" for n in HEADS if len(word) >= n)) if word else ()


def counts(text: str, known=None, memo: dict | None = None) -> dict[str, int]:
    """How often the text holds each feature, or each known one. memo keeps what words stand for."""
    out: dict[str, int] = {}
    memo = {} if memo is None else memo
    for w in text.lower().split():
        own = memo.get(w)
        if own is None:
            own = features_of(w)
            if known is not None:
                own = tuple(f for f in own if f in known)
            memo[w] = own
        for f in own:
            out[f] = out.get(f, 0) + 1
    return out


@dataclass
class Model:
    weight: dict[str, float] = field(default_factory=dict)
    cuts: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, 50.0))
    memo: dict = field(default_factory=dict, repr=False)

    def grades(self, texts: list[str]) -> np.ndarray:
        """P(grade) per text."""
        score = np.zeros(len(texts))
        for i, t in enumerate(texts):
            if len(self.memo) > MEMO:
                self.memo.clear()
            score[i] = sum(self.weight[f] * np.log1p(n) for f, n in counts(t, self.weight, self.memo).items())
        below = 1 / (1 + np.exp(np.clip(score[:, None] - self.cuts[None, :], -50, 50)))
        full = np.concatenate([np.zeros((len(texts), 1)), below, np.ones((len(texts), 1))], axis=1)
        return np.diff(full, axis=1)


def vocabulary(texts: list[str], toxic: np.ndarray) -> list[str]:
    """The features whose presence differs most between toxic and other documents, in standard errors."""
    yes, no, memo = Counter(), Counter(), {}
    for t, y in zip(texts, toxic, strict=True):
        (yes if y else no).update(counts(t, memo=memo).keys())
    n1, n0 = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    rank = []
    for w in yes.keys() | no.keys():
        if yes[w] + no[w] >= max(3, LEAST_SHARE * len(texts)):
            p1, p0, p = yes[w] / n1, no[w] / n0, (yes[w] + no[w]) / (n1 + n0)
            rank.append((-abs(p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12), w))
    return [w for _, w in sorted(rank)[:FEATURES]]


def fit(texts: list[str], grades: list[int]) -> Model:
    """Full gradients with adaptive steps on the penalized likelihood; the same on every run."""
    y = np.asarray(grades)
    if len(y) == 0 or y.max() == 0:
        return Model()
    names = vocabulary(texts, y > 0)
    place = {w: i for i, w in enumerate(names)}
    x, memo = np.zeros((len(texts), len(names)), dtype=np.float32), {}
    for i, t in enumerate(texts):
        for f, n in counts(t, place, memo).items():
            x[i, place[f]] = np.log1p(n)
    k = GRADES - 1
    share = np.asarray([(y <= g).mean() for g in range(k)]).clip(1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    # cuts as a first one and the logarithms of the gaps keep them ascending
    theta = np.concatenate([np.zeros(len(names)), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, gaps = theta[: len(names)], np.exp(theta[len(names) + 1 :])
        cuts = theta[len(names)] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = x @ w
        f = 1 / (1 + np.exp(np.clip(s[:, None] - cuts[None, :], -50, 50)))
        full = np.concatenate([np.zeros((len(y), 1)), f, np.ones((len(y), 1))], axis=1)
        p = np.maximum(full[np.arange(len(y)), y + 1] - full[np.arange(len(y)), y], 1e-9)
        slope = full * (1 - full)
        up, down = slope[np.arange(len(y)), y + 1] / p, slope[np.arange(len(y)), y] / p
        by_cut = np.zeros((len(y), k))
        at = np.arange(len(y))
        by_cut[at[y < k], y[y < k]] += up[y < k]
        by_cut[at[y > 0], y[y > 0] - 1] -= down[y > 0]
        g_cut = -by_cut.mean(axis=0)
        g_w = x.T @ (up - down) / len(y) + RIDGE * w
        g = np.concatenate([g_w, [g_cut.sum()], np.asarray([g_cut[j + 1 :].sum() for j in range(k - 1)]) * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    cuts = theta[len(names)] + np.concatenate([[0.0], np.cumsum(np.exp(theta[len(names) + 1 :]))])
    return Model(dict(zip(names, theta[: len(names)].tolist(), strict=True)), cuts)


def held_out(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def training_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[list[str], list[int]]:
    """At most size texts and grades of labelled documents that are not held out, first by hash."""
    grade = F.coalesce(F.col("toxic"), F.lit(0)) * (2 - F.coalesce(F.col("quality"), F.lit(1)))
    # one text, the same on every run, of a document that has several
    named = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.least(grade, F.lit(GRADES - 1))).alias("grade"))
    chosen = staged(named.orderBy(F.xxhash64("doc_id", F.lit("toxic-sample")), "doc_id").limit(size), "toxic-sample")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null")
    rows = sorted(rows.groupBy("doc_id", "grade").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).collect(), key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], [r["grade"] for r in rows]


def graded(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, p_toxic, severity (the expected grade), grade (the likeliest), toxic for every row of docs."""
    model = model or fit(*training_sample(docs, labels))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES words

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = shared.value.grades([t if isinstance(t, str) else "" for t in pdf["text"]])
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "p_toxic": 1 - p[:, 0], "severity": p @ np.arange(GRADES), "grade": p.argmax(axis=1).astype("int32"), "toxic": p[:, 0] <= 1 - FLAG,
            })

    # doc_id as text keeps nulls and large ids exact through pandas
    narrow = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    out = narrow.mapInPandas(run, "doc_id string, held_out boolean, p_toxic double, severity double, grade int, toxic boolean")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
