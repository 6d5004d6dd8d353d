"""Language identification by a string kernel: blended-spectrum n-gram presence, Nystroem landmarks, ridge regression.

The kernel of two texts is the number of distinct byte n-grams (n from 1 to 3, lower-cased UTF-8, hashed into DIMS
buckets) that both hold, over the geometric mean of how many each holds. A bounded sample of labelled texts is the only
thing that reaches the driver, as the presence bits of whole texts, DIMS / 8 bytes each: PER_LANGUAGE texts of each of at
most LANGUAGES labels, chosen by hash, and SAMPLE in all. Of these, LANDMARKS texts span the Nystroem space, in which one ridge regression per language (one against the rest) is solved.
Since the kernel is linear in the presence vectors, a batch is scored as the product of its presence matrix with the
landmarks' and then with the coefficients; the latter two are multiplied once, at the end of the fit.

The outputs of a text always add up to the sum of the biases, so the best one alone never tells that a text is in none of
the languages. What does is its lift, (output - bias) / (1 - bias): 0 for a text that has nothing in common with the
landmarks, about 1 for one of the language. A text is recognized if its lift reaches LIFT_SHARE of what all but
LIFT_QUANTILE of its language's training texts reach. Texts of fewer than FULL_GRAMS distinct n-grams tell less: their
limit is lower in proportion.

Defined results: a null text or one without a letter gets `und` and score 0.0; without any labelled text every document
does; with one label only every lift is 1, so all texts with letters are recognized; an equal score goes to the first language by code point; an empty table gives no rows; lang, source and doc_id are
never read for a prediction.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released

DIMS = 1 << 14
ORDERS = (1, 2, 3)
PER_LANGUAGE, LANGUAGES, SAMPLE = 700, 200, 1 << 15
LANDMARKS, RIDGE = 320, 1e-3
BATCH = 64
LIFT_QUANTILE, LIFT_SHARE, FULL_GRAMS = 0.01, 0.45, 64
UNKNOWN = "und"
#: Letters, and numerals such as superscripts, which are none.
_LETTER = re.compile(r"[^\W\d_]")


def buckets(text: str) -> np.ndarray:
    """The distinct buckets of the whole text's n-grams."""
    a = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    seen = np.zeros(DIMS, dtype=bool)
    code = np.zeros(len(a), dtype=np.uint32)
    for n in ORDERS:
        if len(a) < n:
            break
        code = (code[: len(a) - n + 1] << np.uint32(8)) | a[n - 1 :]
        seen[((code * np.uint32(2654435761) + np.uint32(n * 0x9E37)) >> np.uint32(16)) & np.uint32(DIMS - 1)] = True
    return np.flatnonzero(seen)


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def presence_of_sets(sets: list[np.ndarray]) -> np.ndarray:
    """A row per set of buckets, of 0 or 1 / sqrt(size of the set): its products are the normalized kernel."""
    out = np.zeros((len(sets), DIMS), dtype=np.float32)
    for i, at in enumerate(sets):
        if len(at):
            out[i, at] = 1 / np.sqrt(len(at))
    return out


def presence(texts: list[str]) -> np.ndarray:
    return presence_of_sets([buckets(t) for t in texts])


@dataclass
class Model:
    languages: list[str]
    #: DIMS x languages: the landmarks' presence times the coefficients.
    folded: np.ndarray
    bias: np.ndarray
    #: Per language, the least lift of a recognized text.
    least: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        out = [presence(texts[i : i + BATCH]) @ self.folded for i in range(0, len(texts), BATCH)]
        return np.concatenate(out) + self.bias if out else np.zeros((0, len(self.languages)))

    def recognized(self, texts: list[str], outputs: np.ndarray) -> np.ndarray:
        """Whether each text, of these outputs, is in one of the languages."""
        top = outputs.argmax(axis=1)
        lift, least = _lift(outputs, self.bias)[np.arange(len(top)), top], self.least[top]
        out = lift >= least
        for i in np.flatnonzero(~out):
            out[i] = lift[i] >= least[i] * min(1, len(buckets(texts[i])) / FULL_GRAMS)
        return out


def _lift(outputs: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return np.where(bias < 1, (outputs - bias) / np.where(bias < 1, 1 - bias, 1), 1.0)


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    return fit_sets([buckets(t) for t in texts], labels, landmarks, ridge)


def fit_sets(sets: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """The texts' buckets in an order that doesn't depend on the labels' sizes; landmarks are taken from each language in
    turn."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((DIMS, 0), np.float32), np.zeros(0), np.zeros(0))
    turns = {lang: [i for i, x in enumerate(labels) if x == lang] for lang in languages}
    chosen = sorted((k, i) for own in turns.values() for k, i in enumerate(own))[:landmarks]
    z = presence_of_sets([sets[i] for _, i in chosen])
    k_nm = np.concatenate([presence_of_sets(sets[i : i + BATCH]) @ z.T for i in range(0, len(sets), BATCH)]).astype(np.float64)
    k_mm = (z @ z.T).astype(np.float64)
    y = np.where(np.asarray(labels)[:, None] == np.asarray(languages)[None, :], 1.0, -1.0)
    # languages weigh the same, whatever their share of the sample
    w = np.asarray([1 / len(turns[x]) for x in labels])
    bias = (w[:, None] * y).sum(axis=0) / w.sum()
    left = (k_nm * w[:, None]).T @ k_nm + ridge * k_mm + 1e-9 * np.eye(len(z))
    alpha = np.linalg.solve(left, (k_nm * w[:, None]).T @ (y - bias))
    lift = _lift(k_nm @ alpha + bias, bias)
    top, own = lift.argmax(axis=1), y.argmax(axis=1)
    # texts that the fit takes for another language say nothing about their label's
    right = [lift[(top == k) & (own == k), k] for k in range(len(languages))]
    least = np.asarray([LIFT_SHARE * np.quantile(x, LIFT_QUANTILE, method="lower") if len(x) else 0.0 for x in right])
    return Model(languages, (z.T.astype(np.float64) @ alpha).astype(np.float32), bias, least)


def held_out(docs: DataFrame):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def _bits(texts: DataFrame) -> DataFrame:
    """lang, place, bits (DIMS / 8 bytes: the buckets of the text) for rows of lang, place, text."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for t in batch.column("text"):
                own = np.zeros(DIMS, dtype=bool)
                own[buckets(t.as_py())] = True
                bits.append(np.packbits(own).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("place"), pa.array(bits, pa.binary())], names=["lang", "place", "bits"])

    return texts.select("lang", "place", "text").mapInArrow(run, "lang string, place double, bits binary")


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[np.ndarray], list[str]]:
    """The buckets of at most per_language whole texts of each of the LANGUAGES most frequent labels, SAMPLE in all, from
    documents that are not held out; those first by a hash of doc_id."""
    own = docs.where(~held_out(docs) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return [], []
    per_language = min(per_language, SAMPLE // len(counts))
    place = F.pmod(F.xxhash64("doc_id", F.lit("lang-sample")), F.lit(1 << 30)) / float(1 << 30)
    keep = F.lit(False)
    for r in counts:
        # a little more than wanted, so that the driver can cut to the exact number
        keep = keep | ((F.col("lang") == r["lang"]) & (F.col("place") < min(1.0, 1.3 * per_language / r["n"])))
    picked = own.select("lang", "text", place.alias("place"), "doc_id").where(keep)
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id", F.xxhash64("text")))
    rows = _bits(picked.withColumn("k", first).where(F.col("k") <= per_language)).collect()
    rows = sorted(rows, key=lambda r: (r["place"], r["lang"], bytes(r["bits"])))
    return [np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8))) for r in rows], [r["lang"] for r in rows]


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    return fit_sets(*training_sample(docs.select("doc_id", "text", "lang"), per_language))


def classify(docs: DataFrame, model: Model, columns: list[str], pred: str = "lang_pred", score: str = "score", reject: bool = False) -> DataFrame:
    """`columns` of docs, and two more with the names of pred and score. columns must not hold text unless it is wanted.
    With reject, texts in none of the model's languages get UNKNOWN and score 0.0 too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS x languages floats

    @released
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            known = np.asarray([bool(m.languages) and has_letter(t) for t in texts], dtype=bool)
            best, value = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
            if known.any():
                lettered = [t for t, k in zip(texts, known, strict=True) if k]
                f = m.scores(lettered)
                if reject:
                    fits = m.recognized(lettered, f)
                    f, known[known] = f[fits], fits
                top = f.argmax(axis=1)
                best[known] = np.asarray(m.languages, dtype=object)[top]
                value[known] = np.clip((f[np.arange(len(f)), top] + 1) / 2, 0, 1)
            yield pdf.drop(columns="text").assign(pred=best, score=value)

    # columns go by place, so that no name clashes; integers as text keep nulls and large ids exact through pandas
    kinds = [dict(docs.dtypes)[c] for c in columns]
    through = ["string" if k == "bigint" else k for k in kinds]
    narrow = docs.select(*[F.col(c).cast(t).alias(f"c{i}") for i, (c, t) in enumerate(zip(columns, through, strict=True))], "text")
    schema = "".join(f"c{i} {t}, " for i, t in enumerate(through))
    out = narrow.mapInPandas(run, f"{schema}pred string, score double")
    back = [F.col(f"c{i}").cast(k).alias(c) for i, (c, k) in enumerate(zip(columns, kinds, strict=True))]
    return out.select(*back, F.col("pred").alias(pred), F.col("score").alias(score))


def language_of(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    model = model or train(docs)
    out = classify(docs.select("doc_id", "text", held_out(docs).alias("held_out")), model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score")


def crc32_mod3(doc_id: int) -> int:
    """As held_out has it, in Python."""
    return zlib.crc32(str(doc_id).encode()) % 3
