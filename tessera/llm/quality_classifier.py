"""A quality classifier: naive Bayes support vectors.

Features are indicators of word unigrams, word bigrams and byte trigrams of the whole text, hashed.
Log-count ratios of the classes come from a bounded sample of labelled training documents, counted by
Spark; a linear machine is fitted on indicators times ratios, by dual coordinate descent, over a part
of these; its margin goes through a sigmoid that is fitted on documents the machine has not seen.
The ids of the sample are chosen first, from the labels alone, so that texts are filtered where they
are read and only sampled ones move.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import hashing
from tessera.llm.common import hash_sample, map_texts, stash, text_batches
from tessera.llm.linear import fit_hinge, fit_sigmoid

#: Buckets of word n-grams and of byte trigrams.
WORDS, BYTES = 1 << 18, 1 << 16
SIZE = WORDS + BYTES
#: Labelled documents of each class that the ratios are counted on, at most, and of those the machine and the sigmoid.
LABELLED, SAMPLE = 10_000, 1500
#: Tasks that count the ratios; their texts are bounded by LABELLED.
COUNTERS = 8
#: Added to every count of a ratio.
SMOOTH = 1.0
#: The bucket of a word that stands twice in a row, whatever the word.
TWICE = 0


def features(texts: list[str]) -> list[np.ndarray]:
    """The distinct buckets of each text, ascending."""
    hashes, at = hashing.words(texts)
    bigrams = hashing.shingles(hashes, 2)
    one = (hashes % np.uint64(WORDS - 1)).astype(np.int64) + 1
    two = (bigrams % np.uint64(WORDS - 1)).astype(np.int64) + 1
    if len(two):
        two[hashes[1:] == hashes[:-1]] = TWICE
    out = []
    for k, text in enumerate(texts):
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
        if len(data) > 2:
            tri = ((data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA77) + data[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(9)) & np.uint32(BYTES - 1)
            seen = np.zeros(BYTES, bool)
            seen[tri] = True
            tri = np.flatnonzero(seen)
        else:
            tri = np.zeros(0, np.int64)
        a, b = at[k], at[k + 1]
        out.append(np.concatenate([np.unique(np.concatenate([one[a:b], two[a : max(a, b - 1)]])), tri + WORDS]))
    return out


@dataclass
class QualityModel:
    """weights: machine times ratios, with the constant last; the sigmoid's slope and shift."""

    weights: np.ndarray
    slope: float
    shift: float

    def score(self, texts: list[str]) -> np.ndarray:
        """P(label 1) of each text; an empty text has only the constant."""
        margins = np.array([_scaled(self.weights, f) for f in features(texts)])
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def _scaled(w: np.ndarray, found: np.ndarray) -> float:
    return float(w[found].sum() / np.sqrt(max(len(found), 1)) + w[-1])


def log_ratios(labelled: DataFrame) -> np.ndarray:
    """log of the class shares of each bucket, from (text, label); SIZE numbers at most leave Spark."""

    def count(frames):
        total = np.zeros((2, SIZE), np.int64)
        rows = np.zeros(2, np.int64)
        for frame in frames:
            labels = frame["label"].tolist()
            for start, texts in text_batches(frame["text"]):
                for k, found in enumerate(features(texts), start):
                    total[labels[k], found] += 1
                    rows[labels[k]] += 1
        where = np.flatnonzero(total.any(axis=0))
        yield pd.DataFrame({"bucket": np.append(where, -1), "n1": np.append(total[1, where], rows[1]), "n0": np.append(total[0, where], rows[0])})

    sums = labelled.mapInPandas(count, "bucket int, n1 long, n0 long").groupBy("bucket").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).toPandas()
    counts = np.zeros((2, SIZE))
    inner = sums[sums["bucket"] >= 0]
    counts[1, inner["bucket"]], counts[0, inner["bucket"]] = inner["n1"], inner["n0"]
    rows = sums.loc[sums["bucket"] == -1, ["n0", "n1"]].to_numpy(float).reshape(-1, 2).sum(axis=0)
    return np.log((counts[1] + SMOOTH) / (rows[1] + 2 * SMOOTH)) - np.log((counts[0] + SMOOTH) / (rows[0] + 2 * SMOOTH))


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on the labelled rows where ``train`` (a condition on ``id``) holds.

    Labels other than 0 and 1, null ids and null texts are passed over; an id and label that stand
    together several times count once. Of documents that share a sampled id, the ratios count all
    and the machine takes one. If a class has no document, every text scores its only class's share
    (0.5 without any label).
    """
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & train)
    chosen = stash(hash_sample(marks, "label", LABELLED), "quality-labelled")  # 2 * LABELLED rows at most, hence broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    found = stash(texts.join(F.broadcast(chosen), "id").select("id", "label", "text"), "quality-sample")
    ratios = log_ratios(found.repartition(COUNTERS))
    few = F.broadcast(hash_sample(chosen, "label", SAMPLE))
    sample = found.join(few, ["id", "label"]).groupBy("id", "label").agg(F.min("text").alias("text")).toPandas().sort_values(["id", "label"])  # 2 * SAMPLE rows at most
    y = sample["label"].to_numpy(int)
    if len(set(y)) < 2:
        share = float((y.sum() + 1) / (len(y) + 2))
        return QualityModel(np.zeros(SIZE + 1), 1.0, float(np.log(share / (1 - share))))
    rows = [(f, ratios[f] / np.sqrt(max(len(f), 1))) for f in (x for _, part in text_batches(sample["text"]) for x in features(part))]
    held = np.arange(len(rows)) % 5 == 0
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held[:] = False
    fitted = np.flatnonzero(~held)
    share = [max(1, (y[fitted] == c).sum()) for c in (0, 1)]
    costs = np.array([len(fitted) / (2 * share[y[k]]) for k in fitted])
    w = fit_hinge([rows[k] for k in fitted], np.where(y[fitted] == 1, 1.0, -1.0), SIZE, costs)
    full = np.append(w[:-1] * ratios, w[-1])
    checked = np.flatnonzero(held) if held.any() else fitted
    margins = np.array([_scaled(full, rows[k][0]) for k in checked])
    return QualityModel(full, *fit_sigmoid(margins, y[checked] == 1))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row for each row of ``docs``: id, score (0 to 1), predicted (1 from ``threshold`` on).

    Whole texts are read, null ones as empty; nothing but the text is an input. Null and repeated ids
    keep their rows; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE numbers
    out = map_texts(docs, [F.col(id_col).alias("id")], F.col(text_col), "score double", lambda texts: [pa.array(shared.value.score(texts), pa.float64())])
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
