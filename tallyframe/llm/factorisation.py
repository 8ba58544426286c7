"""Factorisation machine over sparse features: fitting on a bounded sample, scoring in linear time.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pair sum is
half of (sum_i v_i x_i)^2 - sum_i (v_i x_i)^2, summed over the factors, so a row
costs its number of features times the number of factors.

Features are a few dense columns and hashed terms (32-bit hashes). Of the terms,
those count whose share of rows differs between the two labels by ``MIN_Z``
standard errors in the sample, so a model's size is bounded by the sample's.
Other terms count for nothing.

The sample holds at most ``SAMPLE_ROWS`` labelled rows, chosen by a hash of the
id. Rows held out never enter it. Null labels, and labelled ids without a row,
are left out; contradicting labels of an id count as 1. Null texts count as empty
and get a score. Without both labels in the sample every score is the share of
label 1 in it (one half if it is empty), kept off 0 and 1.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.shared import annotated, field, utf8

#: Labelled rows that a model is fitted on, at most.
SAMPLE_ROWS = 12_000
FACTORS = 8
MIN_ROWS = 5
MIN_Z = 5.0
EPOCHS = 8
RATE = 0.3
PENALTY = 1e-5
SEED = 7

FEATURES = (field("dense", "double", many=True), field("terms", "long", many=True))
#: Gets a text (UTF-8, empty for null), returns dense values and terms.
Describe = Callable[[bytes], tuple[list[float], set[bytes]]]


@dataclass
class Machine:
    """Dense features have the first places, then the terms in order of ``terms``."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    terms: dict[int, int]

    def features(self, dense: list[float], terms: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
        place = self.terms
        return self.at([i for i in {place.get(zlib.crc32(t), -1) for t in terms} if i >= 0], dense)

    def at(self, found: list[int], dense: Iterable[float]) -> tuple[np.ndarray, np.ndarray]:
        x = np.clip((np.array(dense, float) - self.shift) / self.scale, -4, 4)
        found.sort()
        index = np.concatenate([np.arange(len(x)), np.array(found, np.int64) + len(x)]).astype(np.int64)
        return index, np.concatenate([x, np.ones(len(found))])

    def margin(self, index: np.ndarray, x: np.ndarray) -> float:
        vx = self.factors[index] * x[:, None]
        total = vx.sum(axis=0)
        return self.bias + float(self.linear[index] @ x + 0.5 * (total @ total - np.einsum("ij,ij->", vx, vx)))

    def score(self, index: np.ndarray, x: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.margin(index, x), -35, 35))))


def chosen_terms(terms: list[list[int]], labels: np.ndarray) -> list[int]:
    """Terms whose share of rows differs clearly between the labels, in order of the hash."""
    all_rows, label_rows = Counter(), Counter()
    for row, label in zip(terms, labels):
        all_rows.update(row)
        if label:
            label_rows.update(row)
    ones = float(labels.sum())
    zeros = len(labels) - ones
    kept = []
    for term, n in all_rows.items():
        if n >= MIN_ROWS:
            share = n / len(labels)
            error = np.sqrt(max(share * (1 - share), 1 / len(labels)) * (1 / ones + 1 / zeros))
            if abs(label_rows[term] / ones - (n - label_rows[term]) / zeros) >= MIN_Z * error:
                kept.append(term)
    return sorted(kept)


def fitted(dense: list[list[float]], terms: list[list[int]], labels: list[int], factors: int = FACTORS) -> Machine:
    """Adaptive gradient descent on the logistic loss, row by row in a fixed random order."""
    y = np.array(labels, float)
    share = float(y.mean()) if len(y) else 0.5
    rows = np.array(dense, float).reshape(len(y), -1)
    two = 0.0 < share < 1.0
    place = {t: i for i, t in enumerate(chosen_terms(terms, y))} if two else {}
    size = rows.shape[1] + len(place)
    rng = np.random.default_rng(SEED)
    share = min(max(share, 1e-3), 1 - 1e-3)
    machine = Machine(
        float(np.log(share / (1 - share))),
        np.zeros(size),
        rng.normal(0, 0.01, (size, factors)) if two else np.zeros((size, factors)),
        rows.mean(axis=0) if len(rows) else np.zeros(rows.shape[1]),
        np.maximum(rows.std(axis=0), 1e-6) if len(rows) else np.ones(rows.shape[1]),
        place,
    )
    if not two:
        return machine
    examples = [machine.at([place[t] for t in row if t in place], rows[i]) for i, row in enumerate(terms)]
    linear_sum, factor_sum, bias_sum = np.full(size, 1e-2), np.full((size, factors), 1e-2), 1e-2
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            index, x = examples[i]
            v = machine.factors[index]
            vx = v * x[:, None]
            total = vx.sum(axis=0)
            margin = machine.bias + machine.linear[index] @ x + 0.5 * (total @ total - np.einsum("ij,ij->", vx, vx))
            slope = 1.0 / (1.0 + np.exp(-min(max(margin, -35.0), 35.0))) - y[i]
            step = slope * x + PENALTY * machine.linear[index]
            linear_sum[index] += step * step
            machine.linear[index] -= RATE * step / np.sqrt(linear_sum[index])
            step = slope * x[:, None] * (total - vx) + PENALTY * v
            factor_sum[index] += step * step
            machine.factors[index] -= RATE * 0.5 * step / np.sqrt(factor_sum[index])
            bias_sum += slope * slope
            machine.bias -= RATE * slope / np.sqrt(bias_sum)
    return machine


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Callable[[Column], Column]) -> DataFrame:
    """At most ``SAMPLE_ROWS`` labelled ids by a hash of the id, with their texts."""
    known = labels.select(labels["doc_id"].alias("id"), labels[label].cast("int").alias("label"))
    known = known.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("id")))
    some = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
    texts = docs.select(docs["doc_id"].alias("id"), docs["text"].alias("text"))
    return texts.join(F.broadcast(some), "id")  # bounded by SAMPLE_ROWS


def fit(
    docs: DataFrame, labels: DataFrame, label: str, usable: Callable[[Column], Column], describe: Describe
) -> Machine:
    """Features are made where the texts lie; one task fits the bounded sample; the model comes back."""

    def features(parts):
        for (texts,) in parts:
            made = [describe(t or b"") for t in utf8(texts)]
            yield [d for d, _ in made], [sorted({zlib.crc32(t) for t in terms}) for _, terms in made]

    sample = labelled_sample(docs, labels, label, usable)
    rows = annotated(sample, ["text"], features, FEATURES, ["id", "label"]).select("row.id", "row.label", "dense", "terms")
    # ids that occur in many rows must not widen the bounded sample
    rows = rows.orderBy(F.xxhash64("id"), "id", F.xxhash64("terms")).limit(SAMPLE_ROWS)

    def train(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        machine = fitted(
            [list(x) for x in frame["dense"]], [list(map(int, x)) for x in frame["terms"]], frame["label"].tolist()
        )
        return pd.DataFrame({"model": [pickle.dumps(machine.__dict__)]})

    found = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(train, "model binary").first()
    if found is None:
        width = len(describe(b"")[0])
        return Machine(0.0, np.zeros(width), np.zeros((width, FACTORS)), np.zeros(width), np.ones(width), {})
    return Machine(**pickle.loads(found["model"]))


def scored(docs: DataFrame, machine: Machine, describe: Describe, keep: Iterable[str] | None = None) -> DataFrame:
    """Per row: ``row`` (the kept columns) and ``score``."""
    shipped = docs.sparkSession.sparkContext.broadcast(machine.__dict__)

    def step(parts):
        model = Machine(**shipped.value)
        for (texts,) in parts:
            yield ([model.score(*model.features(*describe(t or b""))) for t in utf8(texts)],)

    return annotated(docs, ["text"], step, [field("score", "double")], keep)
