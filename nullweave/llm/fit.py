"""Bounded samples and small numpy learners for the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import Chunk, chunks

#: Bounds of what a classifier is fitted on: rows for each class, and bytes of text in all.
ROWS_PER_CLASS = 1500
SAMPLE_BYTES = 12 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = ROWS_PER_CLASS, most_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list, np.ndarray]:
    """Texts, labels and weights of a hash sample of at most ``rows`` documents for each label.

    ``labels`` has the id and the label; weights give each label its share of all labelled rows.  Each label has an equal part of
    ``most_bytes``; a text that does not fit into what is left of it is left out, and the next ones are tried.  Rows
    without id, label or text are not used.  One count and one pass for all labels: a hash bound that about
    ``2 * rows`` ids of a label pass comes before the ordered choice, so no task orders more than these."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id is not null and label is not null")
    total = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not total:
        return [], [], np.zeros(0)
    space = 1 << 40
    bound = F.create_map(*[F.lit(x) for label in sorted(total) for x in (label, min(space, space * (2 * rows + 100) // total[label]))])
    near = known.where(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(space)) < bound[F.col("label")])
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    picked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows).drop("rank")
    each = most_bytes // len(total)
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where(F.octet_length("text") <= each)
    chosen = source.join(F.broadcast(picked), "id")
    texts, ys, used = [], [], dict.fromkeys(total, 0)
    for r in chosen.orderBy(F.xxhash64("id", F.lit(1)), "id", "text", "label").select("text", "label").toLocalIterator():
        size = len(r["text"].encode())
        if used[r["label"]] + size <= each:
            used[r["label"]] += size
            texts.append(r["text"])
            ys.append(r["label"])
    share = {k: total[k] / max(1, ys.count(k)) for k in total}
    weight = np.array([share[y] for y in ys], float)
    return texts, ys, weight / weight.mean() if len(weight) else weight


def text_chunks(texts: list[str], limit: int = 1 << 22):
    yield from chunks(pa.array(texts, pa.large_string()), limit)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights of a small logistic regression by Newton steps; the last one is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def adagrad(gradient, w: np.ndarray, rounds: int, rate: float) -> np.ndarray:
    """Full-batch descent with a step for each weight."""
    seen = np.full(w.shape, 1e-8)
    for _ in range(rounds):
        g = gradient(w)
        seen += g * g
        w = w - rate * g / np.sqrt(seen)
    return w


def over_chunks(texts: list[str], f) -> np.ndarray:
    parts = [f(c) for c in text_chunks(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, 0))


__all__ = ["Chunk", "adagrad", "labelled_sample", "logistic", "over_chunks", "sigmoid", "text_chunks"]
