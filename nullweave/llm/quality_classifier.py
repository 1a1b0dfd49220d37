"""Quality classifier: histogram gradient-boosted trees over document statistics.

The driver fits the trees on a bounded hash sample of labelled rows (``fit.ROWS_PER_CLASS``, ``fit.SAMPLE_BYTES``):
features are cut into quantile bins, each level's best splits come from histograms of gradients.  The trees are full
binary trees flattened into arrays, so scoring is ``depth`` gathers for all documents and trees at once.  Scoring is
one map over whole texts, without shuffle.

Defined cases: null text counts as empty; an empty text has a score like any other; without labelled rows (or with one
label only) every score is the share of label 1, 0.5 if there is none; repeated rows are scored alike; null ids stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import batch, crc_mod, text_map
from .fit import labelled_sample, over_chunks, sigmoid
from .kernel import Chunk, distinct_sorted, row_sums
from .quality_rules import measure


def marks(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


CLASSES = [marks(bytes(range(65, 91))), marks(bytes(range(48, 58))), marks(b".,;:?"), marks(b"!"), marks(b"|"), marks(b"#*$%&<>"), marks(bytes(range(128, 256))), marks(b"\n"), marks(b"@/\\=+_~^{}[]")]


def statistics(chunk: Chunk) -> np.ndarray:
    """A row of features for each document."""
    m = measure(chunk, (5,))
    start, end, off = chunk.words
    words = np.maximum(m["n_words"], 1)
    size = np.maximum(np.diff(chunk.offsets), 1)
    length = end - start
    out = [np.log1p(m["n_words"]), m["word_chars"] / words, row_sums(length * length, off) / words, row_sums(length <= 3, off) / words, row_sums(length >= 12, off) / words]
    out += [row_sums(c[chunk.data], chunk.offsets) / size for c in CLASSES]
    out += [m["n_lines"] / words, m["n_dup_lines"] / np.maximum(m["n_lines"], 1), m["dup_chars_5"] / np.maximum(m["word_chars"], 1), m["n_repeat_words"] / words]
    out.append(np.diff(distinct_sorted(chunk.word_hashes(0, lower=True), off)[1]) / words)
    return np.column_stack(out).astype(np.float32)


@dataclass
class Trees:
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        out = np.full(len(x), self.base)
        if not trees:
            return out
        node = np.zeros((len(x), trees), np.int64)
        row, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        while node[0, 0] < inner if len(x) else False:
            right = x[row, self.feature[tree, node]] > self.cut[tree, node]
            node = 2 * node + 1 + right
        return out + self.leaf[tree, node - inner].sum(1) if len(x) else out

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x))


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, ridge: float = 2.0, least: float = 3.0) -> Trees:
    n, f = x.shape
    share = float(np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4)) if n else 0.5
    base = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    if n == 0 or len(np.unique(y)) < 2:
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)), base)
    cuts = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0).astype(np.float32)
    binned = np.stack([np.searchsorted(np.unique(cuts[:, k]), x[:, k], "left") for k in range(f)], 1)
    edges = [np.unique(cuts[:, k]) for k in range(f)]
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1))
    margin = np.full(n, base)
    for t in range(trees):
        p = sigmoid(margin)
        g, h = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            place = ((node - first)[:, None] * f + np.arange(f)) * bins + binned
            hist = [np.bincount(place.ravel(), np.repeat(v, f), minlength=count * f * bins).reshape(count, f, bins).cumsum(2) for v in (g, h)]
            gl, hl = hist
            ga, ha = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
            gain[(hl < least / 4) | (ha - hl < least / 4)] = -1
            for k in range(count):
                j, b = np.unravel_index(gain[k].argmax(), (f, bins))
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    feature[t, first + k], cut[t, first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > cut[t, node])
        place = node - inner
        sums = [np.bincount(place, v, minlength=inner + 1) for v in (g, h)]
        leaf[t] = -rate * sums[0] / (sums[1] + ridge)
        margin += leaf[t, place]
    return Trees(feature, cut, leaf, base)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees for the share of label 1; ``labels`` must hold only rows that may be learned from."""
    texts, y, weight = labelled_sample(docs, labels, id_col, text_col, label_col)
    x = over_chunks(texts, statistics)
    return fit_trees(x, np.array(y, float), weight)


def classify(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(rows: pa.RecordBatch, chunk: Chunk) -> pa.RecordBatch:
        return batch(id=rows.column(0), score=shared.value.score(statistics(chunk)))

    kind = docs.schema[id_col].dataType.simpleString()
    return text_map(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of held-out documents are not read."""
    held = crc_mod(F.col("doc_id"), 4) == 2
    trees = train(docs, labels.where(~held))
    return classify(docs, trees).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
