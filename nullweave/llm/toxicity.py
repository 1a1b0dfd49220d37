"""Toxic spans by a linear-chain conditional random field.

Token labels are derived from the document labels of a bounded sample (``fit.ROWS_PER_CLASS``, ``fit.SAMPLE_BYTES``): a
greedy cover picks the words and word beginnings that explain toxic documents and hardly occur in others, and the tokens of
toxic documents with such a stem are labelled toxic.  The field has two states; its emissions are hashed features of a
token (word, beginnings, endings), its transitions are learned.  A document is one chain, however long: tokens are laid out in
blocks, a first pass multiplies each block's transfer matrices, a scan over the blocks carries the state from block to
block, and a second pass gives each token's marginal.  A document's first token forgets what came before, so
documents do not touch each other.  Marginals are aggregated to a document score by a small
logistic regression over the largest marginal, the expected number of toxic tokens and their share.  One map.

Defined cases: null or empty text has no tokens and gets the score of a document without toxic tokens; without labelled
rows (or with one label) the score is the share of label 1, 0 if there is none; repeated rows are scored alike;
null ids stay; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import batch, crc_mod, text_map
from .fit import adagrad, labelled_sample, logistic, sigmoid, text_chunks
from .kernel import BYTE_POLY, BYTE_TABLE, Chunk, U64, mix, row_sums

BITS = 18
STEMS = (4, 5, 6, 7, 8, 9)
AFFIXES = ((3, 0), (4, 0), (5, 0), (6, 0), (7, 0), (8, 0), (9, 0), (0, 3), (0, 4))
TOKEN = np.zeros(256, bool)
TOKEN[48:58] = TOKEN[65:91] = TOKEN[97:123] = TOKEN[128:] = True


class Tokens:
    """Tokens of a chunk (runs of letters and digits) and their features."""

    def __init__(self, chunk: Chunk):
        self.start, self.end, self.off = chunk.runs(TOKEN[chunk.data])
        self.low = chunk.lowered()
        self.first = np.zeros(len(self.start), bool)
        self.first[self.off[:-1][np.diff(self.off) > 0]] = True

    def features(self, some: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Of all tokens, or of some."""
        values = BYTE_TABLE[0][self.low]
        start, end = self.start[some], self.end[some]
        size = end - start
        out = [BYTE_POLY[0].runs(values, start, end)]
        for k, (front, back) in enumerate(AFFIXES):
            a = start if front else np.maximum(start, end - back)
            b = np.minimum(end, start + front) if front else end
            h = mix(BYTE_POLY[0].runs(values, a, b) + U64(k + 1))
            out.append(np.where(size > front + back, h, U64(0)))
        return (np.stack(out, 1) >> U64(64 - BITS)).astype(np.int64)


def marginals(odds: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of chains laid end to end: probability of state 1 at each token, expected transitions, log of the partition
    functions' product.

    ``odds``: emission of state 1 against 0; ``first``: where a chain begins; ``trans``: log weights, from state to state.
    A token's transfer matrix is its transitions times its emission; that of a first token has equal rows."""
    n = len(odds)
    if not n:
        return np.zeros(0), np.zeros((2, 2)), 0.0
    steps = max(16, int(np.sqrt(n) / 3))
    blocks = -(-n // steps)

    def grid(values: np.ndarray, fill: float) -> np.ndarray:
        out = np.full(steps * blocks, fill)
        out[:n] = values
        return np.ascontiguousarray(out.reshape(blocks, steps).T)

    e1 = np.exp(np.clip(odds, -30, 30))
    t = np.exp(trans)
    # Rows after the last token are identities.
    m00, m10 = (grid(np.where(first, 1.0, t[s, 0]), 1.0 - s) for s in (0, 1))
    m01, m11 = (grid(np.where(first, 1.0, t[s, 1]) * e1, float(s)) for s in (0, 1))

    # Product of each block, up to a factor; then the state before each block, and the ratio of what follows it.
    p00, p01, p10, p11 = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for k in range(steps):
        p00, p01, p10, p11 = p00 * m00[k] + p01 * m10[k], p00 * m01[k] + p01 * m11[k], p10 * m00[k] + p11 * m10[k], p10 * m01[k] + p11 * m11[k]
        z = p00 + p01 + p10 + p11
        p00, p01, p10, p11 = p00 / z, p01 / z, p10 / z, p11 / z
    a0, a1 = np.empty(blocks), np.empty(blocks)
    b0, b1 = np.empty(blocks), np.empty(blocks)
    product = list(zip(p00.tolist(), p01.tolist(), p10.tolist(), p11.tolist()))
    x, y = 0.5, 0.5
    for k, (c00, c01, c10, c11) in enumerate(product):
        a0[k], a1[k] = x, y
        x, y = x * c00 + y * c10, x * c01 + y * c11
        x, y = x / (x + y), y / (x + y)
    x, y = 0.5, 0.5
    for k in range(blocks - 1, -1, -1):
        b0[k], b1[k] = x, y
        c00, c01, c10, c11 = product[k]
        x, y = c00 * x + c01 * y, c10 * x + c11 * y
        x, y = x / (x + y), y / (x + y)

    f0, f1 = np.empty((steps, blocks)), np.empty((steps, blocks))  # states before each token
    z = np.empty((steps, blocks))
    for k in range(steps):
        f0[k], f1[k] = a0, a1
        a0, a1 = a0 * m00[k] + a1 * m10[k], a0 * m01[k] + a1 * m11[k]
        z[k] = a0 + a1
        a0, a1 = a0 / z[k], a1 / z[k]
    p = np.empty((steps, blocks))
    inner = grid(~first, 0.0)
    pairs = np.zeros((2, 2))
    for k in range(steps - 1, -1, -1):
        c00, c01, c10, c11 = f0[k] * m00[k] * b0, f0[k] * m01[k] * b1, f1[k] * m10[k] * b0, f1[k] * m11[k] * b1
        one = c01 + c11
        total = c00 + c10 + one
        p[k] = one / total
        share = inner[k] / total
        pairs += [[c00 @ share, c01 @ share], [c10 @ share, c11 @ share]]
        b0, b1 = m00[k] * b0 + m01[k] * b1, m10[k] * b0 + m11[k] * b1
        s = b0 + b1
        b0, b1 = b0 / s, b1 / s
    # States before a first token sum to 1 and count for nothing, so each chain's factors are its partition function's.
    return p.T.ravel()[:n], pairs, float(np.log(z.T.ravel()[:n]).sum())


@dataclass
class Field:
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    head: np.ndarray | None
    share: float

    def tag(self, tokens: Tokens) -> np.ndarray:
        """Marginal of the toxic state of every token."""
        if not len(tokens.start):
            return np.zeros(0)
        odds = self.weights[tokens.features()].sum(1) + self.bias
        return marginals(odds, tokens.first, self.trans)[0]

    def gathered(self, p: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = np.diff(off)
        top = np.zeros(len(n))
        np.maximum.at(top, np.repeat(np.arange(len(n)), n), p)
        total = row_sums(np.where(p > 0.05, p, 0), off)
        return np.column_stack([top, np.log1p(total), total / np.maximum(n, 1)])

    def score(self, p: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.head is None:
            return np.full(len(off) - 1, self.share)
        return sigmoid(np.column_stack([self.gathered(p, off), np.ones(len(off) - 1)]) @ self.head)


def words_of(chunk: Chunk, tokens: Tokens) -> list[list[bytes]]:
    raw = tokens.low.tobytes()
    every = [raw[a:b] for a, b in zip(tokens.start.tolist(), tokens.end.tolist())]
    return [every[a:b] for a, b in zip(tokens.off[:-1].tolist(), tokens.off[1:].tolist())]


def stems_of(word: bytes) -> list[bytes]:
    """The whole word (marked by a space) and its proper beginnings: a word of its own tells nothing of longer ones."""
    return [word + b" ", *(word[:k] for k in STEMS if len(word) > k)]


def cover(docs: list[list[bytes]], toxic: np.ndarray, least: int = 3, leaks: tuple[float, ...] = (0.02, 0.1), lift: float = 6.0) -> set[bytes]:
    """Stems that together explain the toxic documents: again and again the one in most that are not yet explained.

    ``leaks`` bounds the share of other documents among those with a stem: first strict stems, then, for what these
    leave unexplained, laxer ones.  Beginnings that words of both kinds share explain all documents once more, if they stand
    in toxic ones so much more often than chance that it is ``lift`` deviations: they reach words not seen yet."""
    seen = [Counter(), Counter()]
    held: list[set[bytes]] = []
    known = {w: stems_of(w) for w in {w for words in docs for w in words}}
    for words, y in zip(docs, toxic):
        stems = set().union(*(known[w] for w in set(words)))
        seen[int(y)].update(stems)
        held.append(stems if y else set())
    factor = max(1.0, (toxic == 1).sum() / max(1, (toxic == 0).sum()))
    share = float((toxic == 1).mean())
    every = {k for k, y in enumerate(toxic) if y}

    def chosen(good: set[bytes], open_docs: set[int]) -> tuple[set[bytes], dict[bytes, list[int]]]:
        where: dict[bytes, list[int]] = {}
        for k, stems in enumerate(held):
            for s in stems & good:
                where.setdefault(s, []).append(k)
        gain = {s: sum(k in open_docs for k in v) for s, v in where.items()}
        out = set()
        while gain:
            best = max(gain, key=lambda s: (gain[s], len(s), s))
            if gain[best] < least:
                break
            out.add(best)
            for k in where[best]:
                if k in open_docs:
                    open_docs.discard(k)
                    for s in held[k] & good:
                        gain[s] -= 1
            gain[best] = 0
        return out, where

    open_docs, out = set(every), set()
    for leak in leaks:
        more, where = chosen({s for s, n in seen[1].items() if n >= least and seen[0][s] * factor <= leak * n}, open_docs)
        out |= widened(more, where, seen, factor, leak) if leak == leaks[0] else more

    def deviations(s: bytes) -> float:
        n = seen[0][s] + seen[1][s]
        return (seen[1][s] - share * n) / math.sqrt(n * share * (1 - share))

    common = {s for s, n in seen[1].items() if n >= least and not s.endswith(b" ") and seen[0][s] * factor < n and deviations(s) >= lift}
    return out | chosen(common, every)[0]


def widened(stems: set[bytes], where: dict, seen: list[Counter], factor: float, leak: float) -> set[bytes]:
    """Whole toxic words that the cover did not need: those that stand in about as many documents as chosen ones do."""
    if not stems:
        return stems
    usual = np.median([len(where[s]) for s in stems])
    return stems | {s for s, docs in where.items() if len(docs) >= usual / 2 and s.endswith(b" ") and seen[0][s] * factor <= leak * len(docs) / 4}


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray, rounds: int = 40) -> Field:
    share = float((weight * toxic).sum() / weight.sum()) if len(toxic) else 0.0
    empty = Field(np.zeros(1 << BITS), 0.0, np.zeros((2, 2)), None, share)
    if len(np.unique(toxic)) < 2:
        return empty
    parts = [Tokens(c) for c in text_chunks(texts)]
    docs = [w for c, t in zip(text_chunks(texts), parts) for w in words_of(c, t)]
    stems = cover(docs, toxic)
    told = {w: any(s in stems for s in stems_of(w)) for k in np.flatnonzero(toxic) for w in docs[k]}
    label, at = [], 0
    for t in parts:
        n = len(t.off) - 1
        label.append(np.array([float(told[w]) if toxic[at + k] else 0.0 for k in range(n) for w in docs[at + k]]))
        at += n
    # Emissions are functions of the word: each part's distinct words have features, and tokens refer to them.
    kinds = [np.unique(BYTE_POLY[1].runs(BYTE_TABLE[1][t.low], t.start, t.end), return_index=True, return_inverse=True)[1:] for t in parts]
    feats = [t.features(first).astype(np.int32) for t, (first, _) in zip(parts, kinds)]
    gold = np.zeros((2, 2))
    for t, y in zip(parts, label):
        both = np.flatnonzero(~t.first[1:])
        np.add.at(gold, (y[both].astype(int), y[both + 1].astype(int)), 1)
    tokens = max(1, sum(len(y) for y in label))

    def gradient(w: np.ndarray) -> np.ndarray:
        g = np.zeros_like(w)
        trans = w[-4:].reshape(2, 2)
        pairs = np.zeros((2, 2))
        for t, f, (_, kind), y in zip(parts, feats, kinds, label):
            p, more, _ = marginals((w[:-5][f].sum(1) + w[-5])[kind], t.first, trans)
            miss = p - y
            g[: 1 << BITS] += np.bincount(f.ravel(), np.repeat(np.bincount(kind, miss, len(f)), f.shape[1]), minlength=1 << BITS)
            g[-5] += miss.sum()
            pairs += more
        g[-4:] += (pairs - gold).ravel()
        return g / tokens + 1e-7 * w

    start = np.zeros((1 << BITS) + 5)
    start[-5] = -3.0
    w = adagrad(gradient, start, rounds, 0.5)
    field = Field(w[:-5].astype(np.float32), float(w[-5]), w[-4:].reshape(2, 2), None, share)
    x = np.concatenate([field.gathered(field.tag(t), t.off) for t in parts])
    field.head = logistic(x, toxic.astype(float), weight, ridge=1e-2)
    return field


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Field:
    """A field fitted to document labels; ``labels`` must hold only rows that may be learned from."""
    texts, y, weight = labelled_sample(docs, labels, id_col, text_col, label_col)
    return fit(texts, np.array(y, int), weight)


def tag_documents(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, spans: bool = True) -> DataFrame:
    """id, score and, if asked for, the toxic spans (start and stop in code points, probability)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(rows: pa.RecordBatch, chunk: Chunk) -> pa.RecordBatch:
        f, t = shared.value, Tokens(chunk)
        p = f.tag(t)
        out = {"id": rows.column(0), "score": f.score(p, t.off)}
        if spans:
            hit = np.flatnonzero(p >= least)
            ahead = chunk.code_points()
            doc = np.searchsorted(t.off, hit, "right") - 1
            base = ahead[chunk.offsets[:-1]][doc]
            found = pa.StructArray.from_arrays([pa.array(ahead[t.start[hit]] - base), pa.array(ahead[t.end[hit]] - base), pa.array(p[hit])], ["start", "stop", "probability"])
            out["spans"] = pa.ListArray.from_arrays(pa.array(np.searchsorted(hit, t.off).astype(np.int32)), found)
        return batch(**out)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, score double" + ", spans array<struct<start: long, stop: long, probability: double>>" * spans
    return text_map(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, schema).withColumnRenamed("id", id_col)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, n_spans and the spans themselves; labels of held-out documents are not read."""
    held = crc_mod(F.col("doc_id"), 4) == 2
    field = train(docs, labels.where(~held))
    return tag_documents(docs, field).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), "spans")
