"""Language identification by hierarchical discrimination.

First the family: one linear support vector machine for each family against the rest.  Within the winning family,
one-versus-one machines separate its languages and vote.  Features are hashed byte n-grams of 1 to 3 (letters only, case
folded, each run of other characters as one space) as shares of the document; every machine is linear in them, so a document's
margins are means of weights gathered at each byte: one map over whole texts, all machines at once.

The driver fits squared-hinge machines on a bounded hash sample for each language (``ROWS_PER_LANGUAGE``,
``fit.SAMPLE_BYTES``), and a logistic map from each margin to a probability.

Defined cases: null text, or text without a letter, is ``und`` with score 0; without learned languages every text is
``und``; with one language that one is predicted; repeated rows are judged alike; null ids stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import batch, crc_mod, text_map
from .fit import labelled_sample, logistic, sigmoid, text_chunks
from .kernel import Chunk, row_sums

# Language families by ISO 639-1 code.  Codes that are not listed form the family "other".
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "semitic": ["am", "ar", "he", "mt"],
    "cjk": ["ja", "ko", "zh"],
}
BITS = 12
BUCKETS = 1 << BITS
ROWS_PER_LANGUAGE = 700
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes), "other")


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the n-grams of 1 to 3 bytes that begin at each kept byte (3 columns), and the documents' offsets.

    Letters are kept, and the first of each run of other bytes, as a space.  A document's end counts as spaces, so a
    document's n-grams are its own, whatever stands beside it."""
    letter = LETTER[chunk.data]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    starts = chunk.offsets[:-1]
    keep[starts[starts < len(keep)]] = True
    ahead = np.concatenate([[0], np.cumsum(keep)])
    off = ahead[chunk.offsets]
    x = np.where(letter, chunk.lowered(), 32)[keep].astype(np.uint32)
    last = off[1:][np.diff(off) > 0] - 1
    b, c = np.append(x[1:], np.uint32(32)), np.append(x[2:], np.full(2, 32, np.uint32))[: len(x)]
    b[last] = 32
    c[last], c[np.maximum(last - 1, 0)] = 32, 32
    two = x << 8 | b
    three = two << 8 | c
    return np.stack([x, (two * np.uint32(2654435761)) >> np.uint32(32 - BITS), (three * np.uint32(2246822519)) >> np.uint32(32 - BITS)], 1).astype(np.int64), off


def shares(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), BUCKETS), np.float32)
    at = 0
    for chunk in text_chunks(texts, 1 << 20):
        f, off = features(chunk)
        for k in range(chunk.n):
            part = f[off[k] : off[k + 1]].ravel()
            if len(part):
                out[at + k] = np.bincount(part, minlength=BUCKETS) / len(part)
        at += chunk.n
    return out


def machines(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Squared-hinge linear machines by accelerated descent, all at once: weights (columns) and intercepts.

    ``y``: rows x machines, +1 or -1, or 0 where a machine does not learn from a row; both signs of a machine weigh alike.
    Everything is in single precision, so the rows are read as they are at every step."""
    weight = np.where(y > 0, 0.5 / np.maximum(1, (y > 0).sum(0)), np.where(y < 0, 0.5 / np.maximum(1, (y < 0).sum(0)), 0))
    pull, y = (2 * y * weight).astype(np.float32), y.astype(np.float32)
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    b = np.zeros(y.shape[1], np.float32)
    v, c = w, b
    step = (1 / (2 * np.einsum("ij,ij->i", x, x).astype(float) @ weight + 2 + ridge)).astype(np.float32)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v + c)) * pull
        nw, nb = v + step * (x.T @ slack - np.float32(ridge) * v), c + step * slack.sum(0)
        mom = np.float32(k / (k + 3))
        v, c = nw + mom * (nw - w), nb + mom * (nb - b)
        w, b = nw, nb
    return w, b


@dataclass
class Model:
    langs: list[str]
    families: list[str]
    pairs: list[tuple[int, int]]  # of languages of one family
    weights: np.ndarray  # buckets x machines: families first, then pairs
    bias: np.ndarray
    scale: np.ndarray  # machines x 2: margin to log odds

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language index and score, from the margins of each document."""
        odds = sigmoid(margins * self.scale[:, 0] + self.scale[:, 1])
        nf = len(self.families)
        fam = np.maximum(odds[:, :nf], 1e-12)
        fam = fam / fam.sum(1, keepdims=True)
        which = fam.argmax(1)
        votes = np.zeros((len(margins), len(self.langs)))
        chance = np.ones((len(margins), len(self.langs)))
        for k, (i, j) in enumerate(self.pairs):
            p = odds[:, nf + k]
            votes[:, i] += p > 0.5
            votes[:, j] += p <= 0.5
            chance[:, i], chance[:, j] = np.minimum(chance[:, i], p), np.minimum(chance[:, j], 1 - p)
        mine = np.array([self.families.index(family(x)) for x in self.langs])[None, :] == which[:, None]
        best = np.where(mine, votes + chance / 2, -1).argmax(1)
        rows = np.arange(len(margins))
        return best, fam[rows, which] * chance[rows, best]


def fit(texts: list[str], langs: list[str]) -> Model:
    names = sorted(set(langs))
    fams = sorted({family(x) for x in names})
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if family(names[i]) == family(names[j])]
    if not names:
        return Model([], [], [], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), np.zeros((0, 2)))
    x = shares(texts)
    spread = 1 / (x.std(0) + 1e-3 / BUCKETS + 1e-6)
    x = (x * spread / np.sqrt(BUCKETS)).astype(np.float32)
    y, of = np.array(langs, dtype=object), np.array([family(v) for v in langs], dtype=object)
    sign = np.array([np.where(of == f, 1, -1) for f in fams] + [(y == names[i]) * 1 - (y == names[j]) * 1 for i, j in pairs]).T
    w, b = machines(x, sign)
    margin, scale = x @ w + b, []
    for k in range(sign.shape[1]):
        use = sign[:, k] != 0
        both = len(np.unique(sign[use, k])) == 2
        scale.append(logistic(margin[use, k : k + 1].astype(float), (sign[use, k] > 0).astype(float), np.ones(use.sum()), ridge=1.0) if both else np.array([1.0, 5.0]))
    return Model(names, fams, pairs, w * (spread / np.sqrt(BUCKETS)).astype(np.float32)[:, None], b.astype(float), np.array(scale).reshape(-1, 2))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    texts, langs, _ = labelled_sample(docs, docs, id_col, text_col, lang_col, ROWS_PER_LANGUAGE)
    return fit(texts, langs)


def margins(model: Model, chunk: Chunk) -> np.ndarray:
    f, off = features(chunk)
    score = model.weights[f[:, 0]]
    score += model.weights[f[:, 1]]
    score += model.weights[f[:, 2]]
    return row_sums(score.astype(np.float64), off) / (3 * np.maximum(np.diff(off), 1))[:, None] + model.bias


def has_letter(chunk: Chunk) -> np.ndarray:
    plain = row_sums(LETTER[chunk.data] & (chunk.data < 128), chunk.offsets) > 0
    for k in np.flatnonzero(~plain & (np.diff(chunk.offsets) > 0)):
        plain[k] = any(c.isalpha() for c in chunk.data[chunk.offsets[k] : chunk.offsets[k + 1]].tobytes().decode())
    return plain


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: pa.RecordBatch, chunk: Chunk) -> pa.RecordBatch:
        m = shared.value
        known = has_letter(chunk) & bool(m.langs)
        lang = np.full(chunk.n, "und", dtype=object)
        score = np.zeros(chunk.n)
        if known.any():
            best, s = m.predict(margins(m, chunk))
            lang[known] = np.array(m.langs, dtype=object)[best[known]]
            score[known] = s[known]
        return batch(id=rows.column(0), lang_pred=pa.array(lang, pa.string()), score=score)

    kind = docs.schema[id_col].dataType.simpleString()
    return text_map(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; lang of held-out documents is not read."""
    held = crc_mod(F.col("doc_id"), 5) == 0
    model = train(docs.where(~held))
    return identify(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
