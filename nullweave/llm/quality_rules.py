"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths, measured in numpy per chunk.

Per document: words, characters inside words, symbols, duplicate lines, and for each n-gram length the characters
covered by n-grams that occur twice or more (first occurrence included).  A document is kept when the base rule and
all coverage limits hold.  One map over the text, no shuffle.

Defined cases: null text counts as empty; empty or wordless text has zero counts and fails; repeated rows are judged
one by one; null ids pass through; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .engine import batch, text_map
from .kernel import BYTE_POLY, BYTE_TABLE, SEPARATOR, WORD_POLY, Chunk, U64, mix, ngram_positions, owners, row_sums

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Limits:
    """The base rule, then shares of word characters; a share above its limit rejects the document."""

    min_words: int = 20
    repeat_words_percent: int = 30
    duplicate_lines: float = 0.50
    duplicate_line_chars: float = 0.30
    symbols: float = 0.10
    ngrams: dict[int, float] = field(default_factory=lambda: {5: 0.40, 8: 0.35, 10: 0.30})


def lines(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line, and its document."""
    breaks = np.flatnonzero(chunk.data == 10)
    off = chunk.offsets
    doc_of_break = np.searchsorted(off, breaks, "right") - 1
    start = np.concatenate([off[:-1], breaks + 1])
    end = np.concatenate([off[1:], breaks])
    doc = np.concatenate([np.arange(chunk.n), doc_of_break])
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    last = np.ones(len(start), bool)
    last[:-1] = doc[1:] != doc[:-1]
    end = np.empty_like(start)
    end[last] = off[1:][doc[last]]
    end[:-1][~last[:-1]] = start[1:][~last[:-1]] - 1
    return start, end, doc


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which have an equal one before them."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    more, later = np.zeros(len(k), bool), np.zeros(len(k), bool)
    more[1:] |= same
    more[:-1] |= same
    later[1:] = same
    out = np.zeros((2, len(k)), bool)
    out[0][order], out[1][order] = more, later
    return out[0], out[1]


def covered(hashes: np.ndarray, pos: np.ndarray, n_words: int, n: int) -> np.ndarray:
    """Words inside an n-gram whose hash occurs twice or more."""
    hit = pos[repeated(hashes)[0]]
    step = np.zeros(n_words + 1, np.int32)
    np.add.at(step, hit, 1)
    np.add.at(step, hit + n, -1)
    return np.cumsum(step)[:-1] > 0


def measure(chunk: Chunk, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    start, end, word_off = chunk.words
    ahead = np.zeros(len(chunk.data) + 1, np.int64)
    np.cumsum((chunk.data & 0xC0) != 0x80, out=ahead[1:])
    chars = ahead[end] - ahead[start]
    doc = owners(word_off)
    out = {"n_words": np.diff(word_off), "word_chars": row_sums(chars, word_off), "n_symbols": row_sums(SYMBOLS[chunk.data], chunk.offsets)}
    ls, le, ld = lines(chunk)
    inside = np.zeros(len(chunk.data) + 1, np.int64)
    np.cumsum(np.where(SEPARATOR[chunk.data], 0, (chunk.data & 0xC0) != 0x80), out=inside[1:])
    line_chars = inside[le] - inside[ls]
    full = line_chars > 0
    ls, le, ld, line_chars = ls[full], le[full], ld[full], line_chars[full]
    later = repeated(mix(BYTE_POLY[0].runs(BYTE_TABLE[0][chunk.data], ls, le) ^ mix(ld.astype(U64))))[1]
    out["n_lines"] = np.bincount(ld, minlength=chunk.n)
    out["n_dup_lines"] = np.bincount(ld[later], minlength=chunk.n)
    out["dup_line_chars"] = np.bincount(ld[later], line_chars[later], minlength=chunk.n).astype(np.int64)
    hashes = chunk.word_hashes()
    for n in sorted({8, *lengths}):
        pos, off = ngram_positions(word_off, n)
        grams = WORD_POLY[0].runs(hashes, pos, pos + n)
        inside_n = covered(mix(grams ^ mix(doc[pos].astype(U64))), pos, len(start), n)
        out[f"dup_chars_{n}"] = row_sums(np.where(inside_n, chars, 0), word_off)
        if n == 8:
            out["n_repeat_words"] = row_sums(inside_n, word_off)
    return out


def judge(m: dict[str, np.ndarray], limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    failed = (m["n_words"] < limits.min_words) | (100 * m["n_repeat_words"] > limits.repeat_words_percent * m["n_words"])
    chars = np.maximum(m["word_chars"], 1)
    bad = m["n_dup_lines"] > limits.duplicate_lines * np.maximum(m["n_lines"], 1)
    bad |= m["dup_line_chars"] > limits.duplicate_line_chars * chars
    bad |= m["n_symbols"] > limits.symbols * chars
    for n, most in limits.ngrams.items():
        bad |= m[f"dup_chars_{n}"] > most * chars
    return failed, ~failed & ~bad


def quality_rules(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the measures, ``base_failed`` and ``kept``."""
    lengths = tuple(limits.ngrams)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *[f"dup_chars_{n}" for n in sorted({8, *lengths})]]

    def rules(rows: pa.RecordBatch, chunk: Chunk) -> pa.RecordBatch:
        m = measure(chunk, lengths)
        failed, kept = judge(m, limits)
        return batch(id=rows.column(0), **{k: m[k] for k in names}, base_failed=failed, kept=kept)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{k} long" for k in names) + ", base_failed boolean, kept boolean"
    return text_map(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), rules, schema).withColumnRenamed("id", id_col)


def keep_quality(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns, in one map (no join back)."""
    lengths = tuple(limits.ngrams)

    def keep(rows: pa.RecordBatch, chunk: Chunk) -> pa.RecordBatch:
        return rows.filter(pa.array(judge(measure(chunk, lengths), limits)[1]))

    return text_map(docs, keep, docs.schema, text_col)
