"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may have e = floor(rate * m) edits.  Cut into e + 1 pieces, at least one piece is intact in
any text within e edits, so an Aho-Corasick automaton over all pieces finds every candidate place, and Myers'
bit-parallel edit distance decides.  Both sides have ASCII letters lower-cased and each white space made one space, so
positions stay those of the text.  Where a text or an item has runs of white space, the forms with each run made one space
are matched as well (an edited text may fit in one form only), and an offset map gives positions in the text.  Items come to the driver in blocks of bounded size, each block one map over all
documents; a document is read whole.

Defined cases: null or empty texts hold no item; null, empty or blank items match nothing; repeated rows are reported
each; null ids are reported as null; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import text_map
from .kernel import Chunk

#: Characters of items in one block: the bound of what is sent to every executor at once.
BLOCK_CHARS = 1 << 20
#: Edits allowed for each character of an item.
RATE = 0.13
RUNS = re.compile("  +")
PLAIN = bytes(32 if b in b" \t\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def plain(text: bytes) -> str:
    return text.translate(PLAIN).decode()


def flat(text: str) -> str:
    """A plain text with each run of spaces made one."""
    return RUNS.sub(" ", text) if "  " in text else text


def flat_offsets(text: str) -> list[int]:
    """For each character of ``flat(text)`` its position in the text."""
    out, done = [], 0
    for run in RUNS.finditer(text):
        out += range(done, run.start() + 1)
        done = run.end()
    return out + list(range(done, len(text)))


def pieces(m: int, budget: int) -> list[tuple[int, int]]:
    return [(k * m // (budget + 1), (k + 1) * m // (budget + 1)) for k in range(budget + 1)]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for k, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << k
    return out


def myers(pattern: str, text: str, peq: dict[str, int] | None = None) -> tuple[int, int]:
    """Least edit distance of the pattern to a part of the text, and the first end of such a part."""
    m = len(pattern)
    peq = masks(pattern) if peq is None else peq
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        pv = (mh << 1 | ~(xv | ph)) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
            if not best:
                break
    return best, end


def ancestors(j: int) -> list[list[tuple[int, int]]]:
    """For each of j pieces, the ranges of pieces that hold it in a balanced binary tree, small to large.

    Left halves are even, so that nearly all pieces have a smallest range of two."""

    def walk(lo: int, hi: int, above: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
        if hi - lo == 1:
            return [above]
        mid = lo + 1 if hi - lo == 2 else lo + ((hi - lo) // 2 + 1) // 2 * 2
        here = [(lo, hi), *above]
        return walk(lo, mid, here) + walk(mid, hi, here)

    return walk(0, j, [])


class Matcher:
    """Finds items in texts.

    A range of j pieces may have j - 1 errors, and if it has no more, then one of its two halves has no more than its
    own share.  So for some intact piece every range above it is within its share, up to the whole item; a hit is
    given up at the first range that is not.  In a range of two pieces the other one may have one error, so one of its
    halves stands where it must, or one place beside: slices tell this before any distance is computed."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = items
        self.cuts = [pieces(len(t), int(rate * len(t))) for _, t in items]
        self.above = [ancestors(len(c)) for c in self.cuts]
        self.masks: dict[tuple[int, int, int], dict[str, int]] = {}
        at: dict[str, list[tuple]] = {}
        for k, (_, text) in enumerate(items):
            for j, (a, b) in enumerate(self.cuts[k]):
                at.setdefault(text[a:b], []).append((k, j, b, *self.beside(k, j)))
        self.found = ahocorasick.Automaton()
        for piece, where in at.items():
            self.found.add_word(piece, where)
        if at:
            self.found.make_automaton()
        self.flat = Matcher([(i, flat(t)) for i, t in items], rate) if any("  " in t for _, t in items) else self

    def beside(self, k: int, j: int) -> tuple:
        """The halves of the other piece of a range of two: near one, its place in the item, far one, its place."""
        text, cuts = self.items[k][1], self.cuts[k]
        if not self.above[k][j] or self.above[k][j][0][1] - self.above[k][j][0][0] > 2:
            return None, 0, "", 0
        lo, _ = self.above[k][j][0]
        a, b = cuts[lo + 1 if j == lo else lo]
        mid = (a + b) // 2
        near, far = ((a, mid), (mid, b)) if j == lo else ((mid, b), (a, mid))
        return text[slice(*near)], near[0], text[slice(*far)], far[0]

    def peq(self, k: int, a: int, b: int) -> dict[str, int]:
        if (k, a, b) not in self.masks:
            self.masks[k, a, b] = masks(self.items[k][1][a:b])
        return self.masks[k, a, b]

    def __call__(self, text: str) -> list[tuple[int, int, int, int]]:
        """Item id, start, end and distance of each place; places of one item do not overlap."""
        out = self.places(text)
        if self.flat is not self or "  " in text:
            taken: dict[int, list[tuple[int, int]]] = {}
            for k, start, stop, _ in out:
                taken.setdefault(k, []).append((start, stop))
            offsets = None
            for k, start, stop, distance in self.flat.places(flat(text)):
                offsets = flat_offsets(text) if offsets is None else offsets
                start, stop = (offsets[start], offsets[stop - 1] + 1) if stop > start else (offsets[start - 1] + 1,) * 2
                if all(stop <= a or b <= start for a, b in taken.get(k, ())):
                    out.append((k, start, stop, distance))
        return sorted((self.items[k][0], *place) for k, *place in out)

    def places(self, text: str) -> list[tuple[int, int, int, int]]:
        """Item number, start, end and distance of each place in the text as it is."""
        places: dict[int, list[tuple[int, int]]] = {}
        for end, where in self.found.iter(text) if self.items else ():
            for k, j, b, near, at_near, far, at_far in where:
                s = end + 1 - b
                if near is None or self.fits(text, s + at_near, near, s + at_far, far):
                    places.setdefault(k, []).append((s, j))
        out = []
        for k, hits in places.items():
            done = 0
            for s, j in sorted(hits):
                if s + self.cuts[k][j][0] >= done and (hit := self.verify(k, j, s, text, done)):
                    out.append((k, *hit))
                    done = hit[1]
        return out

    @staticmethod
    def fits(text: str, at_near: int, near: str, at_far: int, far: str) -> bool:
        return text.startswith(near, max(0, at_near)) or far in text[max(0, at_far - 1) : max(0, at_far + len(far) + 1)]

    def verify(self, k: int, j: int, s: int, text: str, done: int) -> tuple[int, int, int] | None:
        pattern, cuts = self.items[k][1], self.cuts[k]
        if s >= done and text.startswith(pattern, s):
            return s, s + len(pattern), 0
        for lo, hi in self.above[k][j]:
            a, b, e = cuts[lo][0], cuts[hi - 1][1], hi - lo - 1
            begin = max(done, s + a - e)
            distance, stop = myers(pattern[a:b], text[begin : s + b + e], self.peq(k, a, b))
            if distance > e:
                return None
        if not self.above[k][j]:
            return None
        stop += begin
        back = text[max(done, stop - len(pattern) - e) : stop][::-1]
        return stop - myers(pattern[::-1], back)[1], stop, distance


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    block, chars = [], 0
    for r in items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").toLocalIterator():
        text = plain(r["text"].encode()).strip(" ")
        if text:
            block.append((r["id"], text))
            chars += len(text)
        if chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def find_items(docs: DataFrame, items: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each place of an item in a document: id, item id, start and stop (code points), distance."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, start long, stop long, distance int"
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for block in item_blocks(items, item_id, item_text):
        shared, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def match(rows: pa.RecordBatch, chunk: Chunk, shared=shared, name=name) -> pa.RecordBatch | None:
            matcher = _matcher(shared, name, rate)
            hits = [(k, *h) for k, text in enumerate(chunk.texts()) for h in matcher(plain(text))]
            if not hits:
                return None
            doc, item, a, b, d = zip(*hits)
            return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(doc)), pa.array(item), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.int32())], names=["id", "item", "start", "stop", "distance"])

        out = out.union(text_map(source, match, schema))
    return out.toDF(id_col, item_id, "start", "stop", "distance")


def drop_contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns; one map for each block of items, no join."""
    for block in item_blocks(items, item_id, item_text):
        shared, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def clean(rows: pa.RecordBatch, chunk: Chunk, shared=shared, name=name) -> pa.RecordBatch:
            matcher = _matcher(shared, name, rate)
            return rows.filter(pa.array(np.array([not matcher(plain(text)) for text in chunk.texts()], bool)))

        docs = text_map(docs, clean, docs.schema, text_col)
    return docs


_kept: dict = {}


def _matcher(shared, name: str, rate: float) -> Matcher:
    """Built once for each Python worker and block; ``name`` is the block's own, as a worker serves many of them."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = Matcher(shared.value, rate)
    return _kept[name]
