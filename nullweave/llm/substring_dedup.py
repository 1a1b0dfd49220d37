"""Substring deduplication behind a count-min prefilter.

A window is ``size`` consecutive words.  Every window has an anchor: the smallest-hash run of size//2 words inside it, a
function of the window's words alone.  Consecutive windows with one anchor form a bundle, which is counted once for each
document.  The sketch has ``DEPTH`` rows of ``width`` counters; each anchor adds one to one counter of each row.  A chunk's
sketch is its list of non-zero counters, and Spark's map-side-combined sum merges them.  Counters are shared, so they
overestimate, and equal windows have equal anchors: a window whose least counter is below 2 is in one document only,
and no repeated window is lost, whatever the width.  The width bounds the sketch; by default it is the power of two
from ``BYTES_PER_COUNTER`` bytes of text for each counter of a row on, by which one in sixty single bundles survives.
Only counters of 2 or more are kept, and they are joined by their number, row after row, never broadcast by hand.

The second pass groups exactly what the sketch estimates to be repeated:
1. bundles, by a 128-bit fingerprint of all their words: a bundle that also is in a smaller document goes as a whole;
2. single windows, by 128-bit fingerprints, only for one copy of each bundle whose anchor has different bundles.
All groupings are minima or sums combined before the shuffle.  Their results are shared tables, so both sides of each
join back are plain shuffles, which adaptive execution can split: a passage in a third of all documents meets in no
single task.

Defined cases: null text has no words; rows with a null id are never a source and stay as they are; rows of the same
id do not match each other; repeated rows are treated alike; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .engine import batch, longs, table, text_map
from .kernel import WORD_POLY, Chunk, U64, mix, ragged, signed, sliding_argmin

BLOCK = 1 << 22
#: Rows of the count-min sketch, and bytes of text for each counter of a row where no width is given.
DEPTH = 2
BYTES_PER_COUNTER = 16


def bundles(chunk: Chunk, size: int, fingerprints: bool = True):
    """Of each bundle: document row, first window, number of windows, anchor cell, two fingerprints."""
    _, _, off = chunk.words
    n, k = int(off[-1]), size // 2
    h = [chunk.word_hashes(0), chunk.word_hashes(1) if fingerprints else None]
    ends = np.repeat(off[1:], np.diff(off))
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK + size - 1)
        at = np.arange(lo, hi)
        grams = np.full(hi - lo, ~U64(0), U64)
        whole = at + k <= np.minimum(ends[lo:hi], hi)
        grams[whole] = WORD_POLY[0].runs(h[0][lo:hi], at[whole] - lo, at[whole] - lo + k)
        anchor = sliding_argmin(grams, size - k + 1)
        first = np.flatnonzero((at + size <= ends[lo:hi])[: min(len(anchor), BLOCK)])
        if not len(first):
            continue
        anchor = anchor[first]
        new = np.ones(len(first), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + 1)
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(first)))
        start, anchor = first[begin], anchor[begin]
        stop = start + count - 1 + size
        doc = np.searchsorted(off, start + lo, "right") - 1
        prints = [WORD_POLY[f].runs(h[f][lo:hi], start, stop) for f in (0, 1)] if fingerprints else [None, None]
        if fingerprints:
            prints[0] = mix(prints[0] + (anchor - start).astype(U64))
        yield doc, start + lo - off[doc], count, mix(grams[anchor]), *prints


def sketch_width(docs: DataFrame) -> int:
    """The power of two that gives each ``BYTES_PER_COUNTER`` bytes of text one counter of a row, 2**16 at least."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 1 << max(16, (total // BYTES_PER_COUNTER).bit_length())


def counter(cell: str, row: int, width: int) -> Column:
    """The counter of a sketch row that a cell belongs to: bits of the cell, others for each row (a third of them may
    coincide beyond 2**32 counters, which costs sharpness only)."""
    bits = width.bit_length() - 1
    return F.shiftrightunsigned(cell, max(0, 64 - (row + 1) * bits)).bitwiseAND(F.lit(width - 1))


def merged_sketch(docs: DataFrame, size: int, width: int) -> DataFrame:
    """Counters (row, bucket, n) of the merged sketch that are 2 or more, from ``docs`` (id, text)."""

    def counts(rows: pa.RecordBatch, chunk: Chunk):
        for doc, _, _, cell, _, _ in bundles(chunk, size, fingerprints=False):
            _, once = np.unique(mix(cell + mix(doc.astype(U64))), return_index=True)
            values, n = np.unique(cell[once], return_counts=True)
            yield batch(cell=signed(values), n=n)

    cells = text_map(docs, counts, "cell long, n long")
    at = F.explode(F.array(*[F.struct(F.lit(d).alias("row"), counter("cell", d, width).alias("bucket")) for d in range(DEPTH)]))
    return cells.select(at.alias("at"), "n").groupBy("at.row", "at.bucket").agg(F.sum("n").alias("n")).where("n >= 2")


def repeated_spans(docs: DataFrame, size: int, width: int | None = None) -> DataFrame:
    """Spans (id, th, list of first word and number of windows) whose windows start in a smaller document too.

    ``docs`` has id, th (hash of the text: tells rows of one id apart) and text."""

    def full(rows: pa.RecordBatch, chunk: Chunk):
        for doc, start, count, cell, b1, b2 in bundles(chunk, size):
            yield batch(cell=signed(cell), b1=signed(b1), b2=signed(b2), id=longs(rows.column(0))[doc], th=longs(rows.column(1))[doc], s0=start.astype(np.int32), n=count.astype(np.int32))

    known = docs.where("id is not null")
    width = width or sketch_width(known)
    if width & (width - 1):
        raise ValueError("the width of the sketch must be a power of two")
    sketch = table(merged_sketch(known.select("id", "text"), size, width), "sketch")
    found = text_map(known, full, "cell long, b1 long, b2 long, id long, th long, s0 int, n int")
    for d in range(DEPTH):
        found = found.join(sketch.where(F.col("row") == d).select("bucket"), counter("cell", d, width) == F.col("bucket")).drop("bucket")
    found = table(found, "bundles")

    key = ["cell", "b1", "b2"]
    first = table(found.groupBy(*key).agg(F.min("id").alias("first")), "first")
    mixed = table(first.groupBy("cell").agg(F.count("*").alias("kinds")).where("kinds > 1").select("cell", F.lit(True).alias("mixed")), "mixed")
    judged = table(found.join(first.join(mixed, "cell", "left"), key).where("id > first or mixed").select("id", "th", "s0", "n", (F.col("id") > F.col("first")).alias("whole")), "judged")

    def windows(rows: pa.RecordBatch, chunk: Chunk):
        lists = rows.column(3)
        if lists.null_count == len(lists):
            return
        _, _, off = chunk.words
        h = [chunk.word_hashes(f) for f in (0, 1)]
        sizes = np.asarray(lists.value_lengths().fill_null(0))
        flat = lists.flatten()
        s0, n = (np.asarray(flat.field(k)).astype(np.int64) for k in (0, 1))
        doc = np.repeat(np.repeat(np.arange(chunk.n), sizes), n)
        pos = np.repeat(s0, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = pos + off[doc]
        yield batch(h1=signed(WORD_POLY[0].runs(h[0], at, at + size)), h2=signed(WORD_POLY[1].runs(h[1], at, at + size)), id=longs(rows.column(0))[doc], th=longs(rows.column(1))[doc], s0=pos.astype(np.int32))

    single = judged.where("not whole").groupBy("id", "th").agg(F.collect_list(F.struct("s0", "n")).alias("spans"))
    asked = docs.join(single, ["id", "th"], "left").select("id", "th", "text", "spans")
    window = table(text_map(asked, windows, "h1 long, h2 long, id long, th long, s0 int"), "windows")
    least = table(window.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last"), "least")
    later = window.join(least, ["h1", "h2"]).where("id > first").select("id", "th", "s0", F.lit(1).alias("n"))
    return judged.where("whole").select("id", "th", "s0", "n").union(later).groupBy("id", "th").agg(F.collect_list(F.struct("s0", "n")).alias("spans"))


def remove_repeats(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text", width: int | None = None) -> DataFrame:
    """All rows and columns of ``docs``, plus ``dedup_words``, ``dedup_removed`` and ``dedup_text``: the words that no
    window of a smaller document covers, joined by one space.  ``width``: counters in a row of the sketch, a power of two."""
    keyed = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(docs[text_col]).alias("th"), docs[text_col].alias("text"), F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("row"))
    spans = repeated_spans(keyed.select("id", "th", "text"), size, width)

    def cut(rows: pa.RecordBatch, chunk: Chunk) -> pa.RecordBatch:
        start, end, off = chunk.words
        lists = rows.column(2)
        sizes = np.asarray(lists.value_lengths().fill_null(0))
        flat = lists.flatten()
        step = np.zeros(len(start) + 1, np.int32)
        if len(flat):
            base = np.repeat(off[:-1], sizes)
            s0, n = (np.asarray(flat.field(k)).astype(np.int64) for k in (0, 1))
            np.add.at(step, base + s0, 1)
            np.add.at(step, base + s0 + n - 1 + size, -1)
        keep = np.cumsum(step)[:-1] <= 0
        # Kept words with one space after each; the last space of a document goes.
        a, b = start[keep], end[keep] + 1
        counts = np.diff(np.concatenate([[0], np.cumsum(keep)])[off])
        data = np.append(chunk.data, np.uint8(32))
        length = b - a
        where = np.repeat(a - (np.cumsum(length) - length), length) + np.arange(length.sum())
        out = data[where]
        stops = np.cumsum(length)
        out[stops - 1] = 32
        last = np.cumsum(counts)
        drop = stops[last[counts > 0] - 1] - 1
        out = np.delete(out, drop)
        sums = np.concatenate([[0], np.cumsum(length)])
        size_of = sums[last] - sums[last - counts] - (counts > 0)
        text = pa.StringArray.from_buffers(chunk.n, pa.py_buffer(np.concatenate([[0], np.cumsum(size_of)]).astype(np.int32)), pa.py_buffer(out.tobytes()))
        n_words = np.diff(off)
        return batch(text=rows.column(0), row=rows.column(1), dedup_words=n_words, dedup_removed=n_words - counts, dedup_text=text)

    joined = keyed.join(spans, ["id", "th"], "left").select("text", "row", "spans")
    schema = joined.select("text", "row").schema.add("dedup_words", "long").add("dedup_removed", "long").add("dedup_text", "string")
    out = text_map(joined, cut, schema)
    return out.select(*[F.col("text").alias(text_col) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns], "dedup_words", "dedup_removed", "dedup_text")
