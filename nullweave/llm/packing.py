"""Best-fit packing of tokenised documents through a configuration linear program.

1. One map tokenises every document (byte-level BPE, an end id after each) and cuts it into pieces; the pieces, small
   rows without their ids, are a shared table.
2. The histogram of piece lengths (at most ``size`` rows) goes to the driver.  A configuration is a multiset of lengths
   that fits a sequence.  The covering program over configurations is solved by multiplicative weights: lengths that
   are covered less, or fill badly, weigh more, and a bounded-knapsack dynamic program prices the best configurations.
   Its solution is rounded down, and what stays is solved again, until nothing whole is left of a solution; best-fit
   decreasing places that last remainder.  There is no other candidate for the plan.
3. The plan says, for each length and range of ranks, which sequences and which offset.  Ranks come from two levels,
   length and hash bucket, so even a length that a third of all pieces have is ranked by many tasks.
Everything on the driver is bounded by ``size`` and the number of configurations, not by the documents.

Defined cases: null text is an empty document (its end id alone); empty tables give no rows; repeated rows are packed
one by one; null ids are kept; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .engine import batch, table, text_map
from .kernel import BYTE_POLY, BYTE_TABLE, U64, Chunk, ragged

# Fixed value: the published split pattern of this family of byte-level tokenizers.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_WORDS = 400_000
#: Bytes that may begin a white space of several bytes.
WIDE = np.zeros(256, bool)
WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
ROWS_PER_BUCKET = 50_000
LEAST_BUCKETS = 32
#: The program ends within this share of its bound, or after so many phases.
GAP = 0.002
PHASES = 4


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Token ids of many texts at once.

    A space between two characters that are no white space always begins a new token, so texts are cut there, and
    each distinct cut is encoded once and remembered.  Added tokens of the vocabulary file that stand in a text are cut
    out first and have their own ids, as its tokenizer does."""

    _kept: dict[int, Encoder] = {}

    @classmethod
    def of(cls, vocabulary: bytes) -> Encoder:
        key = zlib.crc32(vocabulary)
        if key not in cls._kept:
            cls._kept[key] = cls(vocabulary)
        return cls._kept[key]

    def __init__(self, vocabulary: bytes):
        import tiktoken

        names = byte_names()
        model = json.loads(vocabulary)
        special = {x["content"] for x in model.get("added_tokens", [])}
        ranks = {bytes(names[c] for c in k): v for k, v in model["model"]["vocab"].items() if k not in special}
        self.encode = tiktoken.Encoding("local", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.added = {x["content"].encode(): x["id"] for x in model.get("added_tokens", [])}
        self.find_added = re.compile(b"|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)  # bytes of each token
        for k, v in ranks.items():
            self.width[v] = len(k)
        self.clear()

    def clear(self) -> None:
        self.known, self.slot = np.zeros(0, U64), np.zeros(0, np.int64)  # first hash, sorted, and the row it stands in
        self.check = np.zeros(0, U64)  # second hash of each row
        self.begin = np.zeros(1, np.int64)  # where a row's ids begin
        self.ids = np.zeros(0, np.uint32)

    def add(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Encode cuts of the data and remember them; their rows.

        Cuts that begin with a space before and end with a character that is no white space are encoded as one text,
        as a new token begins at each such space; the tokens' bytes tell which cut each is of."""
        second, last = data[np.minimum(start + 1, len(data) - 1)], data[end - 1]
        plain = (end - start > 3) & (data[start] == 32) & (second > 32) & ~WIDE[second] & (last > 32)
        plain &= (data[np.maximum(end - 2, 0)] != 0xC2) & ~WIDE[data[np.maximum(end - 3, 0)]]
        ids, counts = [], []
        if plain.any():
            a, size = start[plain], (end - start)[plain]
            stop = np.cumsum(size)
            text = data[np.repeat(a - (stop - size), size) + np.arange(stop[-1])].tobytes()
            ids.append(np.array(self.encode(text.decode()), np.uint32))
            counts.append(np.diff(np.searchsorted(np.cumsum(self.width[ids[0]]), stop) + 1, prepend=0))
        others = np.flatnonzero(~plain)
        raw = data.tobytes() if len(others) else b""
        for k in others.tolist():
            word = raw[start[k] : end[k]]
            ids.append(np.array([self.added[word]] if word in self.added else self.encode(word.decode()), np.uint32))
            counts.append([len(ids[-1])])
        rows = np.empty(len(start), np.int64)
        rows[np.concatenate([np.flatnonzero(plain), others])] = len(self.check) + np.arange(len(start))
        self.check = np.append(self.check, np.concatenate([check[plain], check[others]]))
        self.begin = np.append(self.begin, self.begin[-1] + np.cumsum(np.concatenate(counts)))
        self.ids = np.concatenate([self.ids, *ids])
        return rows

    def cut_added(self, raw: bytes, off: np.ndarray, cut: np.ndarray) -> None:
        """Cut before and after each added token of the vocabulary, nowhere within; one that two documents make together is none."""
        at = 0
        while self.find_added and (hit := self.find_added.search(raw, at)):
            a, b = hit.span()
            stop = int(off[np.searchsorted(off, a, "right")])  # where this document ends
            at = b if b <= stop else a + 1
            if b <= stop:
                cut[a + 1 : b] = False
                cut[a] = True
                if b < len(raw):
                    cut[b] = True

    def __call__(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of the chunk, and their offsets."""
        if len(self.check) > CACHE_WORDS:
            self.clear()
        data, off = chunk.data, chunk.offsets
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(chunk.n + 1, np.int64)
        pad = np.concatenate([np.zeros(3, np.uint8), data, np.zeros(1, np.uint8)])
        wide = WIDE[pad]
        cut = (data == 32) & (pad[2:-2] > 32) & (pad[4:] > 32) & ~wide[4:] & ~(pad[1:-3] == 0xC2) & ~(wide[:-4] & (pad[:-4] != 0xC2))
        cut[off[:-1][off[:-1] < len(data)]] = True
        raw = data.tobytes()
        self.cut_added(raw, off, cut)
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        h, g = (BYTE_POLY[f].runs(BYTE_TABLE[f][data], start, end) for f in (0, 1))
        values, first, which = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, values)
        index = np.append(self.slot, -1)[at]
        there = np.append(self.known, U64(0))[at] == values
        there &= np.append(self.check, U64(0))[index] == g[first]
        new = np.flatnonzero(~there)
        if len(new):
            index[new] = self.add(data, start[first[new]], end[first[new]], g[first[new]])
            self.known, self.slot = np.insert(self.known, at[new], values[new]), np.insert(self.slot, at[new], index[new])
        row = index[which]
        odd = np.flatnonzero(self.check[row] != g)  # equal in one hash only
        if len(odd):
            row[odd] = self.add(data, start[odd], end[odd], g[odd])
        size = self.begin[row + 1] - self.begin[row]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(total[-1]) + np.repeat(self.begin[row] - total[:-1], size)]
        return ids, total[np.searchsorted(start, off)]


def token_pieces(docs: DataFrame, vocabulary_path: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``size`` tokens: id, piece, start, length, ids_crc32 and, if asked for, the token ids."""
    with open(vocabulary_path, "rb") as f:  # read once, by the driver
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def cut(rows: pa.RecordBatch, chunk: Chunk) -> pa.RecordBatch:
        ids, off = Encoder.of(vocabulary.value)(chunk)
        ids = np.insert(ids, off[1:], np.uint32(end_id)).astype("<u4")
        off = off + np.arange(len(off))
        length = np.diff(off)
        count = -(-length // size)
        doc = np.repeat(np.arange(chunk.n), count)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        short = (length - (count - 1) * size)[doc]
        start = np.where(piece == 0, 0, short + (piece - 1) * size)
        stop = short + piece * size
        lo, hi = off[doc] + start, off[doc] + stop
        view = memoryview(ids)
        crc = np.fromiter((zlib.crc32(view[a:b]) for a, b in zip(lo.tolist(), hi.tolist())), np.int64, len(doc))
        more = {"ids": ragged(ids.astype(np.int32), np.append(lo, hi[-1]))} if with_ids else {}
        return batch(id=rows.column(0).take(pa.array(doc)), piece=piece.astype(np.int32), start=start, length=stop - start, ids_crc32=crc, **more)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return text_map(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), cut, schema).withColumnRenamed("id", id_col)


def knapsack(value: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounded knapsack over capacities 0..size: the lengths that are there, ``best[k][c]``, the most value that the k
    shortest of them fill capacity c with, and ``took[k][c]``, how many pieces of the k-th are in it.  Multiples of a
    length are tried in powers of two, so a length costs the logarithm of its copies."""
    size = len(value) - 1
    lengths = np.flatnonzero(there)
    best, took = np.zeros((len(lengths) + 1, size + 1)), np.zeros((len(lengths), size + 1), np.int32)
    for k, length in enumerate(lengths.tolist()):
        row, pieces = best[k + 1], took[k]
        row[:] = best[k]
        left, some = min(int(there[length]), size // length), 1
        while left > 0:
            some = min(some, left)
            w = some * length
            gain, more = row[:-w] + some * value[length], pieces[:-w] + some
            up = gain > row[w:] + 1e-12
            row[w:][up], pieces[w:][up] = gain[up], more[up]
            left, some = left - some, 2 * some
    return lengths, best, took


def price(k: int, value: np.ndarray, there: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The configuration of most value whose longest piece is the k-th length: lengths and how many of each."""
    lengths, best, took = tables
    size, longest = len(value) - 1, int(lengths[k])
    some = np.arange(1, min(int(there[longest]), size // longest) + 1)
    most = int(some[(some * value[longest] + best[k][size - some * longest]).argmax()])
    config, room = [(longest, most)], size - most * longest
    while k > 0 and room > 0:
        k -= 1
        if n := int(took[k, room]):
            config.append((int(lengths[k]), n))
            room -= n * int(lengths[k])
    return tuple(np.array(config).T)


def cover(counts: np.ndarray, weight: np.ndarray, rate: float) -> tuple[dict[tuple, float], np.ndarray]:
    """Cover every length once: how much of which configurations, and the log weights after it.

    The knapsack prices, for every length that still lacks cover, the best configuration that it leads; longer ones go
    first, each is used until one of its lengths is covered, and the weights of what has been covered shrink by
    exp(-rate * share) before the next pricing."""
    size, whole = len(counts) - 1, np.maximum(counts, 1)
    lack, use = counts.astype(float), {}
    while (lack > 1e-9).any():
        before, there = lack.copy(), np.ceil(lack - 1e-9).astype(np.int64)
        value = np.arange(size + 1) / size * np.exp(weight)
        tables = knapsack(value, there)
        for k in range(len(tables[0]) - 1, -1, -1):
            lengths, n = price(k, value, there, tables)
            times = float((lack[lengths] / n).min())
            if times <= 1e-9:
                break  # priced for what an earlier configuration has used
            lack[lengths] = np.maximum(lack[lengths] - times * n, 0)
            lack[lack <= 1e-9] = 0
            key = tuple(zip(lengths.tolist(), n.tolist()))
            use[key] = use.get(key, 0.0) + times
        weight = weight - rate * (before - lack) / whole
    return use, weight


def program(counts: np.ndarray, phases: int = PHASES, gap: float = GAP, start: float = 0.1, rate: float = 0.05, waste: float = 0.5) -> tuple[dict[tuple, float], float]:
    """The covering program over configurations, by multiplicative weights: a solution and the bound it is held against.

    Weights begin at (length / size) ** start, times the length.  Each phase covers every length once; then the weights
    of lengths that stand in badly filled configurations grow by exp(waste * unused share).  Phases end when the least
    phase is within ``gap`` of the dual value (weights in proportion to the lengths, of which no configuration holds
    more than 1), or after ``phases``; the least phase is the solution."""
    size = len(counts) - 1
    weight = np.zeros(size + 1)
    weight[1:] = start * np.log(np.arange(1, size + 1) / size)
    dual, best = float((counts * np.arange(size + 1)).sum() / size), None
    for _ in range(phases):
        use, weight = cover(counts, weight, rate)
        if best is None or sum(use.values()) < sum(best.values()):
            best = use
        if sum(best.values()) <= (1 + gap) * dual:
            break
        loose = np.zeros(size + 1)
        for config, times in use.items():
            unused = 1 - sum(length * n for length, n in config) / size
            for length, n in config:
                loose[length] += times * n * unused
        weight = weight + waste * loose / np.maximum(counts, 1)
        weight -= weight[counts > 0].max()
    return best or {}, dual


def best_fit(counts: np.ndarray) -> Counter:
    """Best-fit decreasing on a histogram; configurations as tuples of lengths."""
    size = len(counts) - 1
    room: dict[int, Counter] = defaultdict(Counter)
    for length in range(size, 0, -1):
        left = int(counts[length])
        while left:
            fit = next((r for r in range(length, size) if room.get(r)), None)
            if fit is None:
                per = size // length
                whole, rest = divmod(left, per)
                if whole:
                    room[size - per * length][(length,) * per] += whole
                if rest:
                    room[size - rest * length][(length,) * rest] += 1
                break
            config, there = room[fit].popitem()
            per = min(fit // length, left)
            used = min(there, left // per)
            if used < there:
                room[fit][config] = there - used
            room[fit - per * length][config + (length,) * per] += used
            left -= used * per
    out: Counter = Counter()
    for held in room.values():
        out.update(held)
    return out


def rounded(counts: np.ndarray, solution: dict[tuple, float]) -> Counter:
    """The solution rounded down to whole configurations that fit into what is there."""
    left, out = counts.copy(), Counter()
    for config, use in sorted(solution.items(), key=lambda x: (-x[1], x[0])):
        lengths, n = np.array(config).T
        times = min(int(use + 1e-6), int((left[lengths] // n).min()))
        if times > 0:
            left[lengths] -= times * n
            out[tuple(np.repeat(lengths, n).tolist())] += times
    return out


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Configurations with whole multiplicities that hold exactly the pieces counted.

    The program's solution is rounded down, and what that leaves is solved and rounded again, until the rounding of a solution
    holds nothing whole; best fit places that last remainder."""
    left, out = counts.astype(np.int64).copy(), Counter()
    if left[-1]:
        out[(len(counts) - 1,)] += int(left[-1])
        left[-1] = 0
    while left.any():
        held = rounded(left, program(left)[0])
        if not held:
            held = best_fit(left)
        for config, times in held.items():
            np.subtract.at(left, np.array(config), times)
        out.update(held)
    return sorted(out.items(), reverse=True)


def place(pieces: DataFrame, size: int = 1024, order: tuple[str, ...] = ("doc_id", "piece", "start", "ids_crc32")) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``length`` is at most ``size``."""
    spark: SparkSession = pieces.sparkSession
    pieces = table(pieces, "pieces")
    total = pieces.count()
    buckets = max(LEAST_BUCKETS, total // ROWS_PER_BUCKET)
    spread = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    by = table(spread.groupBy("length", "_bucket").agg(F.count("*").alias("_n")), "lengths")
    counts = np.zeros(size + 1, np.int64)
    for r in by.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # at most ``size`` rows
        counts[r["length"]] = r["n"]
    rows, sequence, taken = [], 0, np.zeros(size + 1, np.int64)
    for config, times in plan(counts):
        offset = 0
        for length in config:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    slots = np.array(sorted(rows), np.int64).reshape(-1, 4)
    shared = spark.sparkContext.broadcast((slots[:, 0] << 42 | slots[:, 1], slots))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = by.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)) - 1
    ranked = spread.withColumn("_rank", rank).join(base, ["length", "_bucket"]).withColumn("_rank", (F.col("_rank") + F.col("_base")).cast("long")).select(*pieces.columns, "_rank")

    def assign(batches):
        key, slot = shared.value
        for rows in batches:
            length, r = (rows.column(k).to_numpy() for k in ("length", "_rank"))
            at = np.searchsorted(key, length << 42 | r, "right") - 1
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(slot[at, 2] + r - slot[at, 1]), pa.array(slot[at, 3])], names=[*rows.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(assign, pieces.schema.add("sequence_id", "long").add("offset", "long"))


def pack_documents(docs: DataFrame, vocabulary_path: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return place(token_pieces(docs, vocabulary_path, size, end_id, id_col, text_col), size, (id_col, "piece", "start", "ids_crc32"))
