"""Exact n-gram Jaccard join with token-combination prefixes.

A document is its set of distinct ``n``-word shingles.  Documents of equal sets are one class at once.  Shingles have a
global order, rare first, from the counts of 2**18 hash classes over all documents (a table of fixed size).  With
a = ceil(threshold * size), two linked sets share at least max(a, a') shingles, so
- if the first shared shingle is rare, it stands among the first size - a + 1 of both: these are indexed singly;
- else all shared ones are frequent, and the first G + 1 of them stand among the first size - a + 1 + G of both; two
  of these fall into one of G hash groups, so pairs within a group (k = 2 combinations) are indexed.  G is a power of
  two that grows with the size, which keeps the pairs in proportion to the prefix; a set whose partners may have
  another G indexes for both.  Sets too small for G + 1 shared shingles index single ones in any case.
A signature carries its reach, a bound of what two sets can share if it is their first: the size from its first
shingle's rank on (and G - 1 more for a pair).  Candidates whose reach is too short are no candidates.

Classes that share a signature are candidates.  A signature's group is never expanded into all pairs: its most
central class, the pivot, is compared with the others, and linked classes are joined into components.  As long as the
pivot of a large group (more than ``PART`` classes) finds links and the group is not yet one component, the most central class
of its other components is the next pivot.  What stays are the pairs of small groups, and of large ones whose pivot is linked with nothing, that
lie in different components; they are compared each.  Every class has a histogram of its
shingles over ``BINS`` hash classes; the sum of the least counts bounds what two sets share, so most candidates
fall before any text is read, and no link does.  The rest are compared exactly, over the texts themselves.
So ``jaccard_join`` has every component, but not every linked pair; ``jaccard_links`` compares all candidates and has
them all, at the cost of all pairs of a group.

Defined cases: null, empty and wordless texts have an empty set and link with nothing; a text of fewer than ``n`` words
has one shingle, the whole sequence; repeated rows link with each other; null ids take part but never name a
component unless all of its ids are null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import batch, components, table, text_map
from .kernel import WORD_POLY, Chunk, U64, chunks, distinct_sorted, mix, ngram_positions, owners, row_sums, signed

CLASS_BITS = 18
#: Sets of up to this size have one group; the number of groups doubles with the size.
ONE_GROUP = 255
#: Members of a signature in one part, where all its pairs are made.
PART = 64
#: Hash classes of a set's histogram; counts of 255 stand for 255 or more.
BINS = 128


def shingle_sets(chunk: Chunk, n: int, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The documents' sets of shingle hashes: sorted, or in the order of the ``rank`` of their hash classes."""
    _, _, off = chunk.words
    words = chunk.word_hashes(0, lower=True)
    size = np.diff(off)
    count = np.where(size >= n, size - n + 1, (size > 0).astype(np.int64))
    goff = np.concatenate([[0], np.cumsum(count)])
    start = np.arange(goff[-1]) + np.repeat(off[:-1] - goff[:-1], count)
    length = np.repeat(np.minimum(size, n), count)
    return distinct_sorted(WORD_POLY[0].runs(words, start, start + length), goff, rank, CLASS_BITS)


def class_ranks(counts: np.ndarray) -> np.ndarray:
    """The order of the hash classes, rare first."""
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    return rank


def digests(values: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """128 bits of each set: two order-free sums of mixed members."""
    return [mix(row_sums(mix(values ^ U64(seed)), off) + np.diff(off).astype(U64)) for seed in (0x51ED27, 0xA0761D64)]


def histograms(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Of each set how many members fall on each of BINS hash classes, 255 at most."""
    n = len(off) - 1
    bins = (mix(values ^ U64(0x2F1B7)) >> U64(57)).astype(np.int64)
    return np.minimum(np.bincount(owners(off) * BINS + bins, minlength=n * BINS), 255).astype(np.uint8).reshape(n, BINS)


def least_shared(size: np.ndarray, t: Fraction) -> np.ndarray:
    return -((-size * t.numerator) // t.denominator)


def groups_of(size: np.ndarray) -> np.ndarray:
    return 1 << np.floor(np.log2(np.maximum(1, 2 * size // (ONE_GROUP + 1)))).astype(np.int64)


def signatures(values: np.ndarray, off: np.ndarray, counts: np.ndarray, often: int, t: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, their document rows, and their reach, of sets in the order of ``class_ranks``."""
    doc, v = owners(off), values
    freq = counts[(v >> U64(64 - CLASS_BITS)).astype(np.int64)]
    size = np.diff(off)
    rank = np.arange(len(v)) - off[:-1][doc]
    reach = size[doc] - rank
    extra = np.repeat(size - least_shared(size, t), size)
    least, most = groups_of(least_shared(size, t)), groups_of(size * t.denominator // t.numerator)
    small = np.repeat(least_shared(size, t) <= most, size)
    frequent = freq > often
    single = (rank <= extra) & (~frequent | small)
    out, rows, reaches = [v[single]], [doc[single]], [reach[single]]
    for groups, use in ((least, np.ones(len(size), bool)), (most, most != least)):
        g = groups[doc]
        pick = np.flatnonzero(frequent & use[doc] & (rank <= extra + g))
        if not len(pick):
            continue
        group = (mix(v[pick]) & (g[pick] - 1).astype(U64)).astype(np.int64)
        o = np.lexsort((rank[pick], group, doc[pick]))
        pick, group = pick[o], group[o]
        begin = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (doc[pick[1:]] != doc[pick[:-1]])))
        length = np.diff(np.append(begin, len(pick)))
        place = np.arange(len(pick)) - np.repeat(begin, length)
        right = np.repeat(np.arange(len(pick)), place)
        left = np.repeat(np.arange(len(pick)) - place, place) + np.arange(len(right)) - np.repeat(np.cumsum(place) - place, place)
        a, b = pick[left], pick[right]  # a stands before b
        out.append(mix(np.minimum(v[a], v[b]) + mix(np.maximum(v[a], v[b]))))
        rows.append(doc[a])
        reaches.append(reach[a] + g[a] - 1)
    return np.concatenate(out), np.concatenate(rows), np.concatenate(reaches)


def promising(pairs: DataFrame, hists: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) of nodes whose histograms (node, n_shingles, hist) allow them to be similar enough."""
    x = pairs.join(hists.toDF("a", "na", "ha"), "a").join(hists.toDF("b", "nb", "hb"), "b").select("a", "b", "na", "nb", "ha", "hb")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            size = sum(rows.column(k).to_numpy() for k in (2, 3))
            left, right = (np.frombuffer(b"".join(rows.column(k).to_pylist()), np.uint8).reshape(-1, BINS) for k in (4, 5))
            least = np.minimum(left, right)
            shared = least.sum(1, dtype=np.int64)
            ok = (least == 255).any(1) | ((t.denominator + t.numerator) * shared >= t.numerator * size)
            yield batch(a=rows.column(0), b=rows.column(1)).filter(pa.array(ok))

    return x.mapInArrow(bounded, "a long, b long").distinct()


def verified(pairs: DataFrame, hists: DataFrame, texts: DataFrame, n: int, t: Fraction, name: str) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough, as a shared table, from ``texts`` (node, text)."""
    pairs = table(promising(pairs, hists, t), "promising")
    x = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for left in chunks(rows.column(2)):
                for right in chunks(rows.column(3).slice(left.lo, left.n)):
                    part = rows.slice(left.lo + right.lo, right.n)
                    (va, oa), (vb, ob) = shingle_sets(left, n), shingle_sets(right, n)
                    va, oa = va[oa[right.lo] : oa[right.hi]], oa[right.lo : right.hi + 1] - oa[right.lo]
                    both, row = np.concatenate([va, vb]), np.concatenate([owners(oa), owners(ob)])
                    o = np.lexsort((both, row))
                    same = (both[o][1:] == both[o][:-1]) & (row[o][1:] == row[o][:-1])
                    shared = np.bincount(row[o][1:][same], minlength=right.n)
                    union = np.diff(oa) + np.diff(ob) - shared
                    ok = (t.denominator * shared >= t.numerator * union) & (shared > 0)
                    yield batch(a=part.column(0), b=part.column(1)).filter(pa.array(ok))

    return table(x.mapInArrow(compare, "a long, b long").distinct(), name)


def jaccard_classes(docs: DataFrame, n: int = 4, threshold: Fraction = Fraction(85, 100), id_col: str = "doc_id", text_col: str = "text", every: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, links, classes).  rows: id, th (hash of the text), n_shingles, node (class of equal sets, null if empty).
    links: a, b, pairs of classes that were compared and are linked; they connect every component, and with ``every`` they
    are all linked pairs of different classes.
    classes: node, component, for classes with links."""
    t = Fraction(threshold)
    keyed = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(docs[text_col]).alias("th"), docs[text_col].alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CLASS_BITS, np.int64)
        none = lambda k, kind: pa.nulls(k, kind)
        for rows in batches:
            for chunk in chunks(rows.column(2)):
                v, off = shingle_sets(chunk, n)
                d1, d2 = digests(v, off)
                counts += np.bincount((v >> U64(64 - CLASS_BITS)).astype(np.int64), minlength=len(counts))
                part, k = rows.slice(chunk.lo, chunk.n), chunk.n
                hist = pa.Array.from_buffers(pa.binary(BINS), k, [None, pa.py_buffer(histograms(v, off).tobytes())]).cast(pa.binary())
                yield batch(id=part.column(0), th=part.column(1), n_shingles=np.diff(off), d1=signed(d1), d2=signed(d2), hist=hist, bucket=none(k, pa.int32()), seen=none(k, pa.int64()))
        used = np.flatnonzero(counts)
        k = len(used)
        yield batch(id=none(k, pa.int64()), th=none(k, pa.int64()), n_shingles=none(k, pa.int64()), d1=none(k, pa.int64()), d2=none(k, pa.int64()), hist=none(k, pa.binary()), bucket=used.astype(np.int32), seen=counts[used])

    first = table(keyed.mapInArrow(sets, "id long, th long, n_shingles long, d1 long, d2 long, hist binary, bucket int, seen long"), "sets")
    info = first.where("bucket is null").drop("bucket", "seen")
    # 2**18 rows at most, whatever the input.
    seen = first.where("bucket is not null").groupBy("bucket").agg(F.sum("seen").alias("seen")).toArrow()
    counts = np.zeros(1 << CLASS_BITS, np.int64)
    counts[seen["bucket"].to_numpy()] = seen["seen"].to_numpy()
    often = int(2 * np.median(counts)) + 64
    shared = docs.sparkSession.sparkContext.broadcast((counts, class_ranks(counts)))

    def sign(rows: pa.RecordBatch, chunk: Chunk) -> pa.RecordBatch:
        counts, rank = shared.value
        v, off = shingle_sets(chunk, n, rank)
        sig, doc, reach = signatures(v, off, counts, often, t)
        return batch(sig=signed(sig), node=signed(digests(v, off)[0])[doc], size=np.diff(off)[doc].astype(np.int32), reach=reach.astype(np.int32))

    signed_rows = text_map(keyed.select("text"), sign, "sig long, node long, size int, reach int")
    # Most signatures stand in one class only; the others' rows are kept.
    groups = table(signed_rows.groupBy("sig").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("sig"), "groups")
    members = table(signed_rows.join(groups, "sig").groupBy("sig", "node").agg(F.first("size").alias("size"), F.max("reach").alias("reach")), "members")

    def near(x: str, y: str) -> str:
        size = f"{t.denominator} * least({x}.size, {y}.size) >= {t.numerator} * greatest({x}.size, {y}.size)"
        return f"{size} and {t.denominator + t.numerator} * least({x}.reach, {y}.reach) >= {t.numerator} * ({x}.size + {y}.size)"

    # One text per class.  Two sets that differ in d2 only share a node here: both texts are then compared.
    kept = info.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min(F.struct("id", "th", "n_shingles", "hist")).alias("m")).select(F.col("d1").alias("node"), "m.*")
    asked = members.select("node").distinct()
    kept = table(kept.join(asked, "node"), "kept")
    hists = kept.select("node", "n_shingles", "hist")
    texts = table(keyed.join(kept.select("node", "id", "th"), [keyed.id.eqNullSafe(kept.id), keyed.th == kept.th]).select("node", "text"), "texts")
    rows = info.select("id", "th", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("d1")).alias("node"), "d2")
    if every:
        # A signature's pairs are split by the left node, so that no task makes all pairs of a large group.
        sized = members.join(members.groupBy("sig").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "sig")
        one = sized.withColumn("part", F.expr("cast(pmod(xxhash64(node), parts) as int)"))
        each = sized.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
        pairs = one.alias("p").join(each.alias("q"), F.expr(f"p.sig = q.sig and p.part = q.part and p.node < q.node and {near('p', 'q')}"))
        pairs = table(pairs.select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct(), "pairs")
        links = verified(pairs, hists, texts, n, t, "links")
        return rows, links, components(links)

    def compared(rows: DataFrame, pivots: DataFrame, name: str) -> DataFrame:
        """Pairs of the pivots with the other classes of their groups, components ``c`` apart where there are some."""
        apart = " and m.c <> p.c" if "c" in rows.columns else ""
        stars = rows.alias("m").join(pivots.alias("p"), F.expr(f"m.sig = p.sig and m.node <> p.node and {near('m', 'p')}{apart}"))
        return table(stars.select(F.least("m.node", "p.node").alias("a"), F.greatest("m.node", "p.node").alias("b")).distinct(), name)

    def central(rows: DataFrame) -> DataFrame:
        """Of each group the class with the fewest rare shingles of its own."""
        columns = [c for c in rows.columns if c != "sig"]
        most = rows.groupBy("sig").agg(F.max(F.struct((F.col("reach") / F.col("size")).alias("share"), *columns)).alias("p"))
        return table(most.select("sig", *[f"p.{c}" for c in columns]), "pivots")

    pivots = central(members)
    seen_pairs = compared(members, pivots, "stars")
    links = verified(seen_pairs, hists, texts, n, t, "links")
    used, left = pivots.select("sig", "node"), members
    while True:
        comp = table(components(links), "components")
        placed = table(left.join(comp, "node", "left").select("sig", "node", "size", "reach", F.coalesce("component", "node").alias("c")), "placed")
        groups = table(placed.groupBy("sig").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("n")).where("x < y").select("sig", "n"), "open")
        left = table(placed.join(groups, "sig"), "left")
        # Large groups whose last pivot is linked with another class of the group go on with the other components.
        large = left.where(F.col("n") > PART)
        last = pivots.select("sig", "node").join(large.select("sig", "node", "c"), ["sig", "node"]).select("sig", F.col("c").alias("pc"))
        going = table(large.join(last, "sig").where("c = pc").groupBy("sig").agg(F.count("*").alias("k")).where("k > 1").select("sig"), "going")
        if not going.head(1):
            break
        done = table(used.join(large.select("sig", "node", "c"), ["sig", "node"]).select("sig", "c").distinct(), "done")
        fresh = large.join(going, "sig").join(done, ["sig", "c"], "left_anti").select("sig", "node", "size", "reach", "c")
        pivots = central(fresh)
        stars = table(compared(large.join(pivots.select("sig"), "sig").select("sig", "node", "size", "reach", "c"), pivots, "stars").join(seen_pairs, ["a", "b"], "left_anti"), "stars")
        links = links.union(verified(stars, hists, texts, n, t, "links"))
        used, seen_pairs = used.union(pivots.select("sig", "node")), seen_pairs.union(stars)
    cross = left.alias("p").join(left.alias("q"), F.expr(f"p.sig = q.sig and p.c <> q.c and p.node < q.node and {near('p', 'q')}"))
    cross = cross.select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct()
    more = verified(table(cross.join(seen_pairs, ["a", "b"], "left_anti"), "cross"), hists, texts, n, t, "more")
    if more.head(1):
        links = links.union(more)
        comp = components(links)
    return rows, links, comp


def jaccard_join(docs: DataFrame, n: int = 4, threshold: Fraction = Fraction(85, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` (smallest id of its component)."""
    rows, _, comp = jaccard_classes(docs, n, threshold, id_col, text_col)
    least = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("least"))
    named = table(least.join(comp, "node", "left").select("node", "least", F.coalesce("component", "node").alias("c")), "classes")
    names = table(named.groupBy("c").agg(F.min("least").alias("component_id")), "names")
    labelled = table(named.join(names, "c").select("node", "component_id"), "named")
    return rows.join(labelled, "node", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def jaccard_links(docs: DataFrame, n: int = 4, threshold: Fraction = Fraction(85, 100), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, links), with every linked pair.  documents: one row per document: id, ``n_shingles``, ``node`` (class of
    equal sets, null if empty), ``n_links`` (other rows that it is linked with, those of its own class included).
    links: a, b, all linked pairs of different classes, a < b."""
    rows, links, _ = jaccard_classes(docs, n, threshold, id_col, text_col, every=True)
    sizes = table(rows.where("node is not null").groupBy("node").agg(F.count("*").alias("n")), "class-sizes")
    both = links.union(links.select("b", "a")).toDF("node", "other")
    far = both.join(sizes.toDF("other", "m"), "other").groupBy("node").agg(F.sum("m").alias("far"))
    counted = sizes.join(far, "node", "left").select("node", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    out = rows.join(counted, "node", "left").select(F.col("id").alias(id_col), "n_shingles", "node", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return out, links


def component_heads(docs: DataFrame, n: int, threshold: Fraction, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the row of smallest (id, hash of the text), as id and th; rows of empty sets are each their own."""
    rows, _, comp = jaccard_classes(docs, n, threshold, id_col, text_col)
    named = rows.where("id is not null").join(comp, "node", "left").withColumn("c", F.coalesce("component", "node"))
    heads = named.where("c is not null").groupBy("c").agg(F.min(F.struct("id", "th")).alias("m")).select("m.id", "m.th")
    return heads.union(named.where("c is null").select("id", "th").distinct())
