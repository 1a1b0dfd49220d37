import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nullweave.llm import kernel, packing, queries, substring_dedup
from nullweave.llm.decontaminate import drop_contaminated, find_items, myers
from nullweave.llm.jaccard_join import jaccard_join, jaccard_links
from nullweave.llm.quality_rules import Limits, keep_quality, quality_rules
from nullweave.llm.substring_dedup import remove_repeats
from nullweave.llm.url_filters import filter_urls

from . import brute

SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted(((tuple(r) for r in (df.select(*cols) if cols else df).collect())), key=repr)


@pytest.fixture(scope="module")
def sample(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd():
    """Nulls, empty and long texts, ties, repeated rows, near copies, shared passages, odd white space."""
    rnd = random.Random(5)
    vocabulary = [f"w{k}" for k in range(40)] + ["É", "naïve", "日本", "a|b", "X"]
    passage = " ".join(rnd.choice(vocabulary) + str(k) for k in range(60))
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    base = " ".join(f"{rnd.choice(vocabulary)}{k}" for k in range(300))
    out = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One two"), (6, "one two three"), (7, "one  two\tthree four")]
    out += [(20 + k, text(rnd.randint(1, 400))) for k in range(30)]
    out += [(60 + k, f"{text(rnd.randint(0, 30))}\n{passage} {text(rnd.randint(0, 30))}") for k in range(12)]
    for k in range(25):
        w = base.split()
        for _ in range(rnd.randint(0, 12)):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        out.append((100 + k, " ".join(w)))
    out += [(130, base), (131, base), (131, base), (132, base.upper()), (140, text(9000)), (141, "x" * 50000), (142, text(20) + "\x0b" + passage)]
    out += [(150, "line of words here\n" * 30), (151, None), (None, base), (None, None), (160, "\u00a0".join(base.split()[:80]))]
    rnd.shuffle(out)
    return out


def frame(spark, data, name="doc_id"):
    df = spark.createDataFrame(data, f"{name} long, text string")
    return df.withColumns({"n": F.lit("clash"), "id": F.lit(None).cast("string"), "cell": F.lit(1), "size": F.lit(2.0)}).repartition(5)


@pytest.mark.parametrize("which", ["sample", "odd"])
def test_substring_dedup(spark, which, request):
    data = request.getfixturevalue(which)
    got = remove_repeats(frame(spark, data)).select("doc_id", "dedup_words", "dedup_removed", F.sha2("dedup_text", 256))
    assert rows(got) == sorted(brute.op2(data), key=repr)


def test_substring_dedup_small_window(spark, odd):
    got = remove_repeats(frame(spark, odd), size=6).select("doc_id", "dedup_words", "dedup_removed", F.sha2("dedup_text", 256))
    assert rows(got) == sorted(brute.op2(odd, 6), key=repr)


@pytest.mark.parametrize("width", [1, 2, 64])
def test_substring_dedup_loses_nothing_with_a_tiny_sketch(spark, odd, width):
    """Shared counters let more through to the exact pass, and never less."""
    got = remove_repeats(frame(spark, odd), size=6, width=width).select("doc_id", "dedup_words", "dedup_removed", F.sha2("dedup_text", 256))
    assert rows(got) == sorted(brute.op2(odd, 6), key=repr)


def test_sketch_overestimates(spark, sample):
    """Each counter is the number of (document, anchor) pairs that fall on it, so no anchor's estimate is below its count."""
    docs = frame(spark, sample).select("doc_id", "text").toDF("id", "text")
    true = Counter()
    for chunk in kernel.chunks(pa.array([t for _, t in sample])):
        for doc, _, _, cell, _, _ in substring_dedup.bundles(chunk, 50, fingerprints=False):
            true.update(c for _, c in {(int(d), int(c)) for d, c in zip(doc, kernel.signed(cell))})
    for width in (8, 1 << 20):
        kept = {(r.row, r.bucket): r.n for r in substring_dedup.merged_sketch(docs, 50, width).collect()}
        assert all(0 <= b < width and n >= 2 for (_, b), n in kept.items())
        cells = spark.createDataFrame([(c,) for c in true], "cell long").select("cell", *[substring_dedup.counter("cell", d, width).alias(f"b{d}") for d in range(substring_dedup.DEPTH)]).collect()
        want = Counter()
        for r in cells:
            want.update({(d, r[f"b{d}"]): true[r.cell] for d in range(substring_dedup.DEPTH)})
        assert kept == {k: n for k, n in want.items() if n >= 2}
        assert width == 8 or sum(min(kept.get((d, r[f"b{d}"]), 0) for d in range(2)) >= 2 for r in cells) < 1.1 * sum(n >= 2 for n in true.values()) + 5


@pytest.mark.parametrize("which", ["sample", "odd"])
def test_jaccard_join(spark, which, request):
    data = request.getfixturevalue(which)
    assert rows(jaccard_join(frame(spark, data))) == sorted(brute.op5(data), key=repr)


def test_jaccard_join_frequent_tokens(spark, monkeypatch):
    """All shingles frequent: only the pair combinations find the links."""
    from nullweave.llm import jaccard_join as module

    rnd = random.Random(3)
    data = []
    for base in range(6):
        w = [f"b{base}x{k}" for k in range(rnd.randint(18, 120))]
        for k in range(12):
            v = list(w)
            for _ in range(rnd.randint(0, 3)):
                v[rnd.randrange(len(v))] = f"e{rnd.random()}"
            data.append((len(data), " ".join(v)))
    real = module.signatures
    monkeypatch.setattr(module, "signatures", lambda v, off, counts, often, t: real(v, off, counts, -1, t))
    assert rows(jaccard_join(frame(spark, data))) == sorted(brute.op5(data), key=repr)


@pytest.mark.parametrize("which", ["sample", "odd"])
def test_quality_rules(spark, which, request):
    data = request.getfixturevalue(which)
    got = quality_rules(frame(spark, data))
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows(got, *cols) == sorted(brute.op7(data), key=repr)
    assert got.where("kept and base_failed").count() == 0
    assert sorted(r.doc_id for r in got.where("kept and doc_id is not null").collect()) == sorted(r.doc_id for r in keep_quality(frame(spark, data)).where("doc_id is not null").collect())


def test_packing(spark, sample, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer = Tokenizer.from_file(path)
    tricky = [(900, "it's  we'll\u00a0 x\u2003 y <|endoftext|> \x1c a\x85b \u3000 c  \n\n d'accord 123 ４５ 日本語  "), (901, "Été «déjà» ±3 ÷ end")]
    tricky += [(902, "<|endoftext|>"), (903, "a<|endoftext|><|endoftext|>b <|endoftext|> <|endoftext|"), (904, "x <|endof"), (905, "text|> y"), (906, " <|endoftext|>\n<|endoftext|> the <|END|>")]
    data = sample + odd + tricky
    got = packing.pack_documents(frame(spark, data), path)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert rows(got.drop("sequence_id", "offset")) == sorted(brute.op8(data, tokenizer), key=repr)
    total, used = 0, {}
    for r in got.collect():
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        total += r.length
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    bins = []
    for length in sorted((r.length for r in got.collect()), reverse=True):
        fit = min((k for k, b in enumerate(bins) if b + length <= 1024), key=lambda k: -bins[k], default=None)
        if fit is None:
            bins.append(length)
        else:
            bins[fit] += length
    assert -(-total // 1024) <= len(used) <= len(bins)


def test_plan_holds_every_piece():
    rnd = np.random.default_rng(1)
    counts = np.zeros(101, np.int64)
    counts[1:] = rnd.integers(0, 50, 100)
    held = np.zeros(101, np.int64)
    for config, times in packing.plan(counts):
        assert sum(config) <= 100 and times > 0
        for length in config:
            held[length] += times
    assert (held == counts).all()
    assert packing.plan(np.zeros(11, np.int64)) == []


def test_knapsack_against_every_multiset():
    rnd = np.random.default_rng(5)
    for _ in range(20):
        there = rnd.integers(0, 4, 13) * (np.arange(13) > 0)
        value = np.where(there > 0, rnd.random(13), 0)
        tables = packing.knapsack(value, there)
        sets = [()]
        for length in range(1, 13):
            sets = [(*s, n) for s in sets for n in range(there[length] + 1) if sum(x * y for x, y in enumerate((*s, n), 1)) <= 12]
        for k, length in enumerate(tables[0].tolist()):
            lengths, n = packing.price(k, value, there, tables)
            assert lengths[0] == length and (n <= there[lengths]).all() and (lengths * n).sum() <= 12
            most = max(sum(x * value[y] for y, x in enumerate(s, 1)) for s in sets if s[length - 1] and not any(s[length:]))
            assert np.isclose((n * value[lengths]).sum(), most)


@pytest.mark.parametrize("times, most", [(1, 456), (50, 22811)])
def test_plan_comes_from_the_program(spark, times, most, monkeypatch):
    """On the pieces of the sample table the program alone is no worse than best fit, and near the bound."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = np.zeros(1025, np.int64)
    for r in packing.token_pieces(docs, queries.tokenizer_path()).groupBy("length").count().collect():
        counts[r["length"]] = r["count"] * times
    counts[-1] = 0
    real, placed = packing.best_fit, []
    monkeypatch.setattr(packing, "best_fit", lambda left: placed.append(int(left.sum())) or real(left))
    used = sum(n for _, n in packing.plan(counts))
    bound = (counts * np.arange(1025)).sum() / 1024
    assert bound <= used <= min(most, sum(real(counts).values())) and used <= 1.005 * bound + 1
    assert sum(placed) <= 0.01 * counts.sum()


def test_myers():
    rnd = random.Random(2)
    for _ in range(200):
        p = "".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 80)))
        t = "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 120)))
        assert myers(p, t)[0] == min(len(p), brute.distance_in(p, t))


def test_decontaminate(spark):
    rnd = random.Random(4)
    letters = "abcde fgh"
    items = [(k, "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 150))).strip() or "zz") for k in range(12)] + [(12, None), (13, ""), (14, "  \n"), (15, "q"), (None, "The very same passage, twice over")]
    docs = [(1, None), (2, ""), (3, "nothing"), (4, "the VERY same\npassage, twice  over")]
    for k in range(60):
        _, text = items[k % 12]
        t = list(text)
        for _ in range(rnd.randint(0, 1 + len(t) // 8)):
            at = rnd.randrange(len(t)) if t else 0
            t[at : at + rnd.randint(0, 1)] = rnd.choice(["", "x", "é"])
        docs.append((10 + k, "".join(rnd.choice("nmo pé") for _ in range(rnd.randint(0, 60))) + "".join(t) + "".join(rnd.choice("nmo p") for _ in range(30))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = find_items(frame(spark, docs), bench, rate=0.1).collect()
    from nullweave.llm.decontaminate import plain

    want = {}
    for doc, text in docs:
        for item, pattern in items:
            p = plain((pattern or "").encode()).strip(" ")
            if p and (d := brute.distance_in(p, plain((text or "").encode()))) <= int(0.1 * len(p)):
                want[doc, item] = d
    assert {(r.doc_id, r.item_id) for r in found} == set(want)
    text_of = dict(docs)
    for r in found:
        p = plain(dict(items)[r.item_id].encode()).strip(" ")
        part = plain(text_of[r.doc_id].encode())[r.start : r.stop]
        assert brute.distance_in(p, part) <= r.distance <= int(0.1 * len(p))
    clean = drop_contaminated(frame(spark, docs), bench, rate=0.1)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _ in docs if d not in {k for k, _ in want})


def test_decontaminate_blocks_and_long_texts(spark, monkeypatch):
    """Items in many blocks give the rows that one block gives; an item far inside a very long text is found there."""
    from nullweave.llm import decontaminate as module

    rnd = random.Random(9)
    words = lambda n: " ".join(f"{rnd.choice('bcdfgklm')}{rnd.choice('aeiou')}{rnd.choice('nrst')}{rnd.randrange(90)}" for _ in range(n))
    items = [(k, words(rnd.randint(8, 40))) for k in range(15)]
    long = words(120_000)
    docs = [(k, f"{words(10)} {text} {words(5)}") for k, text in items] + [(50, long + " " + items[3][1].replace("a", "o", 2) + " " + words(20_000)), (51, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = rows(find_items(frame(spark, docs), bench))
    monkeypatch.setattr(module, "BLOCK_CHARS", 200)
    assert len(list(module.item_blocks(bench, "item_id", "text"))) > 5
    assert rows(find_items(frame(spark, docs), bench)) == one and {(k, k) for k in range(15)} <= {r[:2] for r in one}
    assert [(r[0], r[1], r[2]) for r in one if r[0] == 50] == [(50, 3, len(long) + 1)]
    assert [r.doc_id for r in drop_contaminated(frame(spark, docs), bench).collect()] == [51]


def test_url_filters(spark):
    urls = ["http://example.com/en/", "https://WWW.Example.com/en/x?y#z", "ftp://a.b.net/es/1", "http://net/fr/", "http://com", "http://com?x/", "example.com/en/", None, "", "://", "http://x.com#/en/", "http://example.com/EN/", "http://notexample.com/en/a", "http://a.example.com:80/en/", "x://y://com/", "http://ü.net/fr/é\nb", "http://b.net/frx"]
    pages = [(k, u) for k, u in enumerate(urls)] + [(None, urls[0]), (0, urls[0]), (0, urls[0])]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2), "n": F.lit(3)})
    rules = spark.createDataFrame(queries.URL_RULES + [(None, "/", "block"), ("", "/", "block"), ("x.com", None, "block")], "host string, path string, verdict string")
    got = rows(filter_urls(df, rules), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted(brute.op1(pages, queries.URL_RULES), key=repr)
    assert filter_urls(df, rules.limit(0)).where("verdict <> 'allow' or rule is not null").count() == 0


def test_empty_tables(spark):
    none = frame(spark, [])
    assert remove_repeats(none).count() == jaccard_join(none).count() == quality_rules(none).count() == 0
    assert packing.pack_documents(none, queries.tokenizer_path()).count() == 0
    assert find_items(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    pages, rules = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    assert filter_urls(pages, rules).count() == filter_urls(pages, rules.limit(0)).count() == 0


def test_kernel_words_and_hashes(odd):
    texts = [t for _, t in odd]
    for limit in (1, 1000, 1 << 20):
        seen = []
        for chunk in kernel.chunks(pa.array(texts).slice(3), limit):
            start, end, off = chunk.words
            raw = chunk.data.tobytes()
            for k in range(chunk.n):
                seen.append([raw[a:b].decode() for a, b in zip(start[off[k] : off[k + 1]], end[off[k] : off[k + 1]])])
        assert seen == [brute.words(t) for t in texts[3:]]
    chunk = next(kernel.chunks(pa.array(["b a b A", "a B"])))
    h = chunk.word_hashes(0, lower=True)
    assert h[0] == h[2] == h[5] and h[1] == h[3] == h[4] and h[0] != h[1]


@pytest.mark.parametrize("ranked", [False, True])
def test_distinct_sorted(ranked):
    """Also where values differ in their lowest bits only."""
    rnd = np.random.default_rng(7)
    bits = 4
    near = kernel.mix(np.arange(6, dtype=np.uint64))[:, None] ^ np.arange(4, dtype=np.uint64)[None, :]
    for pool in (near.ravel(), kernel.mix(np.arange(40, dtype=np.uint64))):
        off = np.concatenate([[0], np.cumsum(rnd.integers(0, 30, 50))])
        values = rnd.choice(pool, off[-1])
        rank = rnd.permutation(1 << bits) if ranked else None
        got, at = kernel.distinct_sorted(values, off, rank, bits)
        for k in range(50):
            place = (lambda x: (rank[int(x) >> (64 - bits)], x)) if ranked else (lambda x: x)
            assert got[at[k] : at[k + 1]].tolist() == sorted(set(values[off[k] : off[k + 1]].tolist()), key=place)


def test_sliding_argmin():
    keys = kernel.mix(np.arange(500, dtype=np.uint64) // np.uint64(3))
    got = kernel.sliding_argmin(keys, 26)
    for k in range(len(got)):
        w = keys[k : k + 26] >> np.uint64(24)
        assert got[k] == k + int(np.argmin(w))


def test_jaccard_join_frequent_tokens_of_many_sizes(spark, monkeypatch):
    """Sets on both sides of the sizes at which the number of groups changes."""
    from nullweave.llm import jaccard_join as module

    rnd = random.Random(8)
    data = []
    for base, size in enumerate([60, 225, 255, 262, 290, 500, 530, 700]):
        w = [f"b{base}x{k}" for k in range(size)]
        for k in range(8):
            v = w[: size - rnd.randint(0, size // 8)]
            for _ in range(rnd.randint(0, size // 60)):
                v[rnd.randrange(len(v))] = f"e{rnd.random()}"
            data.append((len(data), " ".join(v)))
    real = module.signatures
    monkeypatch.setattr(module, "signatures", lambda v, off, counts, often, t: real(v, off, counts, -1, t))
    assert rows(jaccard_join(frame(spark, data))) == sorted(brute.op5(data), key=repr)


def test_decontaminate_replaced_words_and_reflowed_copies(spark):
    """Four replaced words of an item, and copies whose white space alone differs."""
    w = "every morning the ferry leaves the northern harbour with letters and parcels for the islands and returns before sunset unless the wind has turned or fog has closed the narrow strait between the two white lighthouses on the cliffs".split()
    other = list(w)
    for k in (3, 12, 21, 30):
        other[k] = "qqqqq"
    deleted = " ".join(w).replace("the wind has", "the  has")
    docs = [(1, "so it is " + " ".join(other) + " and on"), (2, "a\n\n" + "   ".join(w) + "  b"), (3, "x " + "\n        ".join(" ".join(w[k : k + 3]) for k in range(0, len(w), 3))), (4, "nothing  of  it"), (5, deleted)]
    items = spark.createDataFrame([(7, " ".join(w)), (8, "  ".join(w))], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in find_items(frame(spark, docs), items).collect()}
    assert set(found) == {(d, i) for d in (1, 2, 3, 5) for i in (7, 8)}
    for d, i in ((2, 7), (2, 8), (3, 7), (3, 8)):
        part = dict(docs)[d][found[d, i].start : found[d, i].stop]
        assert found[d, i].distance == 0 and part.split() == w and part == part.strip()
    assert [r.doc_id for r in drop_contaminated(frame(spark, docs), items).collect()] == [4]


def test_jaccard_join_rounds_of_pivots(spark, odd, monkeypatch):
    """Clusters that share most of a long passage, in groups beyond PART: pivots in rounds, then split listing."""
    from nullweave.llm import jaccard_join as module

    monkeypatch.setattr(module, "PART", 4)
    rnd = random.Random(12)
    common = [f"c{k}" for k in range(120)]
    data = []
    for cluster in range(9):
        own = [f"o{cluster}x{k}" for k in range(60)]
        for k in range(7):
            w = common + own[: 60 - rnd.randint(0, 4)]
            for _ in range(rnd.randint(0, 2)):
                w[120 + rnd.randrange(40)] = f"e{rnd.random()}"
            data.append((len(data) + 1000, " ".join(w)))
    real, rounds = module.verified, []
    monkeypatch.setattr(module, "verified", lambda *x: rounds.append(x[-1]) or real(*x))
    assert rows(jaccard_join(frame(spark, data + odd))) == sorted(brute.op5(data + odd), key=repr)
    assert rounds.count("links") >= 2 and rounds[-1] == "more"


def test_histograms_bound_what_is_shared():
    from nullweave.llm import jaccard_join as module

    rnd = np.random.default_rng(2)
    pool = kernel.mix(np.arange(60000, dtype=np.uint64))
    for size in (1, 50, 700, 40000):
        a, b = (np.unique(rnd.choice(pool, size)) for _ in range(2))
        h = module.histograms(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        least = np.minimum(h[0], h[1])
        assert h.shape == (2, module.BINS) and ((least == 255).any() or least.sum() >= len(np.intersect1d(a, b)))
        assert size > 40000 or (h == 255).any() or (h.sum(1) == [len(a), len(b)]).all()


def test_jaccard_links_are_all_pairs(spark, odd, monkeypatch):
    """Near copies that are all linked with each other, equal rows, and odd texts; groups split in parts."""
    from nullweave.llm import jaccard_join as module

    monkeypatch.setattr(module, "PART", 3)
    w = [f"c{k}" for k in range(200)]
    data = odd + [(500 + k, " ".join([*w[: 20 * k], f"x{k}", *w[20 * k + 1 :]])) for k in range(10)] + [(510, " ".join(w)), (511, " ".join(w))]
    sets = [brute.shingles(text) for _, text in data]
    pairs = [(i, j) for i in range(len(data)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) > 0]
    linked = [sum(k in p for p in pairs) for k in range(len(data))]
    docs, links = jaccard_links(frame(spark, data))
    assert rows(docs, "doc_id", "n_shingles", "n_links") == sorted(((d, len(s), n) for (d, _), s, n in zip(data, sets, linked)), key=repr)
    assert links.count() == len({frozenset((frozenset(sets[i]), frozenset(sets[j]))) for i, j in pairs if sets[i] != sets[j]})
    assert links.where("a >= b").count() == 0
    assert module.jaccard_classes(frame(spark, data))[1].distinct().count() < links.count()
