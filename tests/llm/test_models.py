import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nullweave.llm import langid, license_scan, quality_classifier, toxicity
from nullweave.llm.fit import labelled_sample, logistic, text_chunks
from nullweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def labelled(spark, got, column, truth):
    return [(r[truth], r["score"], r["predicted"]) for r in got.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()]


def test_quality_held_out(spark):
    got = QUERIES["op9_quality_classifier"](spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    pairs = labelled(spark, got, "quality", "quality")
    assert len(pairs) > 50 and np.mean([y == p for y, _, p in pairs]) > 0.93
    assert got.count() == 1000 and got.where("score between 0 and 1").count() == 1000


@pytest.mark.parametrize("sf, recall, alarms", [("sf0.01", 0.6, 0.02), ("sf0.1", 0.92, 0.01)])
def test_toxicity_held_out(spark, sf, recall, alarms):
    """Some labels are noise: toxic ones without any telling word."""
    got = QUERIES["op4_toxicity"](spark, f"/root/testdata/{sf}")
    pairs = [(r.toxic, r.predicted) for r in got.where("held_out").join(spark.read.parquet(f"/root/testdata/{sf}/labels.parquet"), "doc_id").collect()]
    caught, false = np.mean([p for y, p in pairs if y]), np.mean([p for y, p in pairs if not y])
    print(sf, caught, false)
    assert caught >= recall and false <= alarms
    assert got.where("n_spans <> size(spans) or predicted = 1 and size(spans) = 0 and score < 0.3").count() == 0


def test_toxicity_columns(spark):
    got = QUERIES["op4_toxicity"](spark, SF)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    pairs = labelled(spark, got, "toxic", "toxic")
    clean = [p for y, _, p in pairs if y == 0]
    assert np.mean(clean) < 0.05
    assert got.count() == 1000


def test_language_held_out(spark):
    got = QUERIES["op6_language_id"](spark, SF)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    pairs = got.where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in pairs]) > 0.97


def test_held_out_labels_are_not_read(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_classifier.quality_scores(docs, x).select("doc_id", "score").orderBy("doc_id").toPandas() for x in (labels, flipped))
    assert (a.score == b.score).all()


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "12 34 !!"), (5, "word"), (6, "the cat sat on the mat " * 5000), (6, "the cat sat on the mat"), (None, "le chat est sur la table"), (None, None), (7, "Ünïcödé 日本語"), (8, "x" * 30000)]


def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"lang": F.lit("en"), "id": F.lit("x"), "label": F.lit(3), "score": F.lit(1)})
    return df.repartition(3)


@pytest.mark.parametrize("labels", [[], [(5, 1, 1)], [(5, 1, 1), (6, 0, 0), (None, 1, 1), (4, None, None), (99, 1, 0)]])
def test_odd_rows(spark, labels):
    docs = odd(spark)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for got in (quality_classifier.quality_scores(docs, marks), toxicity.toxicity_scores(docs, marks)):
        rows = got.collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in rows)
        none = docs.limit(0)
        assert type(got) is not None
    assert quality_classifier.quality_scores(none, marks).count() == 0 and toxicity.toxicity_scores(none, marks).count() == 0


def test_language_odd_rows(spark):
    got = {(r.doc_id, r.lang_pred) for r in langid.languages(odd(spark)).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "und"), (None, "und"), (5, "en"), (7, "en")} <= got
    assert langid.languages(odd(spark).limit(0)).count() == 0
    nothing = langid.languages(odd(spark).withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"} and nothing.where("score <> 0").count() == 0


def test_sample_is_bounded(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    texts, ys, weight = labelled_sample(docs, labels, "doc_id", "text", "quality", rows=20)
    assert ys.count(0) == ys.count(1) == 20 and math.isclose(weight.mean(), 1)
    texts, _, _ = labelled_sample(docs, labels, "doc_id", "text", "quality", most_bytes=5000)
    assert 0 < sum(map(len, texts)) <= 5000
    one = spark.createDataFrame([(1, "x" * 900), (2, "word"), (3, None), (4, "é" * 10), (5, "far")], "doc_id long, text string")
    texts, ys, _ = labelled_sample(one, spark.createDataFrame([(k, k % 2, 0) for k in range(7)], "doc_id long, toxic int, text int"), "doc_id", "text", "toxic", most_bytes=60)
    assert sorted(zip(ys, texts)) == [(0, "word"), (0, "é" * 10), (1, "far")]  # the long text alone is left out


@pytest.mark.parametrize("sizes", [[6], [1], [3, 1, 8, 2], [11, 5]])
def test_marginals_against_enumeration(sizes):
    rnd = np.random.default_rng(0)
    odds, trans = rnd.normal(size=sum(sizes)), rnd.normal(size=(2, 2))
    first = np.zeros(len(odds), bool)
    p, z, want, at = [], 0.0, np.zeros((2, 2)), 0
    for n in sizes:
        first[at] = True
        weight = {}
        for code in range(2**n):
            y = tuple(code >> k & 1 for k in range(n))
            weight[y] = math.exp(sum(o for o, v in zip(odds[at:], y) if v) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        total = sum(weight.values())
        z += math.log(total)
        p += [sum(v for y, v in weight.items() if y[k]) / total for k in range(n)]
        for y, v in weight.items():
            for a, b in zip(y, y[1:]):
                want[a, b] += v / total
        at += n
    got, pairs, log_z = toxicity.marginals(odds, first, trans)
    assert np.allclose(got, p, rtol=1e-9) and np.allclose(pairs, want) and math.isclose(log_z, z, rel_tol=1e-9)


def test_marginals_of_long_chains():
    """Chains across many blocks against forward-backward one token after the other."""
    rnd = np.random.default_rng(1)
    trans, sizes = np.array([[1.5, -1.0], [-2.0, 2.0]]), [5000, 1, 64, 65, 700]
    odds = rnd.normal(scale=3, size=sum(sizes))
    first = np.zeros(len(odds), bool)
    first[np.cumsum([0, *sizes[:-1]])] = True
    t, want = np.exp(trans), []
    for lo, hi in zip(np.cumsum([0, *sizes[:-1]]), np.cumsum(sizes)):
        e, front, back = np.exp(odds[lo:hi]), [], [np.ones(2)]
        for k in range(hi - lo):
            a = (front[-1] @ t if k else np.ones(2)) * [1, e[k]]
            front.append(a / a.sum())
        for k in range(hi - lo - 1, 0, -1):
            b = t @ (back[-1] * [1, e[k]])
            back.append(b / b.sum())
        both = np.array(front) * np.array(back[::-1])
        want += (both[:, 1] / both.sum(1)).tolist()
    got = toxicity.marginals(odds, first, trans)[0]
    assert np.allclose(got, want, rtol=1e-8, atol=1e-12)
    # A state is carried across every place: one strong token moves its neighbours, wherever a block may end.
    for at in range(100, 300):
        flat = np.full(600, -1.0)
        flat[at] = 12.0
        p = toxicity.marginals(flat, np.arange(600) == 0, np.array([[2.0, -2.0], [-2.0, 2.0]]))[0]
        assert p[at] > 0.9 and p[at - 1] > 3 * p[at - 40] and p[at + 1] > 3 * p[at + 40]


def test_toxic_spans(spark):
    rnd = random.Random(1)
    plain = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("an", "el", "or", "ist", "una")]
    texts, y = [], []
    for k in range(300):
        w = [rnd.choice(plain) for _ in range(rnd.randint(5, 40))]
        if k % 3 == 0:
            for _ in range(rnd.randint(1, 2)):
                w[rnd.randrange(len(w))] = rnd.choice(["zork", "Zorkish,", "vlarg"])
        texts.append(" ".join(w))
        y.append(int(k % 3 == 0))
    field = toxicity.fit(texts, np.array(y), np.ones(len(y)))
    docs = spark.createDataFrame([(1, "bél ñan " + "vlarg bel"), (2, "ban bel")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.tag_documents(docs, field).collect()}
    assert [(s.start, s.stop) for s in got[1].spans] == [(8, 13)] and got[1].score > 0.5
    assert got[2].spans == [] and got[2].score < 0.2


def test_trees_match_plain_walk():
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(400, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = quality_classifier.fit_trees(x, y, np.ones(400))
    assert np.mean((trees.score(x) > 0.5) == y) > 0.95
    for row in x[:20]:
        total = trees.base
        for f, c, leaf in zip(trees.feature, trees.cut, trees.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > c[node])
            total += leaf[node - len(f)]
        assert math.isclose(total, trees.raw(row[None])[0], rel_tol=1e-9)


def test_logistic():
    x = np.linspace(-3, 3, 200)
    y = (np.random.default_rng(0).random(200) < 1 / (1 + np.exp(-2 * x + 1))).astype(float)
    w = logistic(x[:, None], y, np.ones(200))
    assert abs(w[0] - 2) < 0.7 and abs(w[1] + 1) < 0.7


def test_licenses_on_corpus(spark):
    got = {(r.doc_id, r.family) for r in QUERIES["op10_license_scan"](spark, SF).collect()}
    lines = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit", "All rights reserved.": "proprietary"}
    want = {(r.doc_id, f) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() for line, f in lines.items() if line in r.text}
    assert len(want) > 20 and len(want - got) <= 0.02 * len(want) and len(got - want) <= 0.02 * len(got)


def test_licenses_varied(spark):
    model = license_scan.fit(["the cat sat on a mat and was happy", "of all things the general idea is public", "rights and duties of people in the city"] * 10)
    long = "word " * 300
    data = [(1, None), (2, ""), (3, "\n\n"), (4, f"{long}\n{long} licensed under the Apache License, Version 2.0 {long}"), (5, "some text\nALL RIGHTS RESERVED\n"), (6, "He reserved a table for all, rights were not an issue"), (7, "© 2020 Someone. Released under the MIT license"), (8, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."), (None, "All rights reserved."), (9, "Licensed under the GNU Lesser General Public License, version 2.1.")]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("family", F.lit(1))
    got = {(r.doc_id, r.paragraph, r.family) for r in license_scan.scan_licenses(docs, model).where("confirmed").collect()}
    assert got == {(4, 1, "apache"), (5, 1, "proprietary"), (7, 0, "mit"), (8, 0, "cc-by-sa"), (None, 0, "proprietary"), (9, 0, "lgpl")}
    assert license_scan.licenses(docs.limit(0)).count() == 0


def test_licenses_wrapped(spark):
    model = license_scan.fit(["the cat sat on a mat and was happy", "of all things the general idea is public", "rights and duties of people in the city"] * 10)
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet:"
    data = [(1, gpl), (2, bsd), (3, f"a file\nof ours\n\n{bsd}\n\nsome text"), (4, "all of us\n\nhave rights\n\nwhich are reserved"), (5, "one line\nReleased under the MIT License.\nanother line\n"), (6, f"the cat sat\n on a mat\n{gpl}\n#\n# and was happy")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {(r.doc_id, r.paragraph, r.family) for r in license_scan.scan_licenses(docs, model).where("confirmed").collect()}
    assert got == {(1, 0, "gpl"), (2, 0, "bsd"), (3, 3, "bsd"), (5, 1, "mit"), (6, 2, "gpl")}


def test_language_margins_do_not_depend_on_neighbours(spark):
    """Equal scores whatever stands beside a text, under any chunking, order and partitioning."""
    texts = ["no", "a", "", "Bonjour le monde!!", "hello -- world, hello", "ñ", "no", " \n", "b" * 300, "nö  nö"]
    m = langid.fit(["Bonjour le monde", "hello world, hello", "no sé nada", "der die das"] * 5, ["fr", "en", "es", "de"] * 5)
    alone = np.concatenate([langid.margins(m, c) for t in texts for c in text_chunks([t])])
    for limit in (1, 20, 1 << 20):
        assert np.allclose(np.concatenate([langid.margins(m, c) for c in text_chunks(texts, limit)]), alone, rtol=0, atol=1e-9)
    back = np.concatenate([langid.margins(m, c) for c in text_chunks(texts[::-1])])[::-1]
    assert np.allclose(back, alone, rtol=0, atol=1e-9)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one, many = (sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(d, m).collect()) for d in (docs.coalesce(1), docs.orderBy(F.desc("doc_id")).repartition(7)))
    assert one == many


def test_language_features_by_hand():
    """N-grams of each text with every run of other bytes made one space, and spaces after its end."""
    texts = ["Ab, c", "..x", "", "--"]
    f, off = (x for c in text_chunks(texts) for x in langid.features(c))
    got = [[int(v) for v in f[off[k] : off[k + 1], 0]] for k in range(len(texts))]
    assert got == [[ord(x) for x in y] for y in ("ab c", " x", "", " ")]
    bucket = lambda s, factor: (int.from_bytes(s.encode(), "big") * factor % 2**32) >> (32 - langid.BITS)
    for k, y in enumerate(("ab c", " x", "", " ")):
        for j in range(len(y)):
            padded = y + "  "
            assert f[off[k] + j, 1] == bucket(padded[j : j + 2], 2654435761) and f[off[k] + j, 2] == bucket(padded[j : j + 3], 2246822519)


def test_machines_match_one_by_one():
    rnd = np.random.default_rng(4)
    x = rnd.random((90, 20)).astype(np.float32)
    y = np.stack([np.where(x[:, 0] > 0.5, 1, -1), np.where(x[:, 1] > 0.3, 1, -1) * (np.arange(90) % 3 > 0)], 1)
    w, b = langid.machines(x, y)
    use = y[:, 1] != 0
    one, c = langid.machines(x[use], y[use, 1:])
    assert np.allclose(w[:, 1:], one, atol=1e-4) and np.allclose(b[1:], c, atol=1e-4)
    assert np.mean(np.sign(x @ w + b)[:, 0] == y[:, 0]) > 0.9


def test_shares_match_margins():
    texts = ["Bonjour le monde", "", "hello world, hello"]
    m = langid.fit(texts * 5, ["fr", "en", "en"] * 5)
    x = langid.shares(texts)
    got = np.concatenate([langid.margins(m, c) for c in text_chunks(texts)])
    assert np.allclose(got, x @ m.weights + m.bias, atol=1e-4)


def test_license_windows_after_very_long_text():
    """A notice's logits are the same at the start of a text and after a million words."""
    model = license_scan.fit(["the cat sat on a mat and was happy", "of all things the general idea is public"] * 10)
    notice = "Released under the MIT License."
    ahead = "some words of a long line and so on " * 30
    values = []
    for text in (notice, f"{ahead}\n" * 4000 + notice):
        g = license_scan.Grams(next(text_chunks([text])))
        at = np.flatnonzero(g.lo[: g.wrapped] == g.first[-1])[0]
        values.append(g.logits(model.weights, model.bias)[at])
    assert np.allclose(*values, rtol=0, atol=1e-6)


def test_sample_of_paragraphs_leaves_out_what_does_not_fit(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "SAMPLE_BYTES", 100)
    docs = spark.createDataFrame([(k, f"line {k}\n\nmore") for k in range(5)] + [(5, "y" * 90), (6, "x" * 5000), (7, None), (None, "z")], "doc_id long, text string")
    got = license_scan.corpus_paragraphs(docs)
    assert {"more"} | {f"line {k}" for k in range(5)} <= set(got) | {"y" * 90} and not any("x" in p for p in got) and len(got) >= 3
