import importlib.util
import os

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nullweave.llm.decontaminate import plain
from nullweave.llm.packing import token_pieces
from nullweave.llm.quality_rules import quality_rules
from nullweave.llm.queries import tokenizer_path

from . import brute

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    verdict = {r.doc_id: r.kept for r in quality_rules(docs).collect()}
    kept = [(r.doc_id, r.text) for r in docs.collect() if verdict[r.doc_id]]
    stages = dict(pipeline.STAGES)
    docs = stages["quality rules"](spark, docs, SF)
    assert docs.columns == columns and sorted(r.doc_id for r in docs.collect()) == sorted(d for d, _ in kept)

    kept = [(d, t) for (d, t), (_, _, c) in zip(kept, brute.op5(kept)) if d == c]
    docs = stages["n-gram Jaccard join"](spark, docs, SF)
    assert docs.columns == columns and sorted(r.doc_id for r in docs.collect()) == sorted(d for d, _ in kept)

    import hashlib

    cut = {d: (n, gone, sha) for d, n, gone, sha in brute.op2(kept)}
    kept = [(d, t) for d, t in kept if cut[d][1] == 0 or cut[d][1] < cut[d][0]]
    docs = stages["substring dedup"](spark, docs, SF)
    got = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == columns and sorted(got) == sorted(d for d, _ in kept)
    for d, t in kept:
        if cut[d][1]:
            assert hashlib.sha256(got[d].text.encode()).hexdigest() == cut[d][2] and got[d].n_chars == len(got[d].text)
        else:
            assert got[d].text == t

    items = [plain(r.text.encode()).strip() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = stages["benchmark decontamination"](spark, docs, SF)
    left = {r.doc_id for r in docs.collect()}
    leaked = {d for d, r in got.items() if any(i in plain(r.text.encode()) for i in items)}
    assert docs.columns == columns and not left & leaked and len(left) >= len(got) - len(leaked) - 2

    tokenizer = Tokenizer.from_file(tokenizer_path())
    packed = stages["best-fit packing"](spark, docs, SF)
    want = sorted(brute.op8([(d, got[d].text) for d in left], tokenizer))
    assert sorted(tuple(r) for r in packed.drop("sequence_id", "offset").collect()) == want
    again = sorted(tuple(r)[:5] for r in pipeline.run(spark, SF).collect())
    assert again == want
    ids = {(r.doc_id, r.piece): r.ids for r in token_pieces(docs, tokenizer_path(), with_ids=True).collect()}
    assert all(len(ids[d, p]) == n for d, p, _, n, _ in want)


def test_near_duplicates_at_five_words_and_four_fifths(spark):
    """Copies with words appended or cut off, on both sides of 0.8 and of the 0.85 of the op5 query."""
    import corpus_pipeline as pipeline

    data = []
    for k, other in enumerate([80, 83, 85, 90, 100, 110, 118, 121, 124, 127, 130]):
        w = [f"b{k}x{j}" for j in range(140)]
        data += [(10 * k, " ".join(w[:100])), (10 * k + 1, " ".join(w[:other]))]
    want = sorted(d for d, _, c in brute.op5(data, 5, (4, 5)) if d == c)
    assert want != sorted(d for d, _, c in brute.op5(data) if d == c)
    got = pipeline.near_duplicates(spark, spark.createDataFrame(data, "doc_id long, text string"), SF)
    assert sorted(r.doc_id for r in got.collect()) == want


def test_near_duplicates_with_repeated_ids(spark):
    """Rows of one id with different texts are judged each; equal rows are one."""
    import corpus_pipeline as pipeline

    a, b, c = (" ".join(f"{x}{j}" for j in range(60)) for x in "abc")
    data = [(1, a), (2, a), (2, b), (3, c), (3, c), (4, ""), (4, ""), (4, None), (None, a), (5, b + " end")]
    got = pipeline.near_duplicates(spark, spark.createDataFrame(data, "doc_id long, text string"), SF)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, a), (2, b), (3, c), (4, ""), (4, None), (None, a)], key=repr)


ODD = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (None, None)]


def test_stages_with_odd_rows_and_columns(spark):
    """Nulls, short texts, repeated rows, repeated and null ids, a very long text, clashing columns, no n_chars."""
    import random

    import corpus_pipeline as pipeline

    rnd = random.Random(6)
    text = lambda n: " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))
    a, b, passage = text(80), text(90), text(60)
    long = text(40_000)
    kept = [(10, a), (11, b), (11, passage + " " + text(50)), (12, text(70) + " " + passage), (None, b), (13, long)]
    data = ODD + kept + [(10, a), (14, a), (15, long)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    for c, v in {"id": "x", "th": 1, "cell": 2.0, "size": None, "node": "n", "spans": 3, "hist": 4, "row": 5, "length": 6, "offset": 7, "kept": True}.items():
        df = df.withColumn(c, F.lit(v) if v is not None else F.lit(None).cast("string"))
    docs, out = df.repartition(3), {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        out[name] = docs.collect()
        if name != "best-fit packing":
            assert docs.columns == df.columns
    first = {(r.doc_id, r.text) for r in out["quality rules"]}
    assert first == set(kept + [(14, a), (15, long)])
    second = sorted(((r.doc_id, r.text) for r in out["n-gram Jaccard join"]), key=repr)
    assert second == sorted(kept, key=repr)
    third = {r.doc_id: r.text for r in out["substring dedup"] if r.doc_id == 12}
    assert third[12] == " ".join(kept[3][1].split()[:70])
    assert len(out["benchmark decontamination"]) == len(out["substring dedup"]) == 6
    packed = out["best-fit packing"]
    assert {r.doc_id for r in packed} == {None, 10, 11, 12, 13} and max(r.piece for r in packed) > 10


def test_stages_of_an_empty_table(spark):
    import corpus_pipeline as pipeline

    docs = spark.createDataFrame([], spark.read.parquet(f"{SF}/documents.parquet").schema)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_entry_without_operators():
    """The entry module alone holds the guard."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    with open(os.path.join(root, "corpus_pipeline.py")) as f:
        assert "ImportError" not in f.read()
