"""Samples of the ensembles, and z-scores from them.

All node pairs of two classes have one chance, so a sample draws, for each class pair, how many of its pairs are linked (a binomial
number) and then which ones, as distinct numbers of pairs: the work is in proportion to the links and the class pairs,
not to the pairs of nodes.  Class pairs with many node pairs are cut into blocks of about ``BLOCK`` links.  Every random
number depends on (seed, sample, class pair, block) or (seed, sample, pair of nodes) alone, so a sample does not depend on
partitions, order or retries.  All samples are one DataFrame with ``sample_id``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import exponential, geometric, uniform
from . import kernels
from .model import BiCM, Model

#: Expected links of a block, which one call draws at once.
BLOCK = 1 << 16
#: Expected links, and class pairs, of a task.
LINKS, CELLS = 8 * BLOCK, 50_000
#: Parts in which the nodes of a class are numbered.
PARTS = 64


def numbered(members: DataFrame) -> DataFrame:
    """id, cls, rank (from 0) of each node in its class.  Numbers come from two levels, class and hash part, so a class that
    a third of all nodes have is numbered by many tasks."""
    part = members.select("id", "cls").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)))
    before = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = part.groupBy("cls", "part").agg(F.count("*").alias("n")).select("cls", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = F.row_number().over(Window.partitionBy("cls", "part").orderBy("id")) - 1
    return part.withColumn("rank", inner).join(base, ["cls", "part"]).select("id", "cls", (F.col("rank") + F.col("base")).cast("long").alias("rank"))


def unordered(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs a < b in the order (0,1), (0,2), (1,2), (0,3), ... by their number."""
    b = ((1 + np.sqrt(1 + 8.0 * number)) / 2).astype(np.int64)
    b -= b * (b - 1) // 2 > number
    b += (b + 1) * b // 2 <= number
    return number - b * (b - 1) // 2, b


def drawn(cells: DataFrame, extra: list[str], ordered: bool, n: int, seed: int, tasks: int = 1) -> DataFrame:
    """sample_id, ca, ra, cb, rb (classes and numbers of the linked nodes) and the columns ``extra``, from class pairs ca, cb,
    fa, fb (their numbers of nodes), p, same (whether both are one class).

    The rows of class pairs say nothing of how many links they become, so ``tasks`` is given, and links go out by the ``BLOCK``."""
    whole = F.when(F.col("same"), F.col("fa") * (F.col("fa") - 1) / (1 if ordered else 2)).otherwise(F.col("fa") * F.col("fb")).cast("long")
    block = F.least(F.lit(float(1 << 50)), F.ceil(F.lit(float(BLOCK)) / F.col("p"))).cast("long")
    cells = cells.where("p > 0").withColumns({"whole": whole, "block": block}).where("whole > 0")
    cells = cells.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("whole") - 1) / F.col("block")))))
    cells = cells.withColumn("sample_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    columns = ["sample_id", "ca", "cb", "fa", "fb", "same", "k", "whole", "block", "p", *extra]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.random.Philox(key=seed & (2**63 - 1))
        rng, at = np.random.Generator(bits), bits.state
        for rows in batches:
            parts, counts, first, held = [], [], 0, 0
            for sample_id, ca, cb, fa, fb, same, k, total, block, p in zip(*(rows.column(j).to_pylist() for j in range(10))):
                # A stream of its own by its counter, which takes a tenth of the time of a new generator.
                at["state"]["counter"][:] = 0, k, ca << 32 | cb, sample_id
                bits.state = at
                size = min(block, total - k * block)
                number = rng.choice(size, rng.binomial(size, min(p, 1.0)), replace=False, shuffle=False) + k * block
                if not same:
                    a, b = np.divmod(number, int(fb))
                elif ordered:
                    a, b = np.divmod(number, int(fa) - 1)
                    b = b + (b >= a)
                else:
                    a, b = unordered(number)
                parts.append((a, b))
                counts.append(len(number))
                held += len(number)
                if held >= BLOCK or first + len(counts) == rows.num_rows:
                    if held:
                        here = pa.array(first + np.repeat(np.arange(len(counts)), counts))
                        ra, rb = (pa.array(np.concatenate([x[j] for x in parts]).astype(np.int64)) for j in (0, 1))
                        kept = {c: rows.column(j).take(here) for j, c in enumerate(columns) if c in ("sample_id", "ca", "cb", *extra)}
                        yield pa.RecordBatch.from_arrays([*kept.values(), ra, rb], names=[*kept, "ra", "rb"])
                    parts, counts, first, held = [], [], first + len(counts), 0

    schema = "sample_id long, ca int, cb int, " + "".join(f"{c} double, " for c in extra) + "ra long, rb long"
    return cells.select(*columns).repartition(tasks, F.xxhash64("ca", "cb", "k", "sample_id")).mapInArrow(draw, schema)


def sample(model: Model, n: int = 1, seed: int = 0) -> DataFrame:
    """sample_id, src, dst and, for weighted models, w (undirected: src < dst; bipartite: bottom, top)."""
    spark, kind, m = model.sequence.sparkSession, model.kernel, model.pairs
    if n < 1:
        raise ValueError("one sample or more")
    bi = isinstance(model, BiCM)
    if bi:
        top = model.problem.top
        rows, cols = np.flatnonzero(~top), np.flatnonzero(top)
    else:
        rows = cols = np.arange(len(model.f))
    reciprocal = kind in (kernels.RBCM, kernels.CRWCM)
    ordered = model.problem.directed and not reciprocal and not bi
    with np.errstate(invalid="ignore", divide="ignore"):
        if reciprocal:
            cell = {"p": m["p_fwd"] + m["p_bwd"] + m["p_rec"], "fwd": m["p_fwd"], "bwd": m["p_bwd"]}
            if kind is kernels.CRWCM:
                one, two = m["p_fwd"] / m["w_fwd"], m["p_rec"] / m["w_rec"]
                cell |= {"one": one, "one_back": one.T, "two": two, "two_back": two.T}
        else:
            cell = {"p": m["p"]} | ({"mean": m["p"] / m["w"]} if model.weighted else {})
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(rows)), np.arange(len(cols)), indexing="ij"))
    use = np.ones(len(i), bool) if ordered or bi else i <= j
    i, j = i[use], j[use]
    frame = pd.DataFrame({"ca": rows[i] + 1, "cb": cols[j] + 1, "fa": model.f[rows[i]], "fb": model.f[cols[j]], "same": rows[i] == cols[j]} | {c: v[i, j] for c, v in cell.items()})
    extra = [c for c in cell if c != "p"] + ["p"] * reciprocal
    cells = spark.createDataFrame(frame[frame.p > 0], "ca int, cb int, fa double, fb double, same boolean, " + ", ".join(f"{c} double" for c in cell))
    if reciprocal:
        cells, extra = cells.withColumn("any", F.col("p")), [*extra[:-1], "any"]
    expected = float((frame.p.clip(upper=1) * frame.fa * frame.fb * np.where(frame.same & (not ordered), 0.5, 1)).sum())
    links = drawn(cells, extra, ordered, n, seed, 1 + int(n * expected / LINKS) + int(n * len(frame) / CELLS))
    at = numbered(model.members)
    links = links.join(at.toDF("i", "ca", "ra"), ["ca", "ra"]).join(at.toDF("j", "cb", "rb"), ["cb", "rb"])
    if bi:
        return links.select("sample_id", F.col("i").alias("bottom"), F.col("j").alias("top"))
    if reciprocal:
        u = uniform(seed, F.col("sample_id"), F.col("i"), F.col("j"), F.lit(0)) * F.col("any")
        ends: list[Column] = [F.col("i").alias("src"), F.col("j").alias("dst")], [F.col("j").alias("src"), F.col("i").alias("dst")]
        rates = {x: (F.col(x) if kind is kernels.CRWCM else F.lit(0.0)).alias("rate") for x in ("one", "one_back", "two", "two_back")}
        link = lambda way, rate: F.struct(*ends[way], rates[rate])
        state = F.when(u < F.col("fwd"), F.array(link(0, "one"))).when(u < F.col("fwd") + F.col("bwd"), F.array(link(1, "one_back"))).otherwise(F.array(link(0, "two"), link(1, "two_back")))
        out = links.select("sample_id", F.explode(state).alias("l")).select("sample_id", "l.src", "l.dst", "l.rate")
        if kind is kernels.RBCM:
            return out.drop("rate")
        v = uniform(seed, F.col("sample_id"), F.col("src"), F.col("dst"), F.lit(1))
        return out.select("sample_id", "src", "dst", exponential(v, F.col("rate")).alias("w"))
    src, dst = (F.col("i"), F.col("j")) if ordered else (F.least("i", "j"), F.greatest("i", "j"))
    out = links.select("sample_id", src.alias("src"), dst.alias("dst"), *(["mean"] if model.weighted else []))
    if not model.weighted:
        return out
    v = uniform(seed, F.col("sample_id"), F.col("src"), F.col("dst"), F.lit(1))
    # Whole-number models: the mean weight of a link is w / p = 1 / (1 - y).  Rates: the mean is 1 / rate.
    w = geometric(v, 1 - F.col("mean")) if kind in (kernels.UECM, kernels.DECM) else exponential(v, F.col("mean"))
    return out.select("sample_id", "src", "dst", w.alias("w"))


def zscores(observed: DataFrame, samples: DataFrame, metric: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """key, obs, mu, sigma, z.  ``metric`` maps links with ``sample_id`` to sample_id, key, value; ``observed`` are the real
    links.  Samples without a row for a key count as 0.  z is null where sigma is 0."""
    n = samples.select("sample_id").distinct().count()
    if n < 2:
        raise ValueError("two samples or more are needed")
    cols = [c for c in samples.columns if c != "sample_id"]
    obs = metric(observed.select(F.lit(-1).cast("long").alias("sample_id"), *cols)).select("key", F.col("value").alias("obs"))
    s = metric(samples).groupBy("key").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    mu = F.coalesce("s", F.lit(0.0)) / n
    var = F.greatest((F.coalesce("q", F.lit(0.0)) - n * mu * mu) / (n - 1), F.lit(0.0))
    out = obs.join(s, "key", "full").select("key", F.coalesce("obs", F.lit(0.0)).alias("obs"), mu.alias("mu"), F.sqrt(var).alias("sigma"))
    return out.withColumn("z", F.when(F.col("sigma") > 0, (F.col("obs") - F.col("mu")) / F.col("sigma")))


def ensemble_zscores(model: Model, metric: Callable[[DataFrame], DataFrame], n: int = 500, seed: int = 0) -> DataFrame:
    if n < 2:
        raise ValueError("two samples or more are needed")
    if model.graph is None:
        raise ValueError("the model has no graph to compare with")
    edges = model.graph.edges
    return zscores(edges, sample(model, n, seed), metric)
