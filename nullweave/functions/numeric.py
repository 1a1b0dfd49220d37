"""Column expressions that Spark has no function for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log_nan(x: Column) -> Column:
    """Natural logarithm; NaN where it is not defined (Spark's is null)."""
    return F.when(x > 0, F.log(x)).when(x.isNotNull(), F.lit(float("nan")))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def log1pexpsum(a: Column, b: Column, c: Column) -> Column:
    """log(1 + e^a + e^b + e^c) without overflow."""
    m = F.greatest(F.lit(0.0), a, b, c)
    return m + F.log(F.exp(-m) + F.exp(a - m) + F.exp(b - m) + F.exp(c - m))


def binomial(u: Column, n: int) -> Column:
    """C(u, n) as a polynomial in u; 0 where u < n."""
    out = F.lit(1.0)
    for k in range(n):
        out = out * (u - k) / (k + 1)
    return F.when(u < n, F.lit(0.0)).otherwise(out)


def harmonic_difference(u: Column, n: int) -> Column:
    """1/u + 1/(u-1) + ... of n terms; 0 where u < n."""
    return F.when(u < n, F.lit(0.0)).otherwise(sum((1 / (u - k) for k in range(n)), F.lit(0.0)))


def poisson_tail(k: Column, rate: Column) -> Column:
    """P(X >= k), by the recurrence of the terms below k; not below 0."""
    step = lambda s, i: F.struct((s["term"] * rate / i).alias("term"), (s["total"] + s["term"] * rate / i).alias("total"))
    first = F.struct(F.exp(-rate).alias("term"), F.exp(-rate).alias("total"))
    below = F.aggregate(F.sequence(F.lit(1), F.greatest(k - 1, F.lit(1)).cast("int")), first, step)["total"]
    total = F.when(k <= 0, F.lit(0.0)).when(k == 1, F.exp(-rate)).otherwise(below)
    return F.greatest(1 - total, F.lit(0.0))


def poisson_binomial(p: Column) -> Column:
    """The distribution of the number of successes, as an array, from an array of chances."""
    zero = F.array(F.lit(0.0))
    step = lambda d, q: F.zip_with(F.concat(d, zero), F.concat(zero, d), lambda a, b: a * (1 - q) + b * q)
    return F.aggregate(p, F.array(F.lit(1.0)), step)


def poisson_binomial_tail(k: Column, p: Column) -> Column:
    """P(X >= k) for an array of chances: 1 less the k chances below, so only k numbers are carried."""
    zero = F.array(F.lit(0.0))
    size = F.greatest(k, F.lit(1)).cast("int")
    start = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), size - 1))
    step = lambda d, q: F.zip_with(d, F.slice(F.concat(zero, d), F.lit(1), size), lambda a, b: a * (1 - q) + b * q)
    below = F.aggregate(F.aggregate(p, start, step), F.lit(0.0), lambda a, b: a + b)
    return F.when(k <= 0, F.lit(1.0)).when(k > F.size(p), F.lit(0.0)).otherwise(F.greatest(1 - below, F.lit(0.0)))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) that depends on seed and keys only, not on how rows are laid out."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11)
    return (bits + F.lit(0.5)) / F.lit(float(2**53))


def geometric(u: Column, q: Column) -> Column:
    """1, 2, ... with P(w) = (1 - q) q^(w - 1), by inversion."""
    return F.when(q > 0, 1 + F.floor(F.log(u) / F.log(q))).otherwise(F.lit(1)).cast("long")


def exponential(u: Column, rate: Column) -> Column:
    return -F.log(u) / rate


METHODS = ("bh", "by", "bonferroni", "holm", "none")


def adjusted(df: DataFrame, p: str = "p", out: str = "p_adjusted", method: str = "bh", slices: int = 256) -> DataFrame:
    """``df`` with p-values adjusted for multiple testing over all of its rows.

    Only distinct p-values and how often they occur are ordered.  Ranks come from two levels: the distinct values are cut
    into ``slices`` at their quantiles, whose sums (one row each) are accumulated first, so each task orders about an
    equal part of them, whatever their distribution."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if method == "none":
        return df.withColumn(out, F.col(p))
    values = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    cuts = values.agg(F.expr(f"percentile_approx(_p, array({', '.join(str(k / slices) for k in range(1, slices))}), 10000)").alias("_cuts"))
    values = values.crossJoin(F.broadcast(cuts)).withColumn("_s", F.size(F.filter("_cuts", lambda c: c < F.col("_p")))).drop("_cuts")
    sums = values.groupBy("_s").agg(F.sum("_n").alias("_m"))
    order = Window.orderBy("_s")
    sums = sums.select("_s", (F.sum("_m").over(order) - F.col("_m")).alias("_before"), F.sum("_m").over(Window.partitionBy()).alias("_total"))
    inner = Window.partitionBy("_s").orderBy("_p")
    ranked = values.join(F.broadcast(sums), "_s").withColumn("_rank", F.col("_before") + F.sum("_n").over(inner))
    m, rank, q = F.col("_total"), F.col("_rank"), F.col("_p")
    if method == "bonferroni":
        done = ranked.withColumn(out, F.least(q * m, F.lit(1.0)))
    else:
        if method == "holm":  # from below: the running largest of p * (number not smaller)
            raw, agg = q * (m - rank + F.col("_n")), F.max
            scope, ends = inner, Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        else:  # from above: the running smallest of p * m / rank
            factor = harmonic(m) * m if method == "by" else m
            raw, agg = q * factor / rank, F.min
            scope, ends = Window.partitionBy("_s").orderBy(F.col("_p").desc()), Window.orderBy(F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, -1)
        ranked = ranked.withColumn("_raw", raw)
        per = ranked.groupBy("_s").agg(agg("_raw").alias("_e")).withColumn("_out", agg("_e").over(ends)).drop("_e")
        near = agg("_raw").over(scope)
        both = F.greatest(near, F.col("_out")) if method == "holm" else F.least(near, F.col("_out"))
        done = ranked.withColumn("_near", near).join(F.broadcast(per), "_s").withColumn(out, F.least(both, F.lit(1.0)))
    return df.join(done.select(F.col("_p"), out), F.col(p) == F.col("_p"), "left").drop("_p")


def harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m: exactly up to 10,000 terms, else by its expansion."""
    exact = F.aggregate(F.sequence(F.lit(1), F.least(m, F.lit(10000)).cast("int")), F.lit(0.0), lambda a, k: a + 1 / k)
    return F.when(m <= 10000, exact).otherwise(F.log(m) + 0.5772156649015329 + 1 / (2 * m) - 1 / (12 * m * m))
