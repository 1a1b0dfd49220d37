"""Kernels of more classes than one process can pair: the same equations, with the sums over class pairs made by Spark tasks.

The driver holds a few numbers a class (its constraints and parameters); the fitnesses go out as one broadcast, of
``FIELDS_BYTES`` at most; each task pairs some rows with all classes, ``CELLS`` cells at a time, and returns its rows' sums.  A
step takes work in proportion to the square of the classes, spread over the cluster, and memory in proportion to the classes.  A
lost task is run again with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from . import kernels

Array = np.ndarray
#: Cells of a block: what a task holds of a matrix of class pairs at one time.
CELLS = 1 << 20
#: Largest broadcast of fitnesses.
FIELDS_BYTES = 1 << 30


class Blocks(kernels.Kernel):
    """``inner`` with its sums made in blocks.  ``binary``: for conditional models, the fitnesses of the links."""

    def __init__(self, inner: kernels.Kernel, spark: SparkSession, binary: list[Array] | None = None):
        self.__dict__.update(inner.__dict__)
        self.inner, self.spark, self.binary_fields = inner, spark, list(binary or [])
        self.channels, self.directed, self.rates, self.per_node = inner.channels, inner.directed, inner.rates, inner.per_node
        self.method = "L-BFGS" if inner.method == "Newton" else inner.method
        self.split, self.start, self.information = inner.split, inner.start, inner.information
        if 8 * self.k * (len(self.channels) + len(self.binary_fields) + 2) > FIELDS_BYTES:
            raise ValueError(f"{self.k} distinct constraint tuples: their fitnesses are larger than FIELDS_BYTES = {FIELDS_BYTES}")

    def expected(self, u: Array) -> Array:
        return self._run(u, False).T.ravel()

    def loglikelihood(self, u: Array) -> float:
        total = float(self.f @ self._run(u, True)[:, 0])
        return self.linear(u) + (total / 2 if self.inner.halved else total)

    def pairs(self, u: Array) -> dict[str, Array]:
        raise ValueError(f"{self.k} classes: class pairs are not made into matrices; parameters, expected sequences, likelihood and criteria are there")

    def _run(self, u: Array, logs: bool) -> Array:
        """For each class the sums over partners: of its constraints, or of what the likelihood sums."""
        k, width = self.k, 1 if logs else len(self.channels)
        step = max(1, CELLS // k)
        blocks = -(-k // step)
        fields = [*self.binary_fields, *self.split(u)]
        imaginary = np.iscomplexobj(u)
        sent = self.spark.sparkContext.broadcast((type(self.inner), fields, self.f))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kernel, fields, f = sent.value
            for batch in batches:
                for b in batch.column(0).to_pylist():
                    lo, hi = b * step, min(k, (b + 1) * step)
                    rows, own = [x[lo:hi] for x in fields], np.arange(hi - lo)
                    with np.errstate(all="ignore"):
                        parts = kernel.cross_log(rows, fields) if logs else kernel.cross(rows, fields)
                    for m in parts:  # A class of one node has no pair of its own.
                        m[own, lo + own] = np.where(f[lo:hi] == 1, 0, m[own, lo + own])
                    out = [m @ f - m[own, lo + own] for m in parts]
                    out = [x for m in out for x in ((m.real.copy(), m.imag.copy()) if imaginary else (m,))]
                    yield pa.RecordBatch.from_arrays([pa.array(lo + own), *map(pa.array, out)], names=["at", *[f"v{c}" for c in range(len(out))]])

        schema = "at long, " + ", ".join(f"v{c} double" for c in range(width * (1 + imaginary)))
        try:
            tasks = min(blocks, 4 * self.spark.sparkContext.defaultParallelism)
            got = self.spark.range(0, blocks, 1, tasks).mapInArrow(sums, schema).toPandas().sort_values("at")
        finally:
            sent.destroy()
        got = got.drop(columns="at").to_numpy()
        return got[:, ::2] + 1j * got[:, 1::2] if imaginary else got
