"""Models on Spark: constraints are reduced to classes by DataFrame aggregates, the likelihood is solved on the driver over the
class table, and parameters go back as DataFrames.

Only the class table reaches the driver.  It does not grow with the nodes but with the distinct constraint tuples.  Up to
``MAX_CLASSES`` of them the driver pairs classes as matrices; beyond, Spark tasks make the same sums (``blocks.py``), up to the
bound that ``blocks.FIELDS_BYTES`` gives.
"""

from __future__ import annotations

import math
import warnings
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConvergenceError, DomainError, ModelWarning, StateError
from ..graph import Bipartite, Graph, stored
from ..operators import bipartite as bip
from ..operators import sequences as seq
from . import blocks, kernels, solvers
from . import expectations as ex

MAX_CLASSES = 6000
METHODS = ("fixedpoint", "BFGS", "L-BFGS", "LBFGS", "Newton")


def warn(text: str) -> None:
    warnings.warn(text, ModelWarning, stacklevel=4)


class Model:
    """``sequence``: id and one column for each constraint, a row for each node."""

    kernel: type[kernels.Kernel]
    keys: tuple[str, ...]
    weighted = False

    def __init__(self, sequence: DataFrame, graph: Graph | None = None):
        self.graph = graph
        # Checks, classes and members read it, each from the tables' start if it were not stored.
        self.sequence = stored(sequence.select("id", *self.keys), "sequence")
        self.status = {"params_computed": False}
        self._check()
        c = self.class_rows
        self.f = c["f"].to_numpy().astype(float)
        self.columns = {k: c[k].to_numpy().astype(float) for k in self.keys}
        self.n_nodes = int(self.f.sum())
        # Whether class pairs are summed by Spark tasks instead of matrices of the driver.
        self.large = len(self.f) > MAX_CLASSES
        self.problem = self._problem()
        self.theta: np.ndarray | None = None

    # Classes
    @cached_property
    def classes(self) -> DataFrame:
        """cls, constraints, first id, f."""
        return seq.classes(self.sequence, *self.keys)

    @cached_property
    def class_rows(self):
        """The classes, at most as many as their fitnesses may fill a broadcast: a row is at least three numbers of eight bytes.

        They are counted before they are fetched; a limit on the ordered table would have each task hold an array of that length."""
        most = blocks.FIELDS_BYTES // 24
        if self.n_classes > most:
            raise ValueError(f"more than {most} distinct constraint tuples")
        return self.classes.toPandas().sort_values("cls").reset_index(drop=True)

    def spread(self, kernel: kernels.Kernel, binary: list[np.ndarray] | None = None) -> kernels.Kernel:
        """The kernel itself, or its form for many classes."""
        return blocks.Blocks(kernel, self.sequence.sparkSession, binary) if kernel.k > MAX_CLASSES else kernel

    def small(self, table: DataFrame) -> DataFrame:
        """A table of a row a class, marked for broadcast only where it is small."""
        return table if self.large else F.broadcast(table)

    @cached_property
    def members(self) -> DataFrame:
        """id, constraints, cls."""
        return seq.class_of(self.sequence, self.small(self.classes), *self.keys)

    def __len__(self) -> int:
        return len(self.f)

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.n_nodes} nodes, {len(self)} classes, compression {1 - len(self) / max(1, self.n_nodes):.1%})"

    def _problem(self) -> kernels.Kernel:
        return self.spread(self.kernel(self.columns, self.f))

    # Validation
    def _check(self) -> None:
        degree_keys = [k for k in self.keys if k.startswith("k")]
        q = self.sequence.agg(F.count("*").alias("n"), *[F.max(k).alias(f"max_{k}") for k in self.keys], *[F.min(k).alias(f"min_{k}") for k in self.keys], *[F.sum(k).alias(f"sum_{k}") for k in self.keys],
                              *[F.max(F.abs(F.col(k) - F.round(k))).alias(f"frac_{k}") for k in self.keys], *[F.sum(F.when(F.col(k).isNull(), 1).otherwise(0)).alias(f"null_{k}") for k in self.keys],
                              F.count_distinct(F.struct(*self.keys)).alias("classes")).first()
        n, self.n_classes = q["n"], q["classes"]
        if n < 2:
            raise ValueError("a model needs two nodes or more")
        if any(q[f"null_{k}"] for k in self.keys):
            raise ValueError("constraints must not be null")
        if any(q[f"min_{k}"] < 0 for k in self.keys):
            raise DomainError("constraints must not be negative")
        if any(q[f"frac_{k}"] for k in degree_keys) or (self.whole and any(q[f"frac_{k}"] for k in self.keys)):
            raise DomainError("degrees must be whole numbers" + ", strengths too" * self.whole)
        self._check_domain(q, n)
        if any(q[f"min_{k}"] == 0 for k in self.keys) and self.kernel not in (kernels.RBCM, kernels.CRWCM):
            warn("some constraints are 0: their parameters are fixed")

    whole = False

    def _check_domain(self, q, n: int) -> None:
        for k in self.keys:
            if k.startswith("k") and q[f"max_{k}"] >= n:
                raise DomainError(f"{k} must be below the number of nodes")

    # Solving
    def initial_guess(self, method: str | None = None, seed: int = 0) -> np.ndarray:
        return self.problem.start(method, seed) if method else self.problem.start()

    def solve(self, method: str | None = None, initial: str | None = None, maxiters: int = 1000, ftol: float | None = None, g_tol: float = 1e-8, memory: int = 8, seed: int = 0) -> Model:
        """``fixedpoint`` (``ftol`` bounds the last step), BFGS, L-BFGS or Newton (``g_tol`` bounds the gradient).

        Rates have a fixed point only where all are positive; where it does not converge, Newton's method solves the same equations.
        BFGS, and Newton but for rates, hold a matrix of all parameters, so more than ``MAX_CLASSES`` classes take another method."""
        method = method or self.problem.method
        if method not in METHODS:
            raise ValueError(f"unknown method {method!r}")
        if method != "fixedpoint" and ftol is not None:
            warn("ftol is for the fixed point only; use g_tol")
        if method == "fixedpoint" and self.kernel in (kernels.UECM, kernels.DECM):
            warn("the fixed point of this model is not stable; Newton's method is")
        p = self.problem
        if self.large and (method == "BFGS" or method == "Newton" and not p.rates):
            raise ValueError(f"{method} holds a matrix of all parameters; use L-BFGS or fixedpoint for {len(self)} classes")
        start = self.initial_guess(initial, seed)
        if not len(start):
            self.theta, self.iterations = start, 0
        elif p.rates and method in ("fixedpoint", "Newton"):
            self.theta, self.iterations = self._solve_rates(start, method, maxiters, ftol or 1e-8, g_tol, memory)
        elif method == "fixedpoint":
            self.theta, self.iterations = solvers.fixed_point(p.update, start, ftol or 1e-8, maxiters, memory)
        elif method == "Newton" and self.kernel in (kernels.UECM, kernels.DECM):
            self.theta, self.iterations = solvers.scaled_newton(p.value, p.gradient, p.hessian, start, (p.weight * p.flat)[p.live], g_tol, maxiters, p.reach)
        elif method == "Newton":
            self.theta, self.iterations = solvers.newton(p.value, p.gradient, p.hessian, start, g_tol, maxiters)
        else:
            self.theta, self.iterations = solvers.quasi_newton(p.value, p.gradient, start, g_tol, maxiters, None if method == "BFGS" else 20)
        if not np.isfinite(self.theta).all():
            raise ConvergenceError(method, "parameters are not finite")
        self.status["params_computed"] = True
        self.__dict__.pop("pairs", None)
        return self

    def _solve_rates(self, start: np.ndarray, method: str, maxiters: int, ftol: float, g_tol: float, memory: int) -> tuple[np.ndarray, int]:
        """The fixed point steps in the logarithms of the rates; Newton's method, which also finds negative ones, in the rates."""
        p = self.problem
        if method == "fixedpoint":
            try:
                logs, steps = solvers.fixed_point(lambda v: np.log(p.update(np.exp(v))), np.log(start), ftol, maxiters, memory, damped=False)
                return np.exp(logs), steps
            except ConvergenceError:
                warn("the fixed point did not converge (a rate may be negative): solved by Newton's method")
                start = self.initial_guess("strengths_minor")
        return solvers.convex_newton(p.value, p.gradient, start, (p.weight * p.flat)[p.live], g_tol)

    def _need(self) -> np.ndarray:
        if self.theta is None:
            raise StateError("solve the model first")
        return self.theta

    @cached_property
    def pairs(self) -> dict[str, np.ndarray]:
        """Closed forms of class pairs."""
        return self.problem.pairs(self._need())

    def parameters(self) -> DataFrame:
        """cls, f, constraints, and for each constraint its multiplier or rate; dead ones are infinite."""
        full = np.full(len(self.problem.flat), np.inf)
        u = self._need()
        full[self.problem.live] = u
        parts = np.split(full, len(self.problem.channels))
        rows = self.class_rows[["cls", "f", *self.keys]].copy()
        for name, part in zip(self.problem.channels, parts):
            rows[f"theta_{name}"] = part
        return self.sequence.sparkSession.createDataFrame(rows)

    # Expected sequences
    def expected(self) -> DataFrame:
        """cls, f, and for each constraint its observed and expected value for a node of the class."""
        e = np.split(np.real(self.problem.expected(self._need())), len(self.problem.channels))
        rows = self.class_rows[["cls", "f", *self.problem.channels]].copy()
        for name, part in zip(self.problem.channels, e):
            rows[f"expected_{name}"] = part
        return self.sequence.sparkSession.createDataFrame(rows)

    def expected_sequences(self, method: str = "reduced") -> DataFrame:
        """id and expected degree (undirected: k; directed: k_out, k_in) and strength of every node.

        ``reduced`` sums over classes; ``full`` over all pairs of nodes (``dyads``)."""
        if method not in ("reduced", "full"):
            raise ValueError(f"unknown method {method!r}")
        if method == "full":
            d = self.dyads()
            out = d.groupBy(F.col("i").alias("id")).agg(F.sum("p").alias("k_out"), *([F.sum("w").alias("s_out")] if self.weighted else []))
            if not self.problem.directed:
                return out.withColumnsRenamed({"k_out": "k", "s_out": "s"})
            back = d.groupBy(F.col("j").alias("id")).agg(F.sum("p").alias("k_in"), *([F.sum("w").alias("s_in")] if self.weighted else []))
            return out.join(back, "id")
        if self.large:
            rows = self._expected_rows()
            spark = self.sequence.sparkSession
            return self.members.select("id", "cls").join(spark.createDataFrame(rows), "cls").drop("cls")
        rows = self.class_rows[["cls"]].copy()
        sides = [("", lambda m: m)] if not self.problem.directed else [("_out", lambda m: m), ("_in", lambda m: m.T)]
        for side, turn in sides:
            rows[f"k{side}"] = kernels.others(turn(self.pairs["p"]), self.f)
            if self.weighted:
                rows[f"s{side}"] = kernels.others(turn(self.pairs["w"]), self.f)
        for state, name in (("p_fwd", "k_out_single"), ("p_bwd", "k_in_single"), ("p_rec", "k_rec")):
            if state in self.pairs:
                rows[name] = kernels.others(self.pairs[state], self.f)
        spark = self.sequence.sparkSession
        return self.members.select("id", "cls").join(F.broadcast(spark.createDataFrame(rows)), "cls").drop("cls")

    def _expected_rows(self):
        """cls and the columns of ``expected_sequences`` from the sums of the constraints alone, without class pairs."""
        rows = self.class_rows[["cls"]].copy()
        for name, part in self._sums().items():
            rows[name] = part
        if self.kernel in (kernels.RBCM, kernels.CRWCM):
            rows = rows.assign(k_out_single=rows.k_out, k_in_single=rows.k_in, k_out=rows.k_out + rows.k_rec, k_in=rows.k_in + rows.k_rec)
        if self.kernel is kernels.CRWCM:
            rows = rows.assign(s_out=rows.s_out + rows.s_rec_out, s_in=rows.s_in + rows.s_rec_in).drop(columns=["s_rec_out", "s_rec_in"])
        return rows

    def _sums(self) -> dict[str, np.ndarray]:
        """The expected constraints of a node of each class."""
        return dict(zip(self.problem.channels, np.split(self.problem.expected(self._need()), len(self.problem.channels))))

    def constraint_residual(self, relative: bool = False) -> float:
        """Largest difference of an expected and an observed constraint; relative ones leave out constraints of 0."""
        miss = np.abs(np.real(self.problem.expected(self._need())) - self.problem.flat)
        if relative:
            live = self.problem.live
            return float((miss[live] / self.problem.flat[live]).max())
        return float(miss.max())

    # Likelihood
    def loglikelihood(self) -> float:
        return self.problem.loglikelihood(self._need())

    def AIC(self) -> float:
        k, n = self.problem.information()
        if n / k < 40:
            warn("few observations for each parameter: prefer AICc")
        return 2 * k - 2 * self.loglikelihood()

    def AICc(self) -> float:
        k, n = self.problem.information()
        return 2 * k - 2 * self.loglikelihood() + 2 * k * (k + 1) / (n - k - 1)

    def BIC(self) -> float:
        k, n = self.problem.information()
        return k * math.log(n) - 2 * self.loglikelihood()

    # Pairs of nodes
    def pair_table(self) -> DataFrame:
        """Class pairs as rows: ci, cj and the closed forms.  Bounded by MAX_CLASSES squared."""
        import pandas as pd

        k = len(self.f)
        i, j = np.divmod(np.arange(k * k), k)
        return self.sequence.sparkSession.createDataFrame(pd.DataFrame({"ci": i + 1, "cj": j + 1} | {name: np.ravel(m) for name, m in self.pairs.items()}))

    def dyads(self) -> DataFrame:
        """i, j and the closed forms of every ordered pair of distinct nodes (what a dense matrix would hold).  Lazy, in
        proportion to the square of the nodes; metrics by classes do not need it."""
        a = self.members.select(F.col("id").alias("i"), F.col("cls").alias("ci"))
        b = self.members.select(F.col("id").alias("j"), F.col("cls").alias("cj"))
        return a.crossJoin(b).where("i <> j").join(self.pair_table(), ["ci", "cj"]).drop("ci", "cj")

    def probability(self, i: int, j: int) -> dict[str, float]:
        """The closed forms of one ordered pair of nodes."""
        at = {r["id"]: r["cls"] - 1 for r in self.members.where(F.col("id").isin(i, j)).collect()}
        if i not in at or j not in at:
            raise ValueError("no such node")
        return {name: 0.0 if i == j else float(m[at[i], at[j]]) for name, m in self.pairs.items()}

    # Metrics
    def expectation(self, metric: str):
        """Expected value of a metric on the class pairs: edges, wedges, triangles, squares, annd, reciprocity,
        weighted_reciprocity, motifs, fluxes."""
        p, f = self.pairs["p"], self.f
        both = self.pairs.get("p_rec")
        if metric in ("triangles", "wedges", "squares", "annd") and self.problem.directed:
            raise ValueError(f"{metric} is for undirected models")
        if metric in ("reciprocity", "weighted_reciprocity", "motifs", "fluxes") and not self.problem.directed:
            raise ValueError(f"{metric} is for directed models")
        if metric in ("weighted_reciprocity", "fluxes") and not self.weighted:
            raise ValueError(f"{metric} needs a weighted model")
        return {
            "edges": lambda: ex.edges(p, f, self.problem.directed), "wedges": lambda: ex.wedges(p, f), "triangles": lambda: ex.triangles(p, f), "squares": lambda: ex.squares(p, f),
            "annd": lambda: ex.neighbour_degree(p, f), "reciprocity": lambda: ex.reciprocity(p, f, both),
            "weighted_reciprocity": lambda: ex.weighted_reciprocity(self.pairs["w"], p, f, self.pairs.get("w_rec")),
            "motifs": lambda: ex.motifs(self.pairs, f), "fluxes": lambda: ex.motif_fluxes(self.pairs, f),
        }[metric]()

    def sigma(self, metric: str, layer: str = "binary") -> float:
        """Delta-method deviation of a metric with a known gradient (edges, links, wedges, triangles, reciprocity, M1..M13)."""
        if layer not in ("binary", "weighted") or (layer == "weighted" and not self.weighted):
            raise ValueError(f"unknown layer {layer!r}")
        w = layer == "weighted"
        g = ex.gradient(metric, self.pairs["w" if w else "p"], self.f)
        return ex.deviation(g, self.pairs["var_w" if w else "var"], self.pairs["cov_w" if w else "cov"], self.f)

    def sigma_of_gradient(self, gradient: DataFrame, layer: str = "binary") -> DataFrame:
        """The same for any metric, from its gradient as rows i, j, g: one join with the reversed pair."""
        v, c = ("var_w", "cov_w") if layer == "weighted" else ("var", "cov")
        d = self.dyads().select("i", "j", F.col(v).alias("v"), F.col(c).alias("c")).join(gradient, ["i", "j"])
        d = d.join(gradient.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("g").alias("gt")), ["i", "j"], "left")
        return d.agg(F.sqrt(F.sum(F.col("v") * F.col("g") ** 2 + F.col("c") * F.col("g") * F.coalesce("gt", F.lit(0.0)))).alias("sigma"))


def _undirected(graph: Graph, name: str) -> Graph:
    if graph.directed:
        warn(f"{name} is for undirected graphs: directions are dropped")
        return graph.undirected()
    return graph


def _directed(graph: Graph, name: str) -> Graph:
    if not graph.directed:
        warn(f"{name} is for directed graphs: every edge counts both ways")
        return Graph(graph.nodes, graph.both, True)
    return graph


class UBCM(Model):
    kernel, keys = kernels.UBCM, ("k",)

    @classmethod
    def from_graph(cls, graph: Graph) -> UBCM:
        if graph.weighted:
            warn("weights are not used")
        graph = _undirected(graph, cls.__name__)
        return cls(seq.degrees(graph), graph)


class DBCM(Model):
    kernel, keys = kernels.DBCM, ("k_out", "k_in")

    @classmethod
    def from_graph(cls, graph: Graph) -> DBCM:
        if graph.weighted:
            warn("weights are not used")
        graph = _directed(graph, cls.__name__)
        return cls(seq.degrees(graph), graph)


class RBCM(Model):
    kernel, keys = kernels.RBCM, ("k_out", "k_in", "k_rec")

    @classmethod
    def from_graph(cls, graph: Graph) -> RBCM:
        if graph.weighted:
            warn("weights are not used")
        graph = _directed(graph, cls.__name__)
        return cls(seq.reciprocal_degrees(graph), graph)

    def _check_domain(self, q, n):
        if q["sum_k_out"] != q["sum_k_in"]:
            raise DomainError("out- and in-degrees have different sums")
        if int(q["sum_k_rec"]) % 2:
            raise DomainError("the sum of reciprocated degrees is odd")
        top = self.sequence.agg(F.max(F.col("k_out") + F.col("k_in") + F.col("k_rec"))).first()[0]
        if top >= n:
            raise DomainError("the degrees of a node must add up to less than the number of nodes")
        if not q["sum_k_rec"]:
            warn("no link is reciprocated")
        if not q["sum_k_out"]:
            warn("all links are reciprocated")


class UECM(Model):
    kernel, keys, weighted, whole = kernels.UECM, ("k", "s"), True, True

    @classmethod
    def from_graph(cls, graph: Graph) -> UECM:
        graph = _undirected(graph, cls.__name__)
        return cls(seq.degrees(graph).join(seq.strengths(graph), "id"), graph)

    def _check_domain(self, q, n):
        super()._check_domain(q, n)
        if self.sequence.where("(k = 0) <> (s = 0)").head(1):
            raise DomainError("a degree is 0 where the strength is not, or the other way round")
        if self.sequence.where("s < k").head(1):
            warn("a strength is below its degree: no solution")


class DECM(Model):
    kernel, keys, weighted, whole = kernels.DECM, ("k_out", "k_in", "s_out", "s_in"), True, True

    @classmethod
    def from_graph(cls, graph: Graph) -> DECM:
        graph = _directed(graph, cls.__name__)
        return cls(seq.degrees(graph).join(seq.strengths(graph).drop("s"), "id"), graph)

    def _check_domain(self, q, n):
        super()._check_domain(q, n)
        if self.sequence.where("(k_out = 0) <> (s_out = 0) or (k_in = 0) <> (s_in = 0)").head(1):
            warn("a degree is 0 where the strength is not, or the other way round")
        if self.sequence.where("s_out < k_out or s_in < k_in").head(1):
            warn("a strength is below its degree: no solution")


class _TwoStep(Model):
    """A binary model for the links, then rates for the weights given the links."""

    weighted = True
    binary: type[Model]

    def __init__(self, sequence: DataFrame, graph: Graph | None = None):
        super().__init__(sequence, graph)
        self.status["conditional_params_computed"] = False

    def _problem(self):
        return None

    def solve(self, method=None, initial=None, maxiters=1000, ftol=None, g_tol=1e-8, memory=8, seed=0, conditional: dict | None = None) -> Model:
        """``conditional`` holds the options of the binary step."""
        # The links depend on the degrees alone: their model has a class for each distinct tuple of degrees.
        degrees, self.first_class = np.unique(np.stack([self.columns[k] for k in self.binary.keys]), axis=1, return_inverse=True)
        first = self.spread(self.binary.kernel(dict(zip(self.binary.keys, degrees)), np.bincount(self.first_class, self.f)))
        options = {"ftol": 1e-8, "maxiters": 1000, "memory": 8} | {k: v for k, v in (conditional or {}).items() if k in ("ftol", "maxiters", "memory")}
        start = first.start((conditional or {}).get("initial", "degrees"))
        u = solvers.fixed_point(first.update, start, **options)[0] if (conditional or {}).get("method", "fixedpoint") == "fixedpoint" else solvers.quasi_newton(first.value, first.gradient, start)[0]
        self.first, self.first_theta = first, u
        self.status["conditional_params_computed"] = True
        if self.large:
            self.problem = self.spread(self.kernel(self.columns, self.f, None), [x[self.first_class] for x in first.split(u)])
        else:
            pairs = {name: m[np.ix_(self.first_class, self.first_class)] for name, m in first.pairs(u).items()}
            self.problem = self.kernel(self.columns, self.f, pairs["p"], pairs)
        for ks, kk in self.twins:
            if ((self.columns[ks] == 0) != (self.columns[kk] == 0)).any():
                raise DomainError("a strength is 0 where the degree is not, or the other way round")
        return super().solve(method, initial, maxiters, ftol, g_tol, memory, seed)

    def _sums(self):
        binary = np.split(self.first.expected(self.first_theta), len(self.first.channels))
        return {k: e[self.first_class] for k, e in zip(self.first.channels, binary)} | super()._sums()


class CReM(_TwoStep):
    kernel, binary, keys, twins = kernels.CReM, UBCM, ("k", "s"), (("s", "k"),)

    @classmethod
    def from_graph(cls, graph: Graph) -> CReM:
        graph = _undirected(graph, cls.__name__)
        return cls(seq.degrees(graph).join(seq.strengths(graph), "id"), graph)


class DCReM(_TwoStep):
    kernel, binary, keys, twins = kernels.DCReM, DBCM, ("k_out", "k_in", "s_out", "s_in"), (("s_out", "k_out"), ("s_in", "k_in"))

    @classmethod
    def from_graph(cls, graph: Graph) -> DCReM:
        graph = _directed(graph, cls.__name__)
        return cls(seq.degrees(graph).join(seq.strengths(graph).drop("s"), "id"), graph)


class CRWCM(_TwoStep):
    kernel, binary = kernels.CRWCM, RBCM
    keys = ("k_out", "k_in", "k_rec", "s_out", "s_in", "s_rec_out", "s_rec_in")
    twins = (("s_out", "k_out"), ("s_in", "k_in"), ("s_rec_out", "k_rec"), ("s_rec_in", "k_rec"))

    @classmethod
    def from_graph(cls, graph: Graph) -> CRWCM:
        graph = _directed(graph, cls.__name__)
        return cls(seq.reciprocal_degrees(graph).join(seq.reciprocal_strengths(graph), "id"), graph)

    _check_domain = RBCM._check_domain


class BiCM(Model):
    """``sequence``: id, layer (bottom or top), k."""

    kernel, keys = kernels.BiCM, ("layer", "k")

    def __init__(self, sequence: DataFrame, graph: Bipartite | None = None):
        super().__init__(sequence.select("id", F.when(F.col("layer").isin("bottom", "⊥"), 0).otherwise(1).alias("layer"), "k"), graph)

    @classmethod
    def from_graph(cls, graph: Bipartite) -> BiCM:
        both = [bip.degrees(graph, x).withColumn("layer", F.lit(x)) for x in ("bottom", "top")]
        return cls(both[0].union(both[1]), graph)

    def _problem(self):
        return self.spread(kernels.BiCM({"k": self.columns["k"]}, self.f, self.columns["layer"] == 1), [self.columns["layer"]])

    def _check_domain(self, q, n):
        s = {r["layer"]: r for r in self.sequence.groupBy("layer").agg(F.count("*").alias("n"), F.max("k").alias("top"), F.sum("k").alias("links")).collect()}
        if set(s) != {0, 1}:
            raise ValueError("both layers need nodes")
        if s[0]["top"] >= s[1]["n"] or s[1]["top"] >= s[0]["n"]:
            raise DomainError("a node is linked to the whole opposite layer")
        if s[0]["links"] != s[1]["links"]:
            raise DomainError("the degrees of the layers have different sums")

    def sides(self, layer: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chances (classes of the layer x classes of the opposite one) and multiplicities of both."""
        layer = {"⊥": "bottom", "⊤": "top"}.get(layer, layer)
        if layer not in ("bottom", "top"):
            raise ValueError(f"unknown layer {layer!r}")
        p, top = self.pairs["p"], self.problem.top
        return (p, self.f[~top], self.f[top]) if layer == "bottom" else (p.T, self.f[top], self.f[~top])

    def pair_table(self) -> DataFrame:
        import pandas as pd

        top = np.flatnonzero(self.problem.top) + 1
        low = np.flatnonzero(~self.problem.top) + 1
        i, j = np.divmod(np.arange(len(low) * len(top)), len(top))
        return self.sequence.sparkSession.createDataFrame(pd.DataFrame({"ci": low[i], "cj": top[j]} | {name: np.ravel(m) for name, m in self.pairs.items()}))

    def dyads(self) -> DataFrame:
        """i (bottom), j (top) and the closed forms."""
        a = self.members.where("layer = 0").select(F.col("id").alias("i"), F.col("cls").alias("ci"))
        b = self.members.where("layer = 1").select(F.col("id").alias("j"), F.col("cls").alias("cj"))
        return a.crossJoin(b).join(self.pair_table(), ["ci", "cj"]).drop("ci", "cj")

    def expected_sequences(self, method: str = "reduced") -> DataFrame:
        if method == "full":
            d = self.dyads()
            return d.groupBy(F.col("i").alias("id")).agg(F.sum("p").alias("k")).withColumn("layer", F.lit("bottom")).union(d.groupBy(F.col("j").alias("id")).agg(F.sum("p").alias("k")).withColumn("layer", F.lit("top")))
        e = self.expected().select("cls", F.col("expected_k").alias("e"))
        return self.members.join(self.small(e), "cls").select("id", F.col("e").alias("k"), F.when(F.col("layer") == 0, "bottom").otherwise("top").alias("layer"))

    def sigma_v_motifs(self, layer: str = "bottom") -> float:
        """Delta-method deviation of the summed shared neighbours of a layer."""
        p, f, g = self.sides(layer)
        s = f @ p
        grad = s[None, :] - p
        return float(np.sqrt(f @ (p * (1 - p) * grad**2) @ g))

    def probability(self, i: int, j: int) -> dict[str, float]:
        """``i`` of the bottom, ``j`` of the top layer."""
        a = self.members.where((F.col("layer") == 0) & (F.col("id") == i)).first()
        b = self.members.where((F.col("layer") == 1) & (F.col("id") == j)).first()
        if a is None or b is None:
            raise ValueError("no such node")
        row, col = int((~self.problem.top[: a["cls"] - 1]).sum()), int(self.problem.top[: b["cls"] - 1].sum())
        return {name: float(m[row, col]) for name, m in self.pairs.items()}
