"""The nine models on class arrays.

A class is a distinct tuple of constraints with a multiplicity f.  A kernel knows, from the parameters of the classes, the
expected constraints of a node of each class, the log-likelihood, and the closed forms of each pair of classes.  A node pairs
with every other node, so sums over partners weigh class s by f[s] and leave out the node itself once.

Parameters: binary and whole-number models have multipliers theta with fitness exp(-theta); a constraint of 0 has
fitness 0 exactly ("dead").  Conditional models have rates, one for each live strength; one may be negative, the sum of a pair
of nodes that may be linked may not.
"""

from __future__ import annotations

import numpy as np

Array = np.ndarray


def others(m: Array, f: Array) -> Array:
    """Row sums over partners."""
    return m @ f - np.diagonal(m)


def pair_sum(m: Array, f: Array, directed: bool) -> float:
    total = f @ m @ f - f @ np.diagonal(m)
    return float(np.real(total if directed else total / 2))


class Kernel:
    channels: tuple[str, ...] = ()
    directed = True
    rates = False  # rates instead of multipliers
    method = "fixedpoint"
    # Number of parameters for each node, and whether a pair counts once or twice, for information criteria.
    per_node = 1
    halved = True  # the likelihood takes each unordered pair once

    def __init__(self, c: dict[str, Array], f: Array):
        self.c = {k: np.asarray(c[k], float) for k in self.channels}
        self.f = np.asarray(f, float)
        self.k = len(self.f)
        self.n = float(self.f.sum())
        self.flat = np.concatenate([self.c[k] for k in self.channels]) if self.k else np.zeros(0)
        self.live = self.flat > 0
        self.weight = np.tile(self.f, len(self.channels))

    # Fitness form: an array for each channel.
    def split(self, u: Array) -> list[Array]:
        full = np.zeros(len(self.flat), u.dtype)
        full[self.live] = u if self.rates else np.exp(-u)
        if self.rates:
            full[~self.live] = np.inf
        return np.split(full, len(self.channels))

    def logs(self, u: Array) -> list[Array]:
        """Logarithms of the fitnesses, which do not overflow where these do; dead ones are minus infinity."""
        full = np.full(len(self.flat), -np.inf)
        full[self.live] = -u
        return np.split(full, len(self.channels))

    def expected(self, u: Array) -> Array:
        return np.concatenate(self.sums(*self.split(u)))

    def sums(self, *x: Array) -> list[Array]:
        raise NotImplementedError

    @staticmethod
    def cross(a: list[Array], b: list[Array]) -> list[Array]:
        """Expected constraints of pairs, a matrix (classes ``a`` x classes ``b``) for each channel, from the fitnesses of both; for
        conditional models those of the links come first."""
        raise NotImplementedError

    @staticmethod
    def cross_log(a: list[Array], b: list[Array]) -> list[Array]:
        """The matrix that the likelihood sums over pairs."""
        raise NotImplementedError

    def update(self, u: Array) -> Array:
        e = self.expected(u)[self.live]
        if self.rates:
            return u * e / self.flat[self.live]
        return u + np.log(e) - np.log(self.flat[self.live])

    def gradient(self, u: Array) -> Array:
        """Of the negative log-likelihood, by u."""
        return (self.weight * (self.flat - self.expected(u)))[self.live]

    def value(self, u: Array) -> float:
        return -self.loglikelihood(u)

    def linear(self, u: Array) -> float:
        return float(-(self.weight * self.flat)[self.live] @ u)

    def loglikelihood(self, u: Array) -> float:
        raise NotImplementedError

    def hessian(self, u: Array) -> Array:
        """By complex steps: exact to rounding."""
        out = np.zeros((len(u), len(u)))
        for k in range(len(u)):
            z = u.astype(complex)
            z[k] += 1e-30j
            out[:, k] = np.imag(self.gradient(z)) / 1e-30
        return out

    def start(self, kind: str, seed: int = 0) -> Array:
        raise NotImplementedError

    def information(self) -> tuple[float, float]:
        pairs = self.n * (self.n - 1)
        return self.per_node * self.n, pairs if self.directed else pairs / 2

    def pairs(self, u: Array) -> dict[str, Array]:
        """Closed forms of class pairs: p, var, cov and, for weighted models, w, var_w, cov_w."""
        raise NotImplementedError


def share(z: Array) -> Array:
    """z / (1 + z), also where z is infinite."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        return np.where(np.real(z) > 1, 1 / (1 + 1 / z), z / (1 + np.where(np.real(z) > 1, 0, z)))


def log_links(*terms: tuple[Array, Array]) -> Array:
    """-log(1 + sum of products of fitnesses), without overflow."""
    out = np.zeros((len(terms[0][0]), len(terms[0][1])))
    with np.errstate(divide="ignore"):
        for x, y in terms:
            out = np.logaddexp(out, np.add.outer(np.log(x), np.log(y)))
    return -out


def degree_start(kind: str, d: Array, links: float, n: float, seed: int) -> Array:
    if kind == "degrees":
        return -np.log(d)
    if kind == "degrees_minor":
        return -np.log(d / (np.sqrt(links) + 1))
    if kind == "chung_lu":
        return -np.log(d / np.sqrt(2 * links)) if n else d
    if kind == "random":
        return -np.log(np.random.default_rng(seed).uniform(0.001, 1, len(d)))
    if kind == "uniform":
        return np.full(len(d), -np.log(0.5))
    raise ValueError(f"unknown start {kind!r}")


class UBCM(Kernel):
    channels, directed = ("k",), False

    def sums(self, x):
        z = np.outer(x, x)
        return [others(share(z), self.f)]

    @staticmethod
    def cross(a, b):
        return [share(np.outer(a[0], b[0]))]

    @staticmethod
    def cross_log(a, b):
        return [log_links((a[0], b[0]))]

    def loglikelihood(self, u):
        (x,) = self.logs(u)
        return self.linear(u) - pair_sum(np.logaddexp(0, np.add.outer(x, x)), self.f, False)

    def start(self, kind="degrees", seed=0):
        return degree_start(kind, self.flat[self.live], float(self.f @ self.c["k"]) / 2, self.n, seed)

    def pairs(self, u):
        (x,) = self.split(u)
        z = np.outer(x, x)
        p = share(z)
        return {"p": p, "var": p * (1 - p), "cov": p * (1 - p)}


class DBCM(Kernel):
    channels, per_node, halved = ("k_out", "k_in"), 2, False

    def sums(self, x, y):
        z = np.outer(x, y)
        p = share(z)
        return [others(p, self.f), others(p.T, self.f)]

    @staticmethod
    def cross(a, b):
        return [share(np.outer(a[0], b[1])), share(np.outer(a[1], b[0]))]

    @staticmethod
    def cross_log(a, b):
        return [log_links((a[0], b[1]))]

    def loglikelihood(self, u):
        x, y = self.logs(u)
        return self.linear(u) - pair_sum(np.logaddexp(0, np.add.outer(x, y)), self.f, True)

    def start(self, kind="degrees", seed=0):
        return degree_start(kind, self.flat[self.live], float(self.f @ self.c["k_out"]), self.n, seed)

    def pairs(self, u):
        x, y = self.split(u)
        z = np.outer(x, y)
        p = share(z)
        return {"p": p, "var": p * (1 - p), "cov": np.zeros_like(p)}


class RBCM(Kernel):
    channels, per_node = ("k_out", "k_in", "k_rec"), 3

    @staticmethod
    def states(x, y, z, to=None):
        x2, y2, z2 = to or (x, y, z)
        a, b, c = np.outer(x, y2), np.outer(y, x2), np.outer(z, z2)
        # Relative to the largest weight, so that their sum does not overflow.
        top = np.maximum(1, np.maximum(np.real(a), np.maximum(np.real(b), np.real(c))))
        a, b, c, none = a / top, b / top, c / top, 1 / top
        d = none + a + b + c
        return a / d, b / d, c / d, none / d

    def sums(self, x, y, z):
        fwd, bwd, rec, _ = self.states(x, y, z)
        return [others(m, self.f) for m in (fwd, bwd, rec)]

    @staticmethod
    def cross(a, b):
        return list(RBCM.states(*a, to=b)[:3])

    @staticmethod
    def cross_log(a, b):
        return [log_links((a[0], b[1]), (a[1], b[0]), (a[2], b[2]))]

    def loglikelihood(self, u):
        x, y, z = self.logs(u)
        d = np.logaddexp(np.logaddexp(0, np.add.outer(x, y)), np.logaddexp(np.add.outer(y, x), np.add.outer(z, z)))
        return self.linear(u) - pair_sum(d, self.f, False)

    def start(self, kind="degrees", seed=0):
        return degree_start(kind, self.flat[self.live], float(self.f @ (self.c["k_out"] + self.c["k_rec"])), self.n, seed)

    def pairs(self, u):
        fwd, bwd, rec, none = self.states(*self.split(u))
        a = fwd + rec
        return {"p": a, "var": a * (1 - a), "cov": rec - a * (bwd + rec), "p_fwd": fwd, "p_bwd": bwd, "p_rec": rec, "p_none": none}


class BiCM(Kernel):
    """Classes of both layers in one array; ``top`` marks the second layer."""

    channels, directed = ("k",), False

    def __init__(self, c, f, top):
        super().__init__(c, f)
        self.top = np.asarray(top, bool)

    def sums(self, x):
        z = np.outer(x[~self.top], x[self.top])
        p = share(z)
        out = np.zeros(self.k, z.dtype)
        out[~self.top], out[self.top] = p @ self.f[self.top], p.T @ self.f[~self.top]
        return [out]

    @staticmethod
    def cross(a, b):
        """The layer of each class comes before its fitness."""
        return [share(np.outer(a[1], b[1])) * (a[0][:, None] != b[0])]

    @staticmethod
    def cross_log(a, b):
        return [log_links((a[1], b[1])) * (a[0][:, None] != b[0])]

    def loglikelihood(self, u):
        (x,) = self.logs(u)
        m = np.logaddexp(0, np.add.outer(x[~self.top], x[self.top]))
        return self.linear(u) - float(self.f[~self.top] @ m @ self.f[self.top])

    def start(self, kind="degrees", seed=0):
        if kind == "degrees_minor":
            raise ValueError("this model has no start 'degrees_minor'")
        d = self.flat[self.live]
        links = float(self.f[~self.top] @ self.c["k"][~self.top])
        return -np.log(d / np.sqrt(links)) if kind == "chung_lu" else degree_start(kind, d, links, self.n, seed)

    def information(self):
        low, high = self.f[~self.top].sum(), self.f[self.top].sum()
        return float(low + high), float(low * high)

    def pairs(self, u):
        """Bottom classes x top classes."""
        (x,) = self.split(u)
        z = np.outer(x[~self.top], x[self.top])
        p = share(z)
        return {"p": p, "var": p * (1 - p)}


class _Enhanced(Kernel):
    """Whole-number weights: a link has weight 1, 2, ... with a geometric law."""

    method = "Newton"

    @staticmethod
    def parts(a, b):
        """Chance and mean weight from the sums of multipliers of a pair: a for the link, b for its weight."""
        y, one = np.exp(-b), -np.expm1(-b)
        z = np.exp(-a) * y
        z = np.where(np.real(one) > 0, z / np.where(one == 0, 1, one), np.nan)
        p = z / (1 + z)
        return z, p, p / np.where(one == 0, np.nan, one), y

    def split(self, u):
        full = np.full(len(self.flat), np.inf, u.dtype)
        full[self.live] = u
        return np.split(full, len(self.channels))

    @staticmethod
    def plus(a, b):
        with np.errstate(invalid="ignore"):
            return a[:, None] + b[None, :]

    def dead(self, m, value=0.0):
        return np.where(np.isfinite(np.real(m)), m, value)

    def start_of(self, kind, degrees, strengths, seed):
        links, total = float(self.f @ degrees[0]), float(self.f @ strengths[0])
        links = links if self.directed else links / 2
        out = []
        for d, s in ((d, s) for d, s in zip(degrees, strengths)):
            with np.errstate(divide="ignore"):
                pick = {"strengths": (-np.log(d / (links + 1)), -np.log(s / (total + 1))), "strengths_minor": (1 / (d + 1), 1 / (s + 1)), "uniform": (np.full(len(d), 0.001), np.full(len(d), 0.001)), "random": tuple(np.random.default_rng(seed).uniform(0.1, 1, (2, len(d))))}
            if kind not in pick:
                raise ValueError(f"unknown start {kind!r}")
            out.append(pick[kind])
        return out

    def curvature(self, u):
        """Variances and covariance of links and weights, summed over the pairs of nodes of class pairs, as the Hessian's blocks."""
        _, p, w, y = self.all(u)
        with np.errstate(invalid="ignore", divide="ignore"):
            var_w = np.where(p > 0, p * (1 + y - p) / (1 - y) ** 2, 0)
        for c in (p * (1 - p), w * (1 - p), var_w):
            m = self.f[:, None] * c * self.f
            m[np.diag_indices_from(m)] -= self.f * np.diagonal(c)
            yield m

    def reach(self, u, d):
        """How many times ``d`` can be added to ``u`` until the multipliers of some pair's weight add up to 0."""
        b, c = (x[len(x) // 2 :] for x in (self.split(u), self.split(d)))
        now, change = self.plus(b[0], b[-1]), self.plus(c[0], c[-1])
        with np.errstate(invalid="ignore", divide="ignore"):
            far = np.where(np.isfinite(now) & (change < 0), -now / change, np.inf)
        far[np.diag_indices_from(far)] = np.where(self.f == 1, np.inf, np.diagonal(far))
        return float(far.min())

    def own(self, parts):
        """The parts of class pairs; a class of one node has no pair of its own, whatever its multipliers."""
        alone = np.flatnonzero(self.f == 1)
        for m in parts:
            m[alone, alone] = 0
        return parts

    @classmethod
    def linked(cls, a, b):
        """The parts of pairs whose sums of multipliers are ``a`` and ``b``; 0 where no link can be."""
        off = ~np.isfinite(np.real(a))
        return [np.where(off, 0, m) for m in cls.parts(a, b)]


class UECM(_Enhanced):
    channels, directed, per_node = ("k", "s"), False, 2

    def all(self, u):
        a, b = self.split(u)
        return self.own(self.linked(self.plus(a, a), self.plus(b, b)))

    @staticmethod
    def cross(a, b):
        return UECM.linked(UECM.plus(a[0], b[0]), UECM.plus(a[1], b[1]))[1:3]

    @staticmethod
    def cross_log(a, b):
        return [-np.log1p(UECM.linked(UECM.plus(a[0], b[0]), UECM.plus(a[1], b[1]))[0])]

    def expected(self, u):
        _, p, w, _ = self.all(u)
        return np.concatenate([others(p, self.f), others(w, self.f)])

    def loglikelihood(self, u):
        z = self.all(u)[0]
        return self.linear(u) - pair_sum(np.log1p(z), self.f, False)

    def start(self, kind="strengths", seed=0):
        ((a, b),) = self.start_of(kind, [self.c["k"]], [self.c["s"]], seed)
        return np.concatenate([a, b])[self.live]

    def hessian(self, u):
        aa, ab, bb = ((m + np.diag(m.sum(1))) for m in self.curvature(u))
        return np.block([[aa, ab], [ab.T, bb]])[np.ix_(self.live, self.live)]

    def pairs(self, u):
        _, p, w, y = self.all(u)
        var, var_w = p * (1 - p), p * (1 + y - p) / (1 - y) ** 2
        return {"p": p, "var": var, "cov": var, "w": w, "var_w": var_w, "cov_w": var_w}


class DECM(_Enhanced):
    channels, per_node, halved = ("k_out", "k_in", "s_out", "s_in"), 4, False

    def all(self, u):
        ao, ai, bo, bi = self.split(u)
        return self.own(self.linked(self.plus(ao, ai), self.plus(bo, bi)))

    @staticmethod
    def cross(a, b):
        _, p, w, _ = DECM.linked(DECM.plus(a[0], b[1]), DECM.plus(a[2], b[3]))
        _, p_in, w_in, _ = DECM.linked(DECM.plus(a[1], b[0]), DECM.plus(a[3], b[2]))
        return [p, p_in, w, w_in]

    @staticmethod
    def cross_log(a, b):
        return [-np.log1p(DECM.linked(DECM.plus(a[0], b[1]), DECM.plus(a[2], b[3]))[0])]

    def expected(self, u):
        _, p, w, _ = self.all(u)
        return np.concatenate([others(p, self.f), others(p.T, self.f), others(w, self.f), others(w.T, self.f)])

    def loglikelihood(self, u):
        z = self.all(u)[0]
        return self.linear(u) - pair_sum(np.log1p(z), self.f, True)

    def start(self, kind="strengths", seed=0):
        (ao, bo), (ai, bi) = self.start_of(kind, [self.c["k_out"], self.c["k_in"]], [self.c["s_out"], self.c["s_in"]], seed)
        return np.concatenate([ao, ai, bo, bi])[self.live]

    def hessian(self, u):
        aa, ab, bb = (np.block([[np.diag(m.sum(1)), m], [m.T, np.diag(m.sum(0))]]) for m in self.curvature(u))
        return np.block([[aa, ab], [ab.T, bb]])[np.ix_(self.live, self.live)]

    def pairs(self, u):
        _, p, w, y = self.all(u)
        return {"p": p, "var": p * (1 - p), "cov": np.zeros_like(p), "w": w, "var_w": p * (1 + y - p) / (1 - y) ** 2, "cov_w": np.zeros_like(p)}


def over(p: Array, rate: Array) -> Array:
    """p / rate, 0 where no link can be or where a rate is infinite."""
    return np.where((np.real(p) > 0) & np.isfinite(np.real(rate)), p / np.where(np.isfinite(np.real(rate)), rate, 1), 0)


def log_rate(p: Array, rate: Array) -> Array:
    """NaN where a pair that may be linked has no positive rate."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((p > 0) & np.isfinite(rate), p * np.log(np.where(np.isfinite(rate), rate, 1)), 0)


class CReM(Kernel):
    """Exponential weights given chances ``p`` of links (classes x classes)."""

    channels, directed, rates = ("s",), False, True

    def __init__(self, c, f, p, binary=None):
        super().__init__(c, f)
        self.p, self.binary = p, binary

    def log_sum(self, m: Array) -> float:
        """The sum over pairs of nodes; a class of one node has no pair of its own, whatever its rate."""
        m[np.arange(self.k), np.arange(self.k)] = np.where(self.f == 1, 0, np.diagonal(m))
        return pair_sum(m, self.f, self.directed)

    def sums(self, t):
        return [others(over(self.p, t[:, None] + t), self.f)]

    @staticmethod
    def cross(a, b):
        return [over(*UBCM.cross(a, b), a[1][:, None] + b[1])]

    @staticmethod
    def cross_log(a, b):
        return [log_rate(*UBCM.cross(a, b), a[1][:, None] + b[1])]

    def loglikelihood(self, u):
        (t,) = self.split(u)
        return self.linear(u) + self.log_sum(log_rate(self.p, t[:, None] + t))

    def start(self, kind="strengths", seed=0):
        return rate_start(kind, self.flat[self.live], float(self.f @ self.c["s"]), seed)

    def pairs(self, u):
        (t,) = self.split(u)
        r = t[:, None] + t
        var_w = over(self.p * (2 - self.p), r * r)
        return {**self.binary, "w": over(self.p, r), "var_w": var_w, "cov_w": var_w}


class DCReM(CReM):
    channels, directed, per_node, halved = ("s_out", "s_in"), True, 2, False

    def sums(self, o, i):
        m = over(self.p, o[:, None] + i)
        return [others(m, self.f), others(m.T, self.f)]

    @staticmethod
    def cross(a, b):
        p, p_in = DBCM.cross(a, b)
        return [over(p, a[2][:, None] + b[3]), over(p_in, a[3][:, None] + b[2])]

    @staticmethod
    def cross_log(a, b):
        return [log_rate(share(np.outer(a[0], b[1])), a[2][:, None] + b[3])]

    def loglikelihood(self, u):
        o, i = self.split(u)
        return self.linear(u) + self.log_sum(log_rate(self.p, o[:, None] + i))

    def start(self, kind="strengths", seed=0):
        return rate_start(kind, self.flat[self.live], float(self.f @ self.c["s_out"]), seed)

    def pairs(self, u):
        o, i = self.split(u)
        r = o[:, None] + i
        return {**self.binary, "w": over(self.p, r), "var_w": over(self.p * (2 - self.p), r * r), "cov_w": np.zeros_like(self.p)}


class CRWCM(CReM):
    """Two channels: links without an opposite one, and links with one."""

    channels, directed, per_node, halved = ("s_out", "s_in", "s_rec_out", "s_rec_in"), True, 4, False

    def rates_of(self, u):
        o, i, ro, ri = self.split(u)
        return o[:, None] + i, ro[:, None] + ri

    def sums(self, o, i, ro, ri):
        a, b = over(self.binary["p_fwd"], o[:, None] + i), over(self.binary["p_rec"], ro[:, None] + ri)
        return [others(m, self.f) for m in (a, a.T, b, b.T)]

    @staticmethod
    def cross(a, b):
        fwd, bwd, rec, _ = RBCM.states(*a[:3], to=b[:3])
        (o, i, ro, ri), (o2, i2, ro2, ri2) = a[3:], b[3:]
        return [over(fwd, o[:, None] + i2), over(bwd, i[:, None] + o2), over(rec, ro[:, None] + ri2), over(rec, ri[:, None] + ro2)]

    @staticmethod
    def cross_log(a, b):
        fwd, _, rec, _ = RBCM.states(*a[:3], to=b[:3])
        return [log_rate(fwd, a[3][:, None] + b[4]) + log_rate(rec, a[5][:, None] + b[6])]

    def loglikelihood(self, u):
        a, b = self.rates_of(u)
        return self.linear(u) + self.log_sum(log_rate(self.binary["p_fwd"], a)) + self.log_sum(log_rate(self.binary["p_rec"], b))

    def start(self, kind="strengths", seed=0):
        single, both = (float(self.f @ self.c[k]) for k in ("s_out", "s_rec_out"))
        s = np.concatenate([np.tile(np.full(self.k, single), 2), np.tile(np.full(self.k, both), 2)])[self.live]
        return rate_start(kind, self.flat[self.live], s, seed)

    def pairs(self, u):
        a, b = self.rates_of(u)
        fwd, rec = self.binary["p_fwd"], self.binary["p_rec"]
        w1, w2 = over(fwd, a), over(rec, b)
        w = w1 + w2
        var_w = over(2 * fwd, a * a) + over(2 * rec, b * b) - w * w
        both = np.where(np.isfinite(b) & np.isfinite(b.T), b * b.T, np.inf)
        return {**self.binary, "w": w, "w_fwd": w1, "w_rec": w2, "var_w": var_w, "cov_w": over(rec, both) - w * w.T}


def rate_start(kind: str, s: Array, total: float | Array, seed: int) -> Array:
    if kind == "strengths":
        return np.ones(len(s)) / total
    if kind == "strengths_minor":
        return 1 / (s + 1)
    if kind == "random":
        return np.random.default_rng(seed).uniform(0.001, 1, len(s))
    raise ValueError(f"unknown start {kind!r}")
