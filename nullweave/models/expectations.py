"""Expected metrics and their delta-method deviations, on class pairs.

Every metric here depends on a node only through its class, so sums over nodes are sums over classes with multiplicities; a
sum over distinct nodes takes back, class by class, the terms in which nodes coincide.
"""

from __future__ import annotations

import numpy as np

from ..operators.whole_graph import TRIADS

Array = np.ndarray


def edges(p: Array, f: Array, directed: bool) -> float:
    total = f @ p @ f - f @ np.diagonal(p)
    return float(total if directed else total / 2)


def degree(p: Array, f: Array) -> Array:
    return p @ f - np.diagonal(p)


def reciprocity(p: Array, f: Array, both: Array | None = None) -> float:
    """Share of returned links; ``both`` is the chance of both links of a pair, by default that of independent links."""
    both = p * p.T if both is None else both
    return edges(both, f, True) / edges(p, f, True)


def weighted_reciprocity(w: Array, p: Array, f: Array, returned: Array | None = None) -> float:
    """``returned``: expected weight that has an opposite link."""
    returned = w * p.T if returned is None else returned
    return edges(returned, f, True) / edges(w, f, True)


def wedges(p: Array, f: Array) -> float:
    k = degree(p, f)
    return float(f @ (k * (k - 1))) / 2


def neighbour_degree(p: Array, f: Array) -> Array:
    k = degree(p, f)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(k > 0, (p @ (f * k) - np.diagonal(p) * k) / k, 0.0)


def triple(a: Array, b: Array, c: Array, f: Array) -> float:
    """Sum over distinct nodes i, j, k of a_ij b_jk c_ki."""
    da, db, dc = (np.diagonal(m) for m in (a, b, c))
    full = np.einsum("rs,s,st,t,tr,r->", a, f, b, f, c, f, optimize=True)
    ij = f * da @ (b * c.T) @ f
    jk = f * db @ (c * a.T) @ f
    ki = f * dc @ (a * b.T) @ f
    return float(full - ij - jk - ki + 2 * (f @ (da * db * dc)))


def triangles(p: Array, f: Array) -> float:
    return triple(p, p, p, f) / 6


def squares(p: Array, f: Array) -> float:
    """Expected chordless 4-cycles, each once."""
    k = len(f)
    q = 1 - p
    total = 0.0
    for r in range(k):
        for t in range(k):
            ends = f[r] * (f[t] - (r == t)) * q[r, t]
            if ends <= 0:
                continue
            g = f.copy()
            g[r] -= 1
            g[t] -= 1
            v = p[r] * p[t]
            total += ends * (g * v @ q @ (g * v) - g @ (v * v * np.diagonal(q)))
    return float(total) / 8


def states(pairs: dict[str, Array]) -> dict[str, Array]:
    """Chances of P, Q, R, Z seen from the first node: exact where known, else of independent links."""
    if "p_fwd" in pairs:
        return {"P": pairs["p_fwd"], "Q": pairs["p_bwd"], "R": pairs["p_rec"], "Z": pairs["p_none"]}
    p = pairs["p"]
    return {"P": p * (1 - p.T), "Q": p.T * (1 - p), "R": p * p.T, "Z": (1 - p) * (1 - p.T)}


def motifs(pairs: dict[str, Array], f: Array) -> Array:
    s = states(pairs)
    return np.array([triple(*(s[c] for c in code), f) for code in TRIADS.values()])


def motif_fluxes(pairs: dict[str, Array], f: Array) -> Array:
    """Expected weight on each triad: each link in turn is replaced by its expected weight."""
    s = states(pairs)
    if "w_fwd" in pairs:
        one, two = pairs["w_fwd"], pairs["w_rec"]
        heavy = {"P": one, "Q": one.T, "R": two + two.T}
    else:
        p, w = pairs["p"], pairs["w"]
        heavy = {"P": w * (1 - p.T), "Q": w.T * (1 - p), "R": w * p.T + w.T * p}
    out = []
    for code in TRIADS.values():
        total = 0.0
        for at, c in enumerate(code):
            if c != "Z":
                total += triple(*(heavy[c] if k == at else s[x] for k, x in enumerate(code)), f)
        out.append(total)
    return np.array(out)


# Gradients by one matrix entry, at classes r (row node) and s (column node) of distinct nodes.
def gradient(metric: str, p: Array, f: Array) -> Array:
    k = degree(p, f)
    if metric == "edges":
        return np.full(p.shape, 0.5)
    if metric == "links":
        return np.ones(p.shape)
    if metric == "wedges":
        return np.tile(k - 0.5, (len(f), 1))
    if metric == "triangles":
        d = np.diagonal(p)
        two = (p * f) @ p - d[:, None] * p - p * d[None, :]
        return two.T / 2
    if metric == "reciprocity":
        total, both = edges(p, f, True), edges(p * p.T, f, True)
        return (2 * p.T * total - both) / total**2
    if metric.startswith("M") and metric[1:].isdigit() and int(metric[1:]) in TRIADS:
        return triad_gradient(TRIADS[int(metric[1:])], p, f)
    raise ValueError(f"no gradient of {metric!r}; use sampling")


def chain(b: Array, c: Array, f: Array) -> Array:
    """Sum over nodes k other than both of b_jk c_ki, for classes of i (rows) and j (columns)."""
    db, dc = np.diagonal(b), np.diagonal(c)
    return ((b * f) @ c - db[:, None] * c - b * dc[None, :]).T


def triad_gradient(code: str, p: Array, f: Array) -> Array:
    s = states({"p": p})
    h = {x: np.zeros(p.shape) for x in "PQRZ"}
    for at in range(3):
        nxt, prev = s[code[(at + 1) % 3]], s[code[(at + 2) % 3]]
        h[code[at]] += chain(nxt, prev, f)
    hp = h["P"] + h["Q"].T
    hr, hz = h["R"] + h["R"].T, h["Z"] + h["Z"].T
    back = p.T
    return hp * (1 - back) - hp.T * back + hr * back - hz * (1 - back)


def deviation(g: Array, var: Array, cov: Array, f: Array) -> float:
    """Delta method.  Entries of one pair of nodes may covary; entries of different pairs do not."""
    total = edges(var * g * g, f, True) + edges(cov * g * g.T, f, True)
    return float(np.sqrt(max(total, 0.0)))


def neighbour_degree_deviation(p: Array, f: Array, var: Array) -> Array:
    """Of the mean neighbour degree of one node of each class (undirected)."""
    k = degree(p, f)
    num = p @ (f * k) - np.diagonal(p) * k
    out = np.zeros(len(f))
    for q in range(len(f)):
        if k[q] <= 0:
            continue
        g = f.copy()
        g[q] -= 1  # partners of the node q
        a, kq = p[q], k[q]
        # What a pair adds to the gradient: pairs with q, then pairs of two others.
        pair = (a + k) / kq - num[q] / kq**2
        out[q] = g @ (var[q] * pair**2)
        both = (a[:, None] + a[None, :]) / kq
        inner = var * both**2
        out[q] += (g @ inner @ g - g @ np.diagonal(inner)) / 2
    return np.sqrt(out)
