"""Solvers on class arrays: accelerated fixed point, quasi-Newton and Newton with backtracking.  numpy only."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ..errors import ConvergenceError

Array = np.ndarray
#: Accelerated steps without a new smallest change after which the acceleration is given up.
STALLED = 100
#: Longest accelerated step, in logarithms.  Where all chances are near 1 plain steps are equal, and an extrapolation of them has no bound.
#: Longest change of a multiplier in a step of Newton's method too: where chances are 0 or 1 to rounding there is no curvature to come back by.
LONGEST = 5.0


def fixed_point(update: Callable[[Array], Array], start: Array, ftol: float = 1e-8, maxiters: int = 1000, memory: int = 8, damped: bool = True) -> tuple[Array, int]:
    """Fixed point of ``update``; the largest change of a plain step bounds the error.

    Anderson acceleration with ``memory`` first (0 is the plain iteration); where that fails and ``damped`` is set, damped steps with a
    shorter memory, then without."""
    tries = [(memory, 1.0)] + ([(min(memory, 5), 0.5), (0, 0.5)] if memory and damped else [])
    for k, (m, damping) in enumerate(tries):
        try:
            return _iterate(update if damping == 1 else lambda u, d=damping: u + d * (update(u) - u), start, ftol * damping, maxiters, m)
        except ConvergenceError:
            if k == len(tries) - 1:
                raise
    raise AssertionError


def _iterate(update: Callable[[Array], Array], start: Array, ftol: float, maxiters: int, memory: int) -> tuple[Array, int]:
    """A step that leaves the domain, or that makes the change much larger, is taken again without acceleration."""
    u = start.copy()
    xs: list[Array] = []
    gs: list[Array] = []
    last, best_at = np.inf, 0
    for k in range(1, maxiters + 1):
        if memory and k - best_at > STALLED:
            break
        with np.errstate(all="ignore"):
            g = update(u)
        if not np.isfinite(g).all():
            if not xs:
                raise ConvergenceError("fixedpoint", "the start is outside the domain")
            u, xs, gs = gs[-1] if np.isfinite(gs[-1]).all() else xs[-1], [], []
            continue
        r = g - u
        size = float(np.abs(r).max()) if len(r) else 0.0
        # Beyond some 1e6 a step may be lost in rounding, which is no fixed point.
        if size <= ftol and (not len(u) or np.spacing(np.abs(u).max()) <= max(ftol, 1e-10)):
            return g, k
        if size > 10 * last:
            xs, gs = [], []
        if size < last:
            last, best_at = size, k
        xs.append(u)
        gs.append(g)
        if memory and len(xs) > 1:
            xs, gs = xs[-memory - 1 :], gs[-memory - 1 :]
            f = np.array(gs) - np.array(xs)
            df, dg = np.diff(f, axis=0).T, np.diff(np.array(gs), axis=0).T
            coef = np.linalg.lstsq(df, r, rcond=1e-10)[0]
            step = g - dg @ coef - u
            far = float(np.abs(step).max())
            u = u + step * min(1.0, max(LONGEST, size) / far) if 0 < far < np.inf else g
        else:
            u = g
    raise ConvergenceError("fixedpoint", f"{k} iterations, last change {size:.2e}")


def search(value: Callable[[Array], float], x: Array, direction: Array, slope: float, now: float, step: float = 1.0) -> tuple[Array, float, float]:
    """Backtracking: halves the step until the value falls enough; points outside the domain (NaN) count as worse."""
    for _ in range(60):
        with np.errstate(all="ignore"):
            new = value(x + step * direction)
        if np.isfinite(new) and new <= now + 1e-4 * step * slope + 1e-14 * abs(now):
            return x + step * direction, new, step
        step /= 2
    return x, now, 0.0


def quasi_newton(value, gradient, start: Array, g_tol: float = 1e-8, maxiters: int = 1000, memory: int | None = None, scale: Array | None = None) -> tuple[Array, int]:
    """BFGS (``memory`` None keeps the full inverse Hessian) or L-BFGS, minimising ``value``."""
    x = start.copy()
    now, g = value(x), gradient(x)
    if not np.isfinite(now):
        raise ConvergenceError("BFGS", "the start is outside the domain")
    n = len(x)
    d0 = np.ones(n) if scale is None else 1 / scale
    h = np.diag(d0)
    pairs: list[tuple[Array, Array, float]] = []
    stuck = 0
    for k in range(1, maxiters + 1):
        if np.abs(g).max() <= g_tol:
            return x, k
        if memory is None:
            d = -h @ g
        else:
            q, alphas = g.copy(), []
            for s, y, rho in reversed(pairs):
                a = rho * s @ q
                alphas.append(a)
                q -= a * y
            q = q * (d0 if not pairs else (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]))
            for (s, y, rho), a in zip(pairs, reversed(alphas)):
                q += (a - rho * y @ q) * s
            d = -q
        slope = float(g @ d)
        if slope >= 0:
            h, pairs, d = np.diag(d0), [], -d0 * g
            slope = float(g @ d)
        new, then, step = search(value, x, d, slope, now)
        if not step:
            stuck += 1
            if stuck > 1:
                break
            h, pairs = np.diag(d0), []
            continue
        stuck = 0
        g_new = gradient(new)
        s, y = new - x, g_new - g
        sy = float(s @ y)
        if sy > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
            if memory is None:
                v = np.eye(n) - np.outer(s, y) / sy
                h = v @ h @ v.T + np.outer(s, s) / sy
            else:
                pairs = [*pairs[-memory + 1 :], (s, y, 1 / sy)]
        x, now, g = new, then, g_new
    if np.abs(g).max() <= max(1e3 * g_tol, 1e-5):
        return x, maxiters
    raise ConvergenceError("BFGS" if memory is None else "L-BFGS", f"gradient {np.abs(g).max():.2e}")


def newton(value, gradient, hessian, start: Array, g_tol: float = 1e-8, maxiters: int = 200) -> tuple[Array, int]:
    x = start.copy()
    for k in range(1, maxiters + 1):
        g = gradient(x)
        if np.abs(g).max() <= g_tol:
            return x, k
        h = hessian(x)
        h = (h + h.T) / 2
        w, v = np.linalg.eigh(h)
        # Steps along gauge directions (no curvature) are left out.
        use = np.abs(w) > 1e-12 * max(1e-300, np.abs(w).max())
        d = -(v[:, use] / np.abs(w[use])) @ (v[:, use].T @ g)
        new, _, step = search(value, x, d, float(g @ d), value(x))
        if not step:
            if np.abs(g).max() <= max(1e3 * g_tol, 1e-5):
                return x, k
            break
        x = new
    raise ConvergenceError("Newton", f"gradient {np.abs(gradient(x)).max():.2e}")


def convex_newton(value, gradient, start: Array, size: Array, g_tol: float = 1e-8, maxiters: int = 200) -> tuple[Array, int]:
    """Newton's method for a convex value whose Hessian has no negative entry and twice its diagonal as row sums, as sums over
    pairs of -log(x_i + x_j) have; ends when no gradient is above ``g_tol`` times ``size``.

    The Hessian is never made: its products are complex steps of ``gradient``, and conjugate gradients, scaled by its diagonal,
    solve each step as exactly as the gradient asks for."""
    x, tiny = start.copy(), 1e-30
    for k in range(1, maxiters + 1):
        g = gradient(x)
        worst = np.abs(g / size).max()
        if worst <= g_tol:
            return x, k
        product = lambda v, x=x: np.imag(gradient(x + 1j * tiny * v)) / tiny
        scale = product(np.ones(len(x))) / 2
        d, r = np.zeros(len(x)), -g
        z = r / scale
        v, rz = z.copy(), r @ z
        goal = rz * min(0.01, worst)
        for _ in range(4 * len(x)):
            hv = product(v)
            step = rz / (v @ hv)
            d, r = d + step * v, r - step * hv
            z = r / scale
            rz, before = r @ z, rz
            if not rz > goal:
                break
            v = z + rz / before * v
        x, _, step = search(value, x, d, float(g @ d), value(x))
        if not step:
            if worst <= max(1e3 * g_tol, 1e-6):
                return x, k
            break
    raise ConvergenceError("Newton", f"gradient {worst:.2e} of the constraints")


def scaled_newton(value, gradient, hessian, start: Array, size: Array, g_tol: float = 1e-8, maxiters: int = 1000, reach: Callable[[Array, Array], float] | None = None) -> tuple[Array, int]:
    """Newton's method for a convex value, each step solved in the scale of the Hessian's diagonal; ends when no gradient is above
    ``g_tol`` times ``size``.  ``reach`` gives how many times a direction can be gone without leaving the domain; the search begins within.
    Directions without curvature (gauges, and multipliers on their way to infinity) are held by a small multiple of that diagonal,
    which grows where no step falls."""
    x, now, worst = start.copy(), value(start), np.inf
    least = ridge = 1e-12
    for k in range(1, maxiters + 1):
        g = gradient(x)
        worst = np.abs(g / size).max()
        if worst <= g_tol:
            return x, k
        h = hessian(x)
        scale = 1 / np.sqrt(np.maximum(np.diagonal(h), 1e-300))
        h *= scale
        h *= scale[:, None]
        step = 0.0
        while not step and ridge <= 1.0:
            h[np.diag_indices_from(h)] = 1 + ridge
            d = scale * np.linalg.solve(h, -scale * g)
            slope = float(g @ d)
            if np.isfinite(slope) and slope < 0:
                x, now, step = search(value, x, d, slope, now, min(1.0, LONGEST / np.abs(d).max(), 0.9 * reach(x, d) if reach else 1.0))
            ridge = max(least, ridge / 10) if step else ridge * 100
        if not step:
            if worst <= max(1e2 * g_tol, 1e-6):
                return x, k
            break
    raise ConvergenceError("Newton", f"gradient {worst:.2e} of the constraints")
