"""DuckDB SQL that solves models by itself: plain fixed-point rounds as a recursive query over classes, then sums over nodes.

It shares nothing with the engine but the definitions, so equal rows check the solvers, the closed forms and the sums
over classes at once.
"""

from __future__ import annotations

from ..operators.whole_graph import TRIADS

ROUNDS = 500


def recursive(views: str) -> str:
    return views.replace("WITH ", "WITH RECURSIVE ", 1)


def ubcm(views: str) -> str:
    """xn (id, x), p (i, j, p) over ordered pairs, s (i, s) expected degrees."""
    return recursive(views) + f""", it AS (SELECT 0 AS n, k, f, k / sqrt(sum(k * f) OVER ()) AS x FROM (SELECT CAST(k AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS f FROM ku GROUP BY 1)
 UNION ALL SELECT a.n + 1, a.k, a.f, a.k / sum((b.f - CASE WHEN a.k = b.k THEN 1 ELSE 0 END) * b.x / (1 + a.x * b.x)) FROM it a, it b WHERE a.n < {ROUNDS} GROUP BY a.n, a.k, a.f),
xn AS (SELECT ku.id, ku.k, it.x FROM ku JOIN it ON ku.k = it.k AND it.n = {ROUNDS}),
p AS (SELECT a.id AS i, b.id AS j, a.x * b.x / (1 + a.x * b.x) AS p FROM xn a JOIN xn b ON a.id <> b.id),
s AS (SELECT i, sum(p) AS s FROM p GROUP BY i)
"""  # fmt: skip


def dbcm(views: str) -> str:
    """p (i, j, p, back): chance of a link and of the opposite one."""
    same = "CASE WHEN a.ko = b.ko AND a.ki = b.ki THEN 1 ELSE 0 END"
    return recursive(views) + f""", it AS (SELECT 0 AS n, ko, ki, f, ko / sqrt(sum(ko * f) OVER ()) AS x, ki / sqrt(sum(ki * f) OVER ()) AS y FROM (SELECT CAST(k_out AS DOUBLE) AS ko, CAST(k_in AS DOUBLE) AS ki, CAST(count(*) AS DOUBLE) AS f FROM kd GROUP BY 1, 2)
 UNION ALL SELECT a.n + 1, a.ko, a.ki, a.f, a.ko / sum((b.f - {same}) * b.y / (1 + a.x * b.y)), a.ki / sum((b.f - {same}) * b.x / (1 + b.x * a.y)) FROM it a, it b WHERE a.n < {ROUNDS} GROUP BY a.n, a.ko, a.ki, a.f),
xn AS (SELECT kd.id, kd.k_out, kd.k_in, it.x, it.y FROM kd JOIN it ON kd.k_out = it.ko AND kd.k_in = it.ki AND it.n = {ROUNDS}),
p AS (SELECT a.id AS i, b.id AS j, a.x * b.y / (1 + a.x * b.y) AS p, b.x * a.y / (1 + b.x * a.y) AS back FROM xn a JOIN xn b ON a.id <> b.id),
d AS (SELECT i, j, 'P' AS st, p * (1 - back) AS v FROM p UNION ALL SELECT i, j, 'Q', back * (1 - p) FROM p UNION ALL SELECT i, j, 'R', p * back FROM p UNION ALL SELECT i, j, 'Z', (1 - p) * (1 - back) FROM p)
"""  # fmt: skip


def rbcm(views: str) -> str:
    """d (i, j, st, v): chances of the states of ordered pairs."""
    f = "(b.f - CASE WHEN a.ko = b.ko AND a.ki = b.ki AND a.kr = b.kr THEN 1 ELSE 0 END)"
    whole = "(1 + a.x * b.y + b.x * a.y + a.z * b.z)"
    return recursive(views) + f""", it AS (SELECT 0 AS n, ko, ki, kr, f, ko / sqrt(greatest(1, sum(ko * f) OVER ())) AS x, ki / sqrt(greatest(1, sum(ki * f) OVER ())) AS y, kr / sqrt(greatest(1, sum(kr * f) OVER ())) AS z
 FROM (SELECT CAST(k_out AS DOUBLE) AS ko, CAST(k_in AS DOUBLE) AS ki, CAST(k_rec AS DOUBLE) AS kr, CAST(count(*) AS DOUBLE) AS f FROM kr GROUP BY 1, 2, 3)
 UNION ALL SELECT a.n + 1, a.ko, a.ki, a.kr, a.f, coalesce(a.ko / nullif(sum({f} * b.y / {whole}), 0), 0), coalesce(a.ki / nullif(sum({f} * b.x / {whole}), 0), 0), coalesce(a.kr / nullif(sum({f} * b.z / {whole}), 0), 0) FROM it a, it b WHERE a.n < {2 * ROUNDS} GROUP BY a.n, a.ko, a.ki, a.kr, a.f),
xn AS (SELECT kr.id, it.x, it.y, it.z FROM kr JOIN it ON kr.k_out = it.ko AND kr.k_in = it.ki AND kr.k_rec = it.kr AND it.n = {2 * ROUNDS}),
q AS (SELECT a.id AS i, b.id AS j, a.x * b.y AS fwd, b.x * a.y AS bwd, a.z * b.z AS rec FROM xn a JOIN xn b ON a.id <> b.id),
d AS (SELECT i, j, 'P' AS st, fwd / (1 + fwd + bwd + rec) AS v FROM q UNION ALL SELECT i, j, 'Q', bwd / (1 + fwd + bwd + rec) FROM q UNION ALL SELECT i, j, 'R', rec / (1 + fwd + bwd + rec) FROM q UNION ALL SELECT i, j, 'Z', 1 / (1 + fwd + bwd + rec) FROM q)
"""  # fmt: skip


def bicm(views: str) -> str:
    """it at its end: layer, k, f, x; xb, xt (id, k, x) of the nodes of both layers."""
    return recursive(views) + f""", c AS (SELECT 0 AS layer, CAST(k AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS f FROM kb GROUP BY k UNION ALL SELECT 1, CAST(k AS DOUBLE), CAST(count(*) AS DOUBLE) FROM kt GROUP BY k),
it AS (SELECT 0 AS n, layer, k, f, k / sqrt(sum(k * f) OVER () / 2) AS x FROM c
 UNION ALL SELECT a.n + 1, a.layer, a.k, a.f, a.k / sum(b.f * b.x / (1 + a.x * b.x)) FROM it a, it b WHERE a.layer <> b.layer AND a.n < {ROUNDS} GROUP BY a.n, a.layer, a.k, a.f),
xb AS (SELECT kb.id, kb.k, x FROM kb JOIN it ON it.k = kb.k AND layer = 0 AND n = {ROUNDS}), xt AS (SELECT kt.id, kt.k, x FROM kt JOIN it ON it.k = kt.k AND layer = 1 AND n = {ROUNDS})
"""  # fmt: skip


def criteria(rows: dict[str, tuple[str, str, str, str]]) -> str:
    """model, loglikelihood, aic, aicc, bic from (source views, likelihood, parameters, observations)."""
    parts = [f"SELECT '{m}' AS model, (SELECT {l} FROM {src}) AS l, CAST((SELECT {k}) AS DOUBLE) AS k, CAST((SELECT {n}) AS DOUBLE) AS n" for m, (src, l, k, n) in rows.items()]
    return f"""SELECT model, round(l, 4) AS loglikelihood, round(2 * k - 2 * l, 4) AS aic, round(2 * k - 2 * l + 2 * k * (k + 1) / (n - k - 1), 4) AS aicc, round(k * ln(n) - 2 * l, 4) AS bic
FROM ({' UNION ALL '.join(parts)})"""


def significance_ubcm(views: str) -> str:
    obs = "(SELECT CAST(sum(k * (k - 1) / 2) AS DOUBLE) FROM ku)", "(SELECT CAST(count(*) AS DOUBLE) FROM u a JOIN u b ON b.src = a.dst JOIN u c ON c.src = a.src AND c.dst = b.dst)"
    return ubcm(views) + f""", two AS (SELECT a.i, b.j, sum(a.p * b.p) AS t FROM p a JOIN p b ON a.j = b.i AND a.i <> b.j GROUP BY 1, 2),
seen AS (SELECT 'wedges' AS metric, {obs[0]} AS obs, (SELECT sum(s * (s - 1) / 2) FROM s) AS mu, (SELECT sqrt(sum(p * (1 - p) * pow(a.s + b.s - 1, 2)) / 2) FROM p JOIN s a ON a.i = p.i JOIN s b ON b.i = p.j) AS sigma
 UNION ALL SELECT 'triangles', {obs[1]}, (SELECT sum(p * t) / 6 FROM p JOIN two USING (i, j)), (SELECT sqrt(sum(p * (1 - p) * t * t) / 2) FROM p JOIN two USING (i, j)))
SELECT metric, obs, round(mu, 4) AS mu, round(sigma, 4) AS sigma, round((obs - mu) / sigma, 4) AS z FROM seen"""  # fmt: skip


def significance_annd(views: str) -> str:
    """Of node i: mean m = sum_j p_ij s_j / s_i.  The chance of i's pair (i, j) adds (p_ij + s_j - m) / s_i, that of a pair (j, l)
    of others (p_ij + p_il) / s_i."""
    return ubcm(views) + """, m AS (SELECT p.i, sum(p.p * o.s) / min(s.s) AS m FROM p JOIN s ON s.i = p.i JOIN s o ON o.i = p.j GROUP BY p.i),
own AS (SELECT p.i, sum(p.p * (1 - p.p) * pow((p.p + o.s - m.m) / s.s, 2)) AS v FROM p JOIN s ON s.i = p.i JOIN s o ON o.i = p.j JOIN m ON m.i = p.i GROUP BY p.i),
far AS (SELECT a.i, sum(q.p * (1 - q.p) * pow((a.p + b.p) / s.s, 2)) / 2 AS v FROM p a JOIN p q ON q.i = a.j JOIN p b ON b.i = a.i AND b.j = q.j JOIN s ON s.i = a.i GROUP BY a.i),
o AS (SELECT src AS id, sum(k) / count(*) AS obs FROM both_ends JOIN ku ON ku.id = dst GROUP BY 1)
SELECT id, round(obs, 4) AS obs, round(m, 4) AS mu, round(sqrt(own.v + far.v), 4) AS sigma, round((obs - m) / sqrt(own.v + far.v), 3) AS z FROM o JOIN m ON m.i = id JOIN own ON own.i = id JOIN far ON far.i = id"""  # fmt: skip


def squares_ubcm(views: str) -> str:
    """Each square has two pairs of opposite nodes; i, k are one of them, j, l the other."""
    return ubcm(views) + """, v AS (SELECT a.i, b.j AS k, a.j, a.p * b.p AS w, 1 - c.p AS apart FROM p a JOIN p b ON a.j = b.i AND a.i < b.j JOIN p c ON c.i = a.i AND c.j = b.j),
t AS (SELECT 'edges' AS name, sum(p) / 2 AS value FROM p UNION ALL SELECT 'wedges', sum(s * (s - 1) / 2) FROM s
 UNION ALL SELECT 'triangles', sum(w * (1 - apart)) / 3 FROM v
 UNION ALL SELECT 'squares', (SELECT sum(a.apart * a.w * b.w * (1 - p.p)) / 2 FROM v a JOIN v b ON a.i = b.i AND a.k = b.k AND a.j < b.j JOIN p ON p.i = a.j AND p.j = b.j))
SELECT name, round(value, 2) AS value FROM t"""  # fmt: skip


def reciprocity_dbcm(views: str) -> str:
    return dbcm(views) + """, t AS (SELECT sum(p) AS l, sum(p * back) AS b FROM p)
SELECT 'expected' AS name, round(b / l, 7) AS value FROM t UNION ALL SELECT 'sigma', round((SELECT sqrt(sum(p * (1 - p) * pow((2 * back * l - b) / (l * l), 2))) FROM p, t), 7)"""


def _census(observed: str) -> str:
    return f"obs AS (SELECT motif, value AS obs FROM ({observed}))"


def _codes() -> str:
    return ", ".join(f"({m}, '{c}')" for m, c in TRIADS.items())


def triads(solved: str, observed: str, sigma: bool) -> str:
    """Observed and expected triads, and the delta-method deviation of independent links where it is asked for.  ``observed`` is a
    whole query (its views are its own)."""
    mu = f"""codes(motif, code) AS (VALUES {_codes()}),
c AS (SELECT a.st AS s1, b.st AS s2, a.i AS j, b.j AS i, sum(a.v * b.v) AS t FROM d a JOIN d b ON a.j = b.i AND a.i <> b.j GROUP BY 1, 2, 3, 4),
mu AS (SELECT motif, sum(d.v * c.t) AS mu FROM codes JOIN d ON d.st = code[1] JOIN c ON c.s1 = code[2] AND c.s2 = code[3] AND c.i = d.i AND c.j = d.j GROUP BY motif)"""
    if not sigma:
        return solved + f""", {_census(observed)}, {mu}
SELECT obs.motif, obs, round(mu, 3) AS mu, CAST(NULL AS DOUBLE) AS sigma, CAST(NULL AS DOUBLE) AS z FROM obs JOIN mu USING (motif)"""
    turned = " UNION ALL ".join(f"SELECT motif, code[{a + 1}] AS st, code[{(a + 1) % 3 + 1}] AS s1, code[{(a + 2) % 3 + 1}] AS s2 FROM codes" for a in range(3))
    part = ", ".join(f"sum(CASE WHEN t.st = '{s}' THEN c.t ELSE 0 END) AS h{s}" for s in "PQRZ")
    return solved + f""", {_census(observed)}, {mu},
h AS (SELECT motif, i, j, {part} FROM ({turned}) t JOIN c USING (s1, s2) GROUP BY 1, 2, 3),
g AS (SELECT a.motif, p.p * (1 - p.p) AS var, (a.hP + b.hQ) * (1 - back) - (b.hP + a.hQ) * back + (a.hR + b.hR) * back - (a.hZ + b.hZ) * (1 - back) AS g FROM h a JOIN h b ON a.motif = b.motif AND a.i = b.j AND a.j = b.i JOIN p ON p.i = a.i AND p.j = a.j),
sd AS (SELECT motif, sqrt(sum(var * g * g)) AS sigma FROM g GROUP BY motif)
SELECT obs.motif, obs, round(mu, 3) AS mu, round(sigma, 3) AS sigma, round(CASE WHEN sigma > 0 THEN (obs - mu) / sigma END, 3) AS z FROM obs JOIN mu USING (motif) JOIN sd USING (motif)"""  # fmt: skip


def vn(views: str) -> str:
    """Groups of n bottom nodes at each top node: the number of its neighbours is a sum of independent trials, whose factorial moments
    are the elementary symmetric sums e of the chances (Newton's identities from the power sums)."""
    step = ", ".join(f"pow(p, {k}) AS p{k}" for k in range(1, 7))
    out = bicm(views) + f""", q AS (SELECT t.id, b.x * t.x / (1 + b.x * t.x) AS p FROM xt t, xb b),
w AS (SELECT id, {", ".join(f"sum(p{k}) AS s{k}" for k in range(1, 7))}, sum(p1 * (1 - p1)) AS v FROM (SELECT id, {step} FROM q) GROUP BY id), e0 AS (SELECT *, s1 AS e1 FROM w)"""
    for n in range(2, 7):
        terms = " ".join(f"{'+' if k % 2 else '-'} {f'e{n - k}' if n > k else '1'} * s{k}" for k in range(1, n + 1))
        out += f", e{n - 1} AS (SELECT *, ({terms}) / {n} AS e{n} FROM e{n - 2})"
    exact = {2: "e2 + 6 * e3 + 6 * e4", 3: "e3 + 12 * e4 + 30 * e5 + 20 * e6"}
    binomial = {2: "s1 * (s1 - 1) / 2", 3: "s1 * (s1 - 1) * (s1 - 2) / 6"}
    slope = {2: "s1 - 0.5", 3: "(3 * s1 * s1 - 6 * s1 + 2) / 6"}
    shift = {2: "v / 2", 3: "v * (s1 - 1) / 2"}
    parts = []
    for n in (2, 3):
        parts.append(f"SELECT 'bottom' AS layer, {n} AS n, 'exact' AS method, sum(e{n}) AS mu, sqrt(sum({exact[n]} - e{n} * e{n})) AS sigma FROM e5")
        low = f"CASE WHEN s1 < {n} - 1e-6 THEN 0 ELSE {binomial[n]} END"
        full = f"CASE WHEN s1 < {n} - 1e-6 THEN 0 ELSE {slope[n]} END"
        parts.append(f"SELECT 'bottom', {n}, 'delta', sum({low} + {shift[n]}), sqrt(sum(pow({full}, 2) * v)) FROM e5")
    return out + f" SELECT layer, n, method, round(mu, 4) AS mu, round(sigma, 4) AS sigma FROM ({' UNION ALL '.join(parts)})"


def projection(views: str, exact: bool) -> str:
    """All pairs with a common neighbour, their tails, and their adjustment (Benjamini-Hochberg)."""
    pair = "a.x * t.x / (1 + a.x * t.x) * (b.x * t.x / (1 + b.x * t.x))"
    most = 16
    if exact:  # 1 less the chances of fewer, by the elementary symmetric sums of the odds
        sums = ", ".join(f"sum(t.f * pow({pair} / (1 - {pair}), {k}))" for k in range(1, most + 1))
        tail = f"""o AS (SELECT a.k AS ka, b.k AS kb, [{sums}] AS s, exp(sum(t.f * ln(1 - {pair}))) AS none FROM ends a, ends b, it t WHERE a.layer = 0 AND b.layer = 0 AND t.layer = 1 AND t.n = {ROUNDS} GROUP BY 1, 2),
sym AS (SELECT 0 AS r, ka, kb, s, none, [1.0::DOUBLE] AS e FROM o UNION ALL SELECT r + 1, ka, kb, s, none, list_append(e, list_sum([CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END * e[r + 2 - i] * s[i] FOR i IN range(1, r + 2)]) / (r + 1)) FROM sym WHERE r < {most}),
tails AS (SELECT ka, kb, w, greatest(1 - none * list_sum(e[1:w]), 0) AS p FROM sym JOIN (SELECT DISTINCT w FROM seen) ON r = {most})"""
    else:
        tail = f"""o AS (SELECT a.k AS ka, b.k AS kb, sum(t.f * {pair}) AS rate FROM ends a, ends b, it t WHERE a.layer = 0 AND b.layer = 0 AND t.layer = 1 AND t.n = {ROUNDS} GROUP BY 1, 2),
tails AS (SELECT ka, kb, w, greatest(1 - list_sum([exp(-rate) * pow(rate, i) / factorial(CAST(i AS INT)) FOR i IN range(0, w)]), 0) AS p FROM o, (SELECT DISTINCT w FROM seen))"""
    return bicm(views) + f""", ends AS (SELECT layer, k, x FROM it WHERE n = {ROUNDS}),
seen AS (SELECT x.bottom AS src, y.bottom AS dst, CAST(count(*) AS BIGINT) AS w FROM b x JOIN b y ON x.top = y.top AND x.bottom < y.bottom GROUP BY 1, 2),
{tail},
r AS (SELECT src, dst, seen.w, p, count(*) OVER () AS m, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS rn FROM seen JOIN kb i ON i.id = src JOIN kb j ON j.id = dst JOIN tails t ON t.ka = i.k AND t.kb = j.k AND t.w = seen.w)
SELECT src, dst, w, round(p, 7) AS p, round(least(1, min(p * m / rn) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS p_adjusted FROM r"""  # fmt: skip
