"""Queries over the shared tables, and DuckDB SQL that gives the same rows.

Three graphs are views of the tables: who follows whom in ``events`` (directed, weighted), the same without directions, and
which supplier sold much-returned goods to which customer (bipartite).  A fitted model must reproduce its constraints, so
the SQL of a fit computes the observed constraints.
"""

from __future__ import annotations

import warnings
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ModelWarning
from ..functions import numeric
from ..graph import Bipartite, Graph, bipartite, from_edges, stored, successors
from ..models import expectations as ex
from ..models import projection, sampling
from ..models.model import BiCM, CRWCM, CReM, DBCM, DCReM, DECM, RBCM, UBCM, UECM, Model
from ..operators import bipartite as bip
from ..operators import sequences as seq
from ..operators import whole_graph as wg
from ..sources import networks
from . import solved

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

SUCC = """WITH step AS (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events),
e AS (SELECT src, dst, CAST(count(*) AS BIGINT) AS w FROM step WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst GROUP BY 1, 2),
n AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
r AS (SELECT a.src, a.dst, a.w, b.w AS back FROM e a LEFT JOIN e b ON a.src = b.dst AND a.dst = b.src),
u AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, CAST(sum(w) AS BIGINT) AS w FROM e GROUP BY 1, 2),
both_ends AS (SELECT src, dst, w FROM u UNION ALL SELECT dst, src, w FROM u),
ku AS (SELECT src AS id, CAST(count(*) AS BIGINT) AS k, CAST(sum(w) AS BIGINT) AS s FROM both_ends GROUP BY 1),
kd AS (SELECT id, CAST((SELECT count(*) FROM e WHERE src = id) AS BIGINT) AS k_out, CAST((SELECT count(*) FROM e WHERE dst = id) AS BIGINT) AS k_in,
  CAST((SELECT coalesce(sum(w), 0) FROM e WHERE src = id) AS BIGINT) AS s_out, CAST((SELECT coalesce(sum(w), 0) FROM e WHERE dst = id) AS BIGINT) AS s_in FROM n),
kr AS (SELECT id, CAST((SELECT count(*) FROM r WHERE src = id AND back IS NULL) AS BIGINT) AS k_out, CAST((SELECT count(*) FROM r WHERE dst = id AND back IS NULL) AS BIGINT) AS k_in,
  CAST((SELECT count(*) FROM r WHERE src = id AND back IS NOT NULL) AS BIGINT) AS k_rec,
  CAST((SELECT coalesce(sum(w), 0) FROM r WHERE src = id AND back IS NULL) AS BIGINT) AS s_out, CAST((SELECT coalesce(sum(w), 0) FROM r WHERE dst = id AND back IS NULL) AS BIGINT) AS s_in,
  CAST((SELECT coalesce(sum(w), 0) FROM r WHERE src = id AND back IS NOT NULL) AS BIGINT) AS s_rec_out, CAST((SELECT coalesce(sum(w), 0) FROM r WHERE dst = id AND back IS NOT NULL) AS BIGINT) AS s_rec_in FROM n)
"""  # fmt: skip
BI = """WITH b AS (SELECT DISTINCT l_suppkey AS bottom, o_custkey AS top FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity >= 40),
kb AS (SELECT bottom AS id, CAST(count(*) AS BIGINT) AS k FROM b GROUP BY 1), kt AS (SELECT top AS id, CAST(count(*) AS BIGINT) AS k FROM b GROUP BY 1)
"""  # fmt: skip


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def succ(spark: SparkSession, sf_dir: str) -> Graph:
    return successors(read(spark, sf_dir, "events"))


def succ_und(spark: SparkSession, sf_dir: str) -> Graph:
    return succ(spark, sf_dir).undirected()


def sup_cust(spark: SparkSession, sf_dir: str) -> Bipartite:
    """Filters and columns reach the scans; pairs are made distinct after the join."""
    items = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 40").select("l_orderkey", "l_suppkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return bipartite(items.join(orders, items.l_orderkey == orders.o_orderkey), "l_suppkey", "o_custkey")


def query(sql: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore", ModelWarning)
                return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql:
            ORACLE[fn.__name__] = sql
        return run

    return register


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})


# Builders and reduction
@query(SUCC + "SELECT src, dst, w FROM e")
def succ_edges(spark, sf_dir):
    return succ(spark, sf_dir).edges


@query(SUCC + "SELECT src, dst, w FROM u")
def succ_undirected_edges(spark, sf_dir):
    return succ_und(spark, sf_dir).edges


@query(BI + "SELECT bottom, top, 1 AS value FROM b")
def biadjacency(spark, sf_dir):
    return sup_cust(spark, sf_dir).biadjacency()


@query(SUCC + "SELECT CAST(row_number() OVER (ORDER BY k_out, k_in) AS INT) AS cls, k_out, k_in, min(id) AS first, CAST(count(*) AS BIGINT) AS f FROM kd GROUP BY k_out, k_in")
def degree_classes(spark, sf_dir):
    return seq.classes(seq.degrees(succ(spark, sf_dir)), "k_out", "k_in")


@query(SUCC + "SELECT CAST(row_number() OVER (ORDER BY min(id)) AS INT) AS cls, k, min(id) AS first, CAST(count(*) AS BIGINT) AS f FROM ku GROUP BY k")
def degree_classes_by_first(spark, sf_dir):
    return seq.classes(seq.degrees(succ_und(spark, sf_dir)), "k", ordered=False)


# Node sequences
@query(SUCC + "SELECT id, k_out, k_in FROM kd")
def degrees_directed(spark, sf_dir):
    return seq.degrees(succ(spark, sf_dir))


@query(SUCC + "SELECT id, k FROM ku")
def degrees_undirected(spark, sf_dir):
    return seq.degrees(succ_und(spark, sf_dir))


@query(SUCC + "SELECT id, s_out, s_in, s_out + s_in AS s FROM kd")
def strengths_directed(spark, sf_dir):
    return seq.strengths(succ(spark, sf_dir))


@query(SUCC + "SELECT id, s FROM ku")
def strengths_undirected(spark, sf_dir):
    return seq.strengths(succ_und(spark, sf_dir))


@query(SUCC + "SELECT id, k_out, k_in, k_rec FROM kr")
def reciprocal_degrees(spark, sf_dir):
    return seq.reciprocal_degrees(succ(spark, sf_dir))


@query(SUCC + "SELECT id, s_out, s_in, s_rec_out, s_rec_in FROM kr")
def reciprocal_strengths(spark, sf_dir):
    return seq.reciprocal_strengths(succ(spark, sf_dir))


@query(SUCC + "SELECT src AS id, round(sum(k) / count(*), 6) + 0.0 AS annd FROM both_ends JOIN ku ON ku.id = dst GROUP BY 1")
def neighbour_degree(spark, sf_dir):
    return rounded(seq.neighbour_degree(succ_und(spark, sf_dir)), 6, "annd")


@query(SUCC + "SELECT n.id, coalesce(round(sum(k.k_out) / nullif(max(o.k_out), 0), 6), 0.0) AS annd FROM n JOIN kd o USING (id) LEFT JOIN e ON e.src = n.id LEFT JOIN kd k ON k.id = e.dst GROUP BY n.id")
def neighbour_degree_out(spark, sf_dir):
    return rounded(seq.neighbour_degree(succ(spark, sf_dir), "out"), 6, "annd")


@query(SUCC + "SELECT n.id, coalesce(round(sum(k.k_in) / nullif(max(o.k_in), 0), 6), 0.0) AS annd FROM n JOIN kd o USING (id) LEFT JOIN e ON e.src = n.id LEFT JOIN kd k ON k.id = e.dst GROUP BY n.id")
def neighbour_degree_in(spark, sf_dir):
    return rounded(seq.neighbour_degree(succ(spark, sf_dir), "in"), 6, "annd")


# Whole graph
@query(SUCC + "SELECT round(count(back) / count(*), 9) AS reciprocity, round(sum(CASE WHEN back IS NOT NULL THEN w ELSE 0 END) / sum(w), 9) AS weighted_reciprocity FROM r")
def reciprocity(spark, sf_dir):
    return rounded(wg.reciprocity(succ(spark, sf_dir)), 9, "reciprocity", "weighted_reciprocity")


@query(SUCC + "SELECT CAST(sum(k * (k - 1) / 2) AS DOUBLE) AS wedges FROM ku")
def wedges(spark, sf_dir):
    return wg.wedges(succ_und(spark, sf_dir))


@query(SUCC + "SELECT CAST(count(*) AS BIGINT) AS triangles FROM u a JOIN u b ON b.src = a.dst JOIN u c ON c.src = a.src AND c.dst = b.dst")
def triangles(spark, sf_dir):
    return wg.triangles(succ_und(spark, sf_dir))


@query(SUCC + """, w AS (SELECT x.src AS i, y.dst AS k, x.dst AS j FROM both_ends x JOIN both_ends y ON x.dst = y.src AND x.src < y.dst WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.src = x.src AND u.dst = y.dst))
SELECT CAST(count(*) / 2 AS BIGINT) AS squares FROM w a JOIN w b ON a.i = b.i AND a.k = b.k AND a.j < b.j WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.src = a.j AND u.dst = b.j)""")
def squares(spark, sf_dir):
    return wg.squares(succ_und(spark, sf_dir))


TRIAD_SQL = SUCC + """, d AS (SELECT src AS i, dst AS j, CASE WHEN back IS NULL THEN 'P' ELSE 'R' END AS s, CAST(w AS DOUBLE) AS wf, CAST(coalesce(back, 0) AS DOUBLE) AS wb FROM r
 UNION ALL SELECT dst, src, 'Q', 0.0, CAST(w AS DOUBLE) FROM r WHERE back IS NULL),
t AS (SELECT a.s AS s1, b.s AS s2, coalesce(c.s, 'Z') AS s3, a.wf AS f1, a.wb AS b1, b.wf AS f2, b.wb AS b2, c.wf AS f3, c.wb AS b3
 FROM d a JOIN d b ON a.j = b.i AND a.i <> b.j LEFT JOIN d c ON c.i = b.j AND c.j = a.i),
v AS (SELECT s1 || s2 || s3 AS code, {part1} AS v1, {part2} AS v2, {part3} AS v3, CASE s1 WHEN 'R' THEN 2 ELSE 1 END + CASE s2 WHEN 'R' THEN 2 ELSE 1 END + CASE s3 WHEN 'R' THEN 2 WHEN 'Z' THEN 0 ELSE 1 END AS links FROM t),
m(motif, code) AS (VALUES {codes})
SELECT motif, round(coalesce(sum({value}), 0), {digits}) AS value FROM m LEFT JOIN v USING (code) GROUP BY motif"""  # fmt: skip


def triad_sql(kind: str, digits: int) -> str:
    # An open triad is found at its middle node, so its states are turned until the missing link is last.
    codes = {m: c if "Z" not in c else c[c.find("Z") + 1 :] + c[: c.find("Z") + 1] for m, c in wg.TRIADS.items()}
    two, none = ("* ", "1.0") if kind == "intensity" else ("+ ", "0.0")
    part = [f"CASE s{k} WHEN 'P' THEN f{k} WHEN 'Q' THEN b{k} WHEN 'R' THEN f{k} {two}b{k} ELSE {none} END" for k in (1, 2, 3)]
    value = {"count": "CASE WHEN v1 IS NULL THEN 0.0 ELSE 1.0 END", "flux": "v1 + v2 + v3", "intensity": "pow(v1 * v2 * v3, 1.0 / links)"}[kind]
    return TRIAD_SQL.format(part1=part[0], part2=part[1], part3=part[2], codes=", ".join(f"({m}, '{c}')" for m, c in codes.items()), value=value, digits=digits)


@query(triad_sql("count", 0))
def triad_counts(spark, sf_dir):
    return rounded(wg.triad_census(succ(spark, sf_dir)), 0, "value")


@query(triad_sql("flux", 3))
def triad_fluxes(spark, sf_dir):
    return rounded(wg.triad_census(succ(spark, sf_dir), "flux"), 3, "value")


@query(triad_sql("intensity", 3))
def triad_intensities(spark, sf_dir):
    return rounded(wg.triad_census(succ(spark, sf_dir), "intensity"), 3, "value")


# Bipartite
@query(BI + "SELECT 'bottom' AS layer, id, k FROM kb UNION ALL SELECT 'top', id, k FROM kt")
def bipartite_degrees(spark, sf_dir):
    g = sup_cust(spark, sf_dir)
    return bip.degrees(g, "bottom").withColumn("layer", F.lit("bottom")).union(bip.degrees(g, "top").withColumn("layer", F.lit("top"))).select("layer", "id", "k")


@query(BI + "SELECT x.bottom AS src, y.bottom AS dst, CAST(count(*) AS BIGINT) AS w FROM b x JOIN b y ON x.top = y.top AND x.bottom < y.bottom GROUP BY 1, 2")
def projection_bottom(spark, sf_dir):
    return bip.project(sup_cust(spark, sf_dir), "bottom")


@query(BI + "SELECT DISTINCT x.top AS src, y.top AS dst FROM b x JOIN b y ON x.bottom = y.bottom AND x.top < y.top")
def projection_top_simple(spark, sf_dir):
    return bip.project(sup_cust(spark, sf_dir), "⊤", "simple")


@query(BI + "SELECT (SELECT sum(k * (k - 1) / 2) FROM kt) AS bottom, (SELECT sum(k * (k - 1) / 2) FROM kb) AS top")
def v_motifs(spark, sf_dir):
    g = sup_cust(spark, sf_dir)
    return bip.v_motifs(g, "bottom").toDF("bottom").crossJoin(bip.v_motifs(g, "top").toDF("top"))


@query(BI + "SELECT CAST(count(*) AS BIGINT) AS v_motif FROM b x JOIN b y ON x.top = y.top WHERE x.bottom = 1 AND y.bottom = 2")
def v_motif_pair(spark, sf_dir):
    return bip.v_motif(sup_cust(spark, sf_dir), 1, 2)


@query(BI + "SELECT 2 AS n, CAST(sum(k * (k - 1) / 2) AS DOUBLE) AS value FROM kt UNION ALL SELECT 3, sum(k * (k - 1) * (k - 2) / 6) FROM kt WHERE k >= 3 UNION ALL SELECT 4, sum(k * (k - 1) * (k - 2) * (k - 3) / 24) FROM kt WHERE k >= 4")
def vn_motifs(spark, sf_dir):
    g = sup_cust(spark, sf_dir)
    parts = [bip.vn_motifs(g, n, "bottom").select(F.lit(n).alias("n"), F.col("vn_motifs").alias("value")) for n in (2, 3, 4)]
    return rounded(parts[0].union(parts[1]).union(parts[2]), 3, "value")


# Fits: each class with its constraints as the model expects them
def fit(model: Model, digits: int = 2) -> DataFrame:
    e = model.expected()
    return e.select("f", *[F.round(f"expected_{k}", digits).alias(k) for k in model.problem.channels])


def observed(source: str, *keys: str) -> str:
    cols = ", ".join(f"CAST({k} AS DOUBLE) AS {k}" for k in keys)
    return SUCC + f"SELECT CAST(count(*) AS BIGINT) AS f, {cols} FROM {source} GROUP BY {', '.join(keys)}"


@query(observed("ku", "k"))
def fit_ubcm(spark, sf_dir):
    return fit(UBCM.from_graph(succ_und(spark, sf_dir)).solve())


@query(observed("kd", "k_out", "k_in"))
def fit_dbcm(spark, sf_dir):
    return fit(DBCM.from_graph(succ(spark, sf_dir)).solve(maxiters=5000))


@query(observed("kr", "k_out", "k_in", "k_rec"))
def fit_rbcm(spark, sf_dir):
    return fit(RBCM.from_graph(succ(spark, sf_dir)).solve(maxiters=5000))


@query(BI + "SELECT layer, CAST(count(*) AS BIGINT) AS f, CAST(k AS DOUBLE) AS k FROM (SELECT 0 AS layer, k FROM kb UNION ALL SELECT 1, k FROM kt) GROUP BY layer, k")
def fit_bicm(spark, sf_dir):
    m = BiCM.from_graph(sup_cust(spark, sf_dir)).solve(maxiters=5000)
    e = m.expected()
    return e.join(m.classes.select("cls", "layer"), "cls").select("layer", "f", F.round("expected_k", 2).alias("k"))


@query(observed("ku", "k", "s"))
def fit_uecm(spark, sf_dir):
    return fit(UECM.from_graph(succ_und(spark, sf_dir)).solve(maxiters=3000))


@query(observed("kd", "k_out", "k_in", "s_out", "s_in"))
def fit_decm(spark, sf_dir):
    return fit(DECM.from_graph(succ(spark, sf_dir)).solve(maxiters=3000))


@query(observed("ku", "s"))
def fit_crem(spark, sf_dir):
    return fit(CReM.from_graph(succ_und(spark, sf_dir)).solve(maxiters=5000)).groupBy("s").agg(F.sum("f").alias("f"))


@query(observed("kd", "s_out", "s_in"))
def fit_dcrem(spark, sf_dir):
    return fit(DCReM.from_graph(succ(spark, sf_dir)).solve(maxiters=5000)).groupBy("s_out", "s_in").agg(F.sum("f").alias("f"))


@query(observed("kr", "s_out", "s_in", "s_rec_out", "s_rec_in"))
def fit_crwcm(spark, sf_dir):
    return fit(CRWCM.from_graph(succ(spark, sf_dir)).solve(maxiters=5000)).groupBy("s_out", "s_in", "s_rec_out", "s_rec_in").agg(F.sum("f").alias("f"))


# Node accessors: what a fit expects of each node, by pairs of nodes
@query(SUCC + "SELECT id, CAST(k_out AS DOUBLE) AS k_out, CAST(k_in AS DOUBLE) AS k_in FROM kd")
def degrees_by_pairs_dbcm(spark, sf_dir):
    m = DBCM.from_graph(succ(spark, sf_dir)).solve(maxiters=5000)
    return rounded(m.expected_sequences("full"), 2, "k_out", "k_in").select("id", "k_out", "k_in")


@query(SUCC + "SELECT id, CAST(s_out AS DOUBLE) AS s_out, CAST(s_in AS DOUBLE) AS s_in FROM kd")
def strengths_by_classes_dcrem(spark, sf_dir):
    m = DCReM.from_graph(succ(spark, sf_dir)).solve(maxiters=5000)
    return rounded(m.expected_sequences(), 2, "s_out", "s_in").select("id", "s_out", "s_in")


@query(SUCC + "SELECT id, CAST(k AS DOUBLE) AS k FROM ku")
def degrees_by_pairs_ubcm(spark, sf_dir):
    return rounded(UBCM.from_graph(succ_und(spark, sf_dir)).solve().expected_sequences("full"), 2, "k").select("id", "k")


@query(SUCC + "SELECT round(count(back) / count(*), 6) AS reciprocity FROM r")
def expected_reciprocity_rbcm(spark, sf_dir):
    m = RBCM.from_graph(succ(spark, sf_dir)).solve(maxiters=5000)
    return spark.createDataFrame([(round(float(m.expectation("reciprocity")), 6),)], "reciprocity double")


@query(SUCC + "SELECT round(sum(CASE WHEN back IS NOT NULL THEN w ELSE 0 END) / sum(w), 5) AS weighted_reciprocity FROM r")
def expected_weighted_reciprocity_crwcm(spark, sf_dir):
    m = CRWCM.from_graph(succ(spark, sf_dir)).solve(maxiters=5000)
    return spark.createDataFrame([(round(float(m.expectation("weighted_reciprocity")), 5),)], "weighted_reciprocity double")


def scalars(spark: SparkSession, rows: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in rows.items()], "name string, value double")


# The likelihood at a given point has a plain SQL form
@query(SUCC + """, c AS (SELECT k, count(*) AS f, -ln(k) AS t FROM ku GROUP BY k)
SELECT round(-(SELECT sum(f * k * t) FROM c) - (SELECT sum(CASE WHEN a.k > b.k THEN a.f * b.f ELSE a.f * (a.f - 1) / 2.0 END * ln(1 + exp(-a.t - b.t))) FROM c a JOIN c b ON a.k >= b.k), 6) AS value""")
def likelihood_ubcm_at_start(spark, sf_dir):
    m = UBCM.from_graph(succ_und(spark, sf_dir))
    return scalars(spark, {"l": m.problem.loglikelihood(m.initial_guess("degrees"))}).select(F.round("value", 6).alias("value"))


@query(SUCC + """, c AS (SELECT k, count(*) AS f, -ln(k) AS t FROM ku GROUP BY k)
SELECT CAST(a.k AS DOUBLE) AS k, round(-ln(a.k / sum((b.f - CASE WHEN a.k = b.k THEN 1 ELSE 0 END) / (exp(b.t) + exp(-a.t)))), 9) AS theta FROM c a CROSS JOIN c b GROUP BY a.k""")
def fixed_point_step_ubcm(spark, sf_dir):
    m = UBCM.from_graph(succ_und(spark, sf_dir))
    step = m.problem.update(m.initial_guess("degrees"))
    return spark.createDataFrame([(float(k), float(t)) for k, t in zip(m.columns["k"], step)], "k double, theta double").withColumn("theta", F.round("theta", 9))


@query(SUCC + """, c AS (SELECT k_out, k_in, CAST(count(*) AS DOUBLE) AS f FROM kd GROUP BY 1, 2)
SELECT CAST(a.k_out AS DOUBLE) AS k_out, CAST(a.k_in AS DOUBLE) AS k_in, round(sum((b.f - CASE WHEN a.k_out = b.k_out AND a.k_in = b.k_in THEN 1 ELSE 0 END) * a.k_out * b.k_in / (1.0 + a.k_out * b.k_in)), 6) AS expected_out FROM c a CROSS JOIN c b GROUP BY 1, 2""")
def expected_degrees_dbcm_at_start(spark, sf_dir):
    m = DBCM.from_graph(succ(spark, sf_dir))
    e = m.problem.expected(m.initial_guess("degrees"))[: len(m)]
    return spark.createDataFrame([(float(a), float(b), float(x)) for a, b, x in zip(m.columns["k_out"], m.columns["k_in"], e)], "k_out double, k_in double, expected_out double").withColumn("expected_out", F.round("expected_out", 6))


# Information criteria, expectations and deviations (tested against published values)
@query()
def information_criteria(spark, sf_dir):
    und, dire = succ_und(spark, sf_dir), succ(spark, sf_dir)
    models = {"ubcm": UBCM.from_graph(und), "dbcm": DBCM.from_graph(dire), "rbcm": RBCM.from_graph(dire), "bicm": BiCM.from_graph(sup_cust(spark, sf_dir)), "crem": CReM.from_graph(und), "dcrem": DCReM.from_graph(dire), "crwcm": CRWCM.from_graph(dire)}
    rows = []
    for name, m in models.items():
        m.solve(maxiters=5000)
        rows.append((name, m.loglikelihood(), m.AIC(), m.AICc(), m.BIC(), m.constraint_residual(), m.constraint_residual(relative=True)))
    return spark.createDataFrame(rows, "model string, loglikelihood double, aic double, aicc double, bic double, residual double, relative_residual double")


CRITERIA = {
    "ubcm": ("(SELECT 1)", "(SELECT sum(k * ln(x)) FROM xn) - (SELECT sum(ln(1 - p)) / -2 FROM p)", "count(*) FROM ku", "count(*) * (count(*) - 1) / 2 FROM ku"),
}
CRITERIA_D = {"dbcm": ("(SELECT 1)", "(SELECT sum(k_out * ln(x) + k_in * ln(y)) FROM xn) + (SELECT sum(ln(1 - p)) FROM p)", "2 * count(*) FROM kd", "count(*) * (count(*) - 1) FROM kd")}
CRITERIA_B = {"bicm": ("(SELECT 1)", "(SELECT sum(k * ln(x)) FROM (SELECT * FROM xb UNION ALL SELECT * FROM xt)) - (SELECT sum(ln(1 + xb.x * xt.x)) FROM xb, xt)", "(SELECT count(*) FROM kb) + (SELECT count(*) FROM kt)", "(SELECT count(*) FROM kb) * (SELECT count(*) FROM kt)")}
TIGHT = {"maxiters": 20000, "ftol": 1e-12}


def criteria(name: str, m: Model) -> DataFrame:
    rows = [(name, m.loglikelihood(), m.AIC(), m.AICc(), m.BIC())]
    out = m.sequence.sparkSession.createDataFrame(rows, "model string, loglikelihood double, aic double, aicc double, bic double")
    return rounded(out, 4, "loglikelihood", "aic", "aicc", "bic")


@query(solved.ubcm(SUCC) + solved.criteria(CRITERIA))
def criteria_ubcm(spark, sf_dir):
    return criteria("ubcm", UBCM.from_graph(succ_und(spark, sf_dir)).solve(**TIGHT))


@query(solved.dbcm(SUCC) + solved.criteria(CRITERIA_D))
def criteria_dbcm(spark, sf_dir):
    return criteria("dbcm", DBCM.from_graph(succ(spark, sf_dir)).solve(**TIGHT))


@query(solved.bicm(BI) + solved.criteria(CRITERIA_B))
def criteria_bicm(spark, sf_dir):
    return criteria("bicm", BiCM.from_graph(sup_cust(spark, sf_dir)).solve(**TIGHT))


@query(solved.significance_ubcm(SUCC))
def significance_ubcm(spark, sf_dir):
    g = succ_und(spark, sf_dir)
    m = UBCM.from_graph(g).solve(**TIGHT)
    seen = wg.wedges(g).crossJoin(wg.triangles(g)).first()
    rows = [(x, float(seen[x]), m.expectation(x), m.sigma(x)) for x in ("wedges", "triangles")]
    out = spark.createDataFrame(rows, "metric string, obs double, mu double, sigma double").withColumn("z", F.when(F.col("sigma") > 0, (F.col("obs") - F.col("mu")) / F.col("sigma")))
    return rounded(out, 4, "mu", "sigma", "z")


@query(solved.significance_annd(SUCC))
def significance_annd(spark, sf_dir):
    g = succ_und(spark, sf_dir)
    m = UBCM.from_graph(g).solve(**TIGHT)
    mu, sigma = m.expectation("annd"), ex.neighbour_degree_deviation(m.pairs["p"], m.f, m.pairs["var"])
    table = spark.createDataFrame([(k + 1, float(a), float(b)) for k, (a, b) in enumerate(zip(mu, sigma))], "cls int, mu double, sigma double")
    out = seq.neighbour_degree(g).join(m.members.select("id", "cls"), "id").join(F.broadcast(table), "cls").select("id", F.col("annd").alias("obs"), "mu", "sigma", F.when(F.col("sigma") > 0, (F.col("annd") - F.col("mu")) / F.col("sigma")).alias("z"))
    return rounded(rounded(out, 4, "obs", "mu", "sigma"), 3, "z")


def triad_significance(spark, g: Graph, m: Model) -> DataFrame:
    mu = m.expectation("motifs")
    sigma = [m.sigma(f"M{k}") for k in wg.TRIADS] if "p_fwd" not in m.pairs else [None] * 13
    table = spark.createDataFrame([(k, float(e), s) for k, e, s in zip(wg.TRIADS, mu, sigma)], "motif int, mu double, sigma double")
    out = wg.triad_census(g).join(F.broadcast(table), "motif").select("motif", F.col("value").alias("obs"), "mu", "sigma", F.when(F.col("sigma") > 0, (F.col("value") - F.col("mu")) / F.col("sigma")).alias("z"))
    return rounded(out, 3, "obs", "mu", "sigma", "z")


@query(solved.triads(solved.dbcm(SUCC), triad_sql("count", 3), True))
def triad_significance_dbcm(spark, sf_dir):
    g = succ(spark, sf_dir)
    return triad_significance(spark, g, DBCM.from_graph(g).solve(**TIGHT))


@query(solved.triads(solved.rbcm(SUCC), triad_sql("count", 3), False))
def triad_expectation_rbcm(spark, sf_dir):
    g = succ(spark, sf_dir)
    return triad_significance(spark, g, RBCM.from_graph(g).solve(**TIGHT))


@query()
def flux_expectation_dcrem(spark, sf_dir):
    g = succ(spark, sf_dir)
    mu = DCReM.from_graph(g).solve(maxiters=5000).expectation("fluxes")
    table = spark.createDataFrame([(k, float(e)) for k, e in zip(wg.TRIADS, mu)], "motif int, mu double")
    return wg.triad_census(g, "flux").join(F.broadcast(table), "motif").select("motif", F.col("value").alias("obs"), "mu")


@query(solved.squares_ubcm(SUCC))
def squares_expectation(spark, sf_dir):
    m = UBCM.from_graph(succ_und(spark, sf_dir)).solve(**TIGHT)
    return rounded(scalars(spark, {x: m.expectation(x) for x in ("edges", "wedges", "triangles", "squares")}), 2, "value")


@query(solved.reciprocity_dbcm(SUCC))
def reciprocity_dbcm(spark, sf_dir):
    m = DBCM.from_graph(succ(spark, sf_dir)).solve(**TIGHT)
    return rounded(scalars(spark, {"expected": m.expectation("reciprocity"), "sigma": m.sigma("reciprocity")}), 7, "value")


@query(solved.vn(BI))
def vn_expectation(spark, sf_dir):
    m = BiCM.from_graph(sup_cust(spark, sf_dir)).solve(**TIGHT)
    rows = [(layer, n, how, *map(float, projection.expected_vn(m, n, layer, how))) for layer in ("bottom",) for n in (2, 3) for how in ("exact", "delta")]
    return rounded(spark.createDataFrame(rows, "layer string, n int, method string, mu double, sigma double"), 4, "mu", "sigma")


@query(BI + "SELECT x.bottom AS src, y.bottom AS dst, CAST(count(*) AS BIGINT) AS w FROM b x JOIN b y ON x.top = y.top AND x.bottom < y.bottom GROUP BY 1, 2")
def tested_pairs(spark, sf_dir):
    """All pairs that the validated projection tests (its p-values are checked by tests)."""
    m = BiCM.from_graph(sup_cust(spark, sf_dir)).solve(maxiters=5000)
    return projection.validated_projection(m, all_pairs=True).where("p between 0 and 1 and p_adjusted >= p").select("src", "dst", "w")


def tested(spark, sf_dir, distribution: str) -> DataFrame:
    m = BiCM.from_graph(sup_cust(spark, sf_dir)).solve(**TIGHT)
    out = projection.validated_projection(m, distribution=distribution, alpha=0.05, all_pairs=True)
    return rounded(rounded(out.select("src", "dst", "w", "p", "p_adjusted"), 7, "p"), 6, "p_adjusted")


@query(solved.projection(BI, False))
def validated_projection(spark, sf_dir):
    """Every tested pair with its chance: the ones below a level are the validated projection at this level."""
    return tested(spark, sf_dir, "poisson")


@query(solved.projection(BI, True))
def validated_projection_exact(spark, sf_dir):
    return tested(spark, sf_dir, "poisson_binomial")


# Samples
def of_sample(model: type[Model], directed: bool):
    def run(spark, sf_dir):
        g = succ(spark, sf_dir) if directed else succ_und(spark, sf_dir)
        return sampling.sample(model.from_graph(g).solve(maxiters=5000), 3, seed=7)

    run.__name__ = f"sample_{model.__name__.lower()}"
    return run


for _model, _directed in ((UBCM, False), (DBCM, True), (RBCM, True), (UECM, False), (DECM, True), (CReM, False), (DCReM, True), (CRWCM, True)):
    query()(of_sample(_model, _directed))


@query()
def sample_bicm(spark, sf_dir):
    return sampling.sample(BiCM.from_graph(sup_cust(spark, sf_dir)).solve(maxiters=5000), 3, seed=7)


def kept_sums(name: str, m: Model, links: float, weight: float | None = None, n: int = 8) -> tuple:
    """Whether the mean number of links of n samples is within six deviations of what the model keeps (at most two links a pair, so
    twice the number of links bounds the variance), and their mean weight within a tenth."""
    s = sampling.sample(m, n, seed=11)
    got = s.agg(F.count("*").alias("l"), F.count_distinct(F.struct(*s.columns[:3])).alias("d"), *([F.sum("w").alias("w")] if weight else [])).first()
    close = got["l"] == got["d"] and abs(got["l"] / n - links) <= 6 * (2 * links / n) ** 0.5
    return name, int(links), bool(close and (not weight or abs(got["w"] / n / weight - 1) <= 0.1))


def of_kinds(*kinds: type[Model]):
    """Samples of models of the successor graph reproduce its links and weight."""

    def run(spark, sf_dir):
        dire = from_edges(stored(succ(spark, sf_dir).edges, "links"), True, weight="w")
        und = dire.undirected()
        rows = []
        for model in kinds:
            g = und if model in (UBCM, UECM, CReM) else dire
            links, weight = (float(x) for x in g.edges.agg(F.count("*"), F.sum("w")).first())
            m = model.from_graph(g).solve(maxiters=5000)
            rows.append(kept_sums(model.__name__.lower(), m, links, weight if m.weighted else None))
        return spark.createDataFrame(rows, "model string, links long, kept boolean")

    run.__name__ = "samples_keep_sums_" + "_".join(k.__name__.lower() for k in kinds)
    both = [f"SELECT '{k.__name__.lower()}' AS model, CAST(count(*) AS BIGINT) AS links, TRUE AS kept FROM {'u' if k in (UBCM, UECM, CReM) else 'e'}" for k in kinds]
    return query(SUCC + " UNION ALL ".join(both))(run)


of_kinds(UBCM, DBCM, RBCM)
of_kinds(CReM, DCReM, CRWCM)
of_kinds(UECM, DECM)


@query(BI + "SELECT 'bicm' AS model, CAST(count(*) AS BIGINT) AS links, TRUE AS kept FROM b")
def samples_keep_sums_bicm(spark, sf_dir):
    g = bipartite(stored(sup_cust(spark, sf_dir).edges, "links"))
    return spark.createDataFrame([kept_sums("bicm", BiCM.from_graph(g).solve(maxiters=5000), float(g.edges.count()))], "model string, links long, kept boolean")


@query()
def triad_zscores_by_sampling(spark, sf_dir):
    g = networks.maspalomas(spark)
    return sampling.ensemble_zscores(DBCM.from_graph(g).solve(), wg.triad_metric(), 50, seed=1)


@query()
def flux_zscores_by_sampling(spark, sf_dir):
    g = networks.rhesus_macaques(spark)
    return sampling.ensemble_zscores(DCReM.from_graph(g).solve(maxiters=3000), wg.triad_metric("flux"), 30, seed=1)


# Numeric helpers
P = "SELECT o_orderkey, (o_totalprice - (SELECT min(o_totalprice) FROM orders)) / (SELECT max(o_totalprice) - min(o_totalprice) FROM orders) AS p FROM orders"


def p_values(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    span = o.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    return o.crossJoin(F.broadcast(span)).select("o_orderkey", ((F.col("o_totalprice") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("p"))


def adjusted(method: str):
    def run(spark, sf_dir):
        out = numeric.adjusted(p_values(spark, sf_dir), method=method)
        return rounded(out.select("o_orderkey", "p_adjusted"), 8, "p_adjusted")

    run.__name__ = f"adjust_{method}"
    return run


_RANKED = f"WITH p AS ({P}), r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p) AS rn FROM p)"
_UP = "round(least(1, min({x}) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) + 0.0"
query(f"{_RANKED} SELECT o_orderkey, {_UP.format(x='p * m / rn')} AS p_adjusted FROM r")(adjusted("bh"))
query(f"{_RANKED} SELECT o_orderkey, {_UP.format(x='p * m * (SELECT sum(1.0 / i) FROM range(1, (SELECT count(*) + 1 FROM orders)) t(i)) / rn')} AS p_adjusted FROM r")(adjusted("by"))
query(f"{_RANKED} SELECT o_orderkey, round(least(1, p * m), 8) + 0.0 AS p_adjusted FROM r")(adjusted("bonferroni"))
query(f"{_RANKED} SELECT o_orderkey, round(least(1, max(p * (m - rn + 1)) OVER (ORDER BY rn)), 8) + 0.0 AS p_adjusted FROM r")(adjusted("holm"))


@query("""SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) ELSE -1 END, 9) AS l, round(greatest(c_acctbal / 1000, 0) + ln(1 + exp(-abs(c_acctbal / 1000))), 9) AS s,
round(ln(1 + exp(c_nationkey / 10.0) + exp(c_acctbal / 1000) + exp(0.5)), 9) AS t, round(c_nationkey * (c_nationkey - 1) * (c_nationkey - 2) / 6.0, 6) AS b,
round(CASE WHEN c_nationkey < 2 THEN 0.0 ELSE 1.0 / c_nationkey + 1.0 / (c_nationkey - 1) END, 9) AS h FROM customer""")
def numeric_helpers(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    n, x = F.col("c_nationkey").cast("double"), F.col("c_acctbal") / 1000
    log = numeric.log_nan(F.col("c_acctbal"))
    out = c.select("c_custkey", F.when(F.isnan(log), F.lit(-1.0)).otherwise(log).alias("l"), numeric.softplus(x).alias("s"), numeric.log1pexpsum(n / 10, x, F.lit(0.5)).alias("t"), numeric.binomial(n, 3).alias("b"), numeric.harmonic_difference(F.when(n < 2, F.lit(1.0)).otherwise(n), 2).alias("h"))
    return rounded(rounded(out, 9, "l", "s", "t", "h"), 6, "b")


@query("""SELECT l_quantity, round(1 - list_sum([exp(-l_quantity / 4) * pow(l_quantity / 4, i) / factorial(CAST(i AS INT)) FOR i IN range(0, CAST(l_quantity AS BIGINT) // 3 + 1)]), 7) + 0.0 AS tail
FROM (SELECT DISTINCT l_quantity FROM lineitem)""")
def poisson_tails(spark, sf_dir):
    q = read(spark, sf_dir, "lineitem").select("l_quantity").distinct()
    k = F.floor(F.col("l_quantity").cast("long") / 3) + 1
    return rounded(q.select("l_quantity", numeric.poisson_tail(k, F.col("l_quantity") / 4).alias("tail")), 7, "tail")


# Tails of sums of independent trials of unequal chances: nations of a region with a customer share, at least two of them
TRIALS = "SELECT n_regionkey AS region, (n_nationkey + 1) / 30.0 AS p FROM nation"


@query(f"WITH t AS ({TRIALS}) SELECT region, round(1 - exp(sum(ln(1 - p))), 9) AS one, round(1 - exp(sum(ln(1 - p))) * (1 + sum(p / (1 - p))), 9) AS two, round(exp(sum(ln(p))), 9) AS every FROM t GROUP BY region")
def poisson_binomial_tails(spark, sf_dir):
    t = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.collect_list((F.col("n_nationkey") + 1) / 30.0).alias("p"))
    tail = lambda k: numeric.poisson_binomial_tail(k, F.col("p"))
    return rounded(t.select("region", tail(F.lit(1)).alias("one"), tail(F.lit(2)).alias("two"), tail(F.size("p")).alias("every")), 9, "one", "two", "every")
