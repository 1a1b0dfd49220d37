import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nullweave.errors import DomainError, ModelWarning, StateError
from nullweave.functions import numeric
from nullweave.graph import Graph, bipartite, from_edges, successors, two_coloured
from nullweave.models import expectations as ex
from nullweave.models import blocks, kernels, model, projection, sampling, solvers
from nullweave.models.model import BiCM, CRWCM, CReM, DBCM, DCReM, DECM, RBCM, UBCM, UECM
from nullweave.operators import bipartite as bip
from nullweave.operators import sequences as seq
from nullweave.operators import whole_graph as wg
from nullweave.sources import networks
from nullweave.sources.readers import read_konect, read_pajek

pytestmark = pytest.mark.filterwarnings("ignore::nullweave.errors.ModelWarning")


def column(df, name, key="id"):
    return [r[name] for r in df.orderBy(key).collect()]


@pytest.fixture(scope="module")
def four(spark):
    return from_edges(spark.createDataFrame([(1, 2, 2.5), (2, 1, 1.0), (2, 3, 3.0), (4, 3, 4.0)], "src long, dst long, w double"), True, spark.range(1, 5), weight="w")


@pytest.fixture(scope="module")
def karate(spark):
    rows = [(k, d) for k, d in enumerate(networks.KARATE_DEGREES, 1)]
    return UBCM(spark.createDataFrame(rows, "id long, k long")).solve()


@pytest.fixture(scope="module")
def club(spark):
    return BiCM.from_graph(networks.corporate_club(spark)).solve()


def test_hand_values(four):
    r = seq.reciprocal_degrees(four)
    assert [column(r, c) for c in ("k_out", "k_in", "k_rec")] == [[0, 1, 0, 1], [0, 0, 2, 0], [1, 1, 0, 0]]
    s = seq.reciprocal_strengths(four)
    assert [column(s, c) for c in ("s_out", "s_in", "s_rec_out", "s_rec_in")] == [[0, 3, 0, 4], [0, 0, 7, 0], [2.5, 1, 0, 0], [1, 2.5, 0, 0]]
    got = wg.reciprocity(four).first()
    assert got.reciprocity == 0.5 and math.isclose(got.weighted_reciprocity, 3.5 / 10.5)
    assert column(seq.strengths(four), "s_out") == [2.5, 4, 0, 4]
    with pytest.raises(ValueError):
        seq.strengths(four, "up")
    with pytest.raises(ValueError):
        seq.neighbour_degree(four)


def test_rhesus_goldens(spark):
    g = networks.rhesus_macaques(spark)
    got = wg.reciprocity(g).first()
    assert math.isclose(got.reciprocity, 0.7567567567567568) and math.isclose(got.weighted_reciprocity, 0.8995363214837713)
    s = seq.reciprocal_strengths(g).where("id = 6").first()
    assert (s.s_out, s.s_in, s.s_rec_out, s.s_rec_in) == (19, 0, 20, 30)
    model = DBCM.from_graph(g).solve()
    assert abs(model.expectation("reciprocity") - 0.561) < 5e-4


def test_karate_goldens(karate):
    assert math.isclose(karate.loglikelihood(), -168.68325136302832, rel_tol=1e-9)
    assert math.isclose(karate.AICc(), 409.891217554954, rel_tol=1e-9) and math.isclose(karate.BIC(), 552.5770135138283, rel_tol=1e-9)
    assert np.allclose(karate.theta[:3], [2.85165990590, 2.05300837457, 1.54326395139], atol=1e-7)
    assert math.isclose(karate.expectation("edges"), 78, rel_tol=1e-8) and abs(karate.sigma("edges") - 7.095) < 1e-3
    assert math.isclose(karate.expectation("wedges"), 528.0000011, rel_tol=1e-7)
    assert math.isclose(karate.expectation("triangles"), 52.849301, rel_tol=1e-6)
    assert math.isclose(karate.expectation("squares"), 45.644737, rel_tol=1e-6)
    assert karate.constraint_residual() < 1e-6 and "34 nodes" in repr(karate) and len(karate) == 11
    p = karate.parameters()
    assert p.columns == ["cls", "f", "k", "theta_k"] and p.count() == 11


def test_classes(spark):
    rows = spark.createDataFrame(list(enumerate(networks.KARATE_DEGREES, 1)), "id long, k long")
    c = seq.classes(rows, "k").orderBy("cls").collect()
    assert [(r.k, r.first, r.f) for r in c][:3] == [(1, 12, 1), (2, 10, 11), (3, 5, 6)]
    back = seq.class_of(rows, seq.classes(rows, "k"), "k")
    assert back.count() == 34


def test_club_goldens(spark, club):
    assert math.isclose(club.AICc(), 432.12227535579956, rel_tol=1e-8) and math.isclose(club.BIC(), 579.3789571131789, rel_tol=1e-8)
    assert abs(projection.expected_v_motifs(club, "bottom") - 449.257) < 1e-3 and abs(projection.expected_v_motifs(club, "⊤") - 180.257) < 1e-3
    assert abs(projection.expected_v_motif(club, 16, 13) - 3.385653) < 1e-6
    top = [r.id for r in club.graph.tops.orderBy("id").collect()]
    assert abs(projection.expected_v_motif(club, top[4], top[0], "top") - 9.469880) < 1e-6
    assert abs(projection.expected_vn(club, 3, "top")[1] - 70.311) < 0.7 and abs(projection.vn_zscore(club, 3, "top") + 1.2506) < 0.013
    for layer, edges in (("bottom", 259), ("top", 66)):
        assert bip.project(club.graph, layer, "simple").count() == edges
        for kind in ("poisson", "poisson_binomial"):
            assert projection.validated_projection(club, layer, distribution=kind).count() == 0
    assert projection.validated_projection(club, "bottom", alpha=0.9).count() == 255
    assert club.constraint_residual() < 1e-6
    with pytest.raises(ValueError):
        bip.project(club.graph, "left")


def test_small_bipartite(spark):
    g = bipartite(spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)], "bottom long, top long"))
    assert bip.v_motifs(g, "bottom").first()[0] == 4 and bip.v_motifs(g, "top").first()[0] == 2
    assert bip.vn_motifs(g, 3, "bottom").first()[0] == 1.0 and bip.v_motif(g, 1, 2).first()[0] == 2
    with pytest.raises(DomainError):
        BiCM.from_graph(g)
    two_coloured_graph = from_edges(spark.createDataFrame([(1, 4), (2, 4), (2, 5), (3, 5)], "src long, dst long"), False)
    b = two_coloured(two_coloured_graph)
    assert {r.id for r in b.bottoms.collect()} in ({1, 2, 3}, {4, 5})
    with pytest.raises(ValueError):
        two_coloured(from_edges(spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "src long, dst long"), False))


@pytest.mark.parametrize("order", ["ids in order", "ids mixed"])
def test_two_colouring_of_long_paths_and_rings(spark, order):
    """Far more hops than rounds; parts of all kinds; one odd ring anywhere is found."""
    name = (lambda k: k) if order == "ids in order" else (lambda k: k * 7919 % 10007)
    path = [(name(k), name(k + 1)) for k in range(500)]
    ring = [(name(2000 + k), name(2000 + (k + 1) % 400)) for k in range(400)]
    star = [(name(5000), name(5001 + k)) for k in range(50)]
    b = two_coloured(from_edges(spark.createDataFrame(path + ring + star, "src long, dst long"), False))
    low, high = ({r.id for r in x.collect()} for x in (b.bottoms, b.tops))
    assert len(low) + len(high) == 501 + 400 + 51 and not low & high
    for part in (path, ring, star):
        nodes = {x for e in part for x in e}
        assert min(nodes) in low and all((x in low) != (y in low) for x, y in part)
    assert b.edges.count() == len(path + ring + star) and b.edges.join(b.bottoms, b.edges.bottom == b.bottoms.id).count() == b.edges.count()
    odd = [(name(8000 + k), name(8000 + (k + 1) % 301)) for k in range(301)]
    with pytest.raises(ValueError):
        two_coloured(from_edges(spark.createDataFrame(path + odd, "src long, dst long"), False))


def test_samples_draw_links_not_pairs(spark):
    """100,000 nodes: no cross join in the plan, and as many links as expected, all distinct and none to itself."""
    seq = spark.range(100_000).select("id", F.when(F.col("id") % 1000 == 0, 300).otherwise(1 + F.col("id") % 7).cast("long").alias("k"))
    m = UBCM(seq).solve()
    s = sampling.sample(m, 2, seed=5)
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    n, distinct, wrong = s.agg(F.count("*"), F.countDistinct("sample_id", "src", "dst"), F.sum((F.col("src") >= F.col("dst")).cast("int"))).first()
    assert n == distinct and not wrong and abs(n / 2 - m.expectation("edges")) < 6 * m.sigma("edges") / math.sqrt(2)
    k = s.select("sample_id", F.explode(F.array("src", "dst")).alias("id")).groupBy("id").count().where("id % 1000 = 0").agg(F.avg("count")).first()[0]
    assert abs(k / 2 - 300) < 6


def test_numbers_of_pairs():
    a, b = sampling.unordered(np.arange(10_000))
    assert [(int(x), int(y)) for x, y in zip(a, b)] == [(x, y) for y in range(1, 142) for x in range(y)][:10_000]
    far = np.array([2**52 - 1, 2**52, 2**52 + 1])
    a, b = sampling.unordered(far)
    assert (b * (b - 1) // 2 + a == far).all() and (a < b).all() and (a >= 0).all()


def random_digraph(n, p, seed):
    rnd = random.Random(seed)
    return {(i, j): rnd.randint(1, 9) for i in range(n) for j in range(n) if i != j and rnd.random() < p}


def brute_triads(w, n, kind):
    state = lambda i, j: {(1, 0): "P", (0, 1): "Q", (1, 1): "R", (0, 0): "Z"}[((i, j) in w), ((j, i) in w)]
    out = dict.fromkeys(wg.TRIADS, 0.0)
    code = {c: m for m, c in wg.TRIADS.items()}
    for i, j, k in itertools.permutations(range(n), 3):
        m = code.get(state(i, j) + state(j, k) + state(k, i))
        if m is None:
            continue
        weights = []
        for c, (a, b) in zip(wg.TRIADS[m], ((i, j), (j, k), (k, i))):
            weights += [w[a, b]] if c == "P" else [w[b, a]] if c == "Q" else [w[a, b], w[b, a]] if c == "R" else []
        out[m] += {"count": 1, "flux": sum(weights), "intensity": math.prod(weights) ** (1 / len(weights))}[kind]
    return out


@pytest.mark.parametrize("kind", ["count", "flux", "intensity"])
def test_triads(spark, kind):
    w = random_digraph(14, 0.35, 7)
    g = from_edges(spark.createDataFrame([(i, j, v) for (i, j), v in w.items()], "src long, dst long, w long"), True, spark.range(14), weight="w")
    got = {r.motif: r.value for r in wg.triad_census(g, kind).collect()}
    want = brute_triads(w, 14, kind)
    assert all(math.isclose(got[m], want[m], rel_tol=1e-9, abs_tol=1e-9) for m in want)
    if kind == "count":
        links = g.edges.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("sample_id"), "src", "dst")
        many = wg.triad_metric()(links)
        assert {(r.sample_id, r.key): r.value for r in many.collect()} == {(s, f"M{m}"): v for s in range(3) for m, v in want.items() if v}


def test_undirected_metrics(spark):
    rnd = random.Random(4)
    n = 16
    e = {(i, j) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.35}
    a = np.zeros((n, n))
    for i, j in e:
        a[i, j] = a[j, i] = 1
    g = from_edges(spark.createDataFrame(sorted(e), "src long, dst long"), False, spark.range(n))
    assert wg.triangles(g).first()[0] == round(np.trace(a @ a @ a) / 6)
    k = a.sum(1)
    assert wg.wedges(g).first()[0] == (k * (k - 1) / 2).sum()
    sq = sum(a[i, j] * a[j, m] * a[m, x] * a[x, i] * (1 - a[i, m]) * (1 - a[j, x]) for i, j, m, x in itertools.permutations(range(n), 4)) / 8
    assert wg.squares(g).first()[0] == round(sq)
    assert np.allclose(column(seq.neighbour_degree(g), "annd"), np.where(k > 0, a @ k / np.maximum(k, 1), 0))
    f = np.ones(n)
    assert math.isclose(ex.triangles(a, f), np.trace(a @ a @ a) / 6) and math.isclose(ex.squares(a, f), sq) and math.isclose(ex.wedges(a, f), (k * (k - 1) / 2).sum())


def test_gradients():
    rnd = np.random.default_rng(1)
    f = np.ones(7)
    p = rnd.random((7, 7))
    np.fill_diagonal(p, 0)
    value = {"reciprocity": ex.reciprocity} | {f"M{m}": (lambda q, f, m=m: ex.motifs({"p": q}, f)[m - 1]) for m in wg.TRIADS}
    for name, fn in value.items():
        g = ex.gradient(name, p, f)
        for i, j in ((0, 1), (3, 2), (6, 4)):
            q = p.copy()
            q[i, j] += 1e-6
            assert math.isclose((fn(q, f) - fn(p, f)) / 1e-6, g[i, j], rel_tol=1e-3, abs_tol=1e-4), name
    s = (p + p.T) / 2
    for name, fn in (("wedges", ex.wedges), ("triangles", ex.triangles)):
        g = ex.gradient(name, s, f)
        q = s.copy()
        q[1, 2] += 1e-6
        q[2, 1] += 1e-6
        assert math.isclose((fn(q, f) - fn(s, f)) / 1e-6, g[1, 2] + g[2, 1], rel_tol=1e-4)
    var = s * (1 - s)
    sigma = ex.neighbour_degree_deviation(s, f, var)
    total = np.zeros(7)
    for i, j in itertools.combinations(range(7), 2):
        q = s.copy()
        q[i, j] += 1e-6
        q[j, i] += 1e-6
        total += var[i, j] * ((ex.neighbour_degree(q, f) - ex.neighbour_degree(s, f)) / 1e-6) ** 2
    assert np.allclose(sigma, np.sqrt(total), rtol=1e-3)


CASES = [(UBCM, None), (DBCM, None), (RBCM, None), (UECM, None), (DECM, None), (CReM, None), (DCReM, None), (CRWCM, None)]


@pytest.mark.parametrize("model", [c for c, _ in CASES])
def test_models_keep_their_constraints(spark, model):
    g = networks.rhesus_macaques(spark)
    g = g.undirected() if model in (UBCM, UECM, CReM) else g
    m = model.from_graph(g).solve(maxiters=3000)
    assert m.constraint_residual(relative=True) < 1e-4
    e = m.expected().toPandas()
    for k in m.problem.channels:
        assert np.allclose(e[k], e[f"expected_{k}"], rtol=1e-4, atol=1e-6)
    full, reduced = (m.expected_sequences(x).orderBy("id").toPandas() for x in ("full", "reduced"))
    for c in [c for c in full.columns if c != "id"]:
        assert np.allclose(full[c], reduced[c], rtol=1e-6)
    s = sampling.sample(m, 40, seed=3)
    mean = s.count() / 40
    assert abs(mean - m.expectation("edges")) < 5 * m.sigma("edges" if not m.problem.directed else "links") / math.sqrt(40) + 1e-9
    if m.weighted:
        weight = s.agg(F.sum("w")).first()[0] / 40
        want = ex.edges(m.pairs["w"], m.f, m.problem.directed)
        spread = m.sigma("edges" if not m.problem.directed else "links", "weighted")
        assert abs(weight - want) < 5 * spread / math.sqrt(40)
    again = sampling.sample(m, 2, seed=3).repartition(7)
    assert {tuple(r)[:3] for r in again.collect()} == {tuple(r)[:3] for r in s.where("sample_id < 2").collect()}


@pytest.mark.parametrize("method", ["BFGS", "L-BFGS", "Newton"])
def test_solvers_agree(spark, karate, method):
    m = UBCM(karate.sequence).solve(method)
    assert np.allclose(m.theta, karate.theta, atol=1e-5)
    g = networks.maspalomas(spark)
    a, b = DBCM.from_graph(g).solve(), DBCM.from_graph(g).solve(method)
    assert np.allclose(a.pairs["p"], b.pairs["p"], atol=1e-5)


def test_kernels_far_out():
    """Extreme multipliers, on the way of a solver: finite likelihoods, chances within [0, 1]."""
    from nullweave.models import kernels

    f, k = np.array([3.0, 2.0, 1.0]), np.array([1.0, 2.0, 4.0])
    for kernel, columns in ((kernels.UBCM, {"k": k}), (kernels.DBCM, {"k_out": k, "k_in": k}), (kernels.RBCM, {"k_out": k, "k_in": k, "k_rec": k})):
        p = kernel(columns, f)
        with np.errstate(over="ignore", invalid="ignore"):
            for u in (-360.0, -30.0, 0.0, 400.0):
                at = np.full(len(p.flat), u)
                assert np.isfinite(p.loglikelihood(at)) and np.isfinite(p.expected(np.full(len(p.flat), max(u, -340.0)))).all()
        for u in (0.3, -2.0):
            at = u + 0.1 * np.arange(len(p.flat))
            x = np.exp(-at).reshape(len(p.channels), 3)
            pairs = {"UBCM": lambda: np.outer(x[0], x[0]), "DBCM": lambda: np.outer(x[0], x[1]), "RBCM": lambda: np.outer(x[0], x[1]) + np.outer(x[1], x[0]) + np.outer(x[2], x[2])}[kernel.__name__]()
            each = np.log1p(pairs)
            total = (f @ each @ f - f @ np.diagonal(each)) / (1 if p.directed and kernel is kernels.DBCM else 2)
            assert np.isclose(p.loglikelihood(at), -(np.tile(f, len(p.channels)) * p.flat) @ at - total)
    m = kernels.UBCM({"k": k}, f)
    with np.errstate(over="ignore"):
        assert (m.pairs(np.full(3, -400.0))["p"] == 1).all() and (m.pairs(np.full(3, 400.0))["p"] == 0).all()


def test_starts(spark, karate):
    for kind in ("degrees", "degrees_minor", "random", "uniform", "chung_lu"):
        assert np.allclose(UBCM(karate.sequence).solve(initial=kind).theta, karate.theta, atol=1e-6)
    with pytest.raises(ValueError):
        UBCM(karate.sequence).solve(initial="none")


def test_motif_zscores_chesapeake(spark):
    g = networks.chesapeake_bay(spark)
    m = DBCM.from_graph(g).solve()
    observed = [r.value for r in wg.triad_census(g).orderBy("motif").collect()]
    want = brute_triads({(r.src, r.dst): 1 for r in g.edges.collect()}, 40, "count")  # the self loop of node 19 is left out
    assert observed == [want[m] for m in wg.TRIADS]
    z = [(o - e) / m.sigma(f"M{k}") for k, (o, e) in enumerate(zip(observed, m.expectation("motifs")), 1)]
    assert abs(z[8] + 3.12) < 0.05 and abs(z[4] + 2.0) < 0.05
    zs = {r.key: r for r in sampling.ensemble_zscores(m, wg.triad_metric(), 30).collect()}
    assert zs["M1"].obs == observed[0] and abs(zs["M1"].mu - m.expectation("motifs")[0]) < 5 * zs["M1"].sigma / math.sqrt(30)
    with pytest.raises(ValueError):
        sampling.ensemble_zscores(m, wg.triad_metric(), 1)


def test_dead_and_degenerate(spark):
    g = networks.taro_exchange(spark)
    m = RBCM.from_graph(g).solve()
    assert m.constraint_residual() < 1e-6 and np.all(m.pairs["p_fwd"] == 0)
    m = RBCM.from_graph(networks.maspalomas(spark)).solve()
    assert m.constraint_residual() < 1e-6 and math.isclose(m.expectation("reciprocity"), 10 / 82 * 2 / 2, rel_tol=1e-6)


def test_validation(spark, karate):
    make = lambda rows, s: spark.createDataFrame(rows, s)
    with pytest.raises(ValueError):
        UBCM(make([(1, 1)], "id long, k long"))
    with pytest.raises(DomainError):
        UBCM(make([(1, 2), (2, 1)], "id long, k long"))
    with pytest.raises(DomainError):
        UBCM(make([(1, -1), (2, 1), (3, 1)], "id long, k long"))
    with pytest.raises(DomainError):
        UECM(make([(1, 1, 1.5), (2, 1, 1.5), (3, 1, 1.0)], "id long, k long, s double"))
    with pytest.raises(DomainError):
        RBCM(make([(1, 1, 0, 1), (2, 0, 1, 0), (3, 0, 0, 0)], "id long, k_out long, k_in long, k_rec long"))
    with pytest.raises(DomainError):
        CReM(make([(k, 2, s) for k, s in enumerate([3.0, 5.0, 4.0, 0.0])], "id long, k long, s double")).solve()
    with pytest.raises(StateError):
        UBCM(karate.sequence).expected()
    with pytest.warns(ModelWarning):
        UBCM(make([(1, 1), (2, 1), (3, 0)], "id long, k long"))
    with pytest.warns(ModelWarning):
        UBCM(karate.sequence).solve("BFGS", ftol=1e-6)


def test_sigma_of_gradient(spark):
    m = RBCM.from_graph(networks.maspalomas(spark)).solve()
    d = m.dyads()
    got = m.sigma_of_gradient(d.select("i", "j", F.lit(1.0).alias("g"))).first()[0]
    assert math.isclose(got, m.sigma("links"), rel_tol=1e-9)


def test_planted_projection(spark):
    rows = [(b, t) for b in (1, 2, 3) for t in range(1, 11)] + [(b, (7 * b + 13 * k) % 100 + 1) for b in range(4, 25) for k in range(3)]
    m = BiCM.from_graph(bipartite(spark.createDataFrame(rows, "bottom long, top long"), tops=spark.range(1, 101))).solve()
    for kind in ("poisson", "poisson_binomial"):
        assert {(1, 2), (1, 3), (2, 3)} <= {(r.src, r.dst) for r in projection.validated_projection(m, distribution=kind).collect()}


def test_numeric(spark):
    from nullweave.functions.numeric import adjusted

    rnd = random.Random(0)
    ps = [rnd.random() ** rnd.choice([1, 3, 8]) for _ in range(300)] + [0.0, 1.0, 0.5, 0.5, 0.5]
    df = spark.createDataFrame([(k, p) for k, p in enumerate(ps)] + [(999, None)], "id long, p double")
    m, order = len(ps), sorted(ps)
    last = {p: k + 1 for k, p in enumerate(order)}
    first = {p: m - k for k, p in reversed(list(enumerate(order)))}
    bh = {p: min(1, min(q * m / last[q] for q in ps if q >= p)) for p in ps}
    harmonic = sum(1 / k for k in range(1, m + 1))
    want = {"bh": bh, "by": {p: min(1, min(q * m * harmonic / last[q] for q in ps if q >= p)) for p in ps}, "bonferroni": {p: min(1, p * m) for p in ps}, "holm": {p: min(1, max(q * first[q] for q in ps if q <= p)) for p in ps}, "none": {p: p for p in ps}}
    for method, values in want.items():
        got = adjusted(df, method=method).collect()
        assert len(got) == len(ps) + 1
        for r in got:
            assert (r.p is None and r.p_adjusted is None) or math.isclose(r.p_adjusted, values[r.p], rel_tol=1e-9, abs_tol=1e-300), method
    x = spark.createDataFrame([(0.0, 3, 2.5, [0.2, 0.5, 0.9]), (-1.0, 0, 0.3, [0.1]), (math.e, 1, 7.0, [])], "x double, k long, r double, q array<double>")
    got = x.select(numeric.log_nan(F.col("x")).alias("l"), numeric.softplus(F.col("x")).alias("s"), numeric.poisson_tail(F.col("k"), F.col("r")).alias("t"), numeric.poisson_binomial_tail(F.col("k"), F.col("q")).alias("b"), numeric.log1pexpsum(F.col("x"), F.col("r"), F.lit(0.0)).alias("m"), numeric.binomial(F.col("r"), 2).alias("c"), numeric.harmonic_difference(F.col("r"), 2).alias("h")).collect()
    assert math.isnan(got[0].l) and math.isnan(got[1].l) and math.isclose(got[2].l, 1)
    assert math.isclose(got[0].s, math.log(2)) and math.isclose(got[0].m, math.log(2 + 1 + math.exp(2.5)))
    assert math.isclose(got[0].t, 1 - math.exp(-2.5) * (1 + 2.5 + 2.5**2 / 2)) and got[1].t == 1 and math.isclose(got[2].t, 1 - math.exp(-7))
    assert math.isclose(got[0].b, 0.09) and got[1].b == 1 and got[2].b == 0
    assert math.isclose(got[0].c, 2.5 * 1.5 / 2) and got[1].c == 0 and math.isclose(got[0].h, 1 / 2.5 + 1 / 1.5)
    u = spark.range(20000).select(numeric.uniform(1, F.col("id")).alias("u")).agg(F.avg("u"), F.stddev("u")).first()
    assert abs(u[0] - 0.5) < 0.01 and abs(u[1] - 0.2887) < 0.01


def test_readers(spark, tmp_path):
    f = tmp_path / "out.net"
    f.write_text("% asym posweighted\n% 3 4 4\n1 2 2.5\n2 1 1\n4 3 4.0\n")
    g = read_konect(spark, f"file://{f}")
    assert g.directed and g.weighted and g.n_nodes == 4 and g.edges.count() == 3
    f.write_text("% bip unweighted\n% 3 2 2\n1 1\n1 2 \n2 2\n")
    b = read_konect(spark, f"file://{f}")
    assert {tuple(r) for r in b.edges.collect()} == {(1, 3), (1, 4), (2, 4)}
    f.write_text("% sym unweighted\n% 9 2 2\n1 2\n")
    with pytest.raises(ValueError):
        read_konect(spark, f"file://{f}")
    f.write_text("% odd unweighted\n")
    with pytest.raises(ValueError):
        read_konect(spark, f"file://{f}")
    for end in ("\n\n1 4 9\n", "\n", ""):
        f.write_text("*vertices 5\n1 \"a\"\n*arcs\n1 2 3.0\n2 3 1.0\n 5 1 2" + end)
        g = read_pajek(spark, f"file://{f}")
        assert g.n_nodes == 5 and {tuple(r) for r in g.edges.collect()} == {(1, 2), (2, 3), (5, 1)}


def test_successors(spark):
    rnd = random.Random(9)
    rows = [(k, rnd.randint(0, 40), rnd.randint(1, 6) if rnd.random() > 0.05 else None) for k in range(400)]
    want = {}
    users = [u for _, _, u in sorted(rows, key=lambda r: (r[1], r[0]))]
    for a, b in zip(users, users[1:]):
        if a is not None and b is not None and a != b:
            want[a, b] = want.get((a, b), 0) + 1
    df = spark.createDataFrame(rows, "event_id long, ts long, user_id long").repartition(5)
    for slices in (2, 9, 60):
        assert {(r.src, r.dst): r.w for r in successors(df, slices=slices).edges.collect()} == want


def test_streaming_degrees(spark, tmp_path):
    from nullweave.streaming.degrees import streaming_degrees

    g = networks.rhesus_macaques(spark)
    g.edges.repartition(3).write.parquet(f"{tmp_path}/links")
    stream = spark.readStream.schema(g.edges.schema).parquet(f"{tmp_path}/links")
    q = streaming_degrees(stream).writeStream.outputMode("complete").format("memory").queryName("degrees_now").start()
    q.processAllAvailable()
    q.stop()
    want = {r.id: (r.k_out, r.k_in) for r in seq.degrees(g).collect()}
    assert {r.id: (r.k_out, r.k_in) for r in spark.table("degrees_now").collect()} == want


def test_graph_builders(spark):
    rows = [(1, 2), (2, 1), (1, 1), (None, 3), (2, 1), (3, 4)]
    g = from_edges(spark.createDataFrame(rows, "src long, dst long"), False)
    assert {tuple(r) for r in g.edges.collect()} == {(1, 2), (3, 4)} and g.n_nodes == 4
    d = from_edges(spark.createDataFrame(rows, "src long, dst long"), True)
    assert d.edges.count() == 3 and d.undirected().edges.count() == 2
    assert column(seq.degrees(Graph(spark.range(1, 7), g.edges, False)), "k") == [1, 1, 1, 1, 0, 0]


def weighted_network(spark, nodes=40):
    """Whole weights that differ from node to node; some nodes have no link one way or both."""
    rng = np.random.default_rng(5)
    rows = [(i, j, float(rng.integers(1, 9))) for i in range(1, nodes - 2) for j in range(1, nodes - 1) if i != j and rng.random() < 0.15 + 0.3 * (i + j) / (2 * nodes)]
    return from_edges(spark.createDataFrame(rows, "src long, dst long, w double"), True, spark.range(1, nodes + 1), weight="w")


@pytest.mark.parametrize("kind", [UBCM, DBCM, RBCM, UECM, DECM, CReM, DCReM, CRWCM, BiCM])
def test_many_classes_give_the_same_model(spark, monkeypatch, kind):
    """Sums by blocks equal those by matrices at the solution, and the step from there too."""
    g = networks.corporate_club(spark) if kind is BiCM else weighted_network(spark)
    whole = kind.from_graph(g).solve(maxiters=5000, **({"method": "L-BFGS", "g_tol": 1e-6} if kind in (UECM, DECM) else {"ftol": 1e-10}))
    monkeypatch.setattr(model, "MAX_CLASSES", 3)
    monkeypatch.setattr(blocks, "CELLS", 256)
    parts = kind.from_graph(g)
    if issubclass(kind, model._TwoStep):
        parts.first, parts.first_theta, parts.first_class = whole.first, whole.first_theta, whole.first_class
        parts.problem = parts.spread(parts.kernel(parts.columns, parts.f, None), [x[whole.first_class] for x in whole.first.split(whole.first_theta)])
    parts.theta = whole.theta
    assert isinstance(parts.problem, blocks.Blocks) and parts.large and not whole.large
    away = whole.theta * (1.01 if kind in (UECM, DECM) else 0.9)
    for u in (whole.theta, away):
        assert np.allclose(parts.problem.expected(u), whole.problem.expected(u), rtol=1e-9, atol=1e-12)
        assert np.isclose(parts.problem.loglikelihood(u), whole.problem.loglikelihood(u), rtol=1e-9)
    assert np.isclose(parts.AIC(), whole.AIC(), rtol=1e-9)
    a, b = (m.expected_sequences().toPandas() for m in (parts, whole))
    keys = ["layer", "id"] if kind is BiCM else ["id"]
    assert set(a.columns) == set(b.columns)
    a, b = (x.sort_values(keys).reset_index(drop=True)[sorted(a.columns)] for x in (a, b))
    for c in a.columns:
        assert (a[c] == b[c]).all() if c in keys else np.allclose(a[c], b[c], rtol=1e-9), c
    with pytest.raises(ValueError):
        parts.pairs
    with pytest.raises(ValueError):
        model.Model.solve(parts, method="BFGS")


def test_many_classes_solve(spark, monkeypatch):
    """Both steps of a conditional model by blocks, from the start."""
    g = weighted_network(spark, 24).undirected()
    whole = CReM.from_graph(g).solve(maxiters=5000)
    monkeypatch.setattr(model, "MAX_CLASSES", 3)
    monkeypatch.setattr(blocks, "CELLS", 256)
    parts = CReM.from_graph(g).solve(maxiters=5000, ftol=1e-5, conditional={"ftol": 1e-5})
    assert isinstance(parts.first, blocks.Blocks) and isinstance(parts.problem, blocks.Blocks)
    assert np.allclose(parts.theta, whole.theta, rtol=1e-3) and parts.constraint_residual(relative=True) < 1e-4


@pytest.mark.parametrize("many", [False, True])
def test_negative_rates_are_found(spark, monkeypatch, many):
    """Strengths made from rates of which one is negative, which no fixed point in logarithms reaches."""
    degrees = UBCM(spark.createDataFrame([(i, 3 + i % 4) for i in range(12)], "id long, k long")).solve(ftol=1e-12)
    cls = [r["cls"] - 1 for r in degrees.members.orderBy("id").collect()]
    p = degrees.pairs["p"][np.ix_(cls, cls)]
    np.fill_diagonal(p, 0)
    rates = 0.5 + 0.05 * np.arange(12)
    rates[5] = -0.2
    s = (p / (rates[:, None] + rates + np.eye(12))).sum(1)
    if many:
        monkeypatch.setattr(model, "MAX_CLASSES", 5)
        monkeypatch.setattr(blocks, "CELLS", 64)
    rows = spark.createDataFrame([(i, 3 + i % 4, float(s[i])) for i in range(12)], "id long, k long, s double")
    m = CReM(rows).solve(method="Newton" if many else None, conditional={"ftol": 1e-12})
    got = {(r["k"], r["s"]): r["theta_s"] for r in m.parameters().collect()}
    assert m.large == many and np.allclose([got[(3 + i % 4, float(s[i]))] for i in range(12)], rates, atol=1e-6)
    assert m.constraint_residual(relative=True) < 1e-7


def test_the_bound_of_classes_takes_no_memory(spark, monkeypatch):
    """Classes are counted, not cut: no task holds an array as long as the bound, however high it is."""
    rows = spark.createDataFrame([(k, d) for k, d in enumerate(networks.KARATE_DEGREES, 1)], "id long, k long")
    monkeypatch.setattr(blocks, "FIELDS_BYTES", 1 << 50)
    m = UBCM(rows)
    assert m.n_classes == len(m) == 11
    monkeypatch.setattr(blocks, "FIELDS_BYTES", 24 * 10)
    with pytest.raises(ValueError, match="distinct constraint tuples"):
        UBCM(rows)


@pytest.mark.parametrize("kind", ["uecm", "decm"])
def test_whole_number_models_find_heavy_and_single_weights(kind):
    """Nodes whose links all have weight 1, as others' have weights of a hundred: the multiplier of the former grows without bound."""
    rng = np.random.default_rng(3)
    k = np.concatenate([np.full(40, 2.0), rng.integers(20, 60, 30)])
    s = np.where(np.arange(70) < 5, k, np.where(np.arange(70) < 40, 130 + np.arange(70), k + rng.integers(0, 9, 70)))
    f = np.where(np.arange(70) < 40, 20.0, 3.0)
    p = kernels.UECM({"k": k, "s": s}, f) if kind == "uecm" else kernels.DECM({"k_out": k, "k_in": k, "s_out": s, "s_in": s}, f)
    size = (p.weight * p.flat)[p.live]
    assert np.allclose(p.hessian(p.start()), kernels.Kernel.hessian(p, p.start()), rtol=1e-9, atol=1e-12)
    u, steps = solvers.scaled_newton(p.value, p.gradient, p.hessian, p.start(), size)
    assert steps < 100 and np.abs(p.expected(u) / p.flat - 1).max() <= 1e-8


@pytest.mark.parametrize("seed, nodes", [(94, 4945), (157, 5409), (184, 552)])
def test_fixed_point_where_all_chances_are_near_one(seed, nodes):
    """From this start plain steps are all equal; their extrapolation went so far that a step was lost in rounding."""
    r = np.random.default_rng(seed)
    count, n = r.integers(3, 30), r.integers(200, 20000)
    k = np.sort(r.choice(np.arange(3, 160), count, replace=False)).astype(float)
    p = kernels.UBCM({"k": k}, np.ceil(r.dirichlet(np.ones(count)) * n))
    assert n == nodes
    with np.errstate(all="ignore"):
        u, _ = solvers.fixed_point(p.update, p.start("degrees"))
    assert np.abs(p.expected(u) - k).max() < 1e-5


@pytest.mark.parametrize("directed", [False, True])
def test_newton_stays_in_the_domain_of_weights(directed):
    """Steps of whole-number models that leave the domain are cut at once, not halved again and again."""
    r = np.random.default_rng(3)
    k, n = 40, 2 if directed else 1
    out = r.integers(5, 30, k)
    order = [out, r.permutation(out)][:n]
    heavy = r.integers(1, 4000, k) * (r.random(k) < 0.3)
    weights = [order[0] + heavy, order[-1] + r.permutation(heavy)][:n]
    if directed:  # both sums are one
        weights[1] = weights[1] + 0
        weights[1][0] += weights[0].sum() - weights[1].sum()
    kind = kernels.DECM if directed else kernels.UECM
    p = kind(dict(zip(kind.channels, [*order, *weights])), np.full(k, 3.0))
    calls = []
    with np.errstate(all="ignore"):
        u, steps = solvers.scaled_newton(lambda v: calls.append(1) or p.value(v), p.gradient, p.hessian, p.start(), (p.weight * p.flat)[p.live], reach=p.reach)
        assert len(calls) < 4 * steps
        assert np.abs(p.expected(u) / p.flat - 1).max() < 1e-6
        d = -np.ones(len(u))
        far = p.reach(u, d)
        assert np.isfinite(p.value(u + 0.999 * far * d)) and not np.isfinite(p.value(u + 1.001 * far * d))


def lone_nodes(directed, seed, nodes=40, steps=800):
    """Constraints of a random weighted network, a column a class; nearly every class is one node."""
    r = np.random.default_rng(seed)
    share = r.pareto(2, nodes) + 0.05
    walk = r.choice(nodes, steps, p=share / share.sum())
    w = np.zeros((nodes, nodes))
    np.add.at(w, (walk[:-1], walk[1:]), 1.0)
    np.fill_diagonal(w, 0)
    w = w if directed else w + w.T
    a, f = np.unique(np.stack([x.sum(axis) for x in ((w > 0) * 1.0, w) for axis in ((1, 0) if directed else (1,))]), axis=1, return_counts=True)
    return a[:, a.any(0)], f[a.any(0)].astype(float)


@pytest.mark.parametrize("seed", [0, 6, 12])
@pytest.mark.parametrize("directed", [False, True])
def test_newton_has_no_wall_at_own_pairs_of_lone_nodes(directed, seed):
    """The multipliers of a node may add up to less than 0 with its own where no other node is in its class."""
    a, f = lone_nodes(directed, seed)
    kind = kernels.DECM if directed else kernels.UECM
    p = kind(dict(zip(kind.channels, a)), f)
    with np.errstate(all="ignore"):
        u, steps = solvers.scaled_newton(p.value, p.gradient, p.hessian, p.start(), (p.weight * p.flat)[p.live], reach=p.reach)
        assert steps < 60 and np.abs(p.expected(u) / p.flat - 1)[p.live].max() <= 1e-8


def test_samples_of_lone_nodes_keep_their_sums(spark):
    """Links and weights of samples where nearly every class is one node."""
    (k, s), f = lone_nodes(False, 0)
    rows = [(int(x), int(y)) for x, y, n in zip(k, s, f) for _ in range(int(n))]
    m = UECM(spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "id long, k long, s long")).solve()
    got = sampling.sample(m, 60, seed=4)
    assert got.where("src = dst").count() == 0
    seen = got.agg(F.count("*").alias("l"), F.sum("w").alias("w")).first()
    assert abs(seen["l"] / 60 - (f @ k) / 2) < 5 * m.sigma("edges") / 60**0.5 and abs(seen["w"] / (30 * (f @ s)) - 1) < 0.1


@pytest.mark.parametrize("directed, seed, nodes, links", [(True, 1, 6, 8), (False, 5, 10, 4), (True, 2, 15, 4), (False, 1, 15, 8)])
def test_newton_comes_back_from_chances_of_one(directed, seed, nodes, links):
    """Nearly every pair is linked: a long step made all chances of a node 1 to rounding, where no curvature is left."""
    w = np.random.default_rng(seed).poisson(links, (nodes, nodes)).astype(float)
    np.fill_diagonal(w, 0)
    w = w if directed else np.triu(w) + np.triu(w).T
    a, f = np.unique(np.stack([x.sum(axis) for x in ((w > 0) * 1.0, w) for axis in ((1, 0) if directed else (1,))]), axis=1, return_counts=True)
    kind = kernels.DECM if directed else kernels.UECM
    p = kind(dict(zip(kind.channels, a)), f.astype(float))
    with np.errstate(all="ignore"):
        u, steps = solvers.scaled_newton(p.value, p.gradient, p.hessian, p.start(), (p.weight * p.flat)[p.live], reach=p.reach)
        assert steps < 100 and np.abs(p.expected(u) / p.flat - 1).max() <= 1e-8


def test_samples_have_tasks_in_proportion_to_links(spark, monkeypatch):
    """A few class pairs that become millions of links are not one task's."""
    real, made = sampling.drawn, []
    monkeypatch.setattr(sampling, "drawn", lambda *a: made.append(real(*a)) or made[-1])
    m = UBCM(spark.range(2000).select("id", F.lit(600).alias("k"))).solve()
    sampling.sample(m, 8, seed=2)
    assert made[0].rdd.getNumPartitions() == 10
    count = made[0].where("sample_id = 3").agg(F.count("*").alias("n"), F.count_distinct("ra", "rb").alias("d")).first()
    assert count["n"] == count["d"] and abs(count["n"] - 600_000) < 6 * 600_000**0.5
