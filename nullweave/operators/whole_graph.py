"""Whole-graph metrics of observed graphs: reciprocity, wedges, triangles, squares, directed triads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from .sequences import degrees, with_reverse

# The states of the links (i,j), (j,k), (k,i) in each of the 13 connected directed triads.
# P: only first to second; Q: only second to first; R: both; Z: none.
TRIADS = {1: "QPZ", 2: "QQZ", 3: "QRZ", 4: "QZP", 5: "QPP", 6: "QRP", 7: "PRZ", 8: "RRZ", 9: "PPP", 10: "RPP", 11: "RQP", 12: "RRP", 13: "RRR"}
MIRROR = {"P": "Q", "Q": "P", "R": "R"}


def reciprocity(graph: Graph) -> DataFrame:
    """reciprocity, weighted_reciprocity: share of links, and of weight, whose opposite link is there."""
    e = with_reverse(graph)
    rec = F.col("back").isNotNull()
    out = e.agg(F.avg(F.when(rec, 1.0).otherwise(0.0)).alias("reciprocity"), (F.sum(F.when(rec, F.col("w")).otherwise(0)) / F.sum("w")).alias("weighted_reciprocity"))
    if not graph.edges.head(1):
        raise ValueError("the graph has no links")
    return out


def wedges(graph: Graph) -> DataFrame:
    """Paths of two links: sum of k (k - 1) / 2; no path is listed."""
    k = degrees(graph)
    return k.agg(F.coalesce(F.sum(F.col("k") * (F.col("k") - 1) / 2), F.lit(0.0)).alias("wedges"))


def oriented(graph: Graph, rest: list[str] | None = None) -> DataFrame:
    """Each undirected pair once, from its end of smaller (degree, id): no node has many followers, however large its
    degree, so lists of pairs of followers stay short."""
    k = graph.both.groupBy(F.col("src").alias("n")).agg(F.count("*").alias("k"))
    rest = rest or []
    e = graph.edges.join(k.toDF("src", "ks"), "src").join(k.toDF("dst", "kd"), "dst")
    up = F.struct("ks", "src") < F.struct("kd", "dst")
    return e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("v"), F.greatest(F.struct("ks", F.col("src").alias("i")), F.struct(F.col("kd").alias("ks"), F.col("dst").alias("i"))).alias("rank"), *rest)


def triangle_list(graph: Graph) -> DataFrame:
    """a, b, c of every triangle once."""
    e = oriented(graph)
    two = e.alias("x").join(e.alias("y"), F.expr("x.u = y.u and x.rank < y.rank")).select(F.col("x.u").alias("a"), F.col("x.v").alias("b"), F.col("y.v").alias("c"))
    return two.join(e.select(F.col("u").alias("b"), F.col("v").alias("c")), ["b", "c"]).select("a", "b", "c")


def triangles(graph: Graph) -> DataFrame:
    return triangle_list(graph).agg(F.count("*").alias("triangles"))


def squares(graph: Graph) -> DataFrame:
    """Chordless 4-cycles.  Pairs of wedges on the same ends, without a link between the ends or the middles; each square
    is found at its smallest node."""
    both = graph.both.select("src", "dst")
    # Ends i < k that are not linked; middles j, l larger than i.
    w = both.alias("x").join(both.alias("y"), F.expr("x.dst = y.src and x.src < y.dst and x.src < x.dst")).select(F.col("x.src").alias("i"), F.col("y.dst").alias("k"), F.col("x.dst").alias("j"))
    apart = graph.edges.select(F.col("src").alias("i"), F.col("dst").alias("k"))
    w = w.join(apart, ["i", "k"], "left_anti")
    s = w.alias("a").join(w.alias("b"), F.expr("a.i = b.i and a.k = b.k and a.j < b.j")).select("a.i", "a.k", F.col("a.j").alias("src"), F.col("b.j").alias("dst"))
    return s.join(graph.edges.select("src", "dst"), ["src", "dst"], "left_anti").agg(F.count("*").alias("squares"))


def dyads_observed(graph: Graph) -> DataFrame:
    """i, j, state (P, Q or R, seen from i), wf (weight of i to j, 0 if none), wb (of j to i); both views of each pair."""
    e = with_reverse(graph)
    rec, w, back = F.col("back").isNotNull(), F.col("w").cast("double"), F.coalesce(F.col("back").cast("double"), F.lit(0.0))
    own = F.struct(F.col("src").alias("i"), F.col("dst").alias("j"), F.when(rec, "R").otherwise("P").alias("state"), w.alias("wf"), back.alias("wb"))
    seen = F.struct(F.col("dst").alias("i"), F.col("src").alias("j"), F.lit("Q").alias("state"), back.alias("wf"), w.alias("wb"))
    return e.select(F.explode(F.when(rec, F.array(own)).otherwise(F.array(own, seen))).alias("d")).select("d.*")


def _value(kind: str, state: Column | str, wf: Column, wb: Column) -> Column:
    """What one link adds (fluxes) or multiplies (intensities)."""
    s = F.lit(state) if isinstance(state, str) else state
    if kind == "flux":
        return F.when(s == "P", wf).when(s == "Q", wb).otherwise(wf + wb)
    return F.when(s == "P", wf).when(s == "Q", wb).otherwise(wf * wb)


def triad_census(graph: Graph, kind: str = "count", stride: int | None = None) -> DataFrame:
    """motif (1..13), value (and graph, see below): labelled ordered triples of distinct nodes whose links are as in TRIADS.

    ``count``: how many; ``flux``: total weight on them; ``intensity``: sum of the geometric means of their weights.
    Closed triads come from the triangles, each listed once.  Open triads are all pairs of links at a middle node, which
    sums at the node give without listing them, less the pairs on the same outer node and the closed ones.

    With ``stride`` many graphs are counted at once: a node's graph is its id divided by the stride, rounded down."""
    if kind not in ("count", "flux", "intensity"):
        raise ValueError(f"unknown kind {kind!r}")
    of = lambda c: (F.floor(F.col(c) / stride) if stride else F.lit(0)).cast("long").alias("graph")
    d = dyads_observed(graph)
    # Closed: the six views of each triangle.
    und = Graph(graph.nodes, d.where("i < j").select(F.col("i").alias("src"), F.col("j").alias("dst"), F.struct("state", "wf", "wb").alias("l")), False)
    und = Graph(und.nodes, und.edges.withColumnRenamed("l", "w"), False)
    e = oriented(und, ["w"])
    turned = F.struct(F.when(F.col("w.state") == "P", "Q").when(F.col("w.state") == "Q", "P").otherwise("R").alias("state"), F.col("w.wb").alias("wf"), F.col("w.wf").alias("wb"))
    e = e.withColumns({"f": F.when(F.col("u") < F.col("v"), F.col("w")).otherwise(turned), "b": F.when(F.col("u") < F.col("v"), turned).otherwise(F.col("w"))})
    two = e.alias("x").join(e.alias("y"), F.expr("x.u = y.u and x.rank < y.rank")).select(F.col("x.v").alias("b"), F.col("y.v").alias("c"), F.col("x.f").alias("ab"), F.col("x.b").alias("ba"), F.col("y.f").alias("ac"), F.col("y.b").alias("ca"))
    t = two.join(e.select(F.col("u").alias("b"), F.col("v").alias("c"), F.col("f").alias("bc"), F.col("b").alias("cb")), ["b", "c"])
    views = [("ab", "bc", "ca"), ("bc", "ca", "ab"), ("ca", "ab", "bc"), ("ac", "cb", "ba"), ("cb", "ba", "ac"), ("ba", "ac", "cb")]
    t = t.select(of("b"), F.explode(F.array(*[F.struct(*[F.col(c).alias(f"l{k}") for k, c in enumerate(v, 1)]) for v in views])).alias("t")).select("graph", "t.*")
    code = F.concat("l1.state", "l2.state", "l3.state")
    part = [_value(kind, F.col(f"l{k}.state"), F.col(f"l{k}.wf"), F.col(f"l{k}.wb")) for k in (1, 2, 3)]
    links = sum((F.when(F.col(f"l{k}.state") == "R", 2).otherwise(1) for k in (1, 2, 3)), F.lit(0))
    worth = F.lit(1.0) if kind == "count" else part[0] + part[1] + part[2] if kind == "flux" else F.pow(part[0] * part[1] * part[2], 1.0 / links)
    # What the same triangle would add to an open triad of its first two links.
    open_links = sum((F.when(F.col(f"l{k}.state") == "R", 2).otherwise(1) for k in (1, 2)), F.lit(0))
    open_worth = F.lit(1.0) if kind == "count" else part[0] + part[1] if kind == "flux" else F.pow(part[0] * part[1], 1.0 / open_links)
    closed = t.groupBy("graph", code.alias("code")).agg(F.sum(worth).alias("full"), F.sum(open_worth).alias("open"))
    # Open: at the middle j, links (i,j) of state s1 and (j,k) of state s2.
    spec = []
    for m, c in TRIADS.items():
        at = c.find("Z")
        if at >= 0:
            spec.append((m, c[(at + 1) % 3], c[(at + 2) % 3]))
    size = {"P": 1, "Q": 1, "R": 2}
    aggs, used = [], set()
    for _, s1, s2 in spec:
        n = size[s1] + size[s2]
        for side, s in (("in", s1), ("out", s2)):
            # Seen from the middle, an incoming link of state s1 is the mirrored one.
            seen = MIRROR[s] if side == "in" else s
            wf, wb = (F.col("wb"), F.col("wf")) if side == "in" else (F.col("wf"), F.col("wb"))
            v = _value(kind if kind != "count" else "flux", s, wf, wb)
            if kind == "intensity":
                v = F.pow(v, 1.0 / n)
            for name, x in ((f"n_{side}_{s}", F.lit(1.0)), (f"v_{side}_{s}_{n}", v)):
                if name not in used:
                    used.add(name)
                    aggs.append(F.sum(F.when(F.col("state") == seen, x).otherwise(0.0)).alias(name))
    at_node = d.groupBy(F.col("i").alias("j")).agg(*aggs)
    pick = {"count": lambda a, b, n: F.col(f"n_in_{a}") * F.col(f"n_out_{b}"), "flux": lambda a, b, n: F.col(f"v_in_{a}_{n}") * F.col(f"n_out_{b}") + F.col(f"n_in_{a}") * F.col(f"v_out_{b}_{n}"), "intensity": lambda a, b, n: F.col(f"v_in_{a}_{n}") * F.col(f"v_out_{b}_{n}")}[kind]
    pairs = at_node.groupBy(of("j")).agg(*[F.coalesce(F.sum(pick(a, b, size[a] + size[b])), F.lit(0.0)).alias(f"m{m}") for m, a, b in spec])
    # The same outer node on both sides: s2 is then the mirror of s1.
    same = []
    for m, a, b in spec:
        if MIRROR[a] == b:
            v = _value("flux" if kind != "intensity" else kind, a, F.col("wf"), F.col("wb"))
            x = F.lit(1.0) if kind == "count" else 2 * v if kind == "flux" else F.pow(v * v, 1.0 / (size[a] + size[b]))
            same.append(F.coalesce(F.sum(F.when(F.col("state") == a, x)), F.lit(0.0)).alias(f"s{m}"))
    same_node = d.groupBy(of("i")).agg(*same)
    rows = F.array(*[F.struct(F.lit(m).alias("motif"), (F.col(f"m{m}") - (F.col(f"s{m}") if MIRROR[a] == b else F.lit(0.0))).alias("value"), F.lit(a + b).alias("two")) for m, a, b in spec])
    opened = pairs.join(same_node, "graph").select("graph", F.explode(rows).alias("r")).select("graph", "r.*")
    by_two = closed.groupBy("graph", F.substring("code", 1, 2).alias("two")).agg(F.sum("open").alias("open"))
    opened = opened.join(by_two, ["graph", "two"], "left").select("graph", "motif", (F.col("value") - F.coalesce("open", F.lit(0.0))).alias("value"))
    spark = graph.edges.sparkSession
    listed = spark.createDataFrame([(m, c) for m, c in TRIADS.items() if "Z" not in c], "motif int, code string")
    out = opened.union(closed.join(F.broadcast(listed), "code").select("graph", "motif", F.col("full").alias("value")))
    if stride:
        return out
    every = spark.createDataFrame([(m,) for m in TRIADS], "motif int")
    return every.join(F.broadcast(out), "motif", "left").select("motif", F.coalesce("value", F.lit(0.0)).alias("value"))


def triad_metric(kind: str = "count", stride: int = 1 << 32):
    """The census as a metric of samples (sample_id, src, dst, w): sample_id, key, value."""

    def metric(links: DataFrame) -> DataFrame:
        shift = (F.col("sample_id") + 1) * F.lit(stride)
        rest = ["w"] if "w" in links.columns else []
        e = links.select((shift + F.col("src")).alias("src"), (shift + F.col("dst")).alias("dst"), *rest)
        nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
        out = triad_census(Graph(nodes, e, True), kind, stride)
        return out.select((F.col("graph") - 1).alias("sample_id"), F.concat(F.lit("M"), F.col("motif").cast("string")).alias("key"), "value")

    return metric
