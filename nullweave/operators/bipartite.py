"""Bipartite metrics of observed graphs: projections, co-occurrence motifs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import binomial
from ..graph import Bipartite


def degrees(graph: Bipartite, layer: str) -> DataFrame:
    """id, k for every node of a layer."""
    own, _ = graph.layer(layer)
    k = graph.edges.groupBy(F.col(own).alias("id")).agg(F.count("*").alias("k"))
    return graph.ids(own).join(k, "id", "left").select("id", F.coalesce("k", F.lit(0).cast("long")).alias("k"))


def project(graph: Bipartite, layer: str = "bottom", method: str = "weighted") -> DataFrame:
    """src < dst, linked if they share a node of the opposite layer; ``weighted`` adds w, the number they share.

    Pairs are made and counted around each opposite node and combined before they are shuffled."""
    if method not in ("simple", "weighted"):
        raise ValueError(f"unknown method {method!r}")
    own, other = graph.layer(layer)
    e = graph.edges
    pairs = e.alias("x").join(e.alias("y"), F.expr(f"x.{other} = y.{other} and x.{own} < y.{own}")).groupBy(F.col(f"x.{own}").alias("src"), F.col(f"y.{own}").alias("dst"))
    out = pairs.agg(F.count("*").alias("w"))
    return out if method == "weighted" else out.select("src", "dst")


def v_motifs(graph: Bipartite, layer: str = "bottom") -> DataFrame:
    """Shared neighbours summed over all pairs of a layer, from the opposite degrees: no pair is made."""
    _, other = graph.layer(layer)
    return degrees(graph, other).agg(F.coalesce(F.sum(F.col("k") * (F.col("k") - 1) / 2), F.lit(0.0)).alias("v_motifs"))


def v_motif(graph: Bipartite, i: int, j: int, layer: str = "bottom") -> DataFrame:
    """Shared neighbours of two nodes of a layer; both filters reach the scan."""
    own, other = graph.layer(layer)
    a, b = (graph.edges.where(F.col(own) == x).select(other) for x in (i, j))
    return a.join(b, other, "left_semi").agg(F.count("*").alias("v_motif"))


def vn_motifs(graph: Bipartite, n: int, layer: str = "bottom") -> DataFrame:
    """Groups of n nodes of a layer with a common neighbour: sum of C(u, n) over opposite degrees u."""
    if n < 2:
        raise ValueError("n must be 2 or more")
    _, other = graph.layer(layer)
    return degrees(graph, other).agg(F.coalesce(F.sum(binomial(F.col("k").cast("double"), n)), F.lit(0.0)).alias("vn_motifs"))
