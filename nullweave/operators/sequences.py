"""Node sequences: degrees, strengths, their reciprocal parts, neighbour degrees, and the reduction to classes.

Each returns one row for every node of the graph, also for isolated ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph


def _per_node(graph: Graph, found: DataFrame, *cols: str) -> DataFrame:
    kinds = dict(found.dtypes)
    zero = {c: F.lit(0).cast(kinds[c]) for c in cols}
    return graph.nodes.join(found, "id", "left").select("id", *[F.coalesce(F.col(c), zero[c]).alias(c) for c in cols])


def _directed(graph: Graph, what: str) -> None:
    if not graph.directed:
        raise ValueError(f"{what} needs a directed graph")


def degrees(graph: Graph) -> DataFrame:
    """id, k of an undirected graph; id, k_out, k_in of a directed one.  One shuffle."""
    if not graph.directed:
        return _per_node(graph, graph.both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k")), "k")
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    return _per_node(graph, graph.edges.select(ends.alias("e")).groupBy("e.id").agg(F.sum("e.o").alias("k_out"), F.sum("e.i").alias("k_in")), "k_out", "k_in")


def strengths(graph: Graph, direction: str = "both") -> DataFrame:
    """id and s (undirected) or s_out, s_in, s: sums of weights; ``direction`` is out, in or both."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"unknown direction {direction!r}")
    if not graph.weighted:
        raise ValueError("strengths need weights")
    if not graph.directed:
        return _per_node(graph, graph.both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("s")), "s")
    zero = F.lit(0).cast(dict(graph.edges.dtypes)["w"])
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("w").alias("o"), zero.alias("i")), F.struct(F.col("dst").alias("id"), zero.alias("o"), F.col("w").alias("i"))))
    s = graph.edges.select(ends.alias("e")).groupBy("e.id").agg(F.sum("e.o").alias("s_out"), F.sum("e.i").alias("s_in"))
    s = _per_node(graph, s.withColumn("s", F.col("s_out") + F.col("s_in")), "s_out", "s_in", "s")
    return s if direction == "both" else s.select("id", f"s_{direction}")


def with_reverse(graph: Graph) -> DataFrame:
    """src, dst, w, back: each link's own weight and that of its opposite link (null if there is none).

    Both directions of a pair meet in one aggregate by the unordered pair instead of a join."""
    _directed(graph, "reciprocity")
    w = F.col("w") if graph.weighted else F.lit(1).alias("w")
    up = F.col("src") < F.col("dst")
    pair = graph.edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), F.when(up, w).alias("f"), F.when(~up, w).alias("b"))
    pair = pair.groupBy("u", "v").agg(F.max("f").alias("f"), F.max("b").alias("b"))
    both = F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst"), F.col("f").alias("w"), F.col("b").alias("back")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst"), F.col("b").alias("w"), F.col("f").alias("back"))))
    return pair.select(both.alias("e")).select("e.*").where("w is not null")


def reciprocal_degrees(graph: Graph) -> DataFrame:
    """id, k_out, k_in (links without an opposite one) and k_rec (with one)."""
    e = with_reverse(graph)
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(True).alias("own"), (~F.col("back").isNull()).alias("rec")), F.struct(F.col("dst").alias("id"), F.lit(False).alias("own"), (~F.col("back").isNull()).alias("rec"))))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    found = e.select(ends.alias("e")).select("e.*").groupBy("id").agg(one(F.col("own") & ~F.col("rec")).alias("k_out"), one(~F.col("own") & ~F.col("rec")).alias("k_in"), one(F.col("own") & F.col("rec")).alias("k_rec"))
    return _per_node(graph, found, "k_out", "k_in", "k_rec")


def reciprocal_strengths(graph: Graph) -> DataFrame:
    """id, s_out, s_in (weights of links without an opposite one), s_rec_out, s_rec_in (with one)."""
    e = with_reverse(graph)
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(True).alias("own"), F.col("back").isNotNull().alias("rec"), "w"), F.struct(F.col("dst").alias("id"), F.lit(False).alias("own"), F.col("back").isNotNull().alias("rec"), "w")))
    zero = F.lit(0).cast(dict(e.dtypes)["w"])
    add = lambda c: F.sum(F.when(c, F.col("w")).otherwise(zero))
    own, rec = F.col("own"), F.col("rec")
    found = e.select(ends.alias("e")).select("e.*").groupBy("id").agg(add(own & ~rec).alias("s_out"), add(~own & ~rec).alias("s_in"), add(own & rec).alias("s_rec_out"), add(~own & rec).alias("s_rec_in"))
    return _per_node(graph, found, "s_out", "s_in", "s_rec_out", "s_rec_in")


def neighbour_degree(graph: Graph, kind: str = "any", check_directed: bool = True) -> DataFrame:
    """id, annd: mean degree of a node's neighbours, 0 without any.

    ``kind`` any is for undirected graphs.  For directed ones, out and in average out- or in-degrees, both over the
    nodes that a node links to, and divide by its own out- or in-degree."""
    if kind == "any":
        if graph.directed and check_directed:
            raise ValueError("the graph is directed; use kind 'out' or 'in'")
        k = graph.both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k"))
        links, own = graph.both, k
    elif kind in ("out", "in"):
        _directed(graph, f"kind {kind!r}")
        k = degrees(graph).select("id", F.col(f"k_{kind}").alias("k"))
        links, own = graph.edges, k
    else:
        raise ValueError(f"unknown kind {kind!r}")
    sums = links.join(k.select(F.col("id").alias("dst"), "k"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("k").alias("total"))
    found = own.join(sums, "id", "left").select("id", F.when(F.col("k") > 0, F.coalesce("total", F.lit(0)) / F.col("k")).otherwise(0.0).alias("annd"))
    return _per_node(graph, found, "annd")


def classes(sequence: DataFrame, *keys: str, id_col: str = "id", ordered: bool = True) -> DataFrame:
    """The distinct tuples of ``keys``: cls (1, 2, ... in order), the tuple, first (smallest id), f (how many).

    ``ordered`` numbers the classes by value, else by first id.  The grouped table is small, so one ordered window is."""
    from pyspark.sql import Window

    c = sequence.groupBy(*keys).agg(F.min(id_col).alias("first"), F.count("*").alias("f"))
    return c.select(F.row_number().over(Window.orderBy(*(keys if ordered else ["first"]))).alias("cls"), *keys, "first", "f")


def class_of(sequence: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """The inverse of the reduction: every row with its cls."""
    return sequence.join(table.select("cls", *keys), list(keys)).select(*sequence.columns, "cls")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)
