"""Graphs as DataFrames.

A graph is an edge table and a node table; the node table keeps isolated nodes.  Undirected edges stand once, with
src < dst.  Bipartite graphs have explicit layers, so no colouring is needed.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Graph:
    """``nodes``: id.  ``edges``: src, dst and, if weighted, w."""

    nodes: DataFrame
    edges: DataFrame
    directed: bool

    @property
    def weighted(self) -> bool:
        return "w" in self.edges.columns

    @cached_property
    def n_nodes(self) -> int:
        return self.nodes.count()

    @cached_property
    def both(self) -> DataFrame:
        """Every edge from both ends (undirected graphs), or as it is."""
        if self.directed:
            return self.edges
        ends = F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"))))
        rest = ["w"] if self.weighted else []
        return self.edges.select(ends.alias("e"), *rest).select(F.col("e.a").alias("src"), F.col("e.b").alias("dst"), *rest)

    def binary(self) -> Graph:
        return Graph(self.nodes, self.edges.select("src", "dst"), self.directed)

    def undirected(self) -> Graph:
        """Both directions of a pair as one edge; weights are added."""
        pair = self.edges.where("src <> dst").withColumns({"u": F.least("src", "dst"), "v": F.greatest("src", "dst")}).groupBy("u", "v")
        e = pair.agg(F.sum("w").alias("w")) if self.weighted else pair.agg(F.count("*").alias("n")).drop("n")
        return Graph(self.nodes, e.withColumnsRenamed({"u": "src", "v": "dst"}), False)


def from_edges(edges: DataFrame, directed: bool, nodes: DataFrame | None = None, src: str = "src", dst: str = "dst", weight: str | None = None) -> Graph:
    """A simple graph from rows of links: nulls and self loops go, parallel links become one (weights are added).

    Without ``nodes`` the nodes are the ends of the links."""
    cols = [F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")] + ([F.col(weight).alias("w")] if weight else [])
    e = edges.select(*cols).where("src is not null and dst is not null and src <> dst")
    if nodes is None:
        nodes = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    if not directed:
        rest = ["w"] if weight else []
        e = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *rest)
    e = e.groupBy("src", "dst").agg(F.sum("w").alias("w")).where("w > 0") if weight else e.distinct()
    return Graph(nodes.select(F.col(nodes.columns[0]).cast("long").alias("id")), e, directed)


@dataclass
class Bipartite:
    """``edges``: bottom, top, each pair once; ``bottoms`` and ``tops``: id."""

    edges: DataFrame
    bottoms: DataFrame
    tops: DataFrame

    def layer(self, name: str) -> tuple[str, str]:
        """Column of the layer and of the opposite one; both spellings of a layer are known."""
        name = {"⊥": "bottom", "⊤": "top"}.get(name, name)
        if name not in ("bottom", "top"):
            raise ValueError(f"unknown layer {name!r}")
        return (name, "top") if name == "bottom" else (name, "bottom")

    def ids(self, name: str) -> DataFrame:
        return self.bottoms if self.layer(name)[0] == "bottom" else self.tops

    def biadjacency(self) -> DataFrame:
        return self.edges.select("bottom", "top", F.lit(1).alias("value"))


def bipartite(links: DataFrame, bottom: str = "bottom", top: str = "top", bottoms: DataFrame | None = None, tops: DataFrame | None = None) -> Bipartite:
    e = links.select(F.col(bottom).cast("long").alias("bottom"), F.col(top).cast("long").alias("top")).where("bottom is not null and top is not null").distinct()
    bottoms = e.select(F.col("bottom").alias("id")).distinct() if bottoms is None else bottoms.toDF("id")
    tops = e.select(F.col("top").alias("id")).distinct() if tops is None else tops.toDF("id")
    return Bipartite(e, bottoms, tops)


def kept(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the folder that the cluster shares (``spark.checkpoint.dir``): cuts lineage, survives lost
    executors.  Without that setting only a master within this process has such a folder."""
    spark = df.sparkSession
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='nullweave-')}"
        spark.conf.set("spark.checkpoint.dir", path)
        atexit.register(shutil.rmtree, path.removeprefix("file://"), ignore_errors=True)
    path = f"{path.rstrip('/')}/nullweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame ``kept``, for what is read again and again; as it is where no folder is shared."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) or re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return kept(df, name)
    return df


def two_coloured(graph: Graph, rounds: int = 100) -> Bipartite:
    """Layers of an undirected graph without layer columns: each node's colour is its distance's parity from the root of
    its part.  Raises if an edge joins equal colours.

    Parts are contracted: every root hooks onto the smallest root beside it, with the parity of the way there, and ways are
    halved until each node knows its root; what is left is the graph of roots.  After a round only roots without a
    smaller neighbour are left, so a long path takes about as many rounds as its length has digits.  It ends when no
    edge joins two roots, and raises if that is not reached."""
    state = kept(graph.nodes.select("id", F.col("id").alias("root"), F.lit(0).alias("colour")), "colours")
    edges = graph.both.select("src", "dst")
    for _ in range(rounds):
        ends = edges.join(state.toDF("src", "ra", "ca"), "src").join(state.toDF("dst", "rb", "cb"), "dst")
        # Between two roots one way is enough: an odd circle shows at the end, whichever way was taken.
        ways = kept(ends.where("ra <> rb").groupBy("ra", "rb").agg(F.min((F.col("ca") + F.col("cb") + 1) % 2).alias("turn")), "ways")
        if not ways.head(1):
            break
        # A smaller root beside it, else (in turn, so that no two hook onto each other) none: its neighbours hook onto it.
        up = kept(ways.where("rb < ra").groupBy("ra").agg(F.min(F.struct("rb", "turn")).alias("w")).select(F.col("ra").alias("root"), F.col("w.rb").alias("parent"), F.col("w.turn").alias("turn")), "hooks")
        while True:
            far = up.alias("a").join(up.alias("b"), F.expr("a.parent = b.root"), "left")
            up = kept(far.select("a.root", F.coalesce("b.parent", "a.parent").alias("parent"), F.expr("(a.turn + coalesce(b.turn, 0)) % 2").alias("turn"), F.col("b.root").isNotNull().alias("moved")), "hooks")
            done = not up.where("moved").head(1)
            up = up.drop("moved")
            if done:
                break
        state = kept(state.join(up, "root", "left").select("id", F.coalesce("parent", "root").alias("root"), ((F.col("colour") + F.coalesce("turn", F.lit(0))) % 2).alias("colour")), "colours")
    else:
        raise RuntimeError(f"colours did not settle in {rounds} rounds")
    # The smallest node of each part has colour 0.
    low = kept(state.groupBy("root").agg(F.min(F.struct("id", "colour"))["colour"].alias("flip")), "flips")
    state = kept(state.join(low, "root").select("id", ((F.col("colour") + F.col("flip")) % 2).alias("colour")), "colours")
    marked = graph.edges.join(state.toDF("src", "ca"), "src").join(state.toDF("dst", "cb"), "dst")
    if marked.where("ca = cb").head(1):
        raise ValueError("the graph is not bipartite")
    links = marked.select(F.when(F.col("ca") == 0, F.col("src")).otherwise(F.col("dst")).alias("bottom"), F.when(F.col("ca") == 0, F.col("dst")).otherwise(F.col("src")).alias("top"))
    return bipartite(links, bottoms=state.where("colour = 0").select("id"), tops=state.where("colour = 1").select("id"))


def successors(events: DataFrame, key: str = "user_id", order: tuple[str, ...] = ("ts", "event_id"), slices: int | None = None) -> Graph:
    """The weighted digraph of who follows whom in the order of events.

    A single ordered window would put every event into one task, so the order is cut at quantiles of its first column;
    each slice finds its followers by itself, and slice ends are joined to the next slice's beginning."""
    spark = events.sparkSession
    e = events.select(F.col(key).alias("k"), *[F.col(c).alias(f"o{n}") for n, c in enumerate(order)])
    at = F.col("o0").cast("timestamp") if dict(e.dtypes)["o0"] in ("timestamp_ntz", "date") else F.col("o0")
    e = e.withColumn("at", at.cast("double"))
    slices = slices or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = F.broadcast(e.agg(F.expr(f"percentile_approx(at, array({', '.join(str(k / slices) for k in range(1, slices))}), 10000)").alias("cuts")))
    e = e.crossJoin(cuts).withColumn("slice", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("at"))), F.lit(-1))).drop("cuts")
    from pyspark.sql import Window

    sort = [f"o{n}" for n in range(len(order))]
    w = Window.partitionBy("slice").orderBy(*sort)
    e = e.withColumns({"next": F.lead("k").over(w), "last": F.lead("o0").over(w).isNull() & (F.row_number().over(w) == F.count("*").over(Window.partitionBy("slice")))})
    first = e.groupBy("slice").agg(F.min(F.struct(*sort, "k")).alias("f"))
    # One row for each slice.
    begin = first.withColumn("before", F.lag("slice").over(Window.orderBy("slice"))).select(F.col("before").alias("slice"), F.col("f.k").alias("begin"))
    e = e.join(F.broadcast(begin), "slice", "left").select(F.col("k").alias("src"), F.when(F.col("last"), F.col("begin")).otherwise(F.col("next")).alias("dst"))
    links = e.where("src is not null and dst is not null and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w"))
    return from_edges(links, True, weight="w")
