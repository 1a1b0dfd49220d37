"""Text formats of network collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Bipartite, Graph, bipartite


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("line"))


def read_konect(spark: SparkSession, path: str, check: bool = True) -> Graph | Bipartite:
    """A KONECT edge list: a comment with the kind (sym, asym or bip; unweighted or posweighted), a comment with the
    numbers of edges and nodes, then one edge a row.  Top nodes of bipartite graphs are shifted behind the bottom ones."""
    text = lines(spark, path)
    head = [r["line"].lstrip("% ").split() for r in text.where("line like '\\%%'").limit(2).collect()]
    if len(head) < 1 or not head[0] or head[0][0] not in ("sym", "asym", "bip") or head[0][1] not in ("unweighted", "posweighted"):
        raise ValueError(f"this kind of network is not known: {' '.join(head[0]) if head else 'no header'}")
    kind, weighted = head[0][0], head[0][1] == "posweighted"
    f = F.split("line", r"\s+")
    e = text.where("line <> '' and line not like '\\%%'").select(f[0].cast("long").alias("src"), f[1].cast("long").alias("dst"), *([f[2].cast("double").alias("w")] if weighted else []))
    numbers = [int(x) for x in head[1]] if len(head) > 1 else []
    if kind == "bip":
        low = numbers[1] if numbers else e.agg(F.max("src")).first()[0]
        high = numbers[2] if numbers else e.agg(F.max("dst")).first()[0]
        out = bipartite(e.select(F.col("src").alias("bottom"), (F.col("dst") + low).alias("top")), bottoms=spark.range(1, low + 1), tops=spark.range(low + 1, low + high + 1))
        found = out.edges.count() if check else 0
    else:
        n = numbers[1] if numbers else e.agg(F.max(F.greatest("src", "dst"))).first()[0]
        rest = ["w"] if weighted else []
        e = e if kind == "asym" else e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *rest)
        out = Graph(spark.range(1, n + 1), e.dropDuplicates(["src", "dst"]), kind == "asym")
        found = out.edges.count() if check else 0
    if check and numbers and found != numbers[0]:
        raise ValueError(f"the header says {numbers[0]} edges, the file has {found}")
    return out


def read_pajek(spark: SparkSession, path: str, directed: bool = True) -> Graph:
    """A Pajek network: ``*vertices N``, then after ``*arcs`` one arc a row up to an empty row or the end.  Weights go."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\r", "").alias("t"))
    parts = text.select(F.regexp_extract("t", r"(?i)\*vertices\s+(\d+)", 1).cast("long").alias("n"), F.regexp_extract("t", r"(?is)\*arcs[^\n]*\n(.*)", 1).alias("rest"))
    n = parts.first()["n"] or 0
    block = F.split(F.regexp_extract("rest", r"(?s)^(.*?)(?:\n\s*\n|\n\*|\z)", 1), "\n")
    rows = parts.select(F.explode(block).alias("line")).where(r"line rlike '\\d+\\s+\\d+'")
    e = rows.select(*[F.regexp_extract("line", r"(\d+)\s+(\d+)", k).cast("long").alias(c) for k, c in ((1, "src"), (2, "dst"))])
    if not directed:
        e = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return Graph(spark.range(1, n + 1), e.where("src <> dst").distinct(), directed)
