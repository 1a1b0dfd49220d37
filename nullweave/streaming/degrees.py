"""Node sequences of a growing graph: a stream of links keeps degrees and strengths up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_degrees(links: DataFrame, directed: bool = True) -> DataFrame:
    """Running sequences of a stream of links (src, dst and, if weighted, w), for the ``update`` or ``complete`` mode.

    Each link must come once: the state is one row for each node, not one for each link."""
    w = F.col("w") if "w" in links.columns else F.lit(1)
    kind = F.lit(True)
    out = F.struct(F.col("src").alias("id"), kind.alias("own"), w.alias("w"))
    back = F.struct(F.col("dst").alias("id"), (~kind).alias("own"), w.alias("w"))
    e = links.where("src is not null and dst is not null and src <> dst").select(F.explode(F.array(out, back)).alias("e")).select("e.*")
    if not directed:
        return e.groupBy("id").agg(F.count("*").alias("k"), F.sum("w").alias("s"))
    own = F.col("own")
    pick = lambda c, x: F.sum(F.when(c, x).otherwise(F.lit(0)))
    return e.groupBy("id").agg(pick(own, F.lit(1)).alias("k_out"), pick(~own, F.lit(1)).alias("k_in"), pick(own, F.col("w")).alias("s_out"), pick(~own, F.col("w")).alias("s_in"))


def windowed_links(events: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Links (ts, src, dst) counted for each window of event time; later ones than ``delay`` are dropped."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "src", "dst").agg(F.count("*").alias("w"))
