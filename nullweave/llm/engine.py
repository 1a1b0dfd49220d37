"""What the operators share on the Spark side: Arrow maps, shared tables and connected components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import Chunk, chunks


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints (``spark.checkpoint.dir``).  Where it is unset, a temporary folder
    serves a master within this process; with any other master its executors would not see it, which is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        path = f"file://{tempfile.mkdtemp(prefix='nullweave-')}"
        spark.conf.set("spark.checkpoint.dir", path)
        atexit.register(shutil.rmtree, path.removeprefix("file://"), ignore_errors=True)
    return path.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it again: cuts lineage, survives lost executors, has known size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/nullweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_map(df: DataFrame, fn: Callable[[pa.RecordBatch, Chunk], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: str, text: str = "text") -> DataFrame:
    """Map chunks of documents.  ``fn`` gets the rows of a chunk as a batch, and the chunk of its text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for chunk in chunks(batch.column(at)):
                out = fn(batch.slice(chunk.lo, chunk.n), chunk)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out

    return df.mapInArrow(run, schema)


def batch(schema: str | None = None, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def longs(array: pa.Array) -> np.ndarray:
    """A BIGINT column as numpy; nulls become the smallest integer."""
    return array.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def crc_mod(col: Column, n: int) -> Column:
    return F.crc32(col.cast("string")) % n


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge, from columns a and b.

    Alternates the large-star and small-star steps, each one aggregate of minima (combined before the shuffle) and one
    join.  The minima are a shared table before they are joined, so both sides of a join are plain shuffles, and adaptive
    execution can split the rows of a hub; no node's neighbours are ever gathered.  Every round's edges are a shared table, so a
    lost executor repeats one round at most.  It ends when all edges form stars around their smallest node: when no
    node has two smaller neighbours, and none has both a smaller and a larger one.  Null nodes are ignored."""
    e = table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(e.select("v", F.lit(0), F.lit(1)))
        if not ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down = 1 and up = 1").head(1):
            break
        both = e.union(e.select("v", "u")).toDF("x", "y")
        low = table(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")), "low")
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        large = table(large.where("u <> v").distinct(), "large")
        low = table(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        e = table(small.where("u <> v").distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
