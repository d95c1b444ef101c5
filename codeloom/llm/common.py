"""What the operators of this package share: table access, lineage cuts and connected components."""

from __future__ import annotations

import ctypes
import gc
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.lineage import cut  # noqa: F401  used by the operators from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory; the path may be of any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Steps of a plan that keep the rows of a file scan in their order and places.
NARROW = frozenset({"FileScan", "Project", "Filter", "ColumnarToRow", "WholeStageCodegen", "InputAdapter", "Batched"})


def settled(df: DataFrame) -> DataFrame:
    """``df`` itself if every use of it computes the same rows in the same places, else ``df`` cut.

    Rows of files do, after steps that take each row by itself; rows of other sources, or rows that were shuffled, may
    arrive in another order when they are computed again.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    steps = set(re.findall(r"^[ :|+*()\d-]*([A-Za-z]+)", plan, re.M))
    return df if "FileScan" in steps and steps <= NARROW else cut(df)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_HELD: dict = {}


def held(key, make):
    """What a worker process keeps from task to task under ``key``; it keeps one thing, so another key drops the one before."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    tidy()
    return _HELD[key]


def tidy() -> None:
    """Gives freed memory of a worker process back to the system, where its C library and Arrow's memory pool can."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Connected components of undirected ``edges(a, b)``: ``node``, ``root`` (the smallest node reachable).

    Alternating large and small stars: a node's neighbours are pointed at its smallest neighbour until
    every edge points at a root. Only minima are aggregated, never lists of neighbours, so a hub costs
    one partial minimum per task; the joins on hubs are ones that adaptive execution can split. Each
    round cuts the lineage. Nodes without an edge to another node are not in the result.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            edges.groupBy("a").agg(F.min("b").alias("b"))
        ).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        after = cut(
            small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        )
        # done when all edges are stars: no target of an edge is the source of another
        unfinished = after.select(F.col("b").alias("x")).distinct().join(after.select(F.col("a").alias("x")).distinct(), "x", "left_semi")
        edges, done = after, unfinished.isEmpty() and after.groupBy("a").count().where("count > 1").isEmpty()
        if done:
            break
    else:
        raise RuntimeError(f"no convergence in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
