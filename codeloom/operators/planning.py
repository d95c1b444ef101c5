"""Partition planning, change detection, staleness, upserts and deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

COALESCED = "__coalesced__"


def partition_roots(files: DataFrame, submodules: DataFrame | None = None) -> DataFrame:
    """file_path, root_path, kind: the longest submodule that holds the file, else the first path segment (``.`` at the top)."""
    top = F.when(F.instr("file_path", "/") > 0, F.substring_index("file_path", "/", 1)).otherwise(".")
    rows = files.select("file_path", top.alias("top"))
    if submodules is None:
        return rows.select("file_path", F.col("top").alias("root_path"), F.lit("top_level").alias("kind"))
    # every ancestor directory of a file is an equi-join key, so there is no join on prefixes
    parts = F.split("file_path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    subs = submodules.select(F.col("path").alias("up")).distinct()
    found = rows.select("file_path", F.explode(ups).alias("up")).join(subs, "up").groupBy("file_path").agg(F.max_by("up", F.length("up")).alias("sub"))
    return rows.join(found, "file_path", "left").select(
        "file_path", F.coalesce("sub", "top").alias("root_path"), F.when(F.col("sub").isNotNull(), "submodule").otherwise("top_level").alias("kind")
    )


def plan_partitions(files: DataFrame, submodules: DataFrame | None = None, min_files: int = 1) -> DataFrame:
    """root_path, kind, weight: groups of fewer than ``min_files`` files are one group."""
    sizes = partition_roots(files, submodules).groupBy("root_path", "kind").agg(F.count("*").alias("weight"))
    small = F.col("weight") < min_files
    merged = sizes.select(
        F.when(small, COALESCED).otherwise(F.col("root_path")).alias("root_path"), F.when(small, "coalesced").otherwise(F.col("kind")).alias("kind"), "weight"
    )
    return merged.groupBy("root_path", "kind").agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), "root_path")


def partition_of_files(files: DataFrame, submodules: DataFrame | None = None, min_files: int = 1) -> DataFrame:
    """file_path and the root_path of its planned partition."""
    roots = partition_roots(files, submodules)
    sizes = roots.groupBy("root_path").agg(F.count("*").alias("n"))
    return roots.join(sizes, "root_path").select("file_path", F.when(F.col("n") < min_files, COALESCED).otherwise(F.col("root_path")).alias("root_path"))


def changed_files(manifest: DataFrame, current: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """file_path, status (added, deleted, modified) of a manifest against the current files (file_path, mtime, size)."""
    m = manifest.select("file_path", F.col("mtime").alias("m0"), F.col("size").alias("s0"), F.lit(True).alias("old"))
    c = current.select("file_path", F.col("mtime").alias("m1"), F.col("size").alias("s1"), F.lit(True).alias("new"))
    touched = (F.abs(F.col("m0") - F.col("m1")) > tolerance) | (F.col("s0") != F.col("s1"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(touched, "modified")
    return m.join(c, "file_path", "full_outer").select("file_path", status.alias("status")).where("status IS NOT NULL")


def union_distinct(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def without(paths: DataFrame, ignored: DataFrame) -> DataFrame:
    return paths.join(ignored.select("file_path").distinct(), "file_path", "left_anti")


def within(paths: DataFrame, allowed: DataFrame) -> DataFrame:
    return paths.join(allowed.select("file_path").distinct(), "file_path", "left_semi")


def latest(batch: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row of each key: the last by ``order``, or by a hash of the row."""
    by = F.col(order) if order else F.xxhash64(*[c for c in batch.columns])
    return batch.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(by.desc()))).where("__n = 1").drop("__n")


def upsert(target: DataFrame, batch: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of ``target`` whose key is not in the batch, and the batch, each key once."""
    return target.join(batch.select(key).distinct(), key, "left_anti").unionByName(latest(batch, key, order).select(*target.columns))


def delete_by_file(target: DataFrame, files: DataFrame) -> DataFrame:
    return without(target, files).select(*target.columns)


def stale_for_commit(state: DataFrame, head: str | None) -> DataFrame:
    """head_commit and is_stale for each state row: whether it was indexed at another commit than ``head``."""
    commit = F.col("workspace_state.head_commit")
    return state.select(commit.alias("head_commit"), (~commit.eqNullSafe(F.lit(head))).alias("is_stale"))


def staleness(state: DataFrame, head: str | None, dirty: bool, changed: DataFrame | None = None) -> DataFrame:
    """One row: is_stale, reason, head_changed, changed_file_count (-1 without ``changed``); no state is a stale index."""
    n = changed.agg(F.count("*").cast("int").alias("changed")) if changed is not None else state.sparkSession.sql("SELECT -1 AS changed")
    stored = state.agg(F.max("workspace_state.head_commit").alias("stored"), F.count("*").alias("states"))
    now = F.lit(head)
    moved = F.coalesce((now != "") & (F.col("stored") != "") & (now != F.col("stored")), F.lit(False))
    reason = F.when(F.col("states") == 0, "no_index").when(moved, "head_changed").when(F.lit(dirty), "worktree_dirty").otherwise("")
    return stored.join(n, F.lit(True)).select(reason.alias("reason"), "changed").select(
        (F.col("reason") != "").alias("is_stale"), "reason", (F.col("reason") == "head_changed").alias("head_changed"),
        F.when(F.col("reason") == "head_changed", F.col("changed")).otherwise(0).alias("changed_file_count"),
    )
