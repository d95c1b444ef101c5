"""Sharding by extendible hashing.

A directory maps prefixes of a 64-bit hash to shards. It starts as one bucket; only a bucket over the byte
limit is split, on its next bit, until every shard fits or holds a single row. Sizes are aggregated once by
a prefix a few bits longer than needed on average; every ancestor's size follows from that table, and a
row's shard is its shortest prefix that fits. Rows under prefixes that do not fit at that depth go on with
longer ones. Rows whose whole hash is equal (repeated rows) go on with the bits of a hash of their place, which is
written down first, so that every step sees the same.

Defined results: a null text is empty; sizes are UTF-8 bytes of the text; a row over the limit is a shard of
its own; an empty table gives no rows. A shard is named by its bits, the root by the empty string. Columns
named ``shard`` and ``shard_bytes`` are replaced; all others stay, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 8 << 20


def bits(h: Column, n: Column | int) -> Column:
    """The first ``n`` bits of a hash, as text."""
    return F.left(F.lpad(F.bin(h), 64, "0"), n if isinstance(n, Column) else F.lit(n))


def _level(rows: DataFrame, key: str, above: int, depth: int, limit: int) -> DataFrame:
    """Prefixes of ``depth`` bits and, for each, the length of its shortest ancestor that fits (null: none does)."""
    cells = rows.groupBy("base", bits(F.col(key), depth).alias("cell")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
    each = cells.select("*", F.explode(F.sequence(F.lit(above), F.lit(depth))).alias("d"))
    each = each.withColumn("up", F.left("cell", F.col("d")))
    sums = each.groupBy("base", "d", "up").agg(F.sum("b").alias("sb"), F.sum("n").alias("sn"))
    fits = sums.where((F.col("sb") <= limit) | (F.col("sn") == 1))
    found = each.join(fits, ["base", "d", "up"], "left").groupBy("base", "cell").agg(F.min(F.when(F.col("sn").isNotNull(), F.struct("d", "sb", "sn"))).alias("f"))
    return found.select("base", "cell", F.col("f.d").alias("d"), F.col("f.sb").alias("sb"))


def assign(docs: DataFrame, limit: int = LIMIT, size: Column | None = None, key: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """``docs`` with its columns and shard (bits), shard_bytes. size: a row's bytes, if not those of its text; key: the columns hashed."""
    from codeloom.llm.common import cut

    size = F.coalesce(F.octet_length("text") if size is None else size, F.lit(0)).cast("long")
    kept = [c for c in docs.columns if c not in ("shard", "shard_bytes")]
    rows = docs.select(F.struct(*[docs[c] for c in kept]).alias("doc"), size.alias("bytes"), F.xxhash64(*key).alias("hash"), F.lit("").alias("base"))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    first = min(64, max(1, math.ceil(math.log2(max(2, total / limit))) + 4))
    out = None
    for by in ("hash", "place"):
        if by == "place":
            rows = cut(rows.withColumn("place", F.xxhash64(F.monotonically_increasing_id())))
        above, depth = (0, first) if by == "hash" else (1, 8)
        while True:
            table = cut(_level(rows, by, above, depth, limit))
            held = rows.withColumn("cell", bits(F.col(by), depth)).join(table, ["base", "cell"])
            done = held.where("d IS NOT NULL").select("doc.*", F.concat("base", F.left("cell", F.col("d"))).alias("shard"), F.col("sb").alias("shard_bytes"))
            out = done if out is None else out.unionAll(done)
            if table.where("d IS NULL").isEmpty():
                return out
            rows = held.where("d IS NULL").select("doc", "bytes", "hash", "base", *(["place"] if by == "place" else []))
            if depth == 64:
                rows = rows.withColumn("base", bits(F.col(by), 64))
                break
            above, depth = depth + 1, min(64, depth + 12)
    raise RuntimeError("places of rows are not distinct")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Writes each shard as a folder ``shard=<bits>`` of one file."""
    sharded = assign(docs, limit).drop("shard_bytes")
    sharded.repartition("shard").withColumn("shard", F.concat(F.lit("b"), "shard")).write.mode("overwrite").partitionBy("shard").parquet(path)


def op9_extendible_sharding(spark, sf_dir):
    from codeloom.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return assign(docs, size=F.col("n_bytes"), key=("doc_id", "h")).select("doc_id", "shard", F.length("shard").alias("depth"), "shard_bytes", "n_bytes")
