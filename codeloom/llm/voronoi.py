"""Exact top-k search by inner product, as a Voronoi kNN join.

Data and queries are grouped by their nearest pivot. A cell's summary (rows, largest distance to its
pivot) bounds the inner products of a group of queries with all of its rows: for query q near pivot p_i
and row x near p_j, q.x lies within R_i |p_j| + (|p_i| + R_i) r_j of p_i.p_j. The cells of the highest
lower bounds that surely hold k rows which are not the query's own give a score that each query of the group reaches;
a cell whose upper bound is below it is not sent to the group. What a group needs is dealt in blocks of ``BLOCK``
rows, its queries go to these blocks alone, and a group of over ``QUERIES`` queries is dealt in parts, so that a dense
cell fills no task; blocks are solved by matrix products and their best are merged. There are as many pivots as
blocks or parts, at least ``PIVOTS``, far apart from one another among ``CHOICE`` times as many sampled vectors; pivots, summaries and the plan made of them are bounded by ``MOST_PIVOTS`` and its square.

Defined results: vectors that are null, hold a null or non-finite component or have a null id take no part;
a shorter vector counts as padded with zeros; a query's own rows are all rows with its id; equal scores go
to the smaller id, and repeated rows are ranked as often as they occur; rows that repeat a query's id and vector are
one query, and rows of one id but other vectors are queries of their own under that id; scores beyond 64 bits are
clipped; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIVOTS, MOST_PIVOTS, QUERIES, BLOCK = 16, 512, 4096, 16384
#: Sampled vectors that each pivot is chosen from.
CHOICE = 8


def scaled(vectors: DataFrame, factor: float, *others: str) -> DataFrame:
    """vec_id, ``others``, v (array<long>): floor(factor * x) of each component, for the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    fit = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.coalesce(fit, F.lit(False))).select("vec_id", *others, F.transform(x, lambda c: F.floor(c * F.lit(factor)).cast("long")).alias("v"))


def matrix(column, dim: int) -> np.ndarray:
    """Rows of an Arrow list column as int64, padded with zeros."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in double where every partial sum is below 2**53, else in Python integers."""
    top = lambda m: int(np.abs(m.astype(np.float64)).max(initial=0)) + 1
    if top(q) * top(x) * max(1, q.shape[1]) < 1 << 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    exact = q.astype(object) @ x.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def replicas(pivots: np.ndarray, cells: dict, groups: dict, k: int, own: int = 1) -> dict[int, list[int]]:
    """For each cell the query groups that need it. cells: number to (rows, radius); groups: number to radius; own: most rows with one query's id."""
    p = pivots.astype(np.float64)
    norm = np.sqrt((p * p).sum(1))
    need: dict[int, list[int]] = {j: [] for j in cells}
    order = sorted(cells)
    n = np.array([cells[j][0] for j in order])
    r = np.array([cells[j][1] for j in order])
    for i, radius in groups.items():
        mid = p[order] @ p[i]
        slack = radius * norm[order] + (norm[i] + radius) * r
        slack = slack * (1 + 1e-9) + 1e-6 * (1 + np.abs(mid))
        low, high = mid - slack, mid + slack
        by_low = np.argsort(-low)
        enough = np.flatnonzero(np.cumsum(n[by_low]) >= k + own)
        floor = low[by_low[enough[0]]] if len(enough) else -np.inf
        for j in np.flatnonzero(high >= floor).tolist():
            need[order[j]].append(i)
    return need


def spread_out(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Of a sample, the first vector, then again and again the one that is farthest from those taken."""
    x = sample.astype(np.float64)
    taken, far = [0], np.full(len(x), np.inf)
    while len(taken) < min(wanted, len(x)):
        far = np.minimum(far, ((x - x[taken[-1]]) ** 2).sum(1))
        if not far.max() > 0:
            break
        taken.append(int(far.argmax()))
    return sample[taken]


def planned(need: dict[int, list[int]], sizes: dict[int, int], asks: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """(cell, group, place, blocks, parts): the cells that a group needs lie one after the other, from ``place``, and are cut into its blocks."""
    at, rows = dict.fromkeys(asks, 0), []
    for cell, groups in need.items():
        for g in groups:
            rows.append((cell, g, at[g]))
            at[g] += sizes[cell]
    return [(cell, g, place, -(-at[g] // BLOCK), -(-asks[g] // QUERIES)) for cell, g, place in rows]


def grouped(data: DataFrame, k: int, every: int):
    """``data(vec_id, v)`` with its cell, and the plan of what goes where."""
    import pyarrow as pa

    from codeloom.llm.common import cut

    spark, is_query = data.sparkSession, F.col("vec_id") % every == 0
    n, dim, nq = data.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.count_if(is_query)).first()
    own = data.where(is_query).groupBy("vec_id").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    wanted = min(MOST_PIVOTS, max(PIVOTS, -(-nq // QUERIES), -(-n // BLOCK)))
    rows = data.orderBy(F.xxhash64(F.lit("pivot"), "vec_id"), "vec_id").limit(wanted * CHOICE).collect()
    sample = np.zeros((max(1, len(rows)), dim), np.int64)
    for i, row in enumerate(rows):
        sample[i, : len(row.v)] = row.v
    pivots = spread_out(sample, wanted)
    shared = spark.sparkContext.broadcast(pivots)  # at most MOST_PIVOTS vectors

    def assign(batches):
        p = shared.value.astype(np.float64)
        for b in batches:
            x = matrix(b.column("v"), dim).astype(np.float64)
            d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)[None], 0)
            cell = d.argmin(1)
            far = np.sqrt(((x - p[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(cell.astype(np.int32)), pa.array(far)], ["vec_id", "v", "cell", "far"])

    kind = data.schema["vec_id"].dataType.simpleString()
    celled = cut(data.mapInArrow(assign, f"vec_id {kind}, v array<long>, cell int, far double").withColumn("spread", F.xxhash64("vec_id", F.monotonically_increasing_id())))
    summary = celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r"), F.max(F.when(is_query, F.col("far"))).alias("q"), F.count_if(is_query).alias("asks")).collect()
    sizes, asks = {s.cell: s.n for s in summary}, {s.cell: s.asks for s in summary if s.asks}
    need = replicas(pivots, {s.cell: (s.n, s.r) for s in summary}, {s.cell: s.q for s in summary if s.asks}, k, own)
    return celled, planned(need, sizes, asks), sizes, dim


def top_k(vectors: DataFrame, k: int = 10, factor: float = 1024.0, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score for queries whose id is divisible by ``every``."""
    import pyarrow as pa
    from pyspark.sql import Window

    from codeloom.llm.common import cut

    spark = vectors.sparkSession
    celled, plan, sizes, dim = grouped(cut(scaled(vectors, factor)), k, every)
    kind = celled.schema["vec_id"].dataType.simpleString()
    # at most MOST_PIVOTS squared rows of six numbers, one row of four for each group
    routes = spark.createDataFrame([(c, g, place, parts, sizes[c]) for c, g, place, _, parts in plan], "cell int, `group` int, place long, parts long, size long")
    stops = spark.createDataFrame([*{(g, blocks, parts) for _, g, _, blocks, parts in plan}], "cell int, blocks long, parts long")
    sent = celled.join(F.broadcast(routes), "cell").select(
        "vec_id", "v", "group", F.floor((F.col("place") + F.pmod("spread", "size")) / BLOCK).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("part")
    )
    asked = celled.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]).withColumn("q", F.xxhash64("vec_id", "v")).join(F.broadcast(stops), "cell")
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("w"), "q", F.col("cell").alias("group"), F.pmod("spread", "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("block"))

    def solve(left, right):
        ids, named, found, score = [], [], [], []
        if left.num_rows and right.num_rows:
            qid, name, q = left.column("query_id").to_numpy(), left.column("q").to_numpy(), matrix(left.column("w"), dim)
            vid, x = right.column("vec_id").to_numpy(), matrix(right.column("v"), dim)
            order = np.argsort(vid, kind="stable")
            vid, x = vid[order], x[order]
            for a in range(0, len(qid), 256):
                s = products(q[a : a + 256], x)
                for row, own, number in zip(s, qid[a : a + 256].tolist(), name[a : a + 256].tolist(), strict=True):
                    others = np.flatnonzero(vid != own)
                    mine = row[others]
                    if len(mine) > k:
                        least = np.partition(mine, len(mine) - k)[len(mine) - k]
                        over = np.flatnonzero(mine > least)
                        take = np.concatenate([over, np.flatnonzero(mine == least)[: k - len(over)]])
                    else:
                        take = np.arange(len(mine))
                    ids += [own] * len(take)
                    named += [number] * len(take)
                    found += vid[others[take]].tolist()
                    score += mine[take].tolist()
        t = left.schema.field("query_id").type
        return pa.table([pa.array(ids, t), pa.array(named, pa.int64()), pa.array(found, t), pa.array(score, pa.int64())], ["query_id", "q", "vec_id", "score"])

    keys = ["group", "part", "block"]
    best = asked.groupBy(keys).cogroup(sent.groupBy(keys)).applyInArrow(solve, f"query_id {kind}, q long, vec_id {kind}, score long")
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_voronoi_topk(spark, sf_dir):
    from codeloom.llm.common import table

    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, a.q, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v) a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
