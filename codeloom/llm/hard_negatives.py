"""Hard negatives for anchors, as a Voronoi-partition kNN join over norm-augmented vectors.

Every vector x gets one more component, sqrt(M - x.x), where M is the largest squared norm; an anchor q gets 0. All
augmented vectors then have the same norm, so an inner product is a distance: q.x = (q.q + M - d * d) / 2, and the
triangle inequality bounds it. Augmented vectors are assigned to their nearest pivot. A cell is summed up by its rows and
largest distance to the pivot, in all and for each label. From its own distances to the pivots an anchor derives, for
each cell, between which scores all of its rows lie, and with that which cells it needs:

1. Positives: the cells of its label whose upper bound reaches the score that the cells of the highest lower bounds
   surely reach with enough rows.
2. Negatives, once the exact positives are known: the cells that may hold a score between ``low`` and ``high`` percent
   of a positive's, but for those below a score that enough rows of cells wholly within these limits surely reach.

Anchors are grouped by their pivot, at most about ``QUERIES`` to a part. A cell's rows go to the groups that have an anchor
which needs the cell, and to no other; what a group needs is dealt by a hash into blocks of about ``BLOCK`` rows, so that
neither a dense cell nor a frequent label fills a task. Blocks are solved exactly, by matrix products of integers, and their
best are merged. At most ``MOST_PIVOTS`` pivots are broadcast; routes, label summaries and anchors stay tables.

Defined results: rows with a null id, a null label, or a vector that is null or has a null or non-finite component take no
part; a shorter vector counts as padded with zeros; all rows with an anchor's id are its own, neither its positives nor its
negatives; equal scores go to the smaller id, and repeated rows are ranked as often as they occur; rows that repeat an anchor's id,
label and vector are one anchor, rows of one id but other vectors or labels are anchors of their own; a positive with a score below 0 has
no negatives, as no score is within its limits; an anchor without positives has no rows; scores beyond 64 bits are clipped; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import cut, table
from codeloom.llm.voronoi import CHOICE, matrix, products, scaled, spread_out

PIVOTS, MOST_PIVOTS, QUERIES, BLOCK = 16, 512, 4096, 16384


def distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of augmented vectors to augmented pivots, of which the last column is the further component."""
    p = pivots[:, :-1]
    d = (x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)[None] + (extra[:, None] - pivots[None, :, -1]) ** 2
    return np.sqrt(np.maximum(d, 0))


def further(x: np.ndarray, most: float) -> np.ndarray:
    return np.sqrt(np.maximum(most - (x * x).sum(1), 0))


def between(square: float, most: float, d: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of an anchor (its squared norm) with cells at distances ``d``; wider by what rounding may take."""
    slack = 1e-6 * (1 + square + most)
    low = (square + most - (d + radius) ** 2) / 2 - slack
    high = (square + most - np.maximum(d - radius, 0) ** 2) / 2 + slack
    return low, high


def reached(low: np.ndarray, rows: np.ndarray, wanted: int) -> float:
    """A score that surely ``wanted`` rows of these cells reach."""
    order = np.argsort(-low)
    enough = np.flatnonzero(np.cumsum(rows[order]) >= wanted)
    return low[order[enough[0]]] if len(enough) else -np.inf


def limits(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and the largest integer s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def celled_of(rows: DataFrame, every: int):
    """``rows(vec_id, label, v)`` with cell, distance to its pivot and a hash to deal by; the broadcast pivots; M; the largest dimension."""
    import pyarrow as pa

    spark = rows.sparkSession
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    n, dim, most, asks = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(square), F.lit(0.0)), F.count_if(F.col("vec_id") % every == 0)).first()
    most *= 1 + 1e-12
    wanted = min(MOST_PIVOTS, max(PIVOTS, -(-asks // QUERIES), -(-n // BLOCK)))
    sample = rows.orderBy(F.xxhash64(F.lit("pivot"), "vec_id"), "vec_id").limit(wanted * CHOICE).select("v").collect()
    x = np.zeros((max(1, len(sample)), dim))
    for i, r in enumerate(sample):
        x[i, : len(r.v)] = r.v
    pivots = spark.sparkContext.broadcast(spread_out(np.column_stack([x, further(x, most)]), wanted))

    def assign(batches):
        for b in batches:
            x = matrix(b.column("v"), dim).astype(np.float64)
            d = distances(x, further(x, most), pivots.value)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], [*b.schema.names, "cell", "far"])

    fields = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return cut(rows.mapInArrow(assign, f"{fields}, cell int, far double").withColumn("spread", F.xxhash64("vec_id", F.monotonically_increasing_id()))), pivots, most, dim


def asking(anchors: DataFrame, pivots, most: float, dim: int, need) -> DataFrame:
    """``anchors`` with ``group`` (their nearest pivot) and ``needs``: the cells that ``need(row, square, distances)`` names."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            x = matrix(b.column("w"), dim).astype(np.float64)
            d = distances(x, np.zeros(len(x)), pivots.value)
            rest = b.drop_columns(["w"]).to_pylist()
            needs = [sorted(need(r, float((q * q).sum()), e)) for r, q, e in zip(rest, x, d, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d.argmin(1).astype(np.int32)), pa.array(needs, pa.list_(pa.int32()))], [*b.schema.names, "group", "needs"])

    fields = ", ".join(f"{c} {t}" for c, t in anchors.dtypes)
    return cut(anchors.mapInArrow(run, f"{fields}, `group` int, needs array<int>"))


def met(asked: DataFrame, celled: DataFrame, routes: DataFrame, sizes: DataFrame, on: list[str], solve, returns: str) -> DataFrame:
    """Solves anchors with the rows that their groups need, in blocks. routes: distinct group and ``on``; sizes: rows of each ``on``."""
    routes = cut(routes.join(sizes, on))
    blocks = F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks")
    parts = asked.groupBy("group").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    plan = routes.groupBy("group").agg(blocks).join(parts, "group")  # at most as many rows as pivots
    sent = celled.join(routes.drop("n"), on).join(F.broadcast(plan), "group")
    numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    sent = sent.select("vec_id", "label", "v", "group", F.pmod("spread", "blocks").cast("int").alias("block"), numbers("parts").alias("part"))
    left = asked.join(F.broadcast(plan), "group").drop("needs", "summary").withColumn("part", F.pmod(F.xxhash64("q"), "parts").cast("int")).withColumn("block", numbers("blocks"))
    keys = ["group", "part", "block"]
    return left.groupBy(keys).cogroup(sent.groupBy(keys)).applyInArrow(solve, returns)


def mined(vectors: DataFrame, positives: int = 5, negatives: int = 5, factor: float = 256.0, every: int = 100, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank of ``vectors(vec_id, label, embedding)``.

    Components become floor(``factor`` * x). Anchors are rows whose vec_id is divisible by ``every``; a positive's
    negatives are the first ``negatives`` rows of another label with low * positive_score <= 100 * score <= high * positive_score.
    """
    import pyarrow as pa

    rows = cut(scaled(vectors.where("label IS NOT NULL"), factor, "label"))
    celled, pivots, most, dim = celled_of(rows, every)
    kind, label = celled.schema["vec_id"].dataType.simpleString(), celled.schema["label"].dataType.simpleString()
    is_anchor = F.col("vec_id") % every == 0
    own = celled.where(is_anchor).groupBy("vec_id").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    cells = {r.cell: (r.n, r.radius) for r in celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}  # one of each pivot
    by_label = cut(celled.groupBy("cell", "label").agg(F.count("*").alias("n"), F.max("far").alias("radius")))
    summary = by_label.groupBy("label").agg(F.collect_list(F.struct("cell", "n", "radius")).alias("summary"))  # at most one of each pivot
    anchors = celled.where(is_anchor).select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("of"), F.col("v").alias("w")).distinct()
    anchors = anchors.withColumn("q", F.monotonically_increasing_id()).join(summary.withColumnRenamed("label", "of"), "of")
    anchors = cut(anchors)
    numbers = np.array(sorted(cells), int)
    radius, total = np.array([cells[c][1] for c in numbers.tolist()]), np.array([cells[c][0] for c in numbers.tolist()])

    def same_label(r, square, d):
        c = np.array([s["cell"] for s in r["summary"]], int)
        lower, upper = between(square, most, d[c], np.array([s["radius"] for s in r["summary"]]))
        return c[upper >= reached(lower, np.array([s["n"] for s in r["summary"]]), positives + own)].tolist()

    def other_labels(r, square, d):
        alike = {s["cell"]: s["n"] for s in r["summary"]}
        others = total - np.array([alike.get(c, 0) for c in numbers.tolist()], int)
        lower, upper = between(square, most, d[numbers], radius)
        needed = np.zeros(len(numbers), bool)
        for s in r["scores"]:
            a, b = limits(s, low, high)
            if a > b:
                continue
            inside = (lower >= a) & (upper <= b)
            floor = max(a, reached(lower[inside], others[inside], negatives + own))
            needed |= (others > 0) & (upper >= floor) & (lower <= b)
        return numbers[needed].tolist()

    def best(ids, scores, k):
        """Places of the k highest scores, equal ones by id; ids are in ascending order."""
        if len(scores) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            over, level = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
            return np.concatenate([over, level[: k - len(over)]])
        return np.arange(len(scores))

    def solved(left, right, found):
        """Calls ``found`` for each anchor of a block, with the ids, labels and scores of the others, by ascending id."""
        if not (left.num_rows and right.num_rows):
            return
        ids, labels, x = right.column("vec_id").to_numpy(), right.column("label").to_numpy(zero_copy_only=False), matrix(right.column("v"), dim)
        order = np.argsort(ids, kind="stable")
        ids, labels, x = ids[order], labels[order], x[order]
        mine, of = left.column("anchor_id").to_numpy(), left.column("of").to_numpy(zero_copy_only=False)
        w = matrix(left.column("w"), dim)
        for a in range(0, len(mine), 256):
            for i, s in enumerate(products(w[a : a + 256], x), a):
                found(i, ids, (labels == of[i]) & (ids != mine[i]), (labels != of[i]) & (ids != mine[i]), s)

    def nearest(left, right):
        out = ([], [], [])

        def found(i, ids, alike, _, scores):
            at = np.flatnonzero(alike)
            at = at[best(ids[at], scores[at], positives)]
            for column, values in zip(out, ([left.column("q")[i].as_py()] * len(at), ids[at].tolist(), scores[at].tolist()), strict=True):
                column.extend(values)

        solved(left, right, found)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], right.schema.field("vec_id").type), pa.array(out[2], pa.int64())], ["q", "positive_id", "positive_score"])

    def hardest(left, right):
        out = ([], [], [], [])
        windows = [[limits(s, low, high) for s in x] for x in left.column("scores").to_pylist()]

        def found(i, ids, _, unlike, scores):
            some = np.flatnonzero(unlike & (scores >= min(a for a, _ in windows[i])) & (scores <= max(b for _, b in windows[i])))
            for p, (a, b) in enumerate(windows[i], 1):
                at = some[(scores[some] >= a) & (scores[some] <= b)]
                at = at[best(ids[at], scores[at], negatives)]
                for column, values in zip(out, ([left.column("q")[i].as_py()] * len(at), [p] * len(at), ids[at].tolist(), scores[at].tolist()), strict=True):
                    column.extend(values)

        solved(left, right, found)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], right.schema.field("vec_id").type), pa.array(out[3], pa.int64())], ["q", "positive_rank", "negative_id", "negative_score"])

    asked = asking(anchors, pivots, most, dim, same_label)
    routes = asked.select("group", F.explode("needs").alias("cell"), F.col("of").alias("label")).distinct()
    first = met(asked, celled, routes, by_label.select("cell", "label", "n"), ["cell", "label"], nearest, f"q long, positive_id {kind}, positive_score long")
    order = Window.partitionBy("q").orderBy(F.desc("positive_score"), "positive_id")
    chosen = cut(first.withColumn("positive_rank", F.row_number().over(order)).where(F.col("positive_rank") <= positives))
    listed = chosen.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("positive_rank", "positive_score"))), lambda s: s["positive_score"]).alias("scores"))  # at most ``positives`` of each anchor
    asked = asking(anchors.join(listed, "q"), pivots, most, dim, other_labels)
    routes = asked.select("group", F.explode("needs").alias("cell")).distinct()
    second = met(asked, celled, routes, by_label.groupBy("cell").agg(F.sum("n").alias("n")), ["cell"], hardest, f"q long, positive_rank int, negative_id {kind}, negative_score long")
    order = Window.partitionBy("q", "positive_rank").orderBy(F.desc("negative_score"), "negative_id")
    kept = second.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = chosen.join(anchors.select("q", "anchor_id"), "q")
    return kept.join(named, ["q", "positive_rank"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")


def op12_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return mined(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


OP12_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT row_number() OVER () AS q, * FROM (SELECT DISTINCT vec_id AS anchor_id, label AS own, v AS w FROM e WHERE vec_id % 100 = 0)),
s AS (SELECT q, anchor_id, vec_id, label = own AS alike, CAST(list_inner_product(w, v) AS BIGINT) AS score FROM a JOIN e ON vec_id <> anchor_id),
p AS (
  SELECT q, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS positive_rank FROM s WHERE alike
  QUALIFY positive_rank <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.q, positive_rank ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.q = p.q AND NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
  QUALIFY rank <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score, CAST(positive_rank AS INTEGER) AS positive_rank FROM n
"""
