"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints that differ in at most ``2 * half`` bits share a variant within ``half`` bits of both. Every
fingerprint emits all its variants; fingerprints meeting on a variant are linked, and any two that do are
within ``2 * half`` bits of one another, so the meeting itself verifies the pair.

The shuffle is on the leading bits of the variants: a fingerprint is sent once to each cell that has
variants of it, and its variants in that cell are made there, so 37 rows stand for 2,081 variants. A cell
with more than ``cell`` variants is split on further bits, down to single variants, so that a dense group
of fingerprints spreads out. Within a variant the members are tied to the first, and within a cell only a
spanning forest leaves: no pairs are listed.

Defined results: a null or empty text has fingerprint zero and is linked like any other; repeated rows
have equal fingerprints; a null doc_id takes part, but does not name a class unless all its members' ids
are null; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 4
HALF = 2
CELL = 1 << 21
STEP = 6


def hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of each of a text's word shingles, repeats included; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(b" ".join(parts), 42)] if parts else [], "<u8")
    line = memoryview(b" ".join(parts))
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    starts, ends = (end - size)[: len(parts) - words + 1].tolist(), end[words - 1 :].tolist()
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, ends, strict=True)), "<u8", len(starts))


def majority(h: np.ndarray) -> int:
    """The bits that over half of the numbers have; zero of none."""
    ones, n = np.zeros(64, np.int64), len(h)
    if n == 1:
        return int(h[0])
    for k in range(0, n, 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little") if n else 0


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash of a text's word shingles; a bit is set if it is in over half of their hashes."""
    return majority(hashes(text, words))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, a hash of the text, and the fingerprint as a signed long, one row per document."""
    import pyarrow as pa

    from codeloom.llm.common import held

    def run(batches):
        held(None, dict)  # other operators' caches go
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(fp)], ["doc_id", "text_hash", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash long, fp long")


def flips(bits: int, most: int) -> np.ndarray:
    """All masks of ``bits`` bits with at most ``most`` of them set."""
    one = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    out = [np.zeros(1, np.uint64)]
    if most >= 1:
        out.append(one)
    if most >= 2 and bits > 1:
        i, j = np.triu_indices(bits, 1)
        out.append(one[i] | one[j])
    if most > 2:
        raise ValueError("variants of more than two bits are not needed")
    return np.concatenate(out)


def _solve(depth_name: str = "depth"):
    def run(group):
        import pyarrow as pa

        fp = group.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        cell = group.column("cell").to_numpy().astype(np.int64).view(np.uint64)
        left = group.column("left").to_numpy()
        depth = int(group.column(depth_name)[0].as_py())
        low = 64 - depth
        mask = np.uint64((1 << low) - 1)
        order = np.argsort(fp, kind="stable")
        fp, cell, left = fp[order], cell[order], left[order]
        root = np.arange(len(fp))
        made, owner = [], []
        for budget in np.unique(left).tolist():
            rows = np.flatnonzero(left == budget)
            base = (cell[rows] & ~mask) | (fp[rows] & mask)
            f = flips(low, budget)
            made.append((base[:, None] ^ f[None, :]).ravel())
            owner.append(np.repeat(rows, len(f)))
        made, owner = np.concatenate(made), np.concatenate(owner)
        order = np.argsort(made, kind="stable")
        made, owner = made[order], owner[order]
        same = made[1:] == made[:-1]
        a, b = owner[1:][same], owner[:-1][same]
        pair = np.unique(np.minimum(a, b).astype(np.int64) * len(fp) + np.maximum(a, b))
        a, b = pair // len(fp), pair % len(fp)
        while True:  # smallest label over the links, then shortcuts, until nothing changes
            before = root.copy()
            least = np.minimum(root[a], root[b])
            np.minimum.at(root, root[a], least)
            np.minimum.at(root, root[b], least)
            while (root[root] != root).any():
                root = root[root]
            if (root == before).all():
                break
        child = np.flatnonzero(root != np.arange(len(fp)))
        return pa.table({"a": fp[child].view(np.int64), "b": fp[root[child]].view(np.int64)})

    return run


def _refine(cells: DataFrame, bits: int) -> DataFrame:
    """Each row to the children of its cell, ``bits`` more bits deep, that have variants of it."""
    children = cells.selectExpr("fp", "cell", "`left`", "depth", f"least({bits}, 64 - depth) AS more")
    child = []
    for spent in range(HALF + 1):
        masks = [0] if spent == 0 else [1 << i for i in range(bits)] if spent == 1 else [1 << i | 1 << j for i in range(bits) for j in range(i)]
        child.append((spent, masks))
    out = None
    for spent, masks in child:
        values = F.array(*[F.lit(m).cast("long") for m in masks])
        rows = children.where(F.col("left") >= spent).select("*", F.explode(values).alias("m")).where(F.expr("m < shiftleft(1L, more)"))
        rows = rows.selectExpr(
            "fp",
            # the next bits of the fingerprint, flipped by m, below the cell's own
            "cell | shiftleft((shiftrightunsigned(fp, 64 - depth - more) & (shiftleft(1L, more) - 1)) ^ m, 64 - depth - more) AS cell",
            f"`left` - {spent} AS `left`",
            "depth + more AS depth",
        )
        out = rows if out is None else out.unionAll(rows)
    return out


def links(fps: DataFrame, cell: int = CELL) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints ``fps(fp)`` within ``2 * HALF`` bits."""
    from codeloom.llm.common import cut

    n = fps.count()
    variants = 1 + 64 + 64 * 63 // 2
    depth = min(24, max(8, math.ceil(math.log2(max(1, n) * variants / cell * 2))))
    cells = fps.selectExpr("fp", "0L AS cell", f"{HALF} AS `left`", "0 AS depth")
    cells = _refine(cells, depth)
    weight = F.expr("CASE `left` WHEN 0 THEN 1L WHEN 1 THEN 65L - depth ELSE 1 + (64L - depth) + (64L - depth) * (63L - depth) DIV 2 END")
    solved = None
    while True:
        sizes = cells.groupBy("cell").agg(F.sum(weight).alias("w"), F.count("*").alias("n"), F.first("depth").alias("d"))
        heavy = cut(sizes.where((F.col("w") > cell) & (F.col("n") > 1) & (F.col("d") < 64)).select("cell"))
        if heavy.isEmpty():
            last = cells
            more = False
        else:
            last, more = cells.join(heavy, "cell", "left_anti"), True
        part = last.groupBy("cell").applyInArrow(_solve(), "a long, b long")
        solved = part if solved is None else solved.unionAll(part)
        if not more:
            return solved
        cells = cut(_refine(cells.join(heavy, "cell", "left_semi"), STEP))


def tied(names: DataFrame) -> DataFrame:
    """fp, root for ``names(fp, name)``, distinct fingerprints with orderable distinct names: the smallest name reachable.

    The components are those of the names, so that a class gets its name with the links and not by a join on the class.
    """
    from codeloom.llm.common import components, cut

    names = cut(names)
    found = links(names.select("fp"))
    of = lambda c: names.select(F.col("fp").alias(c), F.col("name").alias(f"n{c}"))
    edges = found.join(of("a"), "a").join(of("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    done = components(edges).withColumnRenamed("node", "name")
    return names.join(done, "name", "left").select("fp", F.coalesce("root", "name").alias("root"))


def classes(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text_hash, fp and component_id (the smallest doc_id reachable) for each row of ``docs(doc_id, text)``."""
    from codeloom.llm.common import cut

    rows = cut(fingerprints(docs, words))
    # a null doc_id names a class only if there is no other
    names = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "fp")).alias("name"))
    named = tied(names).select("fp", F.col("root.doc_id").alias("component_id"))
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id")


def op3_simhash(spark, sf_dir):
    from codeloom.llm.common import table

    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
