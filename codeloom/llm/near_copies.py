"""Groups of near copies by exact Jaccard similarity of word shingles.

Two texts are near copies if their sets of ``WORDS``-word shingles (ASCII case and white space aside) have a
Jaccard similarity of ``LEAST`` or more; a group is what such pairs connect, and is named by its smallest
(id, hash of the text).

1. Balls of SimHash variants (``simhash``) tie the texts whose 64-bit fingerprints differ in at most 4 bits; the texts
   of one fingerprint are compared with the first of them, and these along the links.
2. Fingerprints differ in about 10 bits at 0.8, beyond any ball of variants that can be listed, so further
   candidates come from several shorter fingerprints: each of ``KEYS`` is made of ``HASHES`` minima of permuted shingle
   hashes, and a pair of similarity s shares one with probability 1 - (1 - s^HASHES)^KEYS, 0.99993 at 0.8. The texts
   with one key are a bucket. Each text is compared with the likeliest of the first texts of its buckets, and
   buckets that are then known to lie in one group are done.
3. In the buckets left, all pairs of different groups are compared: inside a task, in blocks of ``BLOCK``
   texts and ``BYTES`` bytes of shingle hashes, so no pairs are listed and only links between groups leave.

Pairs of which under ``ALIKE`` of all minima agree are set aside (at 0.8 with a probability of about 1e-7); every
other one that could tie two groups is verified on its whole texts.

Defined results: a null text is empty, and empty texts are copies of one another; a text of fewer words
than a shingle is one shingle; a null doc_id is larger than any other; of equal doc_ids the order is
by a hash of the text; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS, LEAST = 5, 0.8
KEYS, HASHES, ALIKE = 24, 5, 72
BLOCK, BYTES = 2048, 32 << 20
PIECE = 1 << 11


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in order; a text without words has one, zero."""
    from codeloom.llm.simhash import hashes

    h = hashes(text, words)
    return np.unique(h) if len(h) else np.zeros(1, np.uint64)


def keys(hashes: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, bytes]:
    """``KEYS`` numbers, and one byte of each minimum; ``odd`` are the permutations' multipliers."""
    least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), PIECE):
        h = hashes[k : k + PIECE, None] * odd
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(least, h.min(0), out=least)
    mixed = np.arange(1, KEYS + 1, dtype=np.uint64)
    for part in least.reshape(KEYS, HASHES).T:
        mixed = (mixed ^ part) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
    return mixed, (least & np.uint64(255)).astype(np.uint8).tobytes()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of numbers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def keyed(docs: DataFrame) -> DataFrame:
    """id, h, n (number of shingles), fp (SimHash), keys and minima of ``docs(id, h, text)``, one row for each of its rows."""
    import pyarrow as pa

    from codeloom.llm.common import held
    from codeloom.llm.simhash import hashes, majority

    odd = np.random.default_rng(11).integers(0, 1 << 63, KEYS * HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        held(None, dict)  # other operators' caches go
        for b in batches:
            n, made, minima, fp = np.zeros(b.num_rows, np.int32), np.zeros((b.num_rows, KEYS), np.uint64), [], np.zeros(b.num_rows, np.uint64)
            for k, t in enumerate(b.column("text")):
                all_ = hashes(t.as_py(), WORDS)
                s = np.unique(all_) if len(all_) else np.zeros(1, np.uint64)
                n[k], fp[k] = len(s), majority(all_)
                made[k], m = keys(s, odd)
                minima.append(m)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * KEYS), pa.array(made.ravel().view(np.int64)))
            cols = [b.column("id"), b.column("h"), pa.array(n), pa.array(fp.view(np.int64)), lists, pa.array(minima, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "h", "n", "fp", "keys", "minima"])

    return docs.select("id", "h", "text").mapInArrow(run, "id long, h long, n int, fp long, keys array<long>, minima binary")


def sides(pairs: DataFrame, texts: DataFrame, column: str) -> DataFrame:
    """``pairs(h, ch)`` with the column of both from ``texts(h, ...)``; one exchange of the texts serves both joins."""
    mine, theirs = texts.select("h", column).alias("mine"), texts.select("h", column).alias("theirs")
    both = pairs.alias("p").join(mine, F.col("p.h") == F.col("mine.h")).join(theirs, F.col("p.ch") == F.col("theirs.h"))
    return both.select("p.h", F.col(f"mine.{column}").alias("own"), "p.ch", F.col(f"theirs.{column}").alias("other"))


def agreeing(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those ``pairs(h, ch)`` of which at least ``ALIKE`` minima of ``texts(h, minima)`` agree, and how many do."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            a, c = (np.frombuffer(b"".join(b.column(x).to_pylist()), np.uint8).reshape(-1, KEYS * HASHES) for x in ("own", "other"))
            n = (a == c).sum(1).astype(np.int32)
            out = pa.RecordBatch.from_arrays([b.column("h"), b.column("ch"), pa.array(n)], ["h", "ch", "agree"])
            yield out.filter(pa.array(n >= ALIKE))

    return sides(pairs, texts, "minima").mapInArrow(run, "h long, ch long, agree int")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those ``pairs(h, ch)`` whose ``texts(h, text)`` are near copies."""
    import pyarrow as pa

    def run(batches):
        last, theirs = None, None
        for b in batches:
            near = []
            for t, ch, ct in zip(*(b.column(c) for c in ("own", "ch", "other")), strict=True):
                if ch.as_py() != last:
                    last, theirs = ch.as_py(), shingles(ct.as_py())
                near.append(likeness(shingles(t.as_py()), theirs) >= LEAST)
            yield b.select(["h", "ch"]).filter(pa.array(near, pa.bool_()))

    return sides(pairs, texts, "text").mapInArrow(run, "h long, ch long")


def close(minima: np.ndarray, root: np.ndarray, n: np.ndarray, key: int, left: np.ndarray, right: np.ndarray):
    """Pairs of rows of ``left`` and ``right``, of different roots, that may be near copies and share no key before number ``key``."""
    columns = np.ascontiguousarray(minima.T)
    for s in range(0, len(left), 256):
        i = left[s : s + 256]
        agree, before = np.zeros((len(i), len(right)), np.uint8), np.zeros((len(i), len(right)), bool)
        for g in range(KEYS):
            same = np.ones(agree.shape, bool)
            for c in range(g * HASHES, (g + 1) * HASHES):
                equal = columns[c, i][:, None] == columns[c, right][None]
                agree += equal
                same &= equal
            if g < key:
                before |= same
        a, b = n[i][:, None], n[right][None]
        ok = (agree >= ALIKE) & ~before & (root[i][:, None] != root[right][None]) & (np.minimum(a, b) >= LEAST * np.maximum(a, b))
        if left is right:
            ok &= i[:, None] < right[None]
        x, y = np.nonzero(ok)
        yield i[x], right[y], agree[x, y]


def _sides(table):
    """Rows of a block pair's two sides; one block is both."""
    block, to = table.column("block").to_numpy(), table.column("bi")[0].as_py()
    left = np.flatnonzero(block == to)
    return left, left if table.column("bj")[0].as_py() == to else np.flatnonzero(block != to)


def _columns(table):
    minima = np.frombuffer(b"".join(table.column("minima").to_pylist()), np.uint8).reshape(-1, KEYS * HASHES)
    return minima, table.column("root").to_numpy(), table.column("n").to_numpy(), table.column("k")[0].as_py()


def _hopeful(table):
    """The rows of a block pair that are in some pair of ``close``."""
    import pyarrow as pa

    left, right = _sides(table)
    hit = np.zeros(table.num_rows, bool)
    for i, j, _ in close(*_columns(table), left, right):
        hit[i] = hit[j] = True
    return table.select(["key", "h"]).filter(pa.array(hit))


def _joined(table):
    """Links between the groups of a block pair, each that ties two groups that no link before has tied."""
    import pyarrow as pa

    left, right = _sides(table)
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set").combine_chunks()]
    minima, root, n, key = _columns(table)
    above: dict[int, int] = {}

    def top(x):
        while x in above:
            x = above[x]
        return x

    links = []
    for i, j, agree in close(minima, root, n, key, left, right):
        order = np.lexsort((-agree.astype(np.int16), i))
        i, j = i[order], j[order]
        cuts = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else []
        for a, js in zip(i[cuts].tolist(), np.split(j, cuts[1:]) if len(i) else [], strict=True):
            own = top(int(root[a]))
            js = [x for x in js.tolist() if top(int(root[x])) != own]
            for p in range(0, len(js), 64):
                part = js[p : p + 64]
                size = np.array([len(sets[x]) for x in part])
                found = np.concatenate([sets[x] for x in part])
                at = np.minimum(np.searchsorted(sets[a], found), len(sets[a]) - 1)
                both = np.add.reduceat((sets[a][at] == found).astype(np.int64), np.cumsum(size) - size)
                for x in np.flatnonzero(both >= LEAST * (len(sets[a]) + size - both)).tolist():
                    u, v = top(int(root[a])), top(int(root[part[x]]))
                    if u != v:
                        above[max(u, v)] = min(u, v)
                        links.append((a, part[x]))
    h = table.column("h").to_numpy()
    a, b = (np.array(x, np.int64) for x in (zip(*links, strict=True) if links else ([], [])))
    return pa.table([pa.array(h[a]), pa.array(h[b])], ["h", "ch"])


def paired(rows: DataFrame, blocks) -> DataFrame:
    """``rows(key, h, ...)`` with block, bi, bj: each row in all pairs of its block with one of its key's ``blocks(key, blocks)``."""
    dealt = rows.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    return dealt.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")}).drop("other", "blocks")


def exact(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (h, ch) that tie the groups of buckets ``rows(key, k, h, n, root)``; ``texts(h, text, minima)``."""
    import pyarrow as pa

    from codeloom.llm.common import cut

    rows = cut(rows.join(texts.select("h", "minima"), "h"))
    count = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    pair = ("key", "bi", "bj")  # dealt by all three, or else all block pairs of a key would go to the task that has the key
    hopeful = cut(paired(rows, count).repartition(*pair).groupBy(*pair).applyInArrow(_hopeful, "key long, h long").distinct())

    def listed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array([shingles(t.as_py()).tobytes() for t in b.column("text")], pa.binary())], ["h", "set"])

    sets = texts.join(hopeful.select("h").distinct(), "h", "left_semi").select("h", "text").mapInArrow(listed, "h long, set binary")
    rows = rows.join(hopeful, ["key", "h"], "left_semi")
    size = rows.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.col("n").cast("long") * 8) / BYTES)).alias("blocks"))
    return paired(rows, size).join(sets, "h").repartition(*pair).groupBy(*pair).applyInArrow(_joined, "h long, ch long")


def balls(made: DataFrame) -> DataFrame:
    """Pairs (h, ch) of texts that SimHash balls tie, ch before h by (id, h): each with the first of its fingerprint, and these along the links."""
    from codeloom.llm import simhash
    from codeloom.llm.common import cut

    name = F.struct("id", "h")
    names = cut(made.groupBy("fp").agg(F.min(name).alias("name")))
    same = made.join(names, "fp").where(F.col("name.h") != F.col("h")).select("h", F.col("name.h").alias("ch"))
    of = lambda c: names.select(F.col("fp").alias(c), F.col("name").alias(f"n{c}"))
    linked = simhash.links(names.select("fp")).join(of("a"), "a").join(of("b"), "b")
    return same.union(linked.select(F.greatest("na", "nb")["h"].alias("h"), F.least("na", "nb")["h"].alias("ch"))).distinct()


def staying(docs: DataFrame) -> DataFrame:
    """id and h of one of each group of near copies of ``docs(id, h, text)``, that of the smallest (id, h); h is a hash of the text."""
    from codeloom.llm.common import components, cut

    # of equal texts one row
    made = cut(keyed(docs).groupBy("h", "n", "fp", "keys", "minima").agg(F.min("id").alias("id")))
    rows = made.select(F.posexplode("keys").alias("k", "key"), "id", "h", "n")
    rows = cut(rows.join(rows.groupBy("key").count().where("count > 1").select("key"), "key", "left_semi"))
    tied = cut(balls(made))
    needed = cut(made.join(rows.select("h").union(tied.select("h")).union(tied.select("ch")).distinct(), "h", "left_semi").select("id", "h", "minima"))
    texts = cut(docs.select("id", "h", "text").join(needed, ["id", "h"]).dropDuplicates(["id", "h"]).select("h", "text", "minima"))
    # each text with the likeliest of its buckets' first texts; sets whose sizes differ by more can't be that similar
    hub = rows.groupBy("key").agg(F.min_by(F.struct("h", "n"), F.struct("id", "h")).alias("c"))
    met = rows.join(hub, "key").select("h", "n", F.col("c.h").alias("ch"), F.col("c.n").alias("cn")).where("h <> ch")
    likely = agreeing(met.where(F.least("n", "cn") >= LEAST * F.greatest("n", "cn")).select("h", "ch").distinct(), texts)
    likely = likely.groupBy("h").agg(F.max_by("ch", F.struct("agree", "ch")).alias("ch"))
    tied = cut(verified(tied.union(likely).distinct(), texts))
    # every link leads to a text that comes before, so following them ends; texts with one end are in one group
    root = tied.groupBy("h").agg(F.min("ch").alias("root"))
    for _ in range(2):
        on = root.select(F.col("h").alias("root"), F.col("root").alias("next"))
        root = cut(root.join(on, "root", "left").select("h", F.coalesce("next", "root").alias("root")))
    named = rows.join(root, "h", "left").withColumn("root", F.coalesce("root", "h"))
    open_ = named.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    tied = tied.union(exact(named.join(open_, "key", "left_semi"), texts))
    names = needed.select("h", F.struct("id", "h").alias("name"))
    ends = tied.join(names.select("h", F.col("name").alias("a")), "h").join(names.select(F.col("h").alias("ch"), F.col("name").alias("b")), "ch")
    gone = components(ends.select("a", "b")).where("root <> node").select(F.col("node.h").alias("h"))
    return made.select("id", "h").join(gone, "h", "left_anti")
