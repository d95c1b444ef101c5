"""Ranked lexical search over a two-level quantised index.

The index lies in segments: the at most ``SEGMENT`` documents that a task reads one after the other, as an inverted file of
their own. Level one has the places of the documents that hold a term, and a byte for each: the saturated frequency
f = (10^9 tf) div (1000 tf + 20 m), which is below ``TOP``, in 255 steps, rounded up. Level two has tf itself, and each
document's id and length. A segment is one row, so making and reading an index shuffles no postings.

A search reads the bytes first: a document's upper bound for an item is the sum, over the item's terms, of a term's weight times the
largest f that its byte stands for; its lower bound takes the least. A task carries on the documents whose upper bound reaches the
``k``-th lower bound that it has seen, which is at most that of all documents. The ``k``-th lower bound of all tasks is the item's
floor. Every document whose upper bound reaches it gets its exact score, in 64-bit integers, from level two: no number
of candidates is capped, and documents that tie with the floor are among them. Bounds and scores depend on a
document's own postings and on the statistics alone, so it does not matter where segments begin.

Statistics (documents with terms, terms in all, documents that hold a term) are those of all documents. Where the terms of all searches are
known before the index is made, and are at most ``VOCABULARY``, only their postings are written; else all are. Items are searched in blocks of
about ``TERMS`` terms, which bounds what is broadcast.

Defined results: a null or empty text has no terms and is no document in the statistics; rows with one item_id are one item with the
terms of all of them; rows without an item_id, and items without terms, have no results; repeated documents are ranked each; equal scores go to the
smaller doc_id, null ids come last; a very long text is one document; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import cut, table

#: Documents, and words of all of them, after which a segment ends.
SEGMENT, WORDS = 2048, 4_000_000
#: Terms that go to the tasks which make an index, and terms of the items searched at a time, about.
VOCABULARY, TERMS = 200_000, 1_000_000
TOP = 1_000_000
#: A term: letters, digits and all that is not ASCII, in UTF-8 with A-Z lower-cased.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
LEVELS = {1: "segment long, terms array<binary>, ends array<int>, places binary, impacts binary", 2: "segment long, terms array<binary>, ends array<int>, places binary, tfs binary, ids array<{}>, sizes array<long>"}

BYTE = np.arange(256, dtype=np.int64)
#: The largest and the least saturated frequency that a byte stands for.
MOST = BYTE * TOP // 255
LEAST = np.where(BYTE > 0, (BYTE - 1) * TOP // 255 + 1, 0)


def terms_of(text: bytes | None) -> list[bytes]:
    return TERM.findall(text.lower()) if text else []


def saturated(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """f of term frequencies in documents of ``n`` terms; below TOP."""
    m = 100 - 50 + 50 * n * documents // max(total, 1)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def quantised(f: np.ndarray) -> np.ndarray:
    """Bytes of saturated frequencies, rounded up."""
    return ((f * 255 + TOP - 1) // TOP).astype(np.uint8)


class Segment:
    """Documents read so far, and their postings."""

    def __init__(self):
        self.ids, self.sizes, self.words, self.found = [], [], 0, {}

    def add(self, doc_id, words: list[bytes], keep: frozenset | None) -> None:
        for w, c in Counter(words if keep is None else filter(keep.__contains__, words)).items():
            self.found.setdefault(w, []).append((len(self.ids), c))
        self.ids.append(doc_id)
        self.sizes.append(len(words))
        self.words += len(words)

    def full(self) -> bool:
        return len(self.ids) >= SEGMENT or self.words >= WORDS

    def batch(self, number: int, kind):
        import pyarrow as pa

        terms = sorted(self.found)
        pairs = np.array([x for w in terms for x in self.found[w]], np.int64).reshape(-1, 2)
        ends = np.cumsum([len(self.found[w]) for w in terms]).astype(np.int32)
        one = lambda x, t: pa.array([x], t)
        return pa.RecordBatch.from_arrays(
            [one(number, pa.int64()), one(terms, pa.list_(pa.binary())), one(ends, pa.list_(pa.int32())), one(pairs[:, 0].astype(np.uint16).tobytes(), pa.binary()), one(pairs[:, 1].astype(np.uint32).tobytes(), pa.binary()), one(self.ids, pa.list_(kind)), one(self.sizes, pa.list_(pa.int64()))],
            ["segment", "terms", "ends", "places", "tfs", "ids", "sizes"],
        )


def exact_level(docs: DataFrame, vocabulary: list[bytes] | None) -> DataFrame:
    """Level two of ``docs(doc_id, text)``: each text is read once."""
    import pyarrow as pa
    from pyspark import TaskContext

    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary)) if vocabulary is not None else None  # at most VOCABULARY terms

    def run(batches):
        keep, number, segment, kind = wanted.value if wanted else None, TaskContext.get().partitionId() << 32, Segment(), None
        for b in batches:
            kind, texts = b.schema.field("doc_id").type, b.column("text").cast(pa.binary())
            for i, text in zip(b.column("doc_id").to_pylist(), texts, strict=True):
                if words := terms_of(text.as_py()):
                    segment.add(i, words, keep)
                if segment.full():
                    yield segment.batch(number, kind)
                    number, segment = number + 1, Segment()
        if segment.ids:
            yield segment.batch(number, kind)

    return cut(docs.select("doc_id", "text").mapInArrow(run, LEVELS[2].format(docs.schema["doc_id"].dataType.simpleString())))


class Lists:
    """The posting lists of a segment's row."""

    def __init__(self, terms: list[bytes], ends, places: bytes, values: np.ndarray):
        self.at = {w: i for i, w in enumerate(terms)}
        self.bounds = np.append(0, ends).astype(np.int64)
        self.places, self.values = np.frombuffer(places, np.uint16).astype(np.int64), values

    def of(self, term: bytes):
        """Places and values of a term, or None."""
        i = self.at.get(term)
        return None if i is None else (self.places[self.bounds[i] : self.bounds[i + 1]], self.values[self.bounds[i] : self.bounds[i + 1]])


class Index:
    """Both levels of ``docs(doc_id, text)`` and the statistics. vocabulary: the only terms that will be asked for, if known."""

    def __init__(self, docs: DataFrame, vocabulary: list[bytes] | None = None):
        self.exact = exact_level(docs, vocabulary if vocabulary is None or len(vocabulary) <= VOCABULARY else None)
        summed = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
        n = self.exact.agg(F.sum(F.size("ids")).cast("long").alias("documents"), F.sum(summed).alias("total"), F.max(F.size("ids")).alias("widest")).first()
        self.documents, self.total, self.widest = n.documents or 0, n.total or 0, n.widest or 0
        held_in = F.col("ends")[F.col("at")] - F.when(F.col("at") > 0, F.col("ends")[F.col("at") - 1]).otherwise(0)
        df = self.exact.select("ends", F.posexplode("terms").alias("at", "term")).select("term", held_in.alias("n")).groupBy("term").agg(F.sum("n").alias("df"))
        ratio = (2 * F.lit(self.documents) + 2) / (2 * F.col("df") + 1)
        self.weights = cut(df.select("term", F.floor(1000 * F.log(ratio)).cast("long").alias("weight")))
        self.bounds = self._bounds_level()

    def _bounds_level(self) -> DataFrame:
        import pyarrow as pa

        documents, total = self.documents, self.total

        def run(batches):
            for b in batches:
                impacts = []
                for places, tfs, sizes in zip(*(b.column(c).to_pylist() for c in ("places", "tfs", "sizes")), strict=True):
                    n = np.array(sizes, np.int64)[np.frombuffer(places, np.uint16)]
                    impacts.append(quantised(saturated(np.frombuffer(tfs, np.uint32).astype(np.int64), n, documents, total)).tobytes())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("segment", "terms", "ends", "places")), pa.array(impacts, pa.binary())], ["segment", "terms", "ends", "places", "impacts"])

        return cut(self.exact.drop("ids").mapInArrow(run, LEVELS[1]))


def asked_terms(items: DataFrame) -> DataFrame:
    """item_id, term: the distinct terms of each item."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            sets = [sorted(set(terms_of(t))) for t in b.column("text").cast(pa.binary()).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
            yield pa.RecordBatch.from_arrays([b.column("item_id").take(at), pa.array([w for s in sets for w in s], pa.binary())], ["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.where("item_id IS NOT NULL").select("item_id", "text").mapInArrow(run, f"item_id {kind}, term binary").distinct()


class Best:
    """What one item carries on in a task: documents whose upper bound reaches the k-th lower bound so far."""

    def __init__(self, k: int):
        self.k, self.floor, self.lows, self.kept, self.n = k, 1, np.zeros(0, np.int64), [], 0

    def add(self, segment: int, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        if (better := lower[lower >= self.floor]).size:
            lows = np.concatenate([self.lows, better])
            self.lows = np.partition(lows, len(lows) - self.k)[-self.k :] if len(lows) > self.k else lows
            if len(self.lows) == self.k:
                self.floor = max(1, int(self.lows.min()))
        self.kept.append((np.full(len(at), segment), at, upper, lower))
        self.n += len(at)
        if self.n > 4 * self.k and len(self.kept) > 1:
            self.rows()

    def rows(self):
        """segment, place, upper, lower of what is still carried on."""
        columns = [np.concatenate(c) for c in zip(*self.kept, strict=True)] if self.kept else [np.zeros(0, np.int64)] * 4
        over = columns[2] >= self.floor
        self.kept = [tuple(c[over] for c in columns)]
        self.n = int(over.sum())
        return self.kept[0]


def summed(lists: Lists, items, values: np.ndarray, width: int) -> np.ndarray:
    """For each document of a segment the sum of weight times value over an item's terms; exact, as each partial sum is below 2**53."""
    out = np.zeros(width, np.int64)
    for a in range(0, len(items), 100_000):
        found = [(*p, w) for term, w in items[a : a + 100_000] if (p := lists.of(term)) is not None]
        if found:
            out += np.bincount(np.concatenate([p for p, _, _ in found]), np.concatenate([values[v] * float(w) for _, v, w in found]), width).astype(np.int64)
    return out


def candidates(index: Index, shared, k: int) -> DataFrame:
    """item, segment, place, upper, lower of the documents that may be among an item's ``k`` best, by level one."""
    import pyarrow as pa

    width = index.widest
    names = ["item", "segment", "place", "upper", "lower"]

    def batch(item, rows):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows[0]), item), pa.int64()), *(pa.array(c, pa.int64()) for c in rows)], names)

    def run(batches):
        best = [Best(k) for _ in shared.value]
        for b in batches:
            for segment, terms, ends, places, impacts in zip(*(b.column(c).to_pylist() for c in b.schema.names), strict=True):
                lists = Lists(terms, ends, places, np.frombuffer(impacts, np.uint8))
                for i, items in enumerate(shared.value):
                    upper = summed(lists, items, MOST, width)
                    at = np.flatnonzero(upper >= best[i].floor)
                    if len(at):
                        best[i].add(segment, at, upper[at], summed(lists, items, LEAST, width)[at])
            for i, x in enumerate(best):  # ties are many: written as they come, the floor stays
                if x.n > 100_000:
                    yield batch(i, x.rows())
                    x.kept, x.n = [], 0
        for i, x in enumerate(best):
            yield batch(i, x.rows())

    return cut(index.bounds.select("segment", "terms", "ends", "places", "impacts").mapInArrow(run, ", ".join(f"{c} long" for c in names)))


def rescored(index: Index, wanted: DataFrame, shared) -> DataFrame:
    """item, doc_id, score of ``wanted(item, segment, place)``, by level two."""
    import pyarrow as pa

    documents, total = index.documents, index.total
    kind = index.exact.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        for b in batches:
            t = b.schema.field("ids").type.value_type
            for terms, ends, places, tfs, ids, sizes, asked in zip(*(b.column(c).to_pylist() for c in ("terms", "ends", "places", "tfs", "ids", "sizes", "asked")), strict=True):
                lists, n = Lists(terms, ends, places, np.frombuffer(tfs, np.uint32).astype(np.int64)), np.array(sizes, np.int64)
                pairs = np.array([(a["item"], a["place"]) for a in asked], np.int64)
                pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
                score = np.zeros(len(pairs), np.int64)
                items, first = np.unique(pairs[:, 0], return_index=True)
                for i, a, e in zip(items.tolist(), first, np.append(first[1:], len(pairs)), strict=True):
                    at = pairs[a:e, 1]
                    for term, w in shared.value[i]:
                        if (p := lists.of(term)) is not None and len(p[0]):
                            spot = np.minimum(np.searchsorted(p[0], at), len(p[0]) - 1)
                            hit = np.flatnonzero(p[0][spot] == at)
                            score[a + hit] += w * saturated(p[1][spot[hit]], n[at[hit]], documents, total)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array([ids[p] for p in pairs[:, 1].tolist()], t), pa.array(score)], ["item", "doc_id", "score"])

    # at most SEGMENT times the items of a block in a row
    by_segment = cut(wanted.groupBy("segment").agg(F.collect_list(F.struct("item", "place")).alias("asked")))
    return index.exact.join(by_segment, "segment").mapInArrow(run, f"item long, doc_id {kind}, score long")


def search(index: Index, asked: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item of ``asked(item_id, term)``, scores above 0."""
    spark = asked.sparkSession
    weighed = cut(asked.join(index.weights, "term").withColumn("hash", F.xxhash64("item_id")))
    blocks = max(1, -(-weighed.count() // TERMS))
    out = None
    for block in range(blocks):
        rows = weighed.where(F.pmod("hash", F.lit(blocks)) == block).select("item_id", "term", "weight").collect()  # about TERMS
        by_item: dict = {}
        for r in rows:
            by_item.setdefault(r.item_id, []).append((bytes(r.term), r.weight))
        order = sorted(by_item)
        shared = spark.sparkContext.broadcast([sorted(by_item[i]) for i in order])
        found = candidates(index, shared, k)
        lowest = Window.partitionBy("item").orderBy(F.desc("lower"))
        top = found.select("item", "lower", F.row_number().over(lowest).alias("r")).where(F.col("r") <= k)
        floor = top.groupBy("item").agg(F.when(F.count("*") >= k, F.min("lower")).otherwise(1).alias("floor"))  # a row of each item
        wanted = found.join(F.broadcast(floor), "item").where(F.col("upper") >= F.col("floor"))
        scored = rescored(index, wanted, shared).where("score > 0")
        ranks = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = scored.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
        named = spark.createDataFrame([*enumerate(order)], f"item long, item_id {asked.schema['item_id'].dataType.simpleString()}")
        part = ranked.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out


def ranked(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``search`` of ``items(item_id, text)`` over an index of ``docs(doc_id, text)`` that is made for their terms."""
    asked = cut(asked_terms(items))
    terms = asked.select("term").distinct().limit(VOCABULARY + 1).collect()
    return search(Index(docs, [bytes(r.term) for r in terms] if len(terms) <= VOCABULARY else None), asked, k)


def op13_ranked_search(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return ranked(docs.select("doc_id", "text"), items.select("item_id", "text"))


OP13_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
docs AS (SELECT d, doc_id, ws, CAST(len(ws) AS BIGINT) AS n FROM words WHERE len(ws) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS l FROM docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL),
held AS (SELECT d, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT d, unnest(ws) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM held GROUP BY term), s),
f AS (SELECT d, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nn) // l))) AS part FROM held JOIN docs USING (d) JOIN w USING (term), s),
scored AS (SELECT item_id, d, doc_id, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN f USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50
"""
