"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each word shingle is hashed once; the top bits of the hash are its bin, and a bin keeps its smallest
hash. An empty bin takes the hash of the filled bin that comes first in an order of the bins that is the
empty bin's own (a random one, the same for every document): optimal densification, where probing goes on
until a filled bin is met. The low ``BITS`` bits of each bin's hash are stored, as two hex digits.

The likeness of two fingerprints is the share of equal bins, corrected for low bits that agree by chance,
within 0 and 1.

Defined results: words are what white space parts; a text with fewer words than a shingle has one shingle,
all its words; a text without words (null, empty, blank) has the empty string as its fingerprint, whose
likeness is 1 to another such and 0 to any other; null doc_ids sort as the smallest; rows of equal doc_id
follow a hash of their text, and those of equal doc_id and text are one document; an empty table gives no rows;
``with_signature`` keeps columns of any name, ``with_next`` reads doc_id and text alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
BINS_LOG2, BITS = 7, 8
BINS = 1 << BINS_LOG2


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BINS_LOG2).cast("int")


def with_signature(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: array<tinyint> of the bins' low bits; empty without words. A column of that name is replaced."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    shingle = lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WORDS)])
    # the row goes along as one value, so that its columns may have any names
    rows = df.select(F.struct("*").alias("row"), F.transform(words, lambda w: F.xxhash64(w)).alias("w"))
    shingles = (
        F.when(F.size("w") == 0, F.array().cast("array<long>")).when(F.size("w") <= WORDS, F.array(F.xxhash64("w")))
        .otherwise(F.transform(F.sequence(F.lit(0), F.size("w") - WORDS), shingle))
    )
    rows = rows.select("row", F.sort_array(shingles).alias("s"))
    rows = rows.select("row", F.filter("s", lambda x, i: (i == 0) | (_bin(x) != _bin(F.get("s", i - 1)))).alias("f"))
    rows = rows.select("row", "f", F.transform("f", _bin).alias("b"))
    rows = rows.select("row", "b", F.map_from_arrays("b", "f").alias("m"))
    low = F.lit(-BINS).cast("long")
    nearest = lambda b: F.array_min(F.transform("b", lambda j: F.xxhash64(b, j).bitwiseAND(low).bitwiseOR(j.cast("long")))).bitwiseAND(F.lit(BINS - 1))
    filled = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(F.col("m")[b], F.col("m")[nearest(b).cast("int")]))
    low_bits = F.transform(filled, lambda h: (h.bitwiseAND(F.lit((1 << BITS) - 1)) - 128).cast("tinyint"))
    signature = F.when(F.size("b") == 0, F.array().cast("array<tinyint>")).otherwise(low_bits)
    rows = rows.select("row", signature.alias("signature"))
    return rows.select(*[F.col("row")[c].alias(c) for c in df.columns if c != out], F.col("signature").alias(out))


def packed(signature: Column) -> Column:
    """Hex digits of a signature."""
    return F.lower(F.array_join(F.transform(signature, lambda b: F.lpad(F.hex(b.cast("long") + 128), 2, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of the shingles of two signatures."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, e: n + e)
    chance = 1 / (1 << BITS)
    estimate = (equal / F.lit(float(BINS)) - chance) / (1 - chance)
    both = F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
    return both.otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), estimate)))


def following(keys: DataFrame) -> DataFrame:
    """``keys(doc_id, hash, ...)``, each once, with next_id and next_hash: those that come next by descending doc_id, then hash; after the last comes the first.

    Keys are dealt to ranges and each range is sorted on its own; only ids and hashes move, and of each range only its
    first key is looked at by the range above it.
    """
    from codeloom.llm.common import cut, partitions

    order = (F.col("doc_id").desc_nulls_last(), F.col("hash"))
    ranged = keys.distinct().repartitionByRange(partitions(keys.sparkSession), *order)
    ranged = cut(ranged.withColumn("range", F.spark_partition_id()))  # where a key lies must not change from use to use
    within, key = Window.partitionBy("range").orderBy(*order), F.struct("doc_id", "hash")
    rows = ranged.withColumns({"after": F.lead(key).over(within), "nth": F.row_number().over(within)})
    over = Window.orderBy("range")  # as many rows as ranges, of an id and a hash each
    every = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = rows.where("nth = 1").select("range", F.coalesce(F.lead(key).over(over), F.first(key).over(every)).alias("head"))
    found = rows.join(heads, "range").withColumn("after", F.coalesce("after", "head"))
    return found.select(*keys.columns, F.col("after.doc_id").alias("next_id"), F.col("after.hash").alias("next_hash"))


def with_next(docs: DataFrame, derive=lambda d: d) -> DataFrame:
    """``derive(docs(doc_id, text))`` with next_text, as much of the next document's text as a third of a row's own has code points, and next_<column> for what ``derive`` added.

    The next document is that of ``following``; rows of equal doc_id and text are one document. ``derive`` is
    applied once to every row. A row's text moves once, and a third as much of the next one's comes back to it.
    """
    full = derive(docs.select("doc_id", "text")).withColumn("hash", F.xxhash64("text"))
    added = [c for c in full.columns if c not in ("doc_id", "text", "hash")]
    third = F.floor(F.length("text") / 3).cast("int").alias("third")
    asks = following(docs.select("doc_id", F.xxhash64("text").alias("hash"), third)).alias("a")
    met = asks.join(full.alias("n"), F.col("a.next_id").eqNullSafe(F.col("n.doc_id")) & (F.col("a.next_hash") == F.col("n.hash")))
    sent = met.select("a.doc_id", "a.hash", F.substr("n.text", F.lit(1), F.col("a.third")).alias("next_text"), *[F.col(f"n.{c}").alias(f"next_{c}") for c in added])
    sent = sent.groupBy("doc_id", "hash").agg(*[F.first(c).alias(c) for c in sent.columns[2:]]).alias("s")  # of repeated rows one answers
    rows = full.alias("f").join(sent, F.col("f.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("f.hash") == F.col("s.hash")))
    return rows.select("f.doc_id", "f.text", *[f"f.{c}" for c in added], "s.next_text", *[f"s.next_{c}" for c in added])


def op4_minhash(spark, sf_dir):
    from codeloom.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, lambda d: with_signature(d, "text", "sig"))
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - third), "next_text")
    rows = with_signature(rows.withColumn("edited", edited), "edited", "edited_sig")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("sig")).alias("fingerprint"),
        packed(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
