"""A corpus pipeline of four stages over the table ``documents``.

toxicity: documents whose score is over their language's threshold go. simhash: of each group of documents that
equal texts, or five-word shingles of a similarity of 0.8 and more, connect, the one of the smallest doc_id stays.
suffix_dedup: passages of 50 bytes and more that a document with a smaller doc_id has are cut from the text; bytes of a
character that was cut in two go with it. packing: what is left is packed into sequences of token ids.

Each stage is judged on what the stages before it kept. All but the last return the columns of ``documents``, whatever
further ones there are; ``n_chars`` follows the text. Columns with names of the operators' own (``OWN``) are dropped.

Defined results: a null text is empty for every decision, and stays null where it stays; empty texts are
copies of one another, so one stays; a null doc_id is larger than any other; rows that agree in doc_id and text are
copies, so one stays; rows of one doc_id and other texts are documents of their own, of which the order is by a hash
of the text; an empty table gives no rows, and one without labels loses none to the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import near_copies, packing, suffix_dedup, toxicity
from codeloom.llm.common import cut, table

#: Words that the tokenizer keeps by span of input; fewer than its own default, as executors still hold memory of the stages before.
WORDS = 1 << 17
#: Bytes of a character without its first ones, at the start of a string, or without its last ones, at the end.
PARTIAL = r"\A[\x80-\xBF]+|(?:[\xC2-\xDF]|[\xE0-\xEF][\x80-\xBF]?|[\xF0-\xF4][\x80-\xBF]{0,2})\z"
#: Names that the stages use for columns of their own.
OWN = ("__id", "__hash", "__score", "__threshold", "__logit", "__text", "__part", "__kept", "__spans")


def remove_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.drop(*OWN)
    scored = toxicity.trained_score(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return scored.where("__score < __threshold").drop("__score", "__threshold")


def one_of_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.drop(*OWN)
    last = F.lit((1 << 63) - 1)  # a null doc_id comes after all others
    mine = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), last)).withColumn("__hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    stays = near_copies.staying(mine.select(F.col("__id").alias("id"), F.col("__hash").alias("h"), "text"))
    # rows that agree in doc_id and text are copies of one another
    kept = mine.join(stays.select(F.col("id").alias("__id"), F.col("h").alias("__hash")), ["__id", "__hash"], "left_semi")
    return kept.dropDuplicates(["__id", "__hash"]).select(*docs.columns)


def cut_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.drop(*OWN)
    done = suffix_dedup.dedup(docs)
    data = F.col("text").cast("binary")
    # what lies between the spans, a character for each byte, without the parts of characters at the edges
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("__spans", lambda s: s["end"].cast("long")))
    ends = F.concat(F.transform("__spans", lambda s: s["start"].cast("long")), F.array(F.octet_length("text").cast("long")))
    piece = lambda a, b: F.regexp_replace(F.decode(data.substr((a + 1).cast("int"), (b - a).cast("int")), "ISO-8859-1"), PARTIAL, "")
    whole = F.encode(F.array_join(F.zip_with(starts, ends, piece), ""), "ISO-8859-1")
    clean = F.when(F.size("__spans") == 0, F.col("text")).when(F.octet_length("text") == F.length("text"), F.col("__kept").cast("string"))
    text = F.when(F.col("text").isNotNull(), clean.otherwise(F.make_valid_utf8(whole.cast("string"))))
    return done.withColumn("text", text).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack_tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), cache=WORDS)


STAGES = [("toxicity", remove_toxic), ("simhash", one_of_near_copies), ("suffix_dedup", cut_repeats), ("packing", pack_tokens)]

#: SQL can't express a trained classifier or a tokenizer.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
