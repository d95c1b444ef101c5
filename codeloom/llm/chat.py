"""Chat formatting with typed content parts, in DataFrame functions only.

A message is an array of typed parts. The visitor turns the parts into the turn's body: a run of text parts
into their joined text, escaped as one, an image, audio or document part into a placeholder. Attachments are
recorded in order with their references and the number of tokens that they expand to.

Template: ``<|turn|>role<|says|>body<|end|>\\n`` for each turn. A backslash in a text becomes two and
``<|`` becomes ``<\\|``, so no control string can come from a text, nor from texts that meet, and dropping one
backslash of each pair restores it. Roles are escaped alike.

Defined results: a null text or role is the empty string; null parts are no parts; rows with a null
conversation id form one conversation; turns sort nulls first; rows of equal turn follow role, then
formatted piece, and repeated rows are all kept; an empty table gives no rows; columns other than those read
are not carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>\n"
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
#: Tokens that one unit of an attachment expands to: a square of so many pixels, a second, a page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 1024


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def as_parts(text: Column) -> Column:
    null = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), null.cast("string").alias("ref"), null.cast("int").alias("width"),
            null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages"),
        )
    )


def visit(parts: Column) -> Column:
    """The body of a turn. An unknown type is formatted as a document.

    Texts that follow one another are joined before they are escaped, so that what one ends with and the next
    begins with can't make a control string.
    """

    def step(seen, part):
        kind = F.coalesce(part["type"], F.lit("text"))
        mark = F.concat(F.lit("<|"), F.when(kind.isin("image", "audio"), kind).otherwise("document"), F.lit("|>"))
        said = F.struct(seen["body"].alias("body"), F.concat(seen["text"], F.coalesce(part["text"], F.lit(""))).alias("text"))
        shown = F.struct(F.concat(seen["body"], escape(seen["text"]), mark).alias("body"), F.lit("").alias("text"))
        return F.when(kind == "text", said).otherwise(shown)

    start = F.struct(F.lit("").alias("body"), F.lit("").alias("text"))
    return F.aggregate(parts, start, step, lambda seen: F.concat(seen["body"], escape(seen["text"])))


def expanded(part: Column) -> Column:
    """Tokens that an attachment's placeholder expands to; at least 1."""
    whole = lambda x, y: F.ceil(F.coalesce(x, F.lit(0)) / F.lit(y))
    tokens = (
        F.when(part["type"] == "image", whole(part["width"], PATCH) * whole(part["height"], PATCH))
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * PER_SECOND))
        .otherwise(F.coalesce(part["pages"], F.lit(0)) * F.lit(PER_PAGE))
    )
    return F.greatest(F.lit(1), tokens).cast("long")


def format_chats(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``messages(conv_id, turn, role, parts)`` to one row per conversation.

    Returns conv_id, formatted, loss_spans (start and length in code points of what is under the loss
    mask), attachments (turn, type, ref, tokens; in order) and attachment_tokens. A conversation is one
    string by definition, so its rows meet in one task; nothing else is gathered.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(PARTS))
    role = F.coalesce(F.col("role"), F.lit(""))
    rows = messages.select(
        "conv_id",
        "turn",
        role.alias("role"),
        F.concat(F.lit(TURN), escape(role), F.lit(SAYS)).alias("head"),
        visit(parts).alias("body"),
        F.transform(
            F.filter(parts, lambda p: F.coalesce(p["type"], F.lit("text")) != "text"),
            lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), expanded(p).alias("tokens")),
        ).alias("files"),
    ).withColumn("piece", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "piece")
    before = F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"k": F.row_number().over(order), "start": F.coalesce(before, F.lit(0)) + F.length("head")})
    turns = F.sort_array(F.collect_list(F.struct("k", "piece", "role", "start", F.length("body").cast("long").alias("n"), "turn", "files")))
    return rows.groupBy("conv_id").agg(turns.alias("t")).select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["role"] == loss_role), lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"))).alias("loss_spans"),
        F.flatten(
            F.transform("t", lambda x: F.transform(x["files"], lambda f: F.struct(x["turn"].alias("turn"), f["type"].alias("type"), f["ref"].alias("ref"), f["tokens"].alias("tokens"))))
        ).alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """conv_id and ``turns`` (role, text; unescaped, placeholders as they stand) read back from ``formatted``."""
    pieces = F.split("formatted", r"<\|end\|>\n")
    read = lambda p: F.struct(
        unescape(F.substring(F.substring_index(p, SAYS, 1), len(TURN) + 1, 2**31 - 1)).alias("role"), unescape(F.substring_index(p, SAYS, -1)).alias("text")
    )
    return formatted.withColumn("turns", F.transform(F.slice(pieces, 1, F.size(pieces) - 1), read))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    part = lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["n"].cast("int")))
    return F.array_join(F.transform(spans, part), "")


def op10_chat_format(spark, sf_dir):
    from codeloom.llm.common import table

    said = "</s>[INST] ok [/INST]"
    added = spark.sql(f"SELECT -7L conv_id, 0L turn, 'user' role, '{said}' text UNION ALL SELECT -7L, 1L, 'assistant', '{said}'")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    chats = format_chats(rows.select("conv_id", "turn", "role", as_parts(F.col("text")).alias("parts")))
    loss = loss_text(F.col("formatted"), F.col("loss_spans"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parse_chats(chats).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
