"""Chat formatting with typed content parts.

A message's content is an array of typed parts (text, image, audio, document), a JSON array of such parts in a string,
or a plain string, which is one text part. A visitor turns each part of a conversation, in order, into a segment: text is written
out, every other part leaves a mark, a reference to its attachment, and the tokens that it expands to. The marks are then numbered
in order. Each step is linear in the conversation and a native expression; the only shuffle brings a conversation's
messages together.

Defined results
* messages are ordered by turn (nulls first), then role, then content; repeated messages stay;
* ``<|`` in a text or role is written ``<\\|``, so that no message can write a control mark (a turn, an end, a placeholder) of its own;
* a null role is ``unknown``; a null or empty content is a message without parts; null parts are skipped;
* a string that begins with ``[`` but is no JSON array of parts is plain text;
* a part of unknown or null type leaves ``<|file_n|>`` and expands to nothing; missing sizes count as the least;
* rows with a null conv_id are one conversation; other columns, whatever their names, play no part; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from .common import table

PART = "struct<type:string,text:string,uri:string,width:bigint,height:bigint,seconds:double,pages:bigint>"
TILE, TILE_TOKENS, IMAGE_TOKENS, AUDIO_RATE, PAGE_TOKENS = 512, 170, 85, 25, 400
KINDS = ("image", "audio", "document")


def parse(content: Column) -> Column:
    """A string to an array of parts."""
    plain = F.array(F.struct(F.lit("text").alias("type"), content.alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("uri", "string"), ("width", "bigint"), ("height", "bigint"), ("seconds", "double"), ("pages", "bigint"))))).cast(f"array<{PART}>")
    given = F.from_json(content, f"array<{PART}>")
    typed = F.substring(F.ltrim(content), 1, 1).eqNullSafe("[") & given.isNotNull() & F.coalesce(F.exists(given, lambda p: p.type.isNotNull()), F.lit(False))
    return F.when(content.isNull() | (content == ""), F.array().cast(f"array<{PART}>")).when(typed, given).otherwise(plain)


def text_tokens(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+"))).cast("long")


def expanded(p: Column) -> Column:
    """Tokens of one part."""
    tiles = F.ceil(F.greatest(F.coalesce(p["width"], F.lit(1)), F.lit(1)) / TILE) * F.ceil(F.greatest(F.coalesce(p["height"], F.lit(1)), F.lit(1)) / TILE)
    return (
        F.when(p["type"] == "text", text_tokens(p["text"]))
        .when(p["type"] == "image", IMAGE_TOKENS + TILE_TOKENS * tiles)
        .when(p["type"] == "audio", F.ceil(F.greatest(F.coalesce(p["seconds"], F.lit(0.0)), F.lit(0.0)) * AUDIO_RATE))
        .when(p["type"] == "document", PAGE_TOKENS * F.greatest(F.coalesce(p["pages"], F.lit(1)), F.lit(1)))
        .otherwise(F.lit(0))
        .cast("long")
    )


def escaped(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("<\\|"))


def visit(p: Column, turn: Column) -> Column:
    """The segment of one part: text to write (null for an attachment) and what an attachment refers to."""
    text = p["type"].eqNullSafe("text")
    kind = F.when(p["type"].isin(*KINDS), p["type"]).otherwise("file")
    return F.struct(F.when(text, escaped(F.coalesce(p["text"], F.lit("")))).alias("text"), turn.alias("turn"), kind.alias("type"), p["uri"].alias("uri"), expanded(p).alias("tokens"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) to (conv_id, prompt, messages, tokens, attachments)."""
    ref = "struct<n:int,turn:bigint,type:string,uri:string,tokens:bigint>"
    m = messages.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.filter("parts", lambda p: p.isNotNull()).alias("parts")).alias("m"))
    c = m.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    mark = lambda s: F.struct(s.alias("text"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("uri"), F.lit(0).cast("long").alias("tokens"))

    def message(x: Column) -> Column:
        return F.concat(F.array(mark(F.concat(F.lit("<|"), escaped(x["role"]), F.lit("|>\n")))), F.transform(x["parts"], lambda p: visit(p, x["turn"])), F.array(mark(F.lit("\n<|end|>\n"))))

    def numbered(xs: Column) -> Column:
        refs = F.transform(F.filter(xs, lambda x: x["text"].isNull()), lambda x, i: F.struct((i + 1).alias("n"), x["turn"].alias("turn"), x["type"].alias("type"), x["uri"].alias("uri"), x["tokens"].alias("tokens"))).cast(f"array<{ref}>")
        # no text holds the mark <|#|>: it would have been escaped
        written = F.split(F.array_join(F.transform(xs, lambda x: F.coalesce(x["text"], F.lit("<|#|>"))), ""), r"<\|#\|>")
        return F.struct(written.alias("written"), refs.alias("refs"), F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("tokens"))

    name = lambda r: F.concat(F.lit("<|"), r["type"], F.lit("_"), r["n"].cast("string"), F.lit("|>"))
    c = c.withColumn("v", let(F.flatten(F.transform("ms", message)), numbered))
    prompt = F.array_join(F.zip_with("v.written", "v.refs", lambda w, r: F.concat(w, F.when(r.isNotNull(), name(r)).otherwise(""))), "")
    return c.select("conv_id", prompt.alias("prompt"), F.size("ms").alias("messages"), F.col("v.tokens").alias("tokens"), F.col("v.refs").alias("attachments"))


def format_chats(conversations: DataFrame, content: str = "text") -> DataFrame:
    """``render`` of (conv_id, turn, role, content), the content a string or an array of parts."""
    c = F.col(content)
    parts = parse(c) if conversations.schema[content].dataType.typeName() == "string" else F.coalesce(c, F.array()).cast(f"array<{PART}>")
    return render(conversations.select("conv_id", "turn", "role", parts.alias("parts")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's messages are plain text; so that all kinds of parts occur, each gets an attachment by its place: none,
    image, audio or document in turn, before the text in odd turns and after it in even ones."""
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    n, kind = F.coalesce(F.length("text"), F.lit(0)).cast("long"), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))
    none = lambda t: F.lit(None).cast(t)
    extra = F.struct(
        F.element_at(F.array(F.lit("text"), *map(F.lit, KINDS)), (kind + 1).cast("int")).alias("type"), none("string").alias("text"), F.concat_ws("/", F.lit("attachments"), "conv_id", "turn").alias("uri"),
        (200 + n * 3).alias("width"), (150 + n * 2).alias("height"), (n / 10).alias("seconds"), (1 + F.floor(n / 500)).cast("long").alias("pages"),
    ).cast(PART)
    text = parse(F.col("text"))
    with_extra = F.when(kind == 0, text).when(F.pmod("turn", F.lit(2)) == 1, F.concat(F.array(extra), text)).otherwise(F.concat(text, F.array(extra)))
    out = format_chats(m.withColumn("content", F.coalesce(with_extra, text)), "content")
    refs = F.array_join(F.transform("attachments", lambda r: F.concat_ws(":", r.n, r.turn, r.type, r.uri, r.tokens)), ";")
    return out.select("conv_id", "prompt", "messages", "tokens", F.size("attachments").alias("n_attachments"), refs.alias("attachments"))


ORACLE_SQL = rf"""
WITH m AS (SELECT conv_id, turn, role, text, length(text) AS n, (conv_id + turn) % 4 AS k FROM conversations),
t AS (SELECT *, len(regexp_extract_all(text, '[^ \t\n\r\f]+')) AS words,
      CASE k WHEN 1 THEN {IMAGE_TOKENS} + {TILE_TOKENS} * ceil((200 + n * 3) / {TILE}) * ceil((150 + n * 2) / {TILE}) WHEN 2 THEN ceil(n / 10 * {AUDIO_RATE}) WHEN 3 THEN {PAGE_TOKENS} * (1 + n // 500) ELSE 0 END AS extra,
      CASE k WHEN 1 THEN 'image' WHEN 2 THEN 'audio' WHEN 3 THEN 'document' END AS kind,
      sum(CASE WHEN k > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS i FROM m),
p AS (SELECT *, CASE WHEN k > 0 THEN '<|' || kind || '_' || CAST(i AS BIGINT) || '|>' ELSE '' END AS mark FROM t)
SELECT conv_id, string_agg('<|' || replace(role, '<|', '<\|') || '|>' || chr(10) || CASE WHEN turn % 2 = 1 THEN mark || replace(text, '<|', '<\|') ELSE replace(text, '<|', '<\|') || mark END || chr(10) || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS prompt,
       CAST(count(*) AS INTEGER) AS messages, CAST(sum(words + extra) AS BIGINT) AS tokens, CAST(sum(CASE WHEN k > 0 THEN 1 ELSE 0 END) AS INTEGER) AS n_attachments,
       coalesce(string_agg(CASE WHEN k > 0 THEN CAST(i AS BIGINT) || ':' || turn || ':' || kind || ':attachments/' || conv_id || '/' || turn || ':' || CAST(extra AS BIGINT) END, ';' ORDER BY turn, role, text), '') AS attachments
FROM p GROUP BY conv_id
"""
