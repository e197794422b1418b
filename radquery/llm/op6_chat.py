"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted by turn (ties: by role, then text). An array aggregation
merges adjacent turns of the same role; the texts of a merged turn stay apart by a control string, so nothing is lost.

    <|turn|>role<|text|>first text<|part|>second text<|end|>

Control strings inside roles and texts, those of other common templates too, get a backslash after their first character, or
one more where some are there already. Taking one away restores the text, whatever it was.

Null roles and texts are empty; rows with a null turn come first; repeated rows all stay; null conversation ids form one
conversation. Of further columns nothing is read. No rows: no conversation. A conversation is one row of the result, so it
has to fit in memory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURN, TEXT, PART, END = "<|turn|>", "<|text|>", "<|part|>", "<|end|>"
#: What follows the first character of a control string.
RESTS = r"\|(?:turn|text|part|end|im_start|im_end|system|user|assistant|startoftext|endoftext)\|>|/?s>|/?INST\]|</?SYS>>"
#: Items of a block of an array, at least.
LEAST_BLOCK = 64
#: A conversation that looks like another template's control strings.
TRICKY_ID, TRICKY_TEXT = -7, "</s>[INST] ok [/INST]"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({RESTS})", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({RESTS})", "$1$2$3")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often a lambda within needs it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(items: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of each block of an array and of the place of its first item, from 1. A block has as many items as there are
    blocks, or ``LEAST_BLOCK``, so what copies an array for each item of a block costs n sqrt(n) and not the square of n."""
    n = F.greatest(F.size(items), F.lit(1))
    size = F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.sqrt(n))).cast("int")
    return F.transform(F.sequence(F.lit(1), n, size), lambda first: body(F.slice(items, first, size), first))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, and loss_spans: where texts of ``loss_role`` stand, in code points of ``formatted``."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    spans = "array<struct<start: bigint, length: bigint>>"

    def add(done: Column, t: Column) -> Column:
        """A turn goes on where the turn before has its role; else that one ends and a new one begins."""
        head = F.concat(F.when(done["role"].isNull(), "").otherwise(END), F.lit(TURN), escaped(t["role"]), F.lit(TEXT))
        written = F.struct(F.when(done["role"] == t["role"], PART).otherwise(head).alias("head"), escaped(t["text"]).alias("text"))

        def longer(w: Column) -> Column:
            start, length = done["at"] + F.length(w["head"]), F.length(w["text"]).cast("long")
            span = F.array(F.struct(start.alias("start"), length.alias("length")))
            return F.struct(
                t["role"].alias("role"),
                F.concat(done["pieces"], F.array(w["head"], w["text"])).alias("pieces"),
                (start + length).alias("at"),
                F.when(t["role"] == loss_role, F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"),
            )

        return _let(written, longer)

    def merge(every: Column) -> Column:
        """Blocks of turns, merged each: the pieces of text, their length, and spans from the block's own begin."""

        def block(some: Column, first: Column) -> Column:
            before = F.when(first > 1, F.try_element_at(every, first - 1)["role"])
            empty = F.struct(before.alias("role"), F.expr("cast(array() as array<string>)").alias("pieces"), F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as {spans})").alias("spans"))
            return F.aggregate(some, empty, add)

        return _blocks(every, block)

    def whole(blocks: Column) -> Column:
        places = F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda s, b: F.concat(s, F.array(F.element_at(s, -1) + b["at"])))
        moved = F.zip_with(blocks, places, lambda b, at: F.transform(F.coalesce(b["spans"], F.expr(f"cast(array() as {spans})")), lambda s: F.struct((s["start"] + at).alias("start"), s["length"].alias("length"))))
        text = F.concat(F.array_join(F.flatten(F.transform(blocks, lambda b: b["pieces"])), ""), F.lit(END))
        return F.struct(text.alias("formatted"), F.flatten(moved).alias("loss_spans"))

    made = sorted_turns.select("conv_id", _let(F.col("turns"), lambda every: _let(merge(every), whole)).alias("made"))
    return made.select("conv_id", "made.formatted", "made.loss_spans")


def under_spans(text: Column, spans: Column) -> Column:
    """What stands in ``text`` at each of the ``spans``, which are in order. A block of spans is cut out first, as a place in a
    text is found by counting from its begin."""

    def block(some: Column) -> Column:
        first, last = F.try_element_at(some, F.lit(1)), F.try_element_at(some, F.lit(-1))
        length = last["start"] + last["length"] - first["start"]
        part = text.substr((first["start"] + 1).cast("int"), length.cast("int"))
        return _let(part, lambda p: F.transform(some, lambda s: p.substr((s["start"] - first["start"] + 1).cast("int"), s["length"].cast("int"))))

    return F.flatten(_blocks(spans, lambda some, _: _let(some, block)))


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """Adds ``turns``, the (role, text) of each original row in order, and ``loss_text``, read from the formatted text."""
    quoted = {m: m.replace("|", r"\|") for m in (TURN, TEXT, PART, END)}

    def turn(x: Column) -> Column:
        at = F.instr(x, TEXT)
        body = x.substr(at + len(TEXT), F.length(x) - at - len(TEXT + END) + 1)
        role = unescaped(x.substr(F.lit(1), at - 1))
        return _let(role, lambda r: F.transform(F.split(body, quoted[PART], -1), lambda p: F.struct(r.alias("role"), unescaped(p).alias("text"))))

    raw = F.split("formatted", quoted[TURN], -1)
    turns = _let(raw, lambda r: F.flatten(F.transform(F.slice(r, 2, F.size(r)), turn)))
    loss = _let(F.struct("formatted", "loss_spans"), lambda x: _let(x["formatted"], lambda text: _let(x["loss_spans"], lambda spans: under_spans(text, spans))))
    return formatted.withColumns({"turns": turns, "loss_text": F.array_join(F.transform(loss, unescaped), "")})


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    tricky = spark.range(2).select(F.lit(TRICKY_ID).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(TRICKY_TEXT))
    read = parse_conversations(format_conversations(turns.union(tricky)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_RULE = r"([<\[])(\\*)(\|(?:turn|text|part|end|im_start|im_end|system|user|assistant|startoftext|endoftext)\|>|/?s>|/?INST\]|</?SYS>>)"
OP6_SQL = rf"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(role, '{_RULE}', '\1\\\2\3', 'g') AS r, regexp_replace(text, '{_RULE}', '\1\\\2\3', 'g') AS x,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM t)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(x) + CASE WHEN before = role THEN 8 ELSE 8 + length(r) + 8 + 7 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
