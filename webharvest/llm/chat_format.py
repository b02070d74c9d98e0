"""Chat formatting with a grammar round trip.

A conversation is rendered as

    <turn role="user" esc="0">text</turn>

turn after turn.  The parser is deterministic: a turn ends at the first </turn>, its header at the first >.
Rendered text is parsed again and compared with the source; while they differ, the conversation is rendered at
the next escape level.  Level 1 writes every backslash as \\b and every < as \\l, so no control string is left
in a text; roles are always written with their marks escaped.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE, END = '<turn role="', '" esc="', '">', "</turn>"


def _swap(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    return _swap(_swap(text, "\\", "\\b"), "<", "\\l")


def unescape(text: Column) -> Column:
    """Inverse of escape: an escaped text has no other use of a backslash."""
    return _swap(_swap(text, "\\l", "<"), "\\b", "\\")


def _escape_role(role: Column) -> Column:
    return _swap(_swap(escape(role), '"', "\\q"), ">", "\\g")


def _unescape_role(role: Column) -> Column:
    return unescape(_swap(_swap(role, "\\g", ">"), "\\q", '"'))


def render(turns: Column, level: int) -> Column:
    """turns: array of struct(role, text).  Level 0 writes texts as they are, level 1 escaped."""
    text = (lambda x: escape(x)) if level else (lambda x: x)
    return F.array_join(
        F.transform(
            turns, lambda t: F.concat(F.lit(OPEN), _escape_role(t["role"]), F.lit(f"{MIDDLE}{level}{CLOSE}"), text(t["text"]), F.lit(END))
        ),
        ""
    )


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation, array of struct(role, text, esc); a piece that is no turn has a null role."""
    head = r'^<turn role="([^">]*)" esc="([01])">'

    def turn(piece: Column) -> Column:
        body = F.regexp_replace(piece, F.lit(head), F.lit(""))
        esc = F.regexp_extract(piece, head, 2)
        good = F.regexp_like(piece, F.lit(head))
        return F.struct(
            F.when(good, _unescape_role(F.regexp_extract(piece, head, 1))).alias("role"),
            F.when(esc == "1", unescape(body)).otherwise(body).alias("text"), esc.alias("esc")
        )

    pieces = F.split(formatted, END, -1)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def _same(parsed: Column, turns: Column) -> Column:
    return F.transform(parsed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).eqNullSafe(turns)


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, escape_level, round_trip) of rows (conv_id, turn, role, text).

    Rows are taken by turn; equal turns by role, then text; repeated rows stay.  Null roles and texts count as
    empty, a null turn comes first; rows without a conv_id form a conversation of their own.  A conversation is
    one output row, so it is gathered whole.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    turns = gathered.select(
        "conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns")
    )
    plain = turns.withColumn("formatted", render(F.col("turns"), 0))
    tried = plain.withColumn(
        "plain_ok", _same(parse(F.col("formatted")), F.col("turns")) & ~F.exists("turns", lambda t: F.contains(t["text"], F.lit("<turn ")))
    )
    done = tried.withColumn("formatted", F.when(F.col("plain_ok"), F.col("formatted")).otherwise(render(F.col("turns"), 1)))
    return done.select(
        "conv_id", "formatted", F.when(F.col("plain_ok"), 0).otherwise(1).alias("escape_level"),
        _same(parse(F.col("formatted")), F.col("turns")).alias("round_trip")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests taken from the rendered text alone: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, escape_level, round_trip)."""
    parsed = formatted.withColumn("turns", parse(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    out = parsed.withColumn("said", said).withColumn("loss", loss)
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2("said", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "escape_level", "round_trip"
    )


def loss_spans(formatted: DataFrame, role: str = "assistant") -> DataFrame:
    """(conv_id, span_start, span_end) of the texts under the loss mask, in code points of the rendered text, end exclusive."""
    pieces = F.split("formatted", END, -1)
    each = formatted.select(
        "conv_id", "formatted",
        F.transform(
            F.slice(pieces, 1, F.size(pieces) - 1),
            lambda p: F.struct(
                F.length(F.regexp_extract(p, r'^<turn role="[^">]*" esc="[01]">', 0)).alias("head"), F.length(p).alias("size"),
                _unescape_role(F.regexp_extract(p, r'^<turn role="([^">]*)"', 1)).alias("role")
            )
        ).alias("parts")
    )
    start = {"at": F.lit(0), "spans": F.array().cast("array<struct<a:int,b:int,role:string>>")}
    placed = F.aggregate(
        "parts", F.struct(*[v.alias(k) for k, v in start.items()]), lambda acc,
        p: F.struct(
            (acc["at"] + p["size"] + len(END)).alias("at"),
            F.array_append(
                acc["spans"], F.struct((acc["at"] + p["head"]).alias("a"), (acc["at"] + p["size"]).alias("b"), p["role"].alias("role"))
            ).alias("spans")
        )
    )
    return each.select(
        "conv_id", F.explode(F.filter(placed["spans"], lambda s: s["role"] == role)).alias("s")
    ).select("conv_id", F.col("s.a").alias("span_start"), F.col("s.b").alias("span_end"))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
k AS (SELECT conv_id, max((contains(text, '</turn>') OR contains(text, '<turn '))::INT) AS esc FROM c GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(29 + length(replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '"', '\q'), '>', '\g')) + length(CASE WHEN esc = 1 THEN replace(replace(text, '\', '\b'), '<', '\l') ELSE text END))::BIGINT AS formatted_chars,
  esc AS escape_level, true AS round_trip
FROM c JOIN k USING (conv_id) GROUP BY conv_id, esc"""
