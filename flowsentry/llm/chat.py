"""Chat formatting with a grammar round trip, in DataFrame expressions only.

Grammar of a formatted conversation (every turn starts with ``<s>``)::

    turn      = "<s>" ( "[INST] " text " [/INST]"        role user
                      | "[SYS] " text " [/SYS]"          role system
                      | "[ANS] " text "</s>"             role assistant
                      | "[TURN:" role "] " text " [/TURN]" )   any other role
    text      = characters without a control string

Each turn is rendered raw, reparsed by the grammar and compared with its source.  Where it
differs, the text's conflicting content is escaped (``&amp;``, ``&lt;``, ``&lb;`` for the
first character of a control string or of something that looks like an escape) and parsed
again, and, should that still differ, every ``&``, ``<`` and ``[`` is escaped.  Unescaping is
the same for all, so a reader needs no flag.  A turn that does not survive the last level
fails the job.

Defined cases: a null text or role is empty; a null turn sorts first; rows with equal turn
are ordered by role, then text; repeated rows are turns each; rows with a null conversation
id form one conversation; an empty table gives no conversations.  One conversation is one
output row, so its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAMES = "INST|SYS|ANS|TURN"
_CONTROL = rf"(?: ?\[/?(?:{_NAMES})[\]:]|</?s>)"
_TURN = rf"(?s)^\[(INST|SYS|ANS|TURN:[^\]]*)\] (.*?){_CONTROL}"
_ENTITY = "amp|lt|lb|rb"


def _escape_conflicts(text: Column) -> Column:
    text = F.regexp_replace(text, rf"&(?=(?:{_ENTITY});)", "&amp;")
    text = F.regexp_replace(text, r"<(?=/?s>)", "&lt;")
    return F.regexp_replace(text, rf"\[(?=/?(?:{_NAMES})[\]:])", "&lb;")


def _escape_all(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;"), ("]", "&rb;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&lb;", "["), ("&rb;", "]"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _head(role: Column) -> Column:
    return F.when(role == "user", "<s>[INST] ").when(role == "system", "<s>[SYS] ") \
        .when(role == "assistant", "<s>[ANS] ").otherwise(F.concat(F.lit("<s>[TURN:"), _escape_all(role), F.lit("] ")))


def _tail(role: Column) -> Column:
    return F.when(role == "user", " [/INST]").when(role == "system", " [/SYS]") \
        .when(role == "assistant", "</s>").otherwise(" [/TURN]")


def _parsed_turn(segment: Column) -> Column:
    """(role, text) of what follows ``<s>``; the text ends at the first control string."""
    name = F.regexp_extract(segment, _TURN, 1)
    role = F.when(name == "INST", "user").when(name == "SYS", "system").when(name == "ANS", "assistant") \
        .otherwise(unescape(F.substring(name, len("TURN:") + 1, 1 << 30)))
    return F.struct(role.alias("role"), unescape(F.regexp_extract(segment, _TURN, 2)).alias("text"))


def parse(formatted: Column) -> Column:
    """Turns of a formatted conversation: array of (role, text)."""
    return F.transform(F.filter(F.split(formatted, "<s>", -1), lambda s, i: i > 0), _parsed_turn)


def _survives(piece: Column, role: Column, text: Column) -> Column:
    return parse(piece) == F.array(F.struct(role.alias("role"), text.alias("text")))


def format_conversations(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask (array of (start, length)).

    The mask covers the assistants' texts, as they stand in ``formatted`` (escaped), counted
    in characters from 0.
    """
    r, t = F.col("role"), F.col("text")
    turns = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
                        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    piece = lambda body: F.concat(_head(r), body, _tail(r))
    body = F.when(_survives(piece(t), r, t), t) \
        .when(_survives(piece(_escape_conflicts(t)), r, t), _escape_conflicts(t)) \
        .when(_survives(piece(_escape_all(t)), r, t), _escape_all(t)) \
        .otherwise(F.raise_error(F.lit("a turn does not survive the round trip")).cast("string"))
    safe = turns.withColumn("body", body)
    pieces = safe.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "body"))).alias("turns"))
    build = F.transform("turns", lambda x: F.concat(_head(x["role"]), x["body"], _tail(x["role"])))
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:long,length:long>>)").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(_head(x["role"])) + F.length(x["body"]) + F.length(_tail(x["role"]))).cast("long").alias("at"),
            F.when(x["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(_head(x["role"]))).cast("long").alias("start"),
                F.length(x["body"]).cast("long").alias("length"))))).otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    return pieces.select("conv_id", F.array_join(build, "").alias("formatted"), spans.alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Formatted rows plus ``turns`` (role, text) and ``loss_text``, both from the output alone."""
    loss = F.array_join(F.transform("loss_mask", lambda s: unescape(
        F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return formatted.withColumns({"turns": parse(F.col("formatted")), "loss_text": loss})
