"""Chat formatting: conversations rebuilt from event logs, rendered with a template, and read back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """open role middle text close, for every turn. All three begin with ``<``, which escaped texts never contain."""

    open: str = "<turn>"
    middle: str = "</role>"
    close: str = "</turn>"

    def __post_init__(self):
        if not all(s.startswith("<") and "<" not in s[1:] and "\\" not in s for s in (self.open, self.middle, self.close)):
            raise ValueError("control strings begin with their only < and have no backslash")


def escape(text: Column) -> Column:
    r"""``\`` to ``\s`` and ``<`` to ``\l``: control strings can't occur in the result, and unescape() gets text back."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def rebuild(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, slot, role, text) of an event log (conv_id, seq, slot, kind, role, text).

    slot numbers a conversation's messages. By seq within a conversation: kind ``message`` or ``edit`` sets a slot's
    text, ``delta`` appends to it, ``regenerate`` empties it and drops all later slots' events so far. An edit, a delta
    or a regeneration without role keeps the slot's role. Cases: null text is empty; null kind is a message; null role
    throughout gives an empty role; events of equal seq go by slot, kind, role, text, so repeated deltas are both appended and
    repeated messages count once; events without conv_id form one conversation, and those without slot one message of
    theirs, first in order, which regenerations of others don't touch; an empty log gives no rows. More columns are left out.
    The work is windows and sums over (conv_id[, slot]); only the messages of one conversation meet, in one task,
    as they become one row.
    """
    order = ["seq", "slot", "kind", "role", "text"]
    e = events.select("conv_id", "seq", "slot", F.coalesce("kind", F.lit("message")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    later = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    e = e.withColumn("_cut", F.min(F.when(F.col("kind") == "regenerate", F.col("slot"))).over(later)).where("_cut IS NULL OR slot IS NULL OR slot <= _cut")
    number = F.row_number().over(Window.partitionBy("conv_id", "slot").orderBy(*order))
    e = e.withColumn("_n", number)
    slots = Window.partitionBy("conv_id", "slot")
    e = e.withColumn("_from", F.max(F.when(F.col("kind") != "delta", F.col("_n"))).over(slots))
    e = e.withColumn("_role", F.max_by("role", F.when(F.col("role").isNotNull(), F.col("_n"))).over(slots))
    parts = e.where("_n >= coalesce(_from, 0)").withColumn("_part", F.when(F.col("kind") == "regenerate", F.lit("")).otherwise(F.col("text")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_part"))), lambda x: x["_part"]), "")
    return parts.groupBy("conv_id", "slot").agg(F.coalesce(F.first("_role"), F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame, template: Template = Template(), trained: str = "assistant") -> DataFrame:
    """(conv_id, formatted, spans) of final messages; spans: where formatted holds texts of role trained, the loss mask.

    spans are structs (start from 0, length) in code points of formatted, in order.
    """
    sizes = len(template.open) + len(template.middle), len(template.close)
    m = messages.withColumn("_role", escape(F.col("role"))).withColumn("_text", escape(F.col("text")))
    turn = F.struct("slot", F.concat(F.lit(template.open), "_role", F.lit(template.middle), "_text", F.lit(template.close)).alias("out"), F.length("_role").alias("r"), F.length("_text").alias("t"), (F.col("role") == trained).alias("on"))
    rows = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc, x):
        begin = acc["at"] + F.lit(sizes[0]) + x["r"]
        here = F.when(x["on"], F.array(F.struct(begin.alias("start"), x["t"].alias("length")))).otherwise(F.array().cast("array<struct<start:int,length:int>>"))
        return F.struct((begin + x["t"] + F.lit(sizes[1])).alias("at"), F.concat(acc["spans"], here).alias("spans"))

    return rows.select("conv_id", F.array_join(F.transform("_turns", lambda x: x["out"]), "").alias("formatted"), F.aggregate("_turns", start, step, lambda a: a["spans"]).alias("spans"))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """formatted (conv_id, formatted, spans) with turns, an array of (role, text), and loss, the text under the mask."""
    pieces = F.split(F.col("formatted"), F.lit(template.close))
    turns = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, len(template.open) + 1, 1 << 30), template.middle, 1)).alias("role"),
        unescape(F.substring_index(p, template.middle, -1)).alias("text")))
    loss = F.array_join(F.transform("spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return formatted.withColumn("turns", turns).withColumn("loss", loss)


def conversation_events(rows: DataFrame) -> DataFrame:
    """An event per row of (conv_id, turn, role, text); rows of equal turn stand by role, then text."""
    slot = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text"))
    return rows.select("conv_id", slot.alias("seq"), slot.alias("slot"), F.lit("message").alias("kind"), "role", "text")


PROBE = r"\### Assistant: </turn> ok"


def op4_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """Every conversation, and -7 with control strings in its texts, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    back = read_back(render(rebuild(conversation_events(rows.unionByName(probe)))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(20 + length(replace(replace(role, '\', '\s'), '<', '\l')) + length(replace(replace(text, '\', '\s'), '<', '\l'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
