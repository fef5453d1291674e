"""Chat formatting from event logs (DataFrame functions only).

A log holds events (conversation, seq, kind, target, role, text):

* ``message``: starts message ``target`` with a role and a text;
* ``delta``: adds its text to the end of message ``target`` (streamed output);
* ``edit``: replaces the text of message ``target``;
* ``regenerate``: empties message ``target``; the deltas after it are the new answer;
* ``delete``: removes message ``target`` (a later ``message`` or ``edit`` brings it back).

Logs are partitioned by conversation and message, sorted by seq and folded: what comes before the last event that replaces
the text is void, the rest is joined. Messages stand in the order of their first event.

The template is ``<|turn|>role\\ntext<|end|>``. Inside roles and texts ``&``, ``<`` and ``[`` are written ``&amp;``, ``&lt;``
and ``&#91;`` (in roles a line feed as ``&#10;`` too), so that no control string, of this template or of others, can
occur there, and reading is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
CODES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")]
ROLE_CODES = [*CODES, ("\n", "&#10;")]


def escaped(text: Column, codes=CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, codes=CODES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, place, role, text) of a log; place orders them.

    Null texts are empty, null roles are the empty string. Events with equal seq are taken in the order of kind, role and
    text; a repeated event counts each time (a repeated delta adds its text again). Events on a message that has no
    ``message`` event form a message of their own with an empty role. Rows with a null target or kind are ignored. Extra
    columns are dropped.
    """
    e = events.filter("target is not null and kind is not null").select("conv_id", "target", "seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    e = e.withColumn("at", F.struct("seq", "kind", "role", "text"))
    log = Window.partitionBy("conv_id", "target")
    anew = F.max(F.when(F.col("kind").isin("message", "edit", "regenerate", "delete"), F.col("at"))).over(log)
    e = e.withColumns({"anew": anew, "place": F.min("seq").over(log)})
    keep = e.withColumn("live", F.col("anew").isNull() | (F.col("at") >= F.col("anew")))
    parts = F.sort_array(F.collect_list(F.when(F.col("live") & ~F.col("kind").isin("regenerate", "delete"), F.struct("at", "text"))))
    # a repeated replacing event counts once
    text = F.concat_ws("", F.transform(F.filter(parts, lambda x: x["at"]["kind"] == "delta"), lambda x: x["text"]))
    head = F.max(F.when(F.col("live") & F.col("kind").isin("message", "edit"), F.col("at")))
    return (
        keep.groupBy("conv_id", "target", "place")
        .agg(F.concat(F.coalesce(head["text"], F.lit("")), text).alias("text"), F.coalesce(F.max(F.when(F.col("kind") == "message", F.struct("at", "role")))["role"], F.lit("")).alias("role"), F.max("anew")["kind"].alias("last"))
        .filter("last is null or last <> 'delete'")
        .select("conv_id", "place", "target", "role", "text")
    )


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, mask: spans (turn, start, length) that count for the loss.

    A span lies in the part of the formatted text that begins after the turn mark number ``turn`` (from 0), at a character from
    0 on: the escaped text of a message with one of loss_roles. Spans refer to their turn, so that each is found without
    walking through all of a long conversation.

    messages: conv_id, place, target, role, text as of fold(). A conversation is one text, so its turns meet in one row; nothing
    else is gathered.
    """
    head, text = F.concat(escaped(F.col("role"), ROLE_CODES), F.lit("\n")), escaped(F.col("text"))
    turn = F.struct(head.alias("head"), text.alias("text"), F.col("role").isin(*loss_roles).alias("loss"))
    rows = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "target", turn.alias("turn")))).alias("turns")).select("conv_id", F.col("turns.turn").alias("turns"))
    formatted = F.concat_ws("", F.transform("turns", lambda t: F.concat(F.lit(TURN), t["head"], t["text"], F.lit(END))))
    spans = F.transform("turns", lambda t, i: F.when(t["loss"], F.struct(i.alias("turn"), F.length(t["head"]).alias("start"), F.length(t["text"]).alias("length"))))
    return rows.select("conv_id", formatted.alias("formatted"), F.filter(spans, lambda x: x.isNotNull()).alias("mask"))


def under_mask(formatted: Column, mask: Column) -> Column:
    """The texts under the loss mask, as they were before they were escaped, in order."""
    parts = F.split(formatted, r"<\|turn\|>", -1)  # nothing stands before the first mark
    return F.transform(F.transform(mask, lambda m: F.substring(F.get(parts, m["turn"] + 1), m["start"] + 1, m["length"])), lambda x: unescaped(x))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text holds."""
    parts = F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda x: x != "")
    return F.transform(
        parts,
        lambda x: F.struct(
            unescaped(F.substring_index(x, "\n", 1), ROLE_CODES).alias("role"),
            unescaped(F.regexp_extract(x, r"(?s)^[^\n]*\n(.*)<\|end\|>$", 1)).alias("text"),
        ),
    )


def as_events(conversations: DataFrame) -> DataFrame:
    """Finished conversations (conv_id, turn, role, text) as a log: a message for each row.

    Rows with the same turn stand in the order of role and text; the target tells repeated rows apart.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("seq"), "role", "text", F.lit("message").alias("kind")).withColumn("target", F.col("seq"))


def as_log(conversations: DataFrame) -> DataFrame:
    """Finished conversations as the log of a chat: what people write is begun, then edited; answers come in deltas, are broken
    off, asked for again, and come in deltas once more. Order and repeated rows as in as_events()."""
    rows = as_events(conversations).drop("kind").withColumn("text", F.coalesce("text", F.lit("")))
    half = F.floor(F.length("text") / 2).cast("int")
    first, rest = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))
    event = lambda k, kind, text: F.struct((F.col("seq") * 10 + k).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    typed = F.array(event(0, "message", first), event(1, "edit", F.col("text")))
    streamed = F.array(event(0, "message", F.lit("")), event(1, "delta", rest), event(2, "regenerate", F.lit("")), event(3, "delta", first), event(4, "delta", rest))
    log = rows.select("conv_id", "target", "role", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(typed)).alias("e"))
    return log.select("conv_id", "target", "role", "e.seq", "e.kind", "e.text")


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted texts hold, read back from them."""
    out = formatted.withColumns({"turns": read_back(F.col("formatted")), "loss": F.concat_ws("", under_mask(F.col("formatted"), F.col("mask")))})
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ODD = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string"))
    return digest(render(fold(as_log(rows))))


_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"
OP9_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS t,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS l,
         sum(16 + length(replace({_ESC.format("role")}, chr(10), '&#10;')) + length({_ESC.format("text")})) AS f
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(t) AS turns_sha256, length(l) AS loss_chars, sha256(l) AS loss_sha256, f::BIGINT AS formatted_chars FROM g
"""
