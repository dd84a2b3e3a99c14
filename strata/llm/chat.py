"""Chat formatting: conversations rebuilt from an event log, then rendered by a template.

Events are rows of conversation, message, sequence, kind, role and text. Kinds: ``message`` (a whole
message), or for streamed messages ``start``, ``delta`` (adds text), ``edit`` (replaces the text so
far), ``regenerate`` (empties it) and ``delete``. Events are first folded by conversation and message,
in order of sequence, so a long stream is spread over its messages; only final messages meet in their
conversation's row, which is what is returned.

Template: ``<s>`` and, for each turn, ``[INST]role[/INST]text</s>``. Inside roles and texts ``\\``, ``<``
and ``[`` become ``\\e``, ``\\l`` and ``\\b``, so that no control string can be there, and back again when
read. The loss mask is the list of spans of the assistant's texts.

DataFrame functions only. A streamed message has the sequence of its first event and the first role that
any of its events names (none: empty); an event of it that is delivered again counts once; after a
delete only a start, edit or regenerate brings it back, deltas do not. Other edge cases: null texts and
roles are empty, null kinds are whole messages; null conversation ids are one conversation; null
sequences come first; ties are ordered by role and text; repeated rows of kind ``message`` are repeated
turns; very long texts are whole; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))  # in this order; read back in the other
BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
RESETS = ("edit", "regenerate", "start", "delete")


def escape(text: Column) -> Column:
    for plain, marked in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(marked))
    return text


def unescape(text: Column) -> Column:
    for plain, marked in reversed(ESCAPES):
        text = F.replace(text, F.lit(marked), F.lit(plain))
    return text


def rebuild(events: DataFrame, conv: str = "conv_id", message: str = "message", seq: str = "seq", kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and turns (seq, role, text in order) of each conversation."""
    e = events.select(
        F.col(conv).alias("conv_id"), F.col(message).alias("m"), F.col(seq).alias("seq"), F.coalesce(F.col(kind), F.lit("message")).alias("kind"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    log = F.array_sort(F.collect_list(F.struct("seq", "role", "text", "kind")))
    one = e.groupBy("conv_id", "m").agg(log.alias("log"))
    turn = lambda x: F.struct(x["seq"].alias("seq"), x["role"].alias("role"), x["text"].alias("text"))
    whole = F.transform(F.filter("log", lambda x: x["kind"] == "message"), turn)
    parts = F.array_distinct(F.filter("log", lambda x: x["kind"] != "message"))
    last = F.array_max(F.transform("parts", lambda x, i: F.when(x["kind"].isin(*RESETS), i)))
    since = F.slice("parts", F.coalesce(F.col("last"), F.lit(0)) + 1, F.size("parts"))
    body = F.array_join(F.transform(F.filter(since, lambda x: x["kind"].isin("start", "edit", "delta")), lambda x: x["text"]), "")
    who = F.coalesce(F.get(F.filter(F.transform("parts", lambda x: x["role"]), lambda r: r != ""), F.lit(0)), F.lit(""))
    gone = F.coalesce(F.get("parts", F.col("last"))["kind"] == "delete", F.lit(False))
    streamed = F.when((F.size("parts") > 0), F.array(F.struct(F.get("parts", F.lit(0))["seq"].alias("seq"), who.alias("role"), body.alias("text"))))
    nothing = F.slice(F.col("whole"), 1, 0)
    folded = (
        one.select("conv_id", whole.alias("whole"), parts.alias("parts"))
        .withColumn("last", last)
        .select("conv_id", F.when(F.size("parts") == 0, F.col("whole")).when(gone, F.col("whole")).otherwise(F.concat("whole", F.coalesce(streamed, nothing))).alias("turns"))
    )
    return folded.groupBy("conv_id").agg(F.array_sort(F.flatten(F.collect_list("turns"))).alias("turns"))


def streamed(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The events of rows that are turns, as an application that streams them would log them: an assistant's turn is
    started, streamed in part, regenerated and streamed in two pieces, any other turn is started in part and then edited.
    Each row is a message of its own; seq is its turn, then the step."""
    whole = F.coalesce(F.col(text), F.lit(""))
    half = F.floor(F.length(whole) / 2).cast("int")
    first, second = F.substring(whole, F.lit(1), half), F.substring(whole, half + 1, F.length(whole))
    event = lambda kind, said: F.struct(F.lit(kind).alias("kind"), said.alias("text"))
    said = F.array(event("start", F.lit("")), event("delta", first), event("regenerate", F.lit("")), event("delta", first), event("delta", second))
    steps = F.when(F.col(role) == "assistant", said).otherwise(F.array(event("start", first), event("edit", whole)))
    each = rows.select(F.col(conv).alias("conv_id"), F.monotonically_increasing_id().alias("message"), F.col(turn).alias("turn"), F.col(role).alias("role"), steps.alias("steps"))
    each = each.select("conv_id", "message", "turn", "role", F.posexplode("steps").alias("step", "event"))
    return each.select("conv_id", "message", F.struct("turn", "step").alias("seq"), F.col("event.kind").alias("kind"), "role", F.col("event.text").alias("text"))


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted and loss (spans start, size of the assistant's texts, in characters from 1)."""
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(CLOSE))
    pieces = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), head(t).alias("head"), escape(t["text"]).alias("body")))
    out = conversations.select("conv_id", pieces.alias("p"))
    zero = F.struct(F.lit(len(BEGIN) + 1).alias("at"), F.array().cast("array<struct<start:int,size:int>>").alias("spans"))

    def add(s: Column, p: Column) -> Column:
        start, size = s["at"] + F.length(p["head"]), F.length(p["body"])
        span = F.array(F.struct(start.alias("start"), size.alias("size")))
        return F.struct((start + size + len(END)).alias("at"), F.when(p["role"] == "assistant", F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    formatted = F.concat(F.lit(BEGIN), F.array_join(F.transform("p", lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""))
    return out.select("conv_id", formatted.alias("formatted"), F.aggregate("p", zero, add, lambda s: s["spans"]).alias("loss"))


def read(rendered: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss_text, read back from formatted and loss, and formatted."""
    body = F.substring("formatted", F.lit(len(BEGIN) + 1), F.length("formatted"))
    marks = F.split(body, END)  # the template's own: texts have none
    turn = lambda x: F.split(F.substring(x, F.lit(len(OPEN) + 1), F.length(x)), r"\[/INST\]", 2)
    turns = F.transform(F.slice(marks, F.lit(1), F.size(marks) - 1), lambda x: F.struct(unescape(turn(x)[0]).alias("role"), unescape(turn(x)[1]).alias("text")))
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substring("formatted", s["start"], s["size"]))), "")
    return rendered.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), "formatted")


def digest(back: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'), (-7::BIGINT, 1::BIGINT, 'assistant', '</s>[INST] ok [/INST]')) v)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(17 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<\[]', '', 'g'))))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
