"""Chat formatting by event-sourced reconstruction.

A log holds a conversation's events in sequence: ``delta`` appends to a message,
``edit`` replaces it, ``regenerate`` empties it to be streamed anew. The log is
partitioned by conversation and folded by message; then the messages of a
conversation are put in order and rendered. Messages are known by number, so a
text travels once, as itself. The rendered text can be read back: the template's
marks begin with characters that are escaped inside texts.

All in DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fraudscope.llm.common import let, table

#: The template: TURN role newline text END newline. Marks begin with "<" or "[".
TURN, END = "<|turn|>", "<|end|>\n"
#: Escapes, in this order; undone in the reverse. After them a text holds no "<" and no "[",
#: and each backslash begins one of these pairs.
_ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))
_ROLE_ESCAPES = (*_ESCAPES, ("\n", "\\n"))


def escape(text: Column, pairs=_ESCAPES) -> Column:
    for plain, written in pairs:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column, pairs=_ESCAPES) -> Column:
    for plain, written in reversed(pairs):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, msg, seq, role, text) of ``conv_id, seq, msg, kind, role, text``.

    A message's text is its last edit, if any comes after its last
    regeneration, and all deltas after both. ``seq`` is its first event's;
    its role is the first one given. Events of one sequence number are taken in
    the order of kind and text; NULL texts are empty, unknown kinds are ignored.
    """
    event = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "role")
    logs = events.groupBy("conv_id", "msg").agg(F.sort_array(F.collect_list(event)).alias("log"))

    def text(log: Column) -> Column:
        resets = F.filter(F.transform(log, lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i)), lambda i: i.isNotNull())
        last = F.coalesce(F.array_max(resets), F.lit(0))
        parts = F.filter(log, lambda e, i: (i >= last) & e["kind"].isin("edit", "delta"))
        return F.array_join(F.transform(parts, lambda e: e["text"]), "")

    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return logs.select("conv_id", "msg", F.col("log")[0]["seq"].alias("seq"), F.get(roles, F.lit(0)).alias("role"), let(F.col("log"), text).alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of final messages.

    ``loss_spans`` are the (start, length) in code points of the assistant's
    texts in ``formatted``. A NULL role is an empty one.
    """
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(TURN), escape(role, _ROLE_ESCAPES), F.lit("\n"))
    parts = messages.select("conv_id", "seq", "msg", role.alias("role"), "text", head.alias("head"), escape(F.col("text")).alias("body"))
    # running ends of the turns give the starts of the bodies
    order = ["seq", "msg", "role", "text"]
    so_far = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("head") + F.length("body") + F.lit(len(END))).over(so_far)
    placed = parts.withColumn("start", (end - F.length("body") - F.lit(len(END) - 1)).cast("int"))
    turn = F.struct(*order, "start", "head", "body")
    convs = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    joined = F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    loss = F.filter("turns", lambda x: x["role"] == "assistant")
    spans = F.transform(loss, lambda x: F.struct(x["start"].alias("start"), F.length(x["body"]).alias("length")))
    return convs.select("conv_id", joined.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_text, formatted_chars) parsed from the rendered text."""

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, "\n")
        body = F.substring(piece, cut + 1, F.length(piece) - cut - len(END))
        return F.struct(unescape(F.substring(piece, F.lit(1), cut - 1), _ROLE_ESCAPES).alias("role"), unescape(body).alias("text"))

    pieces = F.filter(F.split("formatted", r"<\|turn\|>"), lambda _, i: i > 0)
    text = F.col("formatted")
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(text, s["start"], s["length"])))
    return formatted.select(
        "conv_id", F.transform(pieces, turn).alias("turns"), F.array_join(loss, "").alias("loss_text"), F.length(text).cast("long").alias("formatted_chars")
    )


def conversation_events(rows: DataFrame) -> DataFrame:
    """Event log of finished rows (conv_id, turn, role, text).

    A message is first streamed as a draft. An assistant's is then regenerated
    and its text streamed in two halves; any other's is replaced by an edit that
    holds the first half, and the second half is streamed after it.

    Messages carry a number in place of their text: 4 * number + step orders a
    conversation's events, and the number is the place of the message by turn,
    role and text (NULL first). So rows that share a turn stay apart, and
    repeated rows are messages of their own.
    """
    place = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select("conv_id", "role", "text", (F.row_number().over(place) - 1).cast("long").alias("msg"))
    text = F.coalesce("text", F.lit(""))
    half = F.expr("length(coalesce(text, '')) div 2").cast("int")
    one, two = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))

    def event(step: int, kind: str, said: Column) -> Column:
        return F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), said.alias("text"))

    draft = event(0, "delta", F.lit("draft"))
    regenerated = F.array(draft, event(1, "regenerate", F.lit("")), event(2, "delta", one), event(3, "delta", two))
    edited = F.array(draft, event(1, "edit", one), event(2, "delta", two))
    steps = numbered.select("conv_id", "msg", "role", F.explode(F.when(F.col("role") == "assistant", regenerated).otherwise(edited)).alias("e"))
    return steps.select("conv_id", (F.col("msg") * 4 + F.col("e.step")).alias("seq"), "msg", F.col("e.kind"), "role", F.col("e.text"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """Formatted conversations of rows (conv_id, turn, role, text), with the figures read back from them.

    NULL and empty texts give empty turns, NULL roles empty roles; rows with a NULL
    ``conv_id`` are one conversation. Turns come in the order of turn (NULL first), role and
    text, repeated rows one after the other; other columns, whatever their names, are not
    read. A conversation is one row of one task, very long texts included. An empty
    table gives no rows.
    """
    rows = rows.select("conv_id", "turn", "role", "text")
    formatted = render(fold_events(conversation_events(rows)))
    back = read_back(formatted)
    log = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(log, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return format_conversations(rows.unionByName(extra))


OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, x.turn, x.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(turn, role)),
e AS (
  SELECT *, length(role) + length(text) + 16
    + length(regexp_replace(role || text, '[^<\[\\]', '', 'g')) + length(regexp_replace(role, '[^\n]', '', 'g')) AS chars
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
