"""Chat formatting from an event log.

A conversation is a log of events: ``message`` starts a message with a text,
``delta`` appends to it, ``edit`` and ``regenerate`` replace what stood before.
Events are put in sequence within their conversation, folded into final messages
and rendered with a reversible template and a loss mask. Everything is DataFrame
work: one shuffle by conversation.

Template: each message is ``<s>[INST]role[/INST]text</s>``. In roles and texts a
backslash is doubled and a control string gets a backslash after its first
character, so no text can end or open a message.

Defined cases: null texts and roles are empty; a null conversation id is a
conversation of its own; events of equal sequence follow message, kind, role and text; deltas before any
other event start from the empty text; repeated events count each; empty logs
give no rows. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapline.llm import common

OPEN, MID, CLOSE = "<s>[INST]", "[/INST]", "</s>"
CONTROL = r"(<)(/?s>)|(\[)(/?INST\])"
REPLACING = ["edit", "message", "regenerate"]


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def final_messages(events: DataFrame) -> DataFrame:
    """``conv_id, messages``: the log folded, as an array of ``(seq, msg, role, text)`` in order of first event.

    ``events`` has ``conv_id, msg, seq, kind, role, text``.
    """
    event = F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    log = events.repartition("conv_id").groupBy("conv_id", "msg").agg(F.sort_array(F.collect_list(event)).alias("log"))
    # The last event that replaces; all deltas after it follow in order.
    places = F.transform("log", lambda e, i: F.when(e["kind"].isin(REPLACING), i + 1).otherwise(0))
    log = log.withColumn("from", F.greatest(F.lit(1), F.array_max(places)))
    kept = F.filter(F.slice("log", F.col("from"), F.size("log")), lambda e: e["kind"].isin([*REPLACING, "delta"]))
    message = F.struct(
        F.col("log")[0]["seq"].alias("seq"), F.col("msg"), F.col("log")[0]["role"].alias("role"),
        F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text"))
    return log.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("messages"))


def render(conversations: DataFrame, learned: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss``: the rendered text and the spans ``(begin, length)`` whose loss counts.

    Spans are code points, from 0; they hold the texts of the ``learned`` role as escaped.
    """
    turn = F.transform("messages", lambda m: F.struct(
        (m["role"] == learned).alias("learned"),
        F.concat(F.lit(OPEN), escape(m["role"]), F.lit(MID)).alias("head"), escape(m["text"]).alias("body")))
    turns = conversations.select("conv_id", turn.alias("turns"))
    rendered = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    # One row a message, so positions are a running sum; the first of them alone carries the text.
    sizes = F.transform("turns", lambda t, i: F.struct(
        t["learned"].alias("learned"), F.length(t["head"]).alias("head"), F.length(t["body"]).alias("body"), F.when(i == 0, rendered).alias("formatted")))
    rows = turns.select("conv_id", F.posexplode_outer(sizes).alias("i", "s"))
    upto = F.sum(F.col("s.head") + F.col("s.body") + len(CLOSE)).over(Window.partitionBy("conv_id").orderBy("i"))
    span = F.struct((upto - F.col("s.body") - len(CLOSE)).alias("begin"), F.col("s.body").alias("length"))
    placed = rows.select("conv_id", "s.formatted", F.col("s.learned").alias("learned"), span.alias("span"))
    # A list takes the text once; a first value would be copied with every row.
    return placed.groupBy("conv_id").agg(
        F.array_join(F.collect_list("formatted"), "").alias("formatted"),
        F.sort_array(F.collect_list(F.when(F.col("learned"), F.col("span")))).alias("loss"))


def parse(formatted: Column) -> Column:
    """The messages ``(role, text)`` of a rendered conversation."""
    pattern = r"(?s)<s>\[INST\](.*?)\[/INST\](.*?)</s>"
    roles = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(1))
    texts = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(2))
    return F.transform(F.arrays_zip(roles.alias("role"), texts.alias("text")),
                       lambda m: F.struct(unescape(m["role"]).alias("role"), unescape(m["text"]).alias("text")))


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped.

    The text is cut into blocks once and a span is taken from the blocks it lies in, so that a span
    does not cost a walk through all of the text before it.
    """
    size = F.greatest(F.lit(1_024), (F.sqrt(F.length(formatted)) * 16).cast("int"))
    sized = F.struct(formatted.alias("text"), loss.alias("loss"), size.alias("size"))

    def cut(x):
        places = F.sequence(F.lit(0), (F.length(x["text"]) / x["size"]).cast("int"))
        return F.struct(F.transform(places, lambda i: F.substring(x["text"], i * x["size"] + 1, x["size"])).alias("blocks"),
                        x["loss"].alias("loss"), x["size"].alias("size"))

    def taken(x, s):
        first = F.floor(s["begin"] / x["size"]).cast("int")
        last = F.floor((s["begin"] + s["length"]) / x["size"]).cast("int")
        held = F.array_join(F.slice(x["blocks"], first + 1, last - first + 1), "")
        return unescape(F.substring(held, (s["begin"] - first * x["size"]).cast("int") + 1, s["length"]))

    # Arrays of one element hold what is worked out once for all spans.
    blocks = F.transform(F.array(sized), cut)
    return F.transform(blocks, lambda x: F.array_join(F.transform(x["loss"], lambda s: taken(x, s)), ""))[0]


def turn_events(rows: DataFrame) -> DataFrame:
    """Stored turns (``conv_id, turn, role, text``) as the log that streaming them would leave.

    A turn's first half comes with its message, the rest as a delta. Turns are told
    apart by where they stand in the input, so repeated rows stay repeated.
    """
    # Places are taken before a row becomes two events, so both carry the same one.
    turns = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), common.text_of("text").alias("text"),
                        F.monotonically_increasing_id().alias("row"))
    half = F.floor(F.length("text") / 2).cast("int")
    event = lambda step, kind, part: F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), part.alias("part"))
    log = turns.withColumn("e", F.explode(F.array(
        event(0, "message", F.substring("text", 1, half)),
        event(1, "delta", F.substring("text", half + 1, F.length("text"))))))
    # The key orders turns of one place by role and text, and does not carry long texts.
    key = F.struct("role", F.substring("text", 1, 64).alias("begin"), F.md5("text").alias("text"), "row")
    return log.select("conv_id", key.alias("msg"), F.struct("turn", "e.step").alias("seq"),
                      "e.kind", "role", F.col("e.part").alias("text"))
