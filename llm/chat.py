"""Chat formatting from an event log (operator 8).

The log holds events of messages.  Events of one message are folded in sequence: ``open`` starts it,
``delta`` appends, ``edit`` replaces what is there, ``regenerate`` throws it away and starts again.
Messages are then rendered in order, in parts of bounded length that are formatted apart from each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TURN, END = "<|im_start|>", "<|im_end|>"
#: Strings that steer a chat model, escaped inside texts.
CONTROL = (TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
TURNS_PER_PART = 256
EVENTS = "conv_id long, msg struct<turn:long,copy:long>, seq struct<turn:long,copy:long,step:long>, kind string, role string, text string"


def escape(text: Column) -> Column:
    """Double backslashes, and put one after the first character of every control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    """Undo :func:`escape`: a backslash goes, what follows it stays."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\␊"))


def _unescape_role(role: Column) -> Column:
    pieces = F.regexp_extract_all(role, F.lit(r"(?s)(\\.|[^\\])"), F.lit(1))
    plain = F.transform(pieces, lambda p: F.when(p == "\\␊", F.lit("\n")).when(p.startswith("\\"), F.substring(p, 2, 1)).otherwise(p))
    return F.array_join(plain, "")


def events_of_rows(rows: DataFrame, chunk: int = 120) -> DataFrame:
    """A streamed log of finished turns (conv_id, turn, role, text): one ``open``, then deltas of ``chunk`` characters.

    Rows with the same turn are messages of their own, in order of role and text; null counts as empty.
    """
    from pyspark.sql import Window

    rows = rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = rows.withColumn("copy", F.row_number().over(same).cast("long"))
    deltas = F.concat(F.array(F.lit("")), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)))
    return rows.select("conv_id", "turn", "copy", "role", F.posexplode(deltas).alias("step", "piece")).select(
        "conv_id", F.struct("turn", "copy").alias("msg"),
        F.struct("turn", "copy", F.col("step").cast("long").alias("step")).alias("seq"),
        F.when(F.col("step") == 0, "open").otherwise("delta").alias("kind"), "role", F.col("piece").alias("text"),
    )


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, msg, role, text.

    ``seq`` orders the events and ``msg`` the messages (any sortable types).  The role is that of the first
    event.  An event that is not a ``delta`` starts the text again with its own.  A message whose events
    are all deltas is their concatenation.  Null text counts as empty; equal events at one place all count.
    """
    log = events.groupBy("conv_id", "msg").agg(
        F.min_by("role", "seq").alias("role"),
        F.max(F.when(F.col("kind") != "delta", F.col("seq"))).alias("_from"),
        F.sort_array(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))).alias("_log"),
    )
    alive = F.filter("_log", lambda e: F.col("_from").isNull() | (e["seq"] >= F.col("_from")))
    return log.select("conv_id", "msg", "role", F.array_join(F.transform(alive, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame, place: Column, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Formatted parts: conv_id, part, formatted, loss (array of start and end in code points).

    ``place`` is the message's number in its conversation; ``TURNS_PER_PART`` numbers share a part, so a
    very long conversation is rendered by many tasks.  The loss mask covers the texts of ``trained`` roles.
    """
    head = F.concat(F.lit(TURN), _escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    turns = messages.select(
        "conv_id", F.floor(place / TURNS_PER_PART).alias("part"), "msg", head.alias("head"), escape(F.col("text")).alias("body"),
        F.coalesce(F.col("role").isin(*trained), F.lit(False)).alias("trained"),
    )
    turns = turns.select(
        "conv_id", "part", "msg", "trained", F.concat("head", "body", F.lit(END + "\n")).alias("turn"),
        F.length("head").alias("lead"), F.length("body").alias("long"),
    )
    parts = turns.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("msg", "turn", "lead", "long", "trained"))).alias("t"))
    zero = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + t["lead"]
        span = F.struct(begin.alias("start"), (begin + t["long"]).alias("end"))
        spans = F.when(t["trained"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + F.length(t["turn"])).alias("at"), spans.alias("spans"))

    return parts.select(
        "conv_id", "part", F.array_join(F.transform("t", lambda t: t["turn"]), "").alias("formatted"),
        F.aggregate("t", zero, step)["spans"].alias("loss"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """What a formatted part says: conv_id, part, turns (array of role, text), loss_text, formatted_chars."""
    pieces = F.slice(F.split("formatted", F.lit(r"\Q" + TURN + r"\E")), 2, F.lit(1 << 30))
    tail = len(END) + 1

    def turn(p: Column) -> Column:
        cut = F.instr(p, "\n")
        return F.struct(
            _unescape_role(F.substr(p, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substr(p, cut + 1, F.length(p) - cut - tail)).alias("text"),
        )

    spans = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return rendered.select(
        "conv_id", "part", F.transform(pieces, turn).alias("turns"), F.array_join(spans, "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def digests(back: DataFrame) -> DataFrame:
    """Counts and digests per conversation.  A digest needs a conversation's text in order, so its parts meet here."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = back.select("conv_id", F.struct("part", said.alias("said"), "loss_text").alias("p"), F.size("turns").cast("long").alias("n"), "formatted_chars")
    whole = parts.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"), F.sort_array(F.collect_list("p")).alias("p")
    )
    loss = F.array_join(F.transform("p", lambda p: p["loss_text"]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.transform("p", lambda p: p["said"]), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )
