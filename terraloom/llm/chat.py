"""Conversations rebuilt from their event logs and rendered for training.

``fold`` turns logged events into final messages, ``render`` into marked-up turns
with a loss mask over assistants' texts, and ``read_back`` parses rendered turns into
digests.  A conversation's events are combined by message, and its turns stay rows of
their own, so even a conversation with a large part of all rows is never held whole:
``read_back`` sorts each conversation by sequence and runs through it row by row.

A turn is ``<|im_start|>`` role, a line break, text, ``<|im_end|>`` and a line break.
Where a role or text holds what could be read as a control string, of this or other
common templates, a backslash goes after its first character (one more, if there are
some already), and reading takes it out again.  Backslashes and line breaks in roles
are escaped too.

Null roles and texts are empty.  Equal sequence numbers are ordered by role and text,
null ones come first, repeated rows are turns of their own, and rows without a
conversation form one.  Very long texts are read whole, one turn at a time.  An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: What follows the first character of a control string.
_REST = r"(?=\||/?s>|/?INST\]|</?SYS>>)"
ESCAPE, UNESCAPE = rf"([<\[])(\\*){_REST}", re.compile(rf"([<\[])\\(\\*){_REST}")
TRAINED = "assistant"
#: Events that set a message's text.
SETS = ("message", "edit", "regenerate")
#: Stands for a turn without a number in a log: before all others.
NO_TURN = -(2**59)
PARSED = "conv_id long, seq long, turn string, start long, trained string, loss long, chars long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def fold(events: DataFrame) -> DataFrame:
    """conv_id, seq, role, text of the final messages.

    events: conv_id, seq, event, message_id, role, text.  An event without a message
    id is a whole message, and one without an event is a delta.  Events of one sequence
    number come in order of name, then of text.  A task holds one message's events.  Of the others, ``message`` and ``edit`` set a message's
    text, ``regenerate`` sets it to its own, mostly empty, for what follows, ``delta`` appends to it, and
    ``delete`` takes it away until it is set again.  A message stands where its first
    event does and has the first role named.
    """
    c = F.col
    whole = events.where("message_id IS NULL").select("conv_id", "seq", "role", "text")
    step = F.struct("seq", F.coalesce("event", F.lit("delta")).alias("event"), F.coalesce("text", F.lit("")).alias("text"))
    named = F.when(c("role").isNotNull(), F.struct("seq", "role"))
    parts = events.where("message_id IS NOT NULL").groupBy("conv_id", "message_id").agg(F.min("seq").alias("seq"), F.min(named)["role"].alias("role"), F.sort_array(F.collect_list(step)).alias("steps"))

    def last(*kinds: str) -> Column:
        """Place (from 0) of the last event of these kinds; -1 if there is none."""
        return F.coalesce(F.array_max(F.transform("steps", lambda e, i: F.when(e["event"].isin(*kinds), i))), F.lit(-1))

    # the text is that of the last event that sets it and of the deltas after it, put together once
    parts = parts.withColumns({"set_at": last(*SETS), "gone_at": last("delete")}).where("gone_at <= set_at OR gone_at < 0")
    left = F.filter(F.slice("steps", F.greatest(c("set_at") + 1, F.lit(1)), F.size("steps")), lambda e: e["event"].isin(*SETS, "delta"))
    return whole.unionByName(parts.select("conv_id", "seq", "role", F.array_join(F.transform(left, lambda e: e["text"]), "").alias("text")))


def log(turns: DataFrame) -> DataFrame:
    """An event log of turns (conv_id, turn, role, text), as a chat service keeps one: each
    message is opened, streamed, edited, and regenerated from two deltas.  ``fold`` gives
    the turns again."""
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    steps = [("message", F.col("role"), F.lit("")), ("delta", None, F.substring(text, F.lit(1), half)), ("edit", None, F.lit("a draft")), ("delta", None, F.lit(" that goes on")), ("regenerate", None, F.lit("")), ("delta", None, F.substring(text, F.lit(1), half)), ("delta", None, F.substring(text, half + 1, F.length(text)))]
    null = F.lit(None).cast("string")
    array = F.array(*(F.struct(F.lit(i).alias("step"), F.lit(e).alias("event"), (null if r is None else r).alias("role"), t.alias("text")) for i, (e, r, t) in enumerate(steps)))
    numbered = turns.withColumn("message_id", F.monotonically_increasing_id().cast("string"))
    rows = numbered.select("conv_id", "turn", "message_id", F.explode(array).alias("e"))
    seq = F.coalesce(F.col("turn").cast("long"), F.lit(NO_TURN)) * len(steps) + F.col("e.step")
    return rows.select("conv_id", seq.alias("seq"), "e.event", "message_id", "e.role", "e.text")


def render(messages: DataFrame) -> DataFrame:
    """conv_id, seq, formatted, and the loss mask within it: loss_from, loss_to (code
    points; equal where nothing is trained)."""
    escape = lambda x: F.regexp_replace(x, ESCAPE, r"$1\\$2")
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(START), escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))), F.lit("\n"))
    text = escape(F.coalesce("text", F.lit("")))
    start = F.length(head).cast("long")
    return messages.select("conv_id", "seq", F.concat(head, text, F.lit(END)).alias("formatted"), start.alias("loss_from"), F.when(role == TRAINED, start + F.length(text)).otherwise(start).alias("loss_to"))


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2", text)


def parse(formatted: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    if not (formatted.startswith(START) and formatted.endswith(END)):
        raise ValueError(f"not a turn: {formatted[:60]!r}")
    head, _, text = formatted[len(START) : -len(END)].partition("\n")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(head))
    return role, unescape(text)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each rendered turn: role and text as they are hashed, where the text starts
    (bytes), what is trained (null if it is the text), and sizes."""
    names = [x.split()[0] for x in PARSED.split(", ")]
    for batch in batches:
        rows = []
        for formatted, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("formatted", "loss_from", "loss_to"))):
            role, text = parse(formatted)
            trained = unescape(formatted[lo:hi])
            rows.append((f"{role}\n{text}\n", len(role.encode()) + 1, None if trained == text else trained, len(trained), len(formatted)))
        turn, start, trained, loss, chars = zip(*rows) if rows else [()] * 5
        columns = [pa.array(turn, pa.string()), pa.array(start, pa.int64()), pa.array(trained, pa.string()), pa.array(loss, pa.int64()), pa.array(chars, pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("seq"), *columns], names)


def read_back(rendered: DataFrame) -> DataFrame:
    """DIGESTS of each conversation, from the rendered turns alone.

    Turns are parsed where they are; only the hashing runs through a conversation in
    order, as it must."""
    names = [x.split()[0] for x in DIGESTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done = None, []

        def close() -> None:
            if state is not None:
                done.append((state["id"], state["n"], state["turns"].hexdigest(), state["loss"], state["text"].hexdigest(), state["chars"]))

        for batch in batches:
            for conv, turn, start, trained, loss, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "start", "trained", "loss", "chars"))):
                if state is None or state["id"] != conv:
                    close()
                    state = {"id": conv, "n": 0, "loss": 0, "chars": 0, "turns": hashlib.sha256(), "text": hashlib.sha256()}
                data = turn.encode()
                state["turns"].update(data)
                state["text"].update(memoryview(data)[start:-1] if trained is None else trained.encode())
                state["loss"] += loss
                state["n"] += 1
                state["chars"] += chars
            if len(done) > 4096:
                ids, *rest = zip(*done)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, rest)], names)
                done = []
        close()
        if done:
            ids, *rest = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, rest)], names)

    turns = rendered.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("seq").cast("long").alias("seq"), "formatted", "loss_from", "loss_to").mapInArrow(_parsed, PARSED)
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "turn").drop("seq").mapInArrow(run, DIGESTS)
