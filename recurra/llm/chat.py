"""Chat formatting by event-sourced reconstruction (operator 5).

Input is a log of events (conv_id, msg, seq, kind, role, payload). A message
is folded from its own events in sequence order: ``open`` names the role,
``delta`` appends streamed text, ``edit`` replaces the text, ``regen`` drops it
and starts a new stream. What counts is the last ``edit`` or ``regen`` and the
deltas after it. The messages of a conversation are rendered in order.

Template, per turn: ``### <role>`` NEWLINE ``<text></turn>`` NEWLINE. In texts
and roles a backslash goes before every backslash, ``#`` and ``<`` (in roles
before a newline too), so no control string can occur inside and reading back
is exact. The loss mask covers the text of assistant turns.

Folding and rendering work per message, so they spread over all tasks however
long one conversation is. Only reading back in order is sequential in a
conversation (a digest of all its turns is), and it streams: one batch of
turns at a time, with a constant state.

Defined cases: null text or payload is empty; a null role is empty; equal rows
each are a turn; rows with the same turn number are ordered by role, then
text; null turns come first; a null conv_id is one conversation; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurra.llm.common import shuffle_partitions

TURN = re.compile(r"### ([^\\\n]*(?:\\.[^\\\n]*)*)\n([^\\<#]*(?:\\.[^\\<#]*)*)</turn>\n", re.S)
UNESCAPE = re.compile(r"\\(.)", re.S)
CHUNK = 64


def events_of(conversations: DataFrame) -> DataFrame:
    """The log that leads to ``conversations``.

    An assistant turn is opened, streamed in part, regenerated and streamed
    again in pieces of CHUNK characters; any other turn is typed in part, edited to its
    first half and continued. Equal rows become one message with a count.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("msg", F.struct("turn", "role", F.sha2(F.col("text").cast("binary"), 256).alias("key")))
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))  # one pass, however long the text
    half = F.floor(F.length("text") / 2).cast("int")

    def event(kind, payload):
        return F.struct(F.lit(kind).alias("kind"), payload.alias("payload"))

    start = [event("open", F.lit("")), event("delta", F.substring("text", 1, 16)), event("delta", F.lit(" ..."))]
    streamed = F.concat(F.array(*start, event("regen", F.lit(""))), F.transform(pieces, lambda p: event("delta", p)))
    typed = F.array(*start, event("edit", F.substring(F.col("text"), F.lit(1), half)),
                    event("delta", F.substring(F.col("text"), half + 1, F.length("text"))))
    return rows.select("conv_id", "msg", "role", "copies", F.posexplode(
        F.when(F.col("role") == "assistant", streamed).otherwise(typed)).alias("seq", "e")).select(
        "conv_id", "msg", "seq", "e.kind", "role", "copies", "e.payload")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, msg, role, copies, text): the final messages. One message's events are one group."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "kind", F.coalesce("payload", F.lit("")).alias("payload"))))
    groups = events.groupBy("conv_id", "msg").agg(
        ordered.alias("log"), F.max("role").alias("role"), F.max("copies").alias("copies"),
        F.max(F.when(F.col("kind").isin("edit", "regen", "open"), F.col("seq"))).alias("since"))
    kept = F.filter("log", lambda e: e["seq"] >= F.coalesce(F.col("since"), e["seq"]))
    return groups.select("conv_id", "msg", "role", "copies",
                         F.array_join(F.transform(kept, lambda e: e["payload"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, msg, copies, segment, body_from, loss_from, loss_to): the rendered turn, places in code points."""
    text = F.regexp_replace(F.col("text"), r"([\\#<])", r"\\$1")
    role = F.regexp_replace(F.col("role"), r"([\\#<\n])", r"\\$1")
    head = F.concat(F.lit("### "), role, F.lit("\n"))
    rows = messages.select("conv_id", "msg", "copies", "role", head.alias("head"), text.alias("body"))
    is_loss = F.col("role") == "assistant"
    return rows.select(
        "conv_id", "msg", "copies", F.concat("head", "body", F.lit("</turn>\n")).alias("segment"),
        F.length("head").alias("body_from"), F.when(is_loss, F.length("head")).alias("loss_from"),
        F.when(is_loss, F.length("head") + F.length("body")).alias("loss_to"))


def parse(segment: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    m = TURN.fullmatch(segment)
    return UNESCAPE.sub(r"\1", m[1]), UNESCAPE.sub(r"\1", m[2])


def ordered_segments(rendered: DataFrame) -> DataFrame:
    """All turns of a conversation in one partition, in order: the sink's and the reader's layout."""
    n = shuffle_partitions(rendered)
    keyed = rendered.withColumn("turn", F.col("msg.turn")).withColumn("who", F.col("msg.role"))
    # Turns of one number and role go by their text as it is, not as it is escaped.
    body = F.substring(F.col("segment"), F.col("body_from") + 1, F.length("segment") - F.col("body_from") - len("</turn>\n"))
    return keyed.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "who", F.regexp_replace(body, r"(?s)\\(.)", "$1"))


def digests(rendered: DataFrame) -> DataFrame:
    """What reading the rendered turns back gives, per conversation."""

    def run(batches):
        conv, state = None, None

        def row():
            n, turns, chars, loss, total = state
            return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), total)

        for b in batches:
            out = []
            for c, copies, seg, lo, hi in zip(*(b.column(x).to_pylist() for x in ("conv_id", "copies", "segment", "loss_from", "loss_to"))):
                if state is None or c != conv:
                    if state is not None:
                        out.append(row())
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse(seg)
                line = f"{role}\n{text}\n".encode("utf-8", "surrogatepass")
                masked = UNESCAPE.sub(r"\1", seg[lo:hi]) if lo is not None else ""
                coded = masked.encode("utf-8", "surrogatepass")
                for _ in range(copies):
                    state[0] += 1
                    state[1].update(line)
                    state[2] += len(masked)
                    state[3].update(coded)
                    state[4] += len(seg)
            if out:
                yield batch(out)
        if state is not None:
            yield batch([row()])

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)

    return ordered_segments(rendered).select("conv_id", "copies", "segment", "loss_from", "loss_to").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_conversations(events: DataFrame) -> DataFrame:
    """Rendered turns of an event log."""
    return render(fold(events))
