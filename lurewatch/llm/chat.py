"""Conversations rebuilt from event logs and rendered with turn marks and a loss mask."""

import re
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import functions as F

# The marks of the template.
BEGIN, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
KINDS = ("message", "delta", "edit", "regenerate")

SEGMENTS = "conv_id {kind}, turn_no bigint, formatted string, loss_start bigint, loss_end bigint"
DIGESTS = ("conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
           "formatted_chars bigint")

_mark = re.compile(r"<(\\*)\|")
_escaped = re.compile(r"<\\(\\*)\|")
_segment = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text):
    """No mark of the template can stand in the result: one backslash more between "<" and "|"."""
    return _mark.sub(r"<\1\\|", text)


def unescape(text):
    return _escaped.sub(r"<\1|", text)


def escape_role(role):
    """A role on a line of its own: escaped like a text, and backslashes and line ends written out."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role):
    plain = unescape(role)
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], plain)


def render(role, text):
    """(segment, start and end of the loss mask in it) of one message; only texts of ``LEARNED`` are learned."""
    head = f"{BEGIN}{escape_role(role)}\n"
    body = escape(text)
    start = len(head)
    return f"{head}{body}{END}\n", start, start + (len(body) if role == LEARNED else 0)


class Fold:
    """The message that the events of one turn have built so far.

    A message begins a new one; a delta adds to its text; an edit replaces it; a regeneration empties it.
    A delta, edit or regeneration without a message before it begins one.
    """

    def __init__(self):
        self.turn = self.role = self.parts = None

    def take(self, turn, kind, role, text):
        """The message finished by this event, or None."""
        done = None
        if self.parts is not None and (turn != self.turn or kind == "message"):
            done = self.close()
        if self.parts is None:
            self.turn, self.role, self.parts = turn, role, [text]
        elif kind == "delta":
            self.parts.append(text)
        else:
            self.parts = [text]
        return done

    def close(self):
        if self.parts is None:
            return None
        done = self.role, "".join(self.parts)
        self.parts = None
        return done


def _renderer(kind):
    schema = pa.schema([("conv_id", kind), ("turn_no", pa.int64()), ("formatted", pa.string()),
                        ("loss_start", pa.int64()), ("loss_end", pa.int64())])

    def run(batches):
        conversation, started, number, fold = None, False, 0, Fold()
        for batch in batches:
            out = []

            def emit(done):
                nonlocal number
                if done is not None:
                    out.append((conversation, number, *render(*done)))
                    number += 1

            for conv, turn, what, role, text in zip(*(batch.column(n).to_pylist() for n in
                                                      ("conv_id", "turn", "kind", "role", "text"))):
                if not started or conv != conversation:
                    emit(fold.close())
                    conversation, started, number = conv, True, 0
                emit(fold.take(turn, what, role or "", "" if what == "regenerate" else text or ""))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * 5, schema)],
                                             schema=schema)
        if (done := fold.close()) is not None:
            last = (conversation, number, *render(*done))
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(last, schema)], schema=schema)

    return run


def format_events(events):
    """Rendered messages (conv_id, turn_no, formatted, loss_start, loss_end) from an event log.

    ``events``: conv_id, turn, seq, kind (one of ``KINDS``; null is "message"), role, text. Events are dealt by
    conversation and sorted by turn and sequence, ties by role and text; each turn is folded into messages as
    ``Fold`` tells. Null texts and roles are empty; null turns come first; a null conv_id is one conversation.
    Repeated rows are messages of their own. No events, no rows. Other columns are not looked at.

    Rows stream through in order, and a task holds one message, never a conversation, however long that is.
    The rows of a conversation stay in order in one partition, so what reads them next can stream as well.
    """
    kind = events.schema["conv_id"].dataType.simpleString()
    rows = events.select("conv_id", "turn", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), "role", "text")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq", "role", "text")
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    return ordered.mapInArrow(_renderer(arrow), SEGMENTS.format(kind=kind))


def message_events(conversations):
    """The event log of a table of finished messages (conv_id, turn, role, text)."""
    return conversations.select("conv_id", "turn", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def join_segments(segments):
    """(conv_id, formatted, loss_spans): whole conversations, for those that fit into a row of their own."""
    rows = segments.groupBy("conv_id").agg(F.array_sort(F.collect_list(
        F.struct("turn_no", "formatted", "loss_start", "loss_end"))).alias("s"))
    before = F.transform("s", lambda x, i: F.aggregate(
        F.slice("s", F.lit(1), i), F.lit(0).cast("bigint"), lambda n, y: n + F.length(y["formatted"])))
    spans = F.zip_with("s", before, lambda x, b: F.struct(
        (x["loss_start"] + b).alias("start"), (x["loss_end"] + b).alias("end")))
    return rows.select("conv_id", F.array_join(F.transform("s", lambda x: x["formatted"]), "").alias("formatted"),
                       F.filter(spans, lambda x: x["start"] < x["end"]).alias("loss_spans"))


def _reader(kind):
    schema = pa.schema([("conv_id", kind), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        now, state = None, None

        def close():
            turns, loss, n, learned, chars = state
            return (now, n, turns.hexdigest(), learned, loss.hexdigest(), chars)

        for batch in batches:
            out = []
            for conv, text, start, end in zip(*(batch.column(c).to_pylist() for c in
                                                ("conv_id", "formatted", "loss_start", "loss_end"))):
                if state is None or conv != now:
                    if state is not None:
                        out.append(close())
                    now, state = conv, [sha256(), sha256(), 0, 0, 0]
                for found in _segment.finditer(text):
                    role, body = unescape_role(found[1]), unescape(found[2])
                    state[0].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                    state[2] += 1
                learned = unescape(text[start:end])
                state[1].update(learned.encode("utf-8", "surrogatepass"))
                state[3] += len(learned)
                state[4] += len(text)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * 6, schema)],
                                             schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(close(), schema)], schema=schema)

    return run


def read_back(segments):
    """One row per conversation, parsed from the rendered messages: (conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars). ``segments`` must come from ``format_events``, whose order it relies on."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    return segments.mapInArrow(_reader(arrow), DIGESTS.format(kind=kind))
