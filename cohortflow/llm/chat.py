"""Chat formatting: a role automaton checks turn order, a template yields segments with loss flags."""

from __future__ import annotations

import dataclasses
import hashlib
import re

from pyspark.sql import DataFrame, functions as F, types as T


@dataclasses.dataclass(frozen=True)
class Template:
    """Declarative format of a turn and the order of roles.

    A turn is ``start role newline text end newline``. ``moves`` maps a state to the state
    that each allowed role leads to; ``final`` has the states a chat may end in. The text
    of ``trained`` roles is under the loss, marks never are.
    """
    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    trained: tuple[str, ...] = ("assistant",)
    moves: dict[str, dict[str, str]] = dataclasses.field(default_factory=lambda: {
        "begin": {"system": "told", "user": "asked"},
        "told": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })
    first: str = "begin"
    final: tuple[str, ...] = ("answered",)


#: Every control string begins with this pair, which escaping keeps out of texts.
_OPEN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No ``<|`` is left in the result; ``unescape`` gives the text back exactly."""
    return _OPEN.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "<" in text else text


def escape_role(role: str) -> str:
    """Roles are one line in the output: line ends and backslashes are escaped too."""
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


SEGMENTS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("part", T.LongType()), T.StructField("turn_no", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("loss", T.BooleanType()),
    T.StructField("allowed", T.BooleanType()), T.StructField("ends_well", T.BooleanType())])


def _arrow_schema(fields):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "string": pa.string(), "bool": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in fields])


def _segments(template: Template):
    """Three segments a turn: opening mark, text, closing mark. Holds one turn at a time."""
    schema = [("conv_id", "long"), ("part", "long"), ("turn_no", "long"), ("role", "string"), ("text", "string"),
              ("loss", "bool"), ("allowed", "bool"), ("ends_well", "bool")]

    def run(batches):
        import pyarrow as pa

        conv, state, part, turn = object(), None, 0, 0
        for batch in batches:
            columns = [[] for _ in schema]
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if c != conv:
                    conv, state, part, turn = c, template.first, 0, 0
                role, text = role or "", text or ""
                state = template.moves.get(state, {}).get(role) if state else None
                allowed, ends = state is not None, state in template.final
                for body, loss in ((f"{template.start}{escape_role(role)}\n", False),
                                   (escape(text), role in template.trained), (f"{template.end}\n", False)):
                    for column, value in zip(columns, (c, part, turn, role, body, loss, allowed, ends), strict=True):
                        column.append(value)
                    part += 1
                turn += 1
                if len(columns[0]) >= 3000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(columns, _arrow_schema(schema))],
                                                     schema=_arrow_schema(schema))
                    columns = [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(columns, _arrow_schema(schema))],
                                             schema=_arrow_schema(schema))
    return run


def format_chats(turns: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """Segments (SEGMENTS) of every conversation, in order within their partition.

    The texts of a conversation's segments, joined by ``part``, are its formatted form;
    ``loss`` marks what is trained on. ``allowed`` tells whether the turn order was valid up
    to this turn and ``ends_well`` whether a chat may end here; invalid chats are formatted
    too. Turns of equal number are ordered by role and text. Null roles and texts count as
    empty, a null turn comes first, rows with a null conversation form one conversation.

    A conversation is one stream of rows, sorted (and spilled) by Spark; the automaton keeps
    one state and one turn, however long the conversation is.
    """
    rows = turns.select(F.col(conv).cast("long").alias("c"), F.col(turn).alias("t"), F.col(role).alias("r"),
                        F.col(text).alias("x"))
    streams = rows.repartition("c").sortWithinPartitions("c", "t", "r", "x").select("c", "r", "x")
    return streams.mapInArrow(_segments(template or Template()), SEGMENTS)


DIGESTS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()),
    T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
    T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
    T.StructField("valid", T.BooleanType())])


def _digests(template: Template):
    """Parse the formatted stream back into turns; only the text, ``loss`` and validity are read."""
    schema = [("conv_id", "long"), ("n_turns", "long"), ("turns_sha256", "string"), ("loss_chars", "long"),
              ("loss_sha256", "string"), ("formatted_chars", "long"), ("valid", "bool")]
    close = f"{template.end}\n"

    def run(batches):
        import pyarrow as pa

        conv, now, rows = object(), None, []
        for batch in batches:
            for c, text, loss, allowed, ends in zip(*(batch.column(i).to_pylist() for i in (0, 4, 5, 6, 7)), strict=True):
                if now is None or c != conv:
                    if now:
                        rows.append((conv, now))
                    conv = c
                    now = {"n": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "l": 0, "chars": 0, "open": "", "ok": True}
                now["chars"] += len(text)
                now["open"] += text
                now["ok"] = allowed and ends
                if loss:
                    plain = unescape(text)
                    now["loss"].update(plain.encode())
                    now["l"] += len(plain)
                while (cut := now["open"].find(close)) >= 0:
                    turn, now["open"] = now["open"][:cut], now["open"][cut + len(close):]
                    head, _, body = turn.removeprefix(template.start).partition("\n")
                    now["n"] += 1
                    now["all"].update(f"{unescape_role(head)}\n{unescape(body)}\n".encode())
            if len(rows) >= 1000:
                yield batch_of(rows, schema)
                rows = []
        if now:
            rows.append((conv, now))
        yield batch_of(rows, schema)

    def batch_of(rows, fields):
        import pyarrow as pa

        values = [(c, x["n"], x["all"].hexdigest(), x["l"], x["loss"].hexdigest(), x["chars"], x["ok"]) for c, x in rows]
        s = _arrow_schema(fields)
        return pa.RecordBatch.from_arrays([pa.array([v[i] for v in values], s.field(i).type) for i in range(len(s))], schema=s)
    return run


def chat_digests(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests (DIGESTS) of the turns and of the trained text, read back from ``format_chats``."""
    return segments.mapInArrow(_digests(template or Template()), DIGESTS)
