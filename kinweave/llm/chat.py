"""Chat formatting by prefix-target expansion.

Every assistant turn of a conversation becomes an example of its own: all turns
before it, formatted, are the prompt, and its own formatted text is the
completion, of which only the reply is trainable.  A turn is written as

    ### Role: text</turn>

and a line end.  Inside texts and roles a backslash, the turn mark ``###``, the
end mark ``</turn>`` and (in roles) a colon are escaped, so nothing that a user
writes can end a turn or begin one, and parsing gives back what was written.

Turns after the last assistant turn have no target; they become one example
whose completion is null, so that no turn is lost.

Rows are read in the order of their turn (null first), then role, then text; a
null text or role is the empty text.  Rows with a null conversation id form one
conversation.  Equal rows are turns of their own.  Other columns are ignored, also those that
bear the name of a result's column.

A conversation is read as a stream and never held as a group: memory holds its
prompt, which is one value of the result anyway.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The template's marks, fixed values.
_TURN, _END, _LINE = "###", "</turn>", "\n"
TARGET_ROLE = "assistant"
_SHOWN = {"user": "User", "assistant": "Assistant", "system": "System"}
_MEANT = {v: k for k, v in _SHOWN.items()}
_ESCAPED = {"\\\\": "\\", "\\t": _TURN, "\\e": _END, "\\c": ":"}
_PARSED = re.compile(r"### (.*?): (.*?)</turn>\n", re.DOTALL)
_SEQUENCE = re.compile(r"\\[\\tec]")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace(_TURN, "\\t").replace(_END, "\\e")


def unescape(text: str) -> str:
    return _SEQUENCE.sub(lambda m: _ESCAPED[m[0]], text)


def _header(role: str) -> str:
    # a role that is spelt like another's shown name is marked
    shown = _SHOWN.get(role) or ("\\r" + role if role in _MEANT else escape(role).replace(":", "\\c"))
    return f"{_TURN} {shown}: "


def _role(shown: str) -> str:
    if shown in _MEANT:
        return _MEANT[shown]
    return shown[2:] if shown.startswith("\\r") else unescape(shown)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text begins and ends in it."""
    head, body = _header(role), escape(text)
    return f"{head}{body}{_END}{_LINE}", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    turns, at = [], 0
    for m in _PARSED.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"not a turn at {at}")
        turns.append((_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not a turn at {at}")
    return turns


EXAMPLE = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("example", T.LongType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("completion", T.StringType()),
        T.StructField("loss_start", T.LongType()),
        T.StructField("loss_end", T.LongType()),
    ]
)


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def _batched(rows: Iterator[tuple], schema: T.StructType, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Record batches of some megabytes."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    held, size = [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size >= most:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def _expand(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Examples of conversations that come turn by turn, each conversation's turns together."""
    nothing = object()
    current, parts, n, waiting = nothing, [], 0, 0
    for conv, role, text in rows:
        if current is nothing or conv != current:
            if waiting:
                yield current, n, "".join(parts), None, None, None
            current, parts, n, waiting = conv, [], 0, 0
        turn, a, z = format_turn(role or "", text or "")
        if role == TARGET_ROLE:
            prompt = "".join(parts)
            yield current, n, prompt, turn, a, z
            parts, n, waiting = [prompt, turn], n + 1, 0
        else:
            parts.append(turn)
            waiting += 1
    if waiting:
        yield current, n, "".join(parts), None, None, None


def expand(turns: DataFrame) -> DataFrame:
    """Examples of ``turns`` (conv_id, turn, role, text).

    Rows: conv_id, example (from 0), prompt, completion, and loss_start and
    loss_end, the code points of the completion that are trainable.  The rows
    of a conversation lie together and in order within a partition.
    """
    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    id_type = turns.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", id_type), *EXAMPLE.fields[1:]])
    return rows.mapInArrow(lambda batches: _batched(_expand(_rows(batches, "conv_id", "role", "text")), schema), schema)


def read_back(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation say: digests of its turns and of its trainable text.

    ``examples`` must come from ``expand`` without a shuffle in between.
    """
    schema = T.StructType(
        [
            examples.schema["conv_id"],
            T.StructField("n_turns", T.LongType()),
            T.StructField("turns_sha256", T.StringType()),
            T.StructField("loss_chars", T.LongType()),
            T.StructField("loss_sha256", T.StringType()),
            T.StructField("formatted_chars", T.LongType()),
            T.StructField("n_examples", T.LongType()),
        ]
    )

    def summed(rows: Iterator[tuple]) -> Iterator[tuple]:
        nothing = object()
        current = nothing
        for conv, prompt, completion, a, z in rows:
            if current is nothing or conv != current:
                if current is not nothing:
                    yield (current, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars, examples_n)
                current, n, loss_n, chars, examples_n, read = conv, 0, 0, 0, 0, 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            # the prompt goes on from the examples before: only what it adds is parsed
            for role, text in parse(prompt[read:]) + (parse(completion) if completion is not None else []):
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                n += 1
            if completion is not None:
                reply = unescape(completion[a:z])
                loss.update(reply.encode("utf-8", "surrogatepass"))
                loss_n += len(reply)
            read = len(prompt) + len(completion or "")
            chars += read
            examples_n += 1
        if current is not nothing:
            yield (current, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars, examples_n)

    return examples.mapInArrow(lambda batches: _batched(summed(_rows(batches, "conv_id", "prompt", "completion", "loss_start", "loss_end")), schema), schema)
