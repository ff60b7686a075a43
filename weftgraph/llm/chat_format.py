"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and
only that reply under the loss mask. A conversation that doesn't end with an assistant's
turn also gives one record of all its turns with nothing to train, so that every turn
can be read back from the output.

Template, for each turn: ``<|im_start|>role``, a line feed, the text, ``<|im_end|>``, a
line feed. Texts and roles can't forge it: where ``<``, any number of backslashes and
``|`` follow each other, one more backslash is put in, which is taken out on reading. In
roles a backslash and a line feed are escaped too.

Turns are dealt by conversation and sorted; a task streams them and holds no more than
the conversation at hand, which its longest example holds anyway.

Defined cases: a null text or role is empty. Rows with a null conversation belong to
none and give nothing. Turns with equal numbers are ordered by role, then text; null
turn numbers come first. A repeated row is a further turn. An empty table gives no rows.
Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, TRAINED = "<|im_start|>", "<|im_end|>", "assistant"
_FORGED, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_RECORD = "conv_id {}, example int, text string, loss_start int, loss_end int, last boolean"
_DIGEST = "conv_id {}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _FORGED.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text stands in it."""
    head, body = f"{START}{_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted record."""
    return [(_unrole(a), unescape(b)) for a, b in _TURN.findall(formatted)]


class _Rows:
    """Records to batches of a bounded size."""

    def __init__(self, kinds: list[pa.DataType], names: list[str]):
        self.kinds, self.names, self.rows, self.chars = kinds, names, [], 0

    def add(self, row: tuple, chars: int) -> bool:
        self.rows.append(row)
        self.chars += chars
        return len(self.rows) >= 10_000 or self.chars > 1 << 24

    def take(self) -> pa.RecordBatch:
        columns = [pa.array(x, kind) for x, kind in zip(zip(*self.rows, strict=True), self.kinds, strict=True)]
        self.rows, self.chars = [], 0
        return pa.RecordBatch.from_arrays(columns, names=self.names)


def _expanded(kind: pa.DataType):
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows([kind, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_()], ["conv_id", "example", "text", "loss_start", "loss_end", "last"])
        own, prefix, size, n, held, trained = None, [], 0, 0, None, False

        def ended() -> Iterator[tuple]:
            if held:
                yield (*held, True)
            if prefix and not trained:  # the last turns are in no example
                yield own, n, "".join(prefix), 0, 0, True

        for batch in batches:
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if conv != own:
                    for row in ended():
                        if out.add(row, len(row[2])):
                            yield out.take()
                    own, prefix, size, n, held, trained = conv, [], 0, 0, None, False
                if held:  # an example is passed on when the next turn shows whether it was the last
                    if out.add((*held, False), len(held[2])):
                        yield out.take()
                    held = None
                turn, a, b = render(role, text)
                prefix.append(turn)
                trained = role == TRAINED
                if trained:
                    held = (own, n, "".join(prefix), size + a, size + b)
                    prefix = [held[2]]
                    n += 1
                size += len(turn)
        for row in ended():
            if out.add(row, len(row[2])):
                yield out.take()
        if out.rows:
            yield out.take()

    return expand


def examples(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, example (from 0), text, loss_start, loss_end (characters), last (of its conversation).

    Records of a conversation stand in order in one partition.
    """
    rows = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    field = rows.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    return rows.select("conv_id", "role", "text").mapInArrow(_expanded(to_arrow_type(field)), _RECORD.format(field.simpleString()))


def _read(kind: pa.DataType):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows([kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        loss, chars, total = hashlib.sha256(), 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                trained = unescape(r["text"][r["loss_start"] : r["loss_end"]])
                loss.update(trained.encode())
                chars += len(trained)
                total += len(r["text"])
                if r["last"]:  # its text holds all turns of the conversation
                    turns = parse(r["text"])
                    digest = hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
                    if out.add((r["conv_id"], len(turns), digest, chars, loss.hexdigest(), total), 300):
                        yield out.take()
                    loss, chars, total = hashlib.sha256(), 0, 0
        if out.rows:
            yield out.take()

    return read


def digests(records: DataFrame) -> DataFrame:
    """What the formatted records of each conversation say, read back from them alone."""
    field = records.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    return records.mapInArrow(_read(to_arrow_type(field)), _DIGEST.format(field.simpleString()))
