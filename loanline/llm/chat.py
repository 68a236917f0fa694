"""Chat formatting in budgeted windows of whole turns.

Turns are tokenized before they are brought together. The running sums of a conversation's turn tokens choose the turns of each window: the system turn is in every one,
then comes a limited history of turns that earlier windows have had, then new turns as far as the budget goes. Only the
new assistant turns are under the loss mask, so each is a target once. Control strings inside texts are escaped, and
the output can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loanline.llm.text import steps
from loanline.llm.tokens import PreTokens

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Tokens of a window, and of the history that it may repeat.
BUDGET = 1024
HISTORY = 256

_TOKEN = re.compile(r"\w+|[^\w\s]")
_TURN = re.compile(r"<\|im_start\|>((?:[^\n\\]|\\.)*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: str) -> str:
    """No control string is left: a backslash is doubled, and one is put between < and |."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _escaped_role(role: str) -> str:
    return escaped(role).replace("\n", "\\n")


def _unescaped_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def formatted(role: str, text: str) -> tuple[str, str, str]:
    """(head, escaped text, end) of a turn."""
    return f"{OPEN}{_escaped_role(role)}\n", escaped(text), f"{CLOSE}\n"


def turn_tokens(role: str, text: str) -> int:
    """Tokens of a formatted turn without a tokenizer: words and marks, and four for its frame."""
    return len(_TOKEN.findall(text)) + len(_TOKEN.findall(role)) + 4


def _measured(tokenizer: str | None):
    """Adds the tokens of each formatted turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = PreTokens(tokenizer) if tokenizer else None
        for batch in steps(batches):
            turns = zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)
            sizes = [known.count("".join(formatted(*t))) if known else turn_tokens(*t) for t in turns]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], names=[*batch.schema.names, "tokens"])

    return run


class Windows:
    """Takes a conversation's turns in order and gives its windows; holds no more turns than one window."""

    def __init__(self, budget: int, history: int, target: str) -> None:
        self.budget, self.limit, self.target = budget, history, target
        self.system: tuple | None = None
        self.history: deque = deque()
        self.fresh: list = []
        self.sums = [0, 0, 0]  # tokens of the system turn, the history and the new turns
        self.number = 0

    def _window(self) -> tuple[int, int, str, list[dict]]:
        text, spans, size = [], [], 0
        turns = [(t, True) for t in ([self.system] if self.system else [])] + [(t, True) for t in self.history]
        for (role, body, *_), repeated in turns + [(t, False) for t in self.fresh]:
            head, inner, end = formatted(role, body)
            if role == self.target and not repeated:
                spans.append({"start": size + len(head), "end": size + len(head) + len(inner)})
            text.append(f"{head}{inner}{end}")
            size += len(text[-1])
        self.number += 1
        return self.number - 1, len(turns), "".join(text), spans

    def _slide(self) -> None:
        """New turns become history, of which the latest stay as far as its limit goes."""
        for turn in self.fresh:
            if turn is not self.system:
                self.history.append(turn)
                self.sums[1] += turn[2]
        while self.history and self.sums[1] > self.limit:
            self.sums[1] -= self.history.popleft()[2]
        self.fresh, self.sums[2] = [], 0

    def add(self, role: str, text: str, tokens: int) -> Iterator[tuple]:
        turn = (role, text, tokens)
        if self.fresh and sum(self.sums) + turn[2] > self.budget:
            yield self._window()
            if self.system is None and self.number == 1 and self.fresh[0][0] == "system":
                self.system = self.fresh[0]
                self.sums[0] = self.system[2]
            self._slide()
        while self.history and sum(self.sums) + turn[2] > self.budget and not self.fresh:
            self.sums[1] -= self.history.popleft()[2]
        self.fresh.append(turn)
        self.sums[2] += turn[2]

    def end(self) -> Iterator[tuple]:
        if self.fresh:
            yield self._window()


_OUT = pa.schema(
    [
        ("conv_id", pa.string()),
        ("window", pa.int64()),
        ("repeated", pa.int32()),
        ("text", pa.large_string()),
        ("targets", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)
_OUT_SQL = "conv_id string, window long, repeated int, text string, targets array<struct<start long, end long>>"


def _format(budget: int, history: int, target: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _OUT.types, strict=True)]
            columns[3] = columns[3].cast(pa.string())
            return pa.RecordBatch.from_arrays(columns, names=_OUT.names)

        open_conv: tuple | None = None
        rows: list[tuple] = []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "tokens"))
            for conv, role, text, tokens in zip(*columns, strict=True):
                if open_conv is None or open_conv[0] != conv:
                    if open_conv:
                        rows += [(open_conv[0], *w) for w in open_conv[1].end()]
                    open_conv = (conv, Windows(budget, history, target))
                rows += [(conv, *w) for w in open_conv[1].add(role, text, tokens)]
                if len(rows) >= 64:
                    yield pack(rows)
                    rows = []
        if open_conv:
            rows += [(open_conv[0], *w) for w in open_conv[1].end()]
        if rows:
            yield pack(rows)

    return run


def format_chats(
    turns: DataFrame,
    budget: int = BUDGET,
    history: int = HISTORY,
    target: str = "assistant",
    tokenizer: str | None = None,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """(conv_id, window, repeated, text, targets): windows of formatted turns, a conversation's in order in one partition.

    Turns go by number, then role and text; a null number comes first. Null roles and texts are empty, null ids are one
    conversation, repeated rows are turns of their own. ``repeated`` counts the turns at a window's beginning that an
    earlier window has too; ``targets`` are offsets of the new turns of the ``target`` role in the text. A turn longer
    than the budget has a window of its own, with the system turn, and is never cut. ``tokenizer`` is a file that tokens
    are counted by, frame and escapes included; without one they are words and marks. All turns are tokenized where they
    are read, so the one task of a very long conversation only lays out its windows; it streams them turn by turn and
    needs no more memory than a window. ``conv_id`` is text. Other columns are ignored.
    """
    rows = turns.select(
        F.col(f"`{conv}`").cast("string").alias("conv_id"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        F.col(f"`{turn}`").alias("turn"),
    )
    rows = rows.mapInArrow(_measured(tokenizer), StructType([*rows.schema.fields, StructField("tokens", LongType())]))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_format(budget, history, target), _OUT_SQL)


def read_window(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a window, control strings restored."""
    return [(_unescaped_role(m[1]), unescaped(m[2])) for m in _TURN.finditer(text)]


_READ_SQL = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    class Sums:
        def __init__(self, conv: str | None) -> None:
            self.conv, self.turns, self.loss = conv, hashlib.sha256(), hashlib.sha256()
            self.n_turns = self.loss_chars = self.chars = 0

        def row(self) -> tuple:
            return self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars

    now: Sums | None = None
    for batch in batches:
        done = []
        for conv, _, repeated, text, targets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.conv != conv:
                done += [now.row()] if now else []
                now = Sums(conv)
            now.chars += len(text)
            for role, body in read_window(text)[repeated:]:
                now.n_turns += 1
                now.turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
            for span in targets:
                body = unescaped(text[span["start"] : span["end"]])
                now.loss_chars += len(body)
                now.loss.update(body.encode("utf-8", "surrogatepass"))
        if done:
            yield _rows(done)
    if now:
        yield _rows([now.row()])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [part.split()[0] for part in _READ_SQL.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows of ``format_chats`` say of each conversation: its turns and its targets, each once and in order.

    ``formatted_chars`` counts all characters of its windows. Expects a conversation's windows in order in a partition.
    """
    return windows.mapInArrow(_read_back, _READ_SQL)
