"""Chat formatting in budgeted windows.

Prefix sums of the turns' token counts, a window function over each conversation, choose spans of whole turns: a span
ends at the last turn whose prefix sum doesn't exceed that of its start by more than the room that the window has left.
A window holds the conversation's system turn, a limited history of the turns before its span, and the span; what is
repeated counts against the budget, and is never a target again: the loss mask covers every assistant text once, in the
window of whose span it is part.

What is repeated takes half of the budget at most: a longer system turn (the first turn, if it is one of the system)
isn't repeated, and the history is limited to what it leaves of that half. A turn that doesn't fit behind the history
comes without it, one that doesn't fit behind the system turn comes alone; so only a turn that is over the budget
itself is in a window over the budget, and it is never cut.

Template: ``<s>role\\ntext</s>`` per turn. Control strings inside roles and texts get a backslash behind their first
character, and a backslash is doubled, so that no control string is left and the change can be undone.

Conversations are streamed in order of their turns: a task holds the history of one window, however long its
conversations are.

Defined results: null texts and roles are empty; turns that tie are ordered by role and text; repeated rows are turns of
their own; rows with a null identifier form one conversation; turns of any length stay whole; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumensift.llm.common import small_batches
from lumensift.llm.textbuf import releasing

BUDGET, HISTORY = 512, 128

#: First characters of ``<s> </s> <<SYS>> <</SYS>> <|...`` and ``[INST] [/INST]``, and the backslash itself.
_CONTROL = re.compile(r"\\|<(?=s>|/s>|</?SYS>>|\|)|\[(?=/?INST\])")
_TURN = re.compile(r"<s>(.*?)\n(.*?)</s>", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\e")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "e" else m[1], role)


def tokens(text: Column) -> Column:
    """A turn's budgeted size: a token for four characters, and four for its marks."""
    return (F.lit(4) + F.ceil(F.char_length(text) / 4)).cast("long")


class Turn(NamedTuple):
    role: str
    text: str
    prefix: int  # tokens of the conversation up to this turn, itself included
    size: int


class Windows:
    """Cuts one conversation into windows, from its turns in order."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: Turn | None = None
        self.before: list[Turn] = []  # turns before the open span that the next window may repeat
        self.open: list[Turn] = []  # turns that no window has yet
        self.number = self.seen = 0

    def _repeated(self) -> list[Turn]:
        """What the next window repeats, in front of its first turn."""
        first = self.open[0]
        system = [self.system] if self.system and first is not self.system and self.system.size + first.size <= self.budget else []
        used = sum(t.size for t in system)
        room = min(self.history, self.budget // 2 - used, self.budget - used - first.size)
        if not self.before or room <= 0:
            return system
        # the history starts behind the turn whose prefix sum is within the room of the span's start
        start = bisect_left(self.before, first.prefix - first.size - room, key=lambda t: t.prefix - t.size)
        return system + [t for t in self.before[start:] if t is not self.system]

    def add(self, turns: list[Turn], last: bool) -> list[dict]:
        """The windows that end within these turns; last: none come after them."""
        if turns and not self.seen and turns[0].role == "system" and turns[0].size <= self.budget // 2:
            self.system = turns[0]
        self.seen += len(turns)
        self.open += turns
        out, at = [], 0
        rest = self.open
        while at < len(rest):
            self.open = rest[at:]
            repeated = self._repeated()
            room = self.budget - sum(t.size for t in repeated)
            first = rest[at]
            end = max(at + 1, bisect_right(rest, first.prefix - first.size + room, lo=at, key=lambda t: t.prefix))
            if end == len(rest) and not last:
                break
            span = rest[at:end]
            out.append(self._window(repeated, span))
            kept = self.before + span
            edge = kept[-1].prefix - self.history
            self.before = kept[bisect_left(kept, edge, key=lambda t: t.prefix - t.size) :]
            at = end
        self.open = rest[at:]
        return out

    def _window(self, repeated: list[Turn], span: list[Turn]) -> dict:
        text, at, mask = [], 0, []
        for i, turn in enumerate(repeated + span):
            head, body = f"<s>{escape_role(turn.role)}\n", escape(turn.text)
            if turn.role == "assistant" and i >= len(repeated):
                mask.append({"start": at + len(head), "stop": at + len(head) + len(body)})
            text.append(f"{head}{body}</s>")
            at += len(text[-1])
        self.number += 1
        return {"window": self.number - 1, "n_repeated": len(repeated), "text": "".join(text), "mask": mask}


SCHEMA = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("n_repeated", pa.int32()), ("text", pa.string()), ("mask", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])


@releasing
def _windows(batches: Iterator[pa.RecordBatch], budget: int, history: int) -> Iterator[pa.RecordBatch]:
    now, open_ = None, None
    for batch in batches:
        out = []
        convs = batch.column(0).to_pylist()
        turns = list(map(Turn, *(batch.column(i).to_pylist() for i in range(1, 5))))
        edges = [0, *(i for i in range(1, len(convs)) if convs[i] != convs[i - 1]), len(convs)]
        for begin, end in zip(edges, edges[1:], strict=False):
            if begin == end:
                continue
            if open_ is not None and convs[begin] != now:
                out += [{"conv_id": now} | w for w in open_.add([], True)]
                open_ = None
            if open_ is None:
                now, open_ = convs[begin], Windows(budget, history)
            out += [{"conv_id": now} | w for w in open_.add(turns[begin:end], False)]
        if out:
            yield pa.RecordBatch.from_pylist(out, SCHEMA)
    if open_ is not None and (out := [{"conv_id": now} | w for w in open_.add([], True)]):
        yield pa.RecordBatch.from_pylist(out, SCHEMA)


def format_conversations(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, count: Callable[[Column], Column] = tokens) -> DataFrame:
    """(conv_id, window, n_repeated, text, mask): a conversation's windows follow one another within a partition.

    The first n_repeated turns of a window are repeated ones; mask: code point ranges of text that are targets.
    """
    small_batches(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["turn", "role", "text"]
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("size", count(F.col("text")).cast("long")).withColumn("prefix", F.sum("size").over(before))
    rows = rows.sortWithinPartitions("conv_id", *order).select("conv_id", "role", "text", "prefix", "size")  # as the window function leaves them
    return rows.mapInArrow(partial(_windows, budget=budget, history=history), "conv_id long, window int, n_repeated int, text string, mask array<struct<start:int,stop:int>>")


def read_window(text: str, n_repeated: int) -> list[tuple[str, str]]:
    """(role, text) of the turns of a window's own span."""
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(text)[n_repeated:]]


DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])


@releasing
def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state, out = None, None, []

    def done() -> dict:
        n, turns, chars, loss, formatted, windows = state
        return dict(zip(DIGEST.names, (now, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, windows), strict=True))

    for batch in batches:
        for row in batch.to_pylist():
            if state is None or row["conv_id"] != now:
                if state is not None:
                    out.append(done())
                now, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, text in read_window(row["text"], row["n_repeated"]):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for m in row["mask"]:
                target = unescape(row["text"][m["start"] : m["stop"]])
                state[2] += len(target)
                state[3].update(target.encode("utf-8", "surrogatepass"))
            state[4] += len(row["text"])
            state[5] += 1
        if out:
            yield pa.RecordBatch.from_pylist(out, DIGEST)
            out = []
    if state is not None:
        yield pa.RecordBatch.from_pylist([done()], DIGEST)


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation what its windows hold: turns and targets, unescaped. windows: as format_conversations gives them."""
    return windows.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
