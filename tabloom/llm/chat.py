r"""Chat formatting with the template as a black box, and masks that mark what is learned from.

Successive prefixes of a conversation are rendered and consecutive outputs compared: where a longer prefix
only appends, the new text is the span of the new turn. Within the span, two renderings that differ in a
probe text alone show where the turn's own text begins and ends. A template whose output for a prefix is
not a beginning of the next one rewrites history (such as one that drops earlier system turns); it is
reported, and no spans are taken from it. Every template goes this way, the registered query's too.

Sorted turns stream by. Without ``window``, the turns of one conversation are held and each prefix is
rendered whole, which costs turns squared. A template said to look back over at most ``window`` turns is
rendered over prefixes that begin up to twice that many turns back, so a conversation of any length needs
bounded memory and ``window`` renderings of each turn; those of up to ``2 * window`` turns are still
rendered whole. Each time the beginning moves on, the output must be the dropped turns' output and the
kept ones', or the template looks back further than it was said to, which is an error. A conversation is read by one task, as
its digests are sequential; those tasks hold no more than the window.

``marked`` is the template of the registered query: ``### role:``, the text and ``</turn>`` on lines of
their own. Backslash, ``#`` and ``<`` inside texts, and colons and line ends inside roles, get a
backslash before them, so no text can end a turn or begin one; ``unescape`` removes it again.

Defined results: a missing text or role is empty. Rows of a conversation go by turn, then role, then
text, missing ones first; a repeated row is a turn of its own. Rows without a conversation id form one
conversation with a missing id. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, FloatType, StructType

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

#: Characters of held turns' output beyond which a window begins later, with one turn at least.
HELD_CHARS = 1 << 22

_PROBES = ("\ue0b1", "\ue0b2")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("<", "\\<")


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:").replace("\n", "\\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def marked(turns: Sequence[Turn]) -> str:
    return "".join(f"### {escape_role(role)}:\n{escape(text)}\n</turn>\n" for role, text in turns)


_TURN = re.compile(r"### ((?:[^\\:\n]|\\.)*):\n((?:[^\\<]|\\.)*)\n</turn>\n", re.DOTALL)


def read_marked(formatted: str) -> list[Turn]:
    """The turns of a text that ``marked`` wrote; anything else in it is an error."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn begins at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


@dataclass
class Located:
    """A rendered conversation: each turn's span, its text's span, and whether history was rewritten."""

    formatted: str
    spans: list[tuple[int, int]]
    texts: list[tuple[int, int]]
    rewrites: bool


def _common(a: str, b: str, step: int = 1) -> int:
    """Characters that two texts share at their beginning, or for a step of -1 at their end."""
    if step < 0:
        return len(os.path.commonprefix([a[::-1], b[::-1]]))
    return len(os.path.commonprefix([a, b]))


def _append(turns: Sequence[Turn], before: str, turn: Turn, render: Template) -> tuple[str, int, int] | None:
    """The output with one more turn, and where the turn's text begins and ends in it; None if history was rewritten.

    The text lies between what two probe texts of its length leave unchanged at the beginning and end of
    what the turn adds. A frame that is another one around the turn's own text is an error.
    """
    now, (role, text) = render([*turns, turn]), turn
    if not now.startswith(before):
        return None
    probes = [render([*turns, (role, p * max(1, len(text)))]) for p in _PROBES]
    if not all(p.startswith(before) for p in probes):
        return None
    start = len(before)
    head, tail = (_common(probes[0][start:], probes[1][start:], step) for step in (1, -1))
    if now[start : start + head] != probes[0][start : start + head] or now[len(now) - tail :] != probes[0][len(probes[0]) - tail :]:
        raise ValueError(f"the template's frame of a turn of {role!r} depends on its text")
    return now, start + head, len(now) - tail


def locate(turns: Sequence[Turn], render: Template) -> Located:
    """Find each turn's span from renderings of successive prefixes alone."""
    before, spans, inner = render([]), [], []
    for i, turn in enumerate(turns):
        found = _append(turns[:i], before, turn, render)
        if found is None:
            return Located(render(turns), [], [], True)
        now, first, last = found
        spans.append((len(before), len(now)))
        inner.append((first, last))
        before = now
    return Located(before, spans, inner, False)


def loss_mask(located: Located, turns: Sequence[Turn], learned: str = "assistant") -> list[tuple[int, int]]:
    """Spans of the formatted text that are learned from: the texts of one role."""
    return [span for span, (role, _) in zip(located.texts, turns) if role == learned]


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _schema(rows: DataFrame) -> str:
    return (
        f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long,"
        " loss_sha256 string, formatted_chars long, rewrites boolean"
    )


class _Whole:
    """A conversation whose turns are held, to be rendered over all its prefixes."""

    def __init__(self, render, read, unescape, learned: str, with_text: bool):
        self.render, self.read, self.unescape, self.learned, self.with_text = render, read, unescape, learned, with_text
        self.turns: list[Turn] = []

    def add(self, turn: Turn) -> None:
        self.turns.append(turn)

    def row(self) -> tuple:
        found = locate(self.turns, self.render)
        back = self.read(found.formatted)
        mask = loss_mask(found, back, self.learned)
        loss = "".join(self.unescape(found.formatted[a:b]) for a, b in mask)
        said = "".join(f"{r}\n{t}\n" for r, t in back)
        row = len(back), _digest(said), len(loss), _digest(loss), len(found.formatted), found.rewrites
        return row + ((found.formatted, [list(s) for s in found.spans], [list(s) for s in mask]) if self.with_text else ())


class _Windowed:
    """What is known of a conversation after some of its turns: counts, digests, and the turns of the window."""

    def __init__(self, render, read, unescape, learned: str, window: int):
        self.render, self.read, self.unescape, self.learned, self.window = render, read, unescape, learned, window
        self.held: list[Turn] = []
        self.opening = self.before = render([])
        self.turns, self.loss, self.chars = 0, 0, len(self.opening)
        self.said, self.learnt = hashlib.sha256(), hashlib.sha256()
        self.rewrites = False

    def add(self, turn: Turn) -> None:
        if self.rewrites:
            return
        found = _append(self.held, self.before, turn, self.render)
        if found is None:
            self.rewrites = True
            return
        now, first, last = found
        span = now[len(self.before) :]
        for role, text in self.read(self.opening + span):
            self.said.update(f"{role}\n{text}\n".encode())
            self.turns += 1
            if role == self.learned:
                loss = self.unescape(now[first:last])
                self.loss += len(loss)
                self.learnt.update(loss.encode())
        self.chars += len(span)
        self.held.append(turn)
        self.before = now
        if len(self.held) >= 2 * self.window or len(now) > HELD_CHARS:
            self._move()

    def _move(self) -> None:
        """Begin later; what is dropped must have no part in the output of what is kept."""
        kept = self.held[-self.window :]
        while len(kept) > 1 and sum(len(t) for _, t in kept) > HELD_CHARS // 2:
            kept = kept[1:]
        dropped = self.held[: len(self.held) - len(kept)]
        after = self.render(kept)
        if self.before != self.render(dropped) + after[len(self.opening) :]:
            raise ValueError(f"the template looks back over more than {self.window} turns")
        self.held, self.before = kept, after

    def row(self) -> tuple:
        if self.rewrites:
            return None, None, None, None, None, True
        return self.turns, self.said.hexdigest(), self.loss, self.learnt.hexdigest(), self.chars, False


def format_conversations(
    rows: DataFrame,
    *,
    render: Template = marked,
    read: Callable[[str], list[Turn]] = read_marked,
    unescape: Callable[[str], str] = unescape,
    learned: str = "assistant",
    window: int | None = None,
    with_text: bool = False,
) -> DataFrame:
    """One row for each conversation of rows (conv_id, turn, role, text).

    Gives conv_id, n_turns, turns_sha256 (of what is read back from the output), loss_chars,
    loss_sha256 (of the unescaped text under the mask), formatted_chars and rewrites; on request also
    the formatted text and the spans of turns and mask, which need all prefixes whole (no ``window``).
    ``read`` gets the output of the whole conversation, or with a window that of each turn. A template
    that rewrites history has no mask, and with a window no counts or digests either.
    """
    if window is not None and (window < 1 or with_text):
        raise ValueError("a window needs one turn or more, and gives no formatted text")
    clean = rows.select(
        F.col("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    kind = clean.schema["conv_id"].dataType
    if isinstance(kind, (DoubleType, FloatType)):  # 0.0 and -0.0 are one conversation, as for groupBy
        clean = clean.withColumn("conv_id", (F.col("conv_id") + F.lit(0.0)).cast(kind))
    schema = _schema(clean) + (", formatted string, spans array<array<long>>, mask array<array<long>>" if with_text else "")
    names, ids = StructType.fromDDL(schema).names, to_arrow_type(kind)
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    if with_text:
        kinds += [pa.string(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.list_(pa.int64()))]
    ordered = clean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def begin():
        if window is None:
            return _Whole(render, read, unescape, learned, with_text)
        return _Windowed(render, read, unescape, learned, window)

    def made(batches: Iterator[pa.RecordBatch]):
        """(id, row) of each conversation, as its last turn has gone by."""
        key, now = None, None
        for batch in batches:
            for own, role, text in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3))):
                same = own == key or (own != own and key != key)
                if now is None or not same:
                    if now is not None:
                        yield key, now.row()
                    key, now = own, begin()
                now.add((role, text))
        if now is not None:
            yield key, now.row()

    def run(batches: Iterator[pa.RecordBatch]):
        done = made(batches)
        while part := list(islice(done, 64 if with_text else 256)):
            columns = [pa.array(c, k) for c, k in zip(zip(*(row for _, row in part)), kinds)]
            yield pa.RecordBatch.from_arrays([pa.array([key for key, _ in part], ids), *columns], names=names)

    return ordered.mapInArrow(run, schema)
