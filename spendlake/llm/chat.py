"""Chat formatting with any template as a black box.

A template is a function from turns to text; nothing is known of its inside. For every turn the conversation is rendered
without and with it, and the outputs are compared: what the longer one adds is the turn's span. Rendering the turn twice
more with probe texts shows where inside the span the text stands, which gives the loss mask of assistant turns. If the
longer output does not begin with the shorter one, the template rewrites history, and the turn is marked.

A turn is rendered behind all turns before it: the outputs of successive prefixes are compared, which takes the memory of
a conversation and the square of its turns. A template that is declared local, because each turn's part depends on the
last few turns alone (``lookback``, or an attribute of that name on the template), is rendered behind these only; a
conversation of any length then takes the memory of ``lookback`` turns. A look back one turn shorter must agree there, or
the turn is marked; what lies further back than declared is not seen.

Rows are dealt by conversation and sorted, and a task goes through them as a stream. A conversation's digest is a chain over
its turns, so one conversation is one task's work.

Defined results:
* null text or role: empty; null turns come first; rows of one turn are ordered by role and text; repeated rows are turns
  of their own; rows with a null conversation are one conversation;
* an empty table gives an empty table; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.llm.common import quoted, small_batches

Turn = tuple[str, str]  # role, text
Template = Callable[[list[Turn]], str]

START, END = "<|im_start|>", "<|im_end|>"
#: Earlier turns that the default template is rendered behind, which looks at none.
LOOKBACK = 4
#: Two texts with no character in common, put in a turn to see where its text stands.
_PROBES = ("\x01", "\x02")


def escape(text: str) -> str:
    """The text with every control string broken up; :func:`unescape` undoes it."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def marked(turns: list[Turn]) -> str:
    """The default template: each turn between its marks, control strings in texts and roles escaped."""
    return "".join(f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n{escape(text)}{END}\n" for role, text in turns)


marked.lookback = LOOKBACK


def added(template: Template, before: list[Turn], turn: Turn) -> tuple[str, int, int, bool]:
    """What the turn adds to the output, where its text begins and ends in that, and whether history was rewritten."""
    return _compared(template, before, turn, template(before), template([*before, turn]))


def _compared(template: Template, before: list[Turn], turn: Turn, short: str, long: str) -> tuple[str, int, int, bool]:
    """:func:`added` where the outputs without and with the turn are known."""
    same = len(short) if long.startswith(short) else len(commonprefix([short, long]))
    piece, rewrites = long[same:], same < len(short)
    first, second = (template([*before, (turn[0], p)]) for p in _PROBES)
    head = len(commonprefix([first, second]))
    tail = len(commonprefix([first[:head - 1 if head else None:-1], second[:head - 1 if head else None:-1]]))
    begin, end = head - same, len(long) - tail - same
    if begin < 0 or end < begin:  # the text stands outside of what was added
        return piece, 0, 0, True
    return piece, begin, end, rewrites


def format_turns(
    rows: DataFrame, template: Template = marked, lookback: int | None = None, loss_roles: tuple[str, ...] = ("assistant",),
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per turn: ``conv_id, turn, role, piece, start, end, loss_start, loss_end, rewrites``.

    ``piece`` is the turn's part of the output and ``start``/``end`` its place there, in characters; the loss span is empty
    but in turns of ``loss_roles``. Rows of a conversation are in one partition, in order. ``lookback`` declares a template
    local; without it, and without the attribute on the template, whole prefixes are rendered.
    """
    if lookback is None:
        lookback = getattr(template, "lookback", None)
    small_batches(rows.sparkSession)
    picked = rows.select(
        quoted(conv_col).alias("conv_id"), quoted(turn_col).alias("turn"),
        F.coalesce(quoted(role_col), F.lit("")).alias("role"), F.coalesce(quoted(text_col), F.lit("")).alias("text"),
    )
    dealt = picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kinds = dict(dealt.dtypes)
    schema = (
        f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, piece string, start long, `end` long, "
        "loss_start long, loss_end long, rewrites boolean"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        current, before, at, shown = none, deque(maxlen=None if lookback is None else lookback + 1), 0, ""
        for batch in batches:
            out: list[tuple] = []
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            for conv, role, text in zip(batch.column("conv_id").to_pylist(), roles, texts, strict=True):
                if conv != current or current is none:
                    current, at = conv, 0
                    before.clear()
                    shown = template([])
                seen = list(before)
                if lookback is None:
                    longer = template([*seen, (role, text)])
                    piece, begin, end, rewrites = _compared(template, seen, (role, text), shown, longer)
                    shown = longer
                else:
                    piece, begin, end, rewrites = added(template, seen, (role, text))
                if lookback is not None and len(seen) > lookback and added(template, seen[1:], (role, text))[:3] != (piece, begin, end):
                    rewrites = True
                lost = (at + begin, at + end) if role in loss_roles else (at, at)
                out.append((piece, at, at + len(piece), *lost, rewrites))
                at += len(piece)
                before.append((role, text))
            columns = zip(*out, strict=True) if out else [[]] * 6
            types = [pa.string(), *[pa.int64()] * 4, pa.bool_()]
            arrays = [batch.column(c) for c in ("conv_id", "turn", "role")] + [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
            names = ["conv_id", "turn", "role", "piece", "start", "end", "loss_start", "loss_end", "rewrites"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return dealt.mapInArrow(run, schema)


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


class _Reader:
    """Reads one formatted conversation back, piece by piece."""

    def __init__(self, conv) -> None:
        self.conv, self.rest, self.turns, self.chars, self.loss_chars = conv, "", 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, begin: int, end: int) -> None:
        self.chars += len(piece)
        self.rest += piece
        at = 0
        for m in iter(lambda: _TURN.match(self.rest, at), None):
            self.all.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            self.turns += 1
            at = m.end()
        self.rest = self.rest[at:]
        lost = unescape(piece[begin:end])
        self.loss_chars += len(lost)
        self.loss.update(lost.encode())

    def row(self) -> tuple:
        if self.rest:
            raise ValueError(f"conversation {self.conv}: the output does not end with a turn")
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the output of the default template: turns, digests of all text and of the text under the loss
    mask, and lengths. Takes :func:`format_turns`'s rows as they are dealt."""
    kind = dict(formatted.dtypes)["conv_id"]
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    fields = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: _Reader | None = None
        conv_type = None

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=fields)

        for batch in batches:
            conv_type, done = batch.column("conv_id").type, []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "piece", "start", "loss_start", "loss_end")]
            for conv, piece, start, a, b in zip(*columns, strict=True):
                if reader is None or conv != reader.conv:
                    if reader is not None:
                        done.append(reader.row())
                    reader = _Reader(conv)
                reader.add(piece, a - start, b - start)
            if done:
                yield packed(done)
        if reader is not None:
            yield packed([reader.row()])

    return formatted.mapInArrow(run, schema)
