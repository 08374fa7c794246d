"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Successive prefixes of a
conversation are rendered; what an output has more than the one before is the new turn's span, and an
output that doesn't start with the one before shows a template that rewrites history. Where a turn's text
lies in its span is found by rendering probe texts in its place.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]  # role, text
Template = Callable[[list[Turn]], str]

BOS, EOS = "<s>", "</s>"
_HEADS = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", f" {EOS}"), "system": ("<<SYS>>\n", "\n<</SYS>>\n\n")}
#: what control strings begin with, and the escape sign itself
_ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
#: what besides could end a role's mark
_ROLE_ESCAPES = {"]": "\\r", "\n": "\\n"}
_UNESCAPES = {v: k for k, v in (_ESCAPES | _ROLE_ESCAPES).items()}
_SPECIAL = re.compile(r"[\\<\[]")
_ESCAPED = re.compile(r"\\[\\lbrn]")


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: _ESCAPES[m[0]], text)


def escape_role(role: str) -> str:
    return re.sub(r"[\]\n]", lambda m: _ROLE_ESCAPES[m[0]], escape(role))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _UNESCAPES[m[0]], text)


def instruct_template(turns: list[Turn]) -> str:
    """Marks each turn with control strings, none of which a turn's text or role can contain."""
    out = [BOS]
    for role, text in turns:
        head, tail = _HEADS.get(role) or (f"[ROLE {escape_role(role)}]\n", "\n[/ROLE]")
        out += [head, escape(text), tail]
    return "".join(out)


_PIECE = re.compile(
    rf"(?:{re.escape(BOS)})?(?:\[INST\] (?P<user>[^<\[]*) \[/INST\]| (?P<assistant>[^<\[]*) </s>|<<SYS>>\n(?P<system>[^<\[]*)\n<</SYS>>\n\n|\[ROLE (?P<role>[^<\[\]\n]*)\]\n(?P<other>[^<\[]*)\n\[/ROLE\])"
)


def parse_piece(piece: str) -> Turn:
    """Role and text of one formatted turn of ``instruct_template``."""
    found = _PIECE.fullmatch(piece)
    if not found:
        raise ValueError(f"no formatted turn: {piece[:80]!r}")
    if found["role"] is not None:
        return unescape(found["role"]), unescape(found["other"])
    kind = found.lastgroup
    return kind, unescape(found[kind])


@dataclass
class Located:
    """A turn in the formatted conversation: the span [start, end), its text's span, if that is known, and if earlier output changed.

    Spans are places in the output up to this turn; where no turn rewrites history they hold in the whole.
    """

    piece: str
    start: int
    end: int
    text_start: int
    text_end: int
    located: bool
    rewrites: bool


class Renderer:
    """Locates turns one after the other by rendering all turns up to each.

    For a template declared turn-local, one whose output for a turn depends on no turn more than ``context`` before it but for whether
    it is the first, only the last ``context`` turns and the new one are rendered, in bounded memory.
    """

    def __init__(self, template: Template, context: int | None = None):
        self.template, self.context = template, context
        self.edges: dict[tuple, tuple[str | None, str]] = {}
        self.begin()

    def begin(self) -> None:
        self.turns: list[Turn] = []
        self.size = 0
        self.first = True
        self.last = ""

    def _edges(self, role: str) -> tuple[str, str]:
        """What stands before and behind a text of ``role`` in the output, from two probes; before it only what comes after all earlier output, if that stays."""
        key = (role, self.first, tuple(r for r, _ in self.turns[-2:])) if self.context is not None else None
        if key is None or key not in self.edges:
            a, b = (self.template([*self.turns, (role, probe)]) for probe in ("qx", "zwk"))
            head, tail = os.path.commonprefix([a, b]), os.path.commonprefix([a[::-1], b[::-1]])[::-1]
            found = (head[len(self.last) :] if head.startswith(self.last) else None, head, tail)
            if key is None:
                return found[1:]
            self.edges[key] = (found[0], tail)
        head, tail = self.edges[key]
        return (self.last + head if head is not None else ""), tail

    def add(self, role: str, text: str) -> Located:
        if self.context is not None and len(self.turns) > self.context:
            self.turns = self.turns[-self.context :]
            self.last = self.template(self.turns)
        out = self.template([*self.turns, (role, text)])
        rewrites = not out.startswith(self.last)
        shared = len(self.last) if not rewrites else len(os.path.commonprefix([out, self.last]))
        piece = out[shared:]
        head, tail = self._edges(role)
        # the probes' edges must be the text's own, and the text behind all that stays
        located = len(head) >= shared and len(head) + len(tail) <= len(out) and out.startswith(head) and out.endswith(tail)
        base = self.size - len(self.last)  # of the output, in the whole conversation's
        start, end = base + shared, base + len(out)
        text_start, text_end = (base + len(head), end - len(tail)) if located else (start, start)
        self.turns.append((role, text))
        self.last, self.size, self.first = out, end, False
        return Located(piece, start, end, text_start, text_end, located, rewrites)


_NAMES = ["conv_id", "seq", "role", "piece", "start", "end", "text_start", "text_end", "in_loss", "rewrites"]
_KINDS = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.bool_(), pa.bool_()]


def format_chats(
    turns: DataFrame, template: Template = instruct_template, loss_roles: tuple[str, ...] = ("assistant",), context: int | None = None,
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """A row for each turn of each conversation, in order within a conversation's partition.

    Columns: ``conv_id``, ``seq`` (from 0), ``role``, ``piece`` (the formatted turn; a conversation's pieces, joined,
    are its formatted text), ``start``, ``end``, ``text_start``, ``text_end`` (offsets in that text, code points),
    ``in_loss`` (whose text span is that of a loss role and is known; else it is empty) and ``rewrites``. Turns go by ``turn``, ties by role and text; null roles and texts count as
    empty; rows with a null ``conv_id`` form one conversation. Repeated rows are turns of their own. A
    conversation streams through one task, turn by turn; with ``context`` (see Renderer) its length isn't bound by memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        renderer, conv, seq = Renderer(template, context), object(), 0
        for batch in batches:
            out: list[tuple] = []
            for key, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if seq == 0 or key != conv:
                    conv, seq = key, 0
                    renderer.begin()
                t = renderer.add(role, text)
                out.append((seq, role, t.piece, t.start, t.end, t.text_start, t.text_end, t.located and role in loss_roles, t.rewrites))
                seq += 1
            if out:
                arrays = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), _KINDS, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], _NAMES)

    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(turn_col).alias("turn")
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"conv_id {kind}, seq bigint, role string, piece string, start bigint, end bigint, text_start bigint, text_end bigint, in_loss boolean, rewrites boolean")
