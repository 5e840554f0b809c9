"""Chat formatting by incremental black-box rendering.

A template is any function from turns to text. Successive prefixes of a
conversation are rendered and consecutive outputs compared: what the longer
one adds is the span of its last turn; if the shorter one is no prefix of the
longer, the template rewrites history there and the turn is flagged. Inside a
span, two renderings of one-letter texts show where the text begins and ends,
which gives the loss mask of the assistant turns without parsing anything.

A conversation streams through one task in turn order (its digest is sequential
anyway). A template that declares itself ``local`` (an attribute, as the default
template has it: spans follow from the last ``CONTEXT`` turns) is rendered, past
``FULL`` turns, from that many last turns, with constant state and in linear
time. Every other template gets full prefixes throughout, whatever a probe would
show: then the turns of one conversation are held in its task. ``probe_template``
compares both ways over a fixed conversation, to check a declaration.

Edge cases: null role or text is the empty one; turns are ordered by (turn,
role, text), null turns last, so ties and repeated rows have a fixed order and
each is a turn; null conv_id is one conversation, last; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import id_back, id_key

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

FULL = 8
CONTEXT = 3

#: Control strings of the default template.
HEAD, END = "###", "</turn>"


def escape(text: str, more: str = "") -> str:
    """Put a backslash before backslashes and control strings."""
    text = text.replace("\\", "\\\\").replace(HEAD, "\\" + HEAD).replace(END, "\\" + END)
    for c in more:
        text = text.replace(c, "\\" + c)
    return text


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    out, at = [], 0
    while (cut := text.find("\\", at)) >= 0:
        out.append(text[at:cut])
        out.append(text[cut + 1:cut + 2])
        at = cut + 2
    out.append(text[at:])
    return "".join(out)


def default_template(turns: Turns) -> str:
    return "".join(f"{HEAD} {escape(role, ':')}: {escape(text)}{END}\n" for role, text in turns)


#: Declares that the spans of a turn follow from its own role and text: no probe of a black box can show that.
default_template.local = True


class Span(NamedTuple):
    text: str       # what the turn adds to the rendering
    head: int       # code points before its text
    tail: int       # code points after its text
    rewrote: bool   # the rendering of earlier turns changed


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Renderer:
    """Spans of successive turns; ``local`` allows rendering from the last turns only."""

    def __init__(self, template: Template, local: bool):
        self.template, self.local, self.frames = template, local, {}
        self.reset()

    def reset(self) -> None:
        self.turns: Turns = []
        self.count = 0

    def add(self, role: str, text: str) -> Span:
        before = self.template(self.turns)
        after = self.template([*self.turns, (role, text)])
        kept = _common(before, after) if not after.startswith(before) else len(before)
        head, tail = self._frame(role, before)
        span = Span(after[kept:], head, tail, kept < len(before))
        self.turns.append((role, text))
        self.count += 1
        if self.local and self.count > FULL:
            self.turns = self.turns[-CONTEXT:]
        return span

    def _frame(self, role: str, before: str) -> tuple[int, int]:
        # what the frame is rendered from, so no other conversation's frame is met
        key = (role, min(self.count, FULL), tuple(r for r, _ in self.turns)) if self.local else None
        if key in self.frames:
            return self.frames[key]
        a, b = (self.template([*self.turns, (role, c)])[_common(before, self.template([*self.turns, (role, c)])):] for c in "xy")
        found = _common(a, b), _common(a[::-1], b[::-1])
        if key and len(self.frames) < 1000:
            self.frames[key] = found
        return found


class Probe(NamedTuple):
    rewrites: bool
    local: bool


def probe_template(template: Template, n: int = 24) -> Probe:
    """Render a fixed conversation: does the template rewrite history, and do its spans depend on the last turns only?"""
    roles = ("system", "user", "assistant", "user", "assistant", "tool")
    talk = [(roles[i % len(roles)], f"probe {i} \\ {HEAD} {END}\n.") for i in range(n)]
    full, near = Renderer(template, False), Renderer(template, True)
    spans = [(full.add(*t), near.add(*t)) for t in talk]
    return Probe(any(a.rewrote for a, _ in spans), all(a == b for a, b in spans))


def _format(template: Template, local: bool, loss_role: str):
    def run(batches):
        renderer, conv, at, i = Renderer(template, local), object(), 0, 0
        for b in batches:
            rows = []
            for c, role, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                if c != conv:
                    renderer.reset()
                    conv, at, i = c, 0, 0
                s = renderer.add(role, text)
                on = role == loss_role and not s.rewrote
                rows.append((c, i, s.text, at, at + s.head if on else None, at + len(s.text) - s.tail if on else None, s.rewrote))
                at, i = at + len(s.text), i + 1
            cols = list(zip(*rows)) if rows else [[]] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)],
                                             ["conv", "i", "chunk", "at", "loss_from", "loss_to", "rewrote"])
    return run


def format_conversations(conversations: DataFrame, template: Template = default_template, loss_role: str = "assistant") -> DataFrame:
    """(conv, i, chunk, at, loss_from, loss_to, rewrote) per turn, in order inside each partition.

    The chunks of a conversation, joined in order, are its formatted text;
    ``at`` and the loss span are code point offsets into it.
    """
    rows = conversations.select(
        id_key("conv_id").alias("conv"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        id_key("turn").alias("turn"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    local = bool(getattr(template, "local", False))
    return rows.mapInArrow(_format(template, local, loss_role),
                           "conv long, i long, chunk string, at long, loss_from long, loss_to long, rewrote boolean")


def _turn_end(text: str, start: int) -> int:
    """Where the first control string END that is not escaped begins, or -1."""
    at = text.find(END, start)
    while at >= 0:
        k = at
        while k > start and text[k - 1] == "\\":
            k -= 1
        if (at - k) % 2 == 0:
            return at
        at = text.find(END, at + 1)
    return -1


def parse_turns(text: str) -> tuple[Turns, str]:
    """Complete turns at the beginning of a default-template text, and what is left."""
    turns, start = [], 0
    while text.startswith(HEAD + " ", start):
        end = _turn_end(text, start)
        if end < 0 or text[end + len(END):end + len(END) + 1] != "\n":
            break
        body = text[start + len(HEAD) + 1:end]
        cut = 0
        while body[cut] != ":":
            cut += 2 if body[cut] == "\\" else 1
        turns.append((unescape(body[:cut]), unescape(body[cut + 2:])))
        start = end + len(END) + 1
    return turns, text[start:]


def _read_back(batches):
    conv, state = None, None
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrote"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def close(s):
        if s["rest"]:
            raise ValueError(f"conversation {conv}: {len(s['rest'])} characters are no turn")
        return (conv, s["n"], s["turns"].hexdigest(), s["loss_n"], s["loss"].hexdigest(), s["chars"], s["rewrote"])

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    for b in batches:
        done = []
        for c, chunk, at, lo, hi, rewrote in zip(*(b.column(k).to_pylist() for k in range(6))):
            if state is None or c != conv:
                if state is not None:
                    done.append(close(state))
                conv, state = c, {"n": 0, "turns": sha256(), "loss_n": 0, "loss": sha256(), "chars": 0, "rewrote": False, "rest": ""}
            turns, state["rest"] = parse_turns(state["rest"] + chunk)
            for role, text in turns:
                state["turns"].update(f"{role}\n{text}\n".encode())
            state["n"] += len(turns)
            state["chars"] += len(chunk)
            state["rewrote"] |= rewrote
            if lo is not None:
                text = unescape(chunk[lo - at:hi - at])
                state["loss"].update(text.encode())
                state["loss_n"] += len(text)
        if done:
            yield batch(done)
    if state is not None:
        yield batch([close(state)])


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse default-template output: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrote)."""
    out = formatted.select("conv", "chunk", "at", "loss_from", "loss_to", "rewrote").mapInArrow(
        _read_back, "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrote boolean")
    return out.select(id_back(F.col("conv")).alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrote")
