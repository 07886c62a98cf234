"""Chat formatting with spans found by rendering, whatever the template.

A template is a black box: turns in, text out. Successive prefixes of a conversation are rendered; where each output
begins with the one before it, the rest is the new turn's span. An ending that moves along (a closing mark after the
last turn) is told from text that was changed: a template that changes text already rendered is reported with the first
turn that did it, and gets no spans. Within its span a turn's own text is found with two probes, renderings that
differ in that text only.

Nothing is asked of a template. By default a conversation is one run, whose every prefix is rendered. A template that is
made turn by turn (``Template(turn=...)``, as the built-in one) has the texts of its turns laid end to end, by
construction, so its conversations are cut into runs of ``run`` turns from one global sort, and one of any length is
spread over tasks. ``looks_back`` is a guess that saves work: runs then begin after that many turns, and what the runs
make is held against renderings of the whole prefix at doubling numbers of runs and at the end; where they differ, the
conversation is rendered again in one run.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import groupby
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Turn = tuple[str, str]  # role, text

CONTROL = {"\\": "\\\\", "</turn>": "\\e", "### ": "\\h"}
ROLE_CONTROL = {**CONTROL, ":": "\\c", "\n": "\\n"}


def _swap(text: str, table: dict[str, str]) -> str:
    return re.sub("|".join(re.escape(k) for k in table), lambda m: table[m[0]], text)


_seen: dict[str, str] | None = None


@contextmanager
def remembering() -> Iterator[None]:
    """While it lasts, escaped texts are kept: prefixes are rendered again and again, with the same few turns."""
    global _seen
    before, _seen = _seen, {}
    try:
        yield
    finally:
        _seen = before


def escape(text: str) -> str:
    """The text with the template's control strings replaced; ``unescape`` gives it back."""
    if _seen is None:
        return _swap(text, CONTROL)
    if text not in _seen:
        _seen[text] = _swap(text, CONTROL)
    return _seen[text]


def escape_role(role: str) -> str:
    """A role without the strings that would end it."""
    return _swap(role, ROLE_CONTROL)


def unescape(text: str) -> str:
    back = {v: k for k, v in ROLE_CONTROL.items()}
    return re.sub(r"\\.", lambda m: back[m[0]], text, flags=re.S)


def render_turn(turn: Turn) -> str:
    """The template's text of a turn: ``### Role:``, the text and a closing mark, control strings escaped."""
    return f"### {escape_role(turn[0])}:\n{escape(turn[1])}</turn>\n"


def render(turns: list[Turn]) -> str:
    """The built-in template: its turns one after the other."""
    return "".join(map(render_turn, turns))


_TURN = re.compile(r"### ([^:\n]*):\n(.*?)</turn>\n", re.S)


def read_back(formatted: str) -> list[Turn]:
    """The turns of what ``render`` gave."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


@dataclass(frozen=True)
class Template:
    """A black box (``render``), or a function of one turn (``turn``), whose texts are laid end to end; none: the built-in one.

    ``looks_back`` is a guess of how many turns before a turn a black box looks at, which is verified; None: no guess.
    """

    render: Callable[[list[Turn]], str] | None = None
    looks_back: int | None = None
    turn: Callable[[Turn], str] | None = None

    def __post_init__(self) -> None:
        if self.turn is None and self.render in (None, render):
            object.__setattr__(self, "turn", render_turn)
        if self.turn is not None:
            turn = self.turn
            object.__setattr__(self, "looks_back", 0)
            object.__setattr__(self, "render", lambda turns: "".join(map(turn, turns)))


@dataclass
class Spans:
    """What is known of a run: its text, each turn's span, that of each turn's own text, and the first turn that changed earlier text (-1: none)."""

    text: str
    turns: list[tuple[int, int]]
    contents: list[tuple[int, int]]
    rewritten_at: int = -1


def _common_end(a: str, b: str) -> int:
    return len(commonprefix([a[::-1], b[::-1]]))


def _locate(template: Callable[[list[Turn]], str], turns: list[Turn], before: list[Turn] = ()) -> Spans:
    """Render successive prefixes of ``turns``, after the turns ``before``, and find the spans."""
    before = list(before)
    ahead = template(before) if before else ""
    shown, spans, contents = ahead, [], []
    for i, (role, _) in enumerate(turns):
        now = template(before + turns[: i + 1])
        if now.startswith(shown):
            start, end = len(shown), len(now)
        else:
            start = len(commonprefix([shown, now]))
            kept = len(shown) - start  # the ending of what was shown, which must stand again at the end
            end = len(now) - kept
            if end < start or now[end:] != shown[start:] or not (spans or before):
                whole = template(before + turns)
                return Spans(whole[len(ahead) :] if whole.startswith(ahead) else whole, [], [], i)
            if spans:  # the ending was taken for the last turn's
                spans[-1] = (spans[-1][0], start - len(ahead))
        # two renderings that differ in this turn's text only: what they share around it is not the text
        probe_a, probe_b = (template([*before, *turns[:i], (role, x)]) for x in ("a", "b"))
        head = len(commonprefix([probe_a, probe_b]))
        tail = _common_end(probe_a[head:], probe_b[head:])
        spans.append((start - len(ahead), end - len(ahead)))
        contents.append((head - len(ahead), len(now) - tail - len(ahead)))
        shown = now
    return Spans(shown[len(ahead) :] if shown.startswith(ahead) else shown, spans, contents)


def locate(template: Callable[[list[Turn]], str], turns: list[Turn], before: list[Turn] = ()) -> Spans:
    """Render successive prefixes of ``turns``, after the turns ``before``, and find the spans."""
    with remembering():
        return _locate(template, turns, before)


def _verified(template: Callable[[list[Turn]], str], located: list[tuple[list[Turn], Spans]]) -> list[tuple[list[Turn], Spans]]:
    """Runs of a whole conversation if together they are what the template makes of its prefixes; else one run."""
    turns, text, ok = [], [], True
    for k, (held, found) in enumerate(located, 1):
        turns += held
        text.append(found.text)
        ok &= found.rewritten_at < 0
        if ok and (k & (k - 1) == 0 or k == len(located)):
            ok = template(turns) == "".join(text)
    return located if ok else [(turns, locate(template, turns))]


def _runs(batches: Iterator[pa.RecordBatch], run: int, looks_back: int | None) -> Iterator[tuple[int | None, list[Turn], list[Turn]]]:
    """Runs of sorted rows: conversation, turns before the run in this task, its turns."""
    now, held, before = None, [], []
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if held and (conv != now or (looks_back is not None and len(held) >= run)):
                yield now, before, held
                before = (before + held)[-looks_back:] if conv == now and looks_back else []
                held = []
            elif not held and conv != now:
                before = []
            now = conv
            held.append((role or "", text or ""))
    if held:
        yield now, before, held


def format_conversations(turns: DataFrame, template: Template | None = None, run: int = 16, loss_role: str = "assistant") -> DataFrame:
    """Format the rows of ``turns`` (conv_id, turn, role, text; other columns are not read), one output row for a run.

    Columns: conv_id, place (rows of a conversation in the order of place make the whole), formatted, roles, spans and
    contents (arrays of start and end in ``formatted``), loss (whether each turn is under the loss mask), rewritten_at
    (the first turn, in the run, at which the template changed earlier text; -1: never). Turns are ordered by turn,
    null first, then role and text; equal rows are turns of their own. A null role or text is empty; a null conv_id is
    a conversation like others. A black box needs a whole conversation, which is in one task then; one whose earlier
    text it changes is one row, rendered whole, without spans. An empty table gives an empty table.
    """
    template = template or Template()
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    if template.turn is None:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    else:
        order = ["conv_id", "turn", "role", "text", F.monotonically_increasing_id()]  # the last spreads equal rows, whose order is of no matter
        rows = rows.repartitionByRange(*order).sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = rows.select("conv_id", "role", "text")
    span = pa.list_(pa.list_(pa.int64()))

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, parts in groupby(_runs(batches, run, template.looks_back), key=lambda r: r[0]):
            located = ((held, locate(template.render, held, before)) for _, before, held in parts)
            if template.turn is None and template.looks_back is not None:
                located = _verified(template.render, list(located))
            for held, found in located:
                yield pa.RecordBatch.from_arrays([
                    pa.array([conv], pa.int64()), pa.array([found.text]), pa.array([[r for r, _ in held]], pa.list_(pa.string())),
                    pa.array([found.turns], span), pa.array([found.contents], span), pa.array([[r == loss_role for r, _ in held]]), pa.array([found.rewritten_at], pa.int32()),
                ], names=["conv_id", "formatted", "roles", "spans", "contents", "loss", "rewritten_at"])

    schema = "conv_id long, formatted string, roles array<string>, spans array<array<long>>, contents array<array<long>>, loss array<boolean>, rewritten_at int"
    placed = rows.mapInArrow(run_all, schema).withColumn("place", F.monotonically_increasing_id())
    return placed.select("conv_id", "place", "formatted", "roles", "spans", "contents", "loss", "rewritten_at")


def digests(formatted: DataFrame) -> DataFrame:
    """Of the output of ``format_conversations``, read back: one row for each conversation.

    conv_id, n_turns, turns_sha256 (of role, newline, text, newline of each turn), loss_chars and loss_sha256 (of the
    unescaped text under the loss mask), formatted_chars, rewritten. A digest needs a conversation's text in order, so
    it passes through one task, as a stream: what is held is a run.
    """
    streamed = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "place")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten"]

        def done() -> pa.RecordBatch:
            n, turns, chars, loss, shown, rewritten = state
            return pa.RecordBatch.from_pylist([dict(zip(names, (now, n, turns.hexdigest(), chars, loss.hexdigest(), shown, rewritten), strict=True))], schema)

        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != now:
                    if state is not None:
                        yield done()
                    now, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                text = row["formatted"]
                back = read_back(text)
                state[0] += len(back)
                for role, said in back:
                    state[1].update(f"{role}\n{said}\n".encode())
                for (start, end), under in zip(row["contents"], row["loss"], strict=True):
                    if under:
                        said = unescape(text[start:end])
                        state[2] += len(said)
                        state[3].update(said.encode())
                state[4] += len(text)
                state[5] |= row["rewritten_at"] >= 0
        if state is not None:
            yield done()

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewritten", pa.bool_())])
    return streamed.mapInArrow(fold, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten boolean")


def probe_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts look like a template's own marks."""
    said: Column = F.lit("\\### Assistant: </turn> ok")
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") + 1).cast("int")).alias("role"), said.alias("text"))
