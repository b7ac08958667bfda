r"""Conversations as training text, with a grammar that a deterministic parser reads back.

A formatted conversation is a series of turns::

    ### <role>: <escaped text></turn>\n

Grammar: ``turn := "### " role ": " body "</turn>\n"``. Within a body (and a role) a backslash goes before every
backslash and before every control string (``###``, ``</turn>``); a role also escapes its colons. So an unescaped
control string only ever is a mark, and un-escaping drops one backslash before the character it protects. Each
turn is parsed again and compared with its source; should a plain template ever differ, the body is escaped harder
(a backslash before each character that a control string starts with) until it is identical.

Turns are escaped where they lie, one by one; conversations are then gathered by a sort within hash partitions of
``conv_id`` and streamed. The reader gets a conversation's joined text in pieces of PIECE code points, cut wherever they end, and
finds the turns by the grammar alone; so no conversation is held in memory as a whole, whatever its length.

Defined cases: null text: empty; null role: the empty role; a null ``conv_id`` is a conversation of its own; rows of
one turn are ordered by (turn, role, text), nulls first, and repeated rows are each a turn; an empty table has no
conversations; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbisplit.llm.common import bounded_batches

#: Code points of joined text that are read at once.
PIECE = 1 << 20
#: Control strings of the template.
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
CONTROL = re.compile(r"\\|###|</turn>")
HARD = re.compile(r"[\\#<]")
TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\#<]++|\\.|#(?!##)|<(?!/turn>))*+)</turn>\n", re.S)


def escape(text: str, hard: bool = False) -> str:
    return (HARD if hard else CONTROL).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turn(role: str, text: str) -> str:
    """One rendered turn, proved to parse back to (role, text)."""
    for hard in (False, True):
        out = f"{OPEN}{escape(role, hard).replace(':', chr(92) + ':')}{MIDDLE}{escape(text, hard)}{CLOSE}"
        m = TURN.fullmatch(out)
        if m and (unescape(m[1]), unescape(m[2])) == (role, text):
            return out
    raise ValueError("a turn does not survive the round trip")


def parse_spans(rendered: str) -> list[tuple[str, int, int]]:
    """(role, start and end of the escaped body) of each turn; anything that is not a turn is an error."""
    found, at = [], 0
    while at < len(rendered):
        m = TURN.match(rendered, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        found.append((unescape(m[1]), m.start(2), m.end(2)))
        at = m.end()
    return found


def parse(rendered: str) -> list[tuple[str, str]]:
    return [(role, unescape(rendered[a:b])) for role, a, b in parse_spans(rendered)]


def recut(parts: Iterable[str], size: int = PIECE) -> Iterator[str]:
    """The joined text in pieces of one size."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part)
        if n >= size:
            text = "".join(held)
            whole = n - n % size
            yield from (text[i : i + size] for i in range(0, whole, size))
            held, n = [text[whole:]], n - whole
    if n:
        yield "".join(held)


def parse_stream(pieces: Iterable[str]) -> Iterator[tuple[str, str]]:
    """The turns of a text that comes in pieces. A turn ends at its first unescaped close, so none is read before it is whole."""
    rest = ""
    for piece in pieces:
        rest, at = rest + piece, 0
        while m := TURN.match(rest, at):
            yield unescape(m[1]), unescape(m[2])
            at = m.end()
        rest = rest[at:]
    if rest:
        raise ValueError("a text ends within a turn")


TURN_SCHEMA = "conv_id long, turn long, role string, text string, rendered string"


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, rendered), a row per turn, in place."""
    bounded_batches(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roles, texts = b.column("role").to_pylist(), b.column("text").to_pylist()
            rendered = [format_turn(r or "", t or "") for r, t in zip(roles, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("turn"), b.column("role"), b.column("text"), pa.array(rendered, pa.string())],
                ["conv_id", "turn", "role", "text", "rendered"],
            )

    typed = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    return typed.mapInArrow(run, TURN_SCHEMA)


def ordered_turns(turns: DataFrame) -> DataFrame:
    """Turns of a conversation side by side, in order; partitions can be streamed."""
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(conversations: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Per conversation: the rendered text and the loss spans (start, end), in code points of the rendered text.

    This gathers the text of a conversation in one row; ``digests`` streams instead and has no such bound.
    """
    bounded_batches(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, rows in _streamed(batches):
            parts, spans, at = [], [], 0
            for _, _, rendered in rows:
                for role, a, b in parse_spans(rendered):
                    if role in loss_roles:
                        spans.append({"start": at + a, "end": at + b})
                parts.append(rendered)
                at += len(rendered)
            yield pa.RecordBatch.from_pylist(
                [{"conv_id": conv, "formatted": "".join(parts), "loss_spans": spans}],
                schema=pa.schema(
                    [("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                ),
            )

    return ordered_turns(format_turns(conversations)).mapInArrow(
        run, "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>"
    )


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple[str | None, str | None, str]]]]:
    from itertools import groupby

    rows = (
        row
        for b in batches
        for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text", "rendered")), strict=True)
    )
    for conv, group in groupby(rows, key=lambda r: r[0]):
        yield conv, (r[1:] for r in group)


def _rendered(rows: Iterator[tuple[str | None, str | None, str]], source: deque[tuple[str, str]], sizes: list[int]) -> Iterator[str]:
    for role, text, rendered in rows:
        source.append((role or "", text or ""))
        sizes.append(len(rendered))
        yield rendered


def digests(conversations: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Per conversation what a reader of its joined text finds: turns and loss text are parsed from it, not taken from the source,
    and then compared with it."""
    bounded_batches(conversations.sparkSession)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "round_trip"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for conv, rows in _streamed(batches):
            turns, loss, n, chars, sizes, same = hashlib.sha256(), hashlib.sha256(), 0, 0, [], True
            source: deque[tuple[str, str]] = deque()  # turns that are rendered and not read yet
            for r, t in parse_stream(recut(_rendered(rows, source, sizes))):
                same = same and bool(source) and source.popleft() == (r, t)
                n += 1
                turns.update(f"{r}\n{t}\n".encode())
                if r in loss_roles:
                    chars += len(t)
                    loss.update(t.encode())
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), sum(sizes), same and not source))
            if len(out) >= 5000:
                yield packed(out)
                out = []
        if out:
            yield packed(out)

    return ordered_turns(format_turns(conversations)).mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, round_trip boolean",
    )
