"""Chat formatting by incremental rendering of a black-box template.

A template is a function from turns to text; nothing else of it is known. The prefixes of a conversation's turns are
rendered one after the other, and comparing each output with the one before gives the turn's piece. Rendering a
turn with two other texts in its place shows what of the piece is the template's and what is the text, so the loss
mask needs no knowledge of markers. An output that doesn't begin with the one before shows a template that rewrites
its history; the piece then says how much of the earlier output it keeps, so outputs stay whole.

Long conversations are cut into chunks of turns, each rendered after the last ``context`` turns before it, so no task
holds a conversation. A template whose output for a turn depends on more than that many turns before it needs a
larger context.

The output is one row per turn in order: (conv_id, at, role, piece, keep, loss_start, loss_end, rewrites). The text of
a conversation is built by keeping ``keep`` characters of what there is (null: all) and adding ``piece``; the mask is
the part of the piece between ``loss_start`` and ``loss_end``, in code points, both null without loss.

Null texts and roles are empty. Rows of one turn number go by role, then text; null turns come first; repeated rows
are turns of their own; null conversation ids are one conversation. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaquery.functions.ordered import ordered_scan
from mediaquery.llm.common import to_batch

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]
#: Turns of a chunk; turns before a chunk that its rendering sees; turn numbers of a bin of the ranking.
CHUNK, CONTEXT, BIN = 32, 2, 4_096
#: Texts that stand in for a turn's own, with nothing in common.
_PROBES = ("\ue000", "\ue001")
OPEN, CLOSE = "### ", " </turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>")
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    """Backslashes, every # of ### and the < of </turn> get a backslash, so no control string is left."""
    return _CONTROL.sub(lambda m: r"\#\#\#" if m[0] == "###" else "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def template(turns: Sequence[Turn]) -> str:
    """``### role: text </turn>`` and a line break for every turn."""
    return "".join(f"{OPEN}{escape(role).replace(':', chr(92) + ':')}: {escape(text)}{CLOSE}" for role, text in turns)


def parse(formatted: str) -> list[Turn]:
    """The turns of a text made by ``template``."""
    found, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}: {formatted[at : at + 40]!r}")
        found.append((unescape(m[1]), unescape(m[2][:-1])))  # the blank before the mark is the template's
        at = m.end()
    return found


def common_prefix(a: str, b: str) -> int:
    """Length of the longest common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def text_span(render: Template, before: Sequence[Turn], turn: Turn, piece: str) -> tuple[int, int] | None:
    """Where the turn's text stands in its piece: what two other texts leave alike around them is the template's."""
    role, _ = turn
    base = render(before)
    first, second = (render([*before, (role, x)]) for x in _PROBES)
    if not (first.startswith(base) and second.startswith(base)):
        return None
    first, second = first[len(base) :], second[len(base) :]
    head = common_prefix(first, second)
    tail = common_prefix(first[head:][::-1], second[head:][::-1])
    if len(piece) < head + tail or piece[:head] != first[:head] or (tail and piece[-tail:] != first[-tail:]):
        return None
    return head, len(piece) - tail


def spans(turns: Sequence[Turn], render: Template = template, loss: Sequence[str] = ("assistant",), skip: int = 0) -> Iterator[tuple]:
    """(piece, keep, loss_start, loss_end, rewrites) of each turn from the ``skip``-th on.

    A turn whose text cannot be found in its piece, or after which history was rewritten, has no loss.
    """
    before = render(turns[:skip])
    for k in range(skip, len(turns)):
        now = render(turns[: k + 1])
        rewrites = not now.startswith(before)
        keep = common_prefix(before, now) if rewrites else len(before)
        piece = now[keep:]
        span = text_span(render, turns[:k], turns[k], piece) if turns[k][0] in loss and not rewrites else None
        yield piece, keep if rewrites else None, *(span or (None, None)), rewrites
        before = now


_OUT = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("role", pa.string()), ("piece", pa.string()), ("keep", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("rewrites", pa.bool_())])
_OUT_DDL = "conv_id long, at long, role string, piece string, keep long, loss_start long, loss_end long, rewrites boolean"


def format_turns(turns: DataFrame, render: Template = template, loss: Sequence[str] = ("assistant",), chunk: int = CHUNK, context: int = CONTEXT, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The formatted pieces of every conversation. With a rewriting template ``keep`` counts from the chunk's context on."""
    if not 0 <= context <= chunk:
        raise ValueError("the context is at most a chunk")
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # windows and joins want a key without nulls
    keyed = rows.withColumns({"key": F.coalesce("conv_id", F.lit(0)), "none": F.col("conv_id").isNull()})
    ranked = ordered_scan(keyed, ["key", "none"], [F.asc_nulls_first("turn"), F.col("role"), F.col("text")], F.coalesce(F.floor(F.col("turn") / BIN), F.lit(-(1 << 60))), rank="n")
    at = F.col("n") - 1
    home = F.floor(at / chunk).cast("long")
    copies = F.array_compact(F.array(home, F.when(at % chunk >= chunk - context, home + 1)))
    dealt = ranked.select("conv_id", at.alias("at"), "role", "text", F.explode(copies).alias("chunk"))
    by = ["conv_id", "chunk", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            own = next((k for k, x in enumerate(group) if x[0] // chunk == key[1]), None) if group else None
            if own is not None:  # else copies that no turn of the next chunk follows
                found = spans([x[1] for x in group], render, loss, own)
                yield to_batch([(key[0], n, t[0], *x) for (n, t), x in zip(group[own:], found, strict=True)], _OUT)

        for batch in batches:
            for c, n, r, t, k in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if key != (c, k):
                    yield from flush()
                    key, group = (c, k), []
                group.append((n, (r, t)))
        yield from flush()

    return dealt.repartition("conv_id", "chunk").sortWithinPartitions(*by).mapInArrow(run, _OUT_DDL)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites", pa.bool_())])


def digests(pieces: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites) read back from pieces made by ``template``.

    Pieces of a conversation pass in order through one task that holds one piece and the running digests. A digest
    of a whole conversation can't be split, so a hot conversation takes one task as long as hashing its text takes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []
        for batch in batches:
            for conv, _, piece, start, end, rewrites in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if state is None or conv != key:
                    if state:
                        done.append(_finished(key, state))
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                for role, text in parse(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    said = unescape(piece[start:end])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(piece)
                state[5] = state[5] or rewrites
            if done:
                yield to_batch(done, _DIGEST)
                done = []
        if state:
            yield to_batch([_finished(key, state)], _DIGEST)

    ordered = pieces.select("conv_id", "at", "piece", "loss_start", "loss_end", "rewrites").repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean")


def _finished(key, state: list) -> tuple:
    return key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]
