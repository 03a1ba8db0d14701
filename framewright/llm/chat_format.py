"""Chat formatting by columnar byte assembly.

A turn becomes ``<|turn|>`` role ``<|text|>`` text ``<|end|>``. In roles and texts a backslash goes after every ``<``,
``[`` and backslash, so neither these marks nor those of other templates (``</s>``, ``[INST]``) are left in them, and
leaving out the byte after each of the three gives the text back.

All turns of a batch are assembled at once: the lengths of all segments (marks, roles, texts) are computed, their
cumulative sums are the offsets, and numpy scatters marks and contents into one preallocated buffer, which becomes the
values of an Arrow string column. The loss mask is the assistant's texts, as pairs of first character and end.

Conversations are dealt by their id and sorted by turn; a batch's last conversation waits for the next batch.

Cases: null text and null role are empty; turns with equal numbers are ordered by role and text; repeated rows are turns
each; a null id is one conversation; a null turn goes first; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = b"<|turn|>", b"<|text|>", b"<|end|>"
_ESCAPED = np.zeros(256, bool)
_ESCAPED[list(b"<[\\")] = True

FORMATTED = "conv_id long, n_turns long, formatted string, loss_spans array<long>"
READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _column(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string array; null: empty."""
    values = values.cast(pa.large_binary()).fill_null(b"")
    values = pa.concat_arrays([values])  # without an offset
    offsets = np.frombuffer(values.buffers()[1], np.int64)[: len(values) + 1] if len(values) else np.zeros(1, np.int64)
    data = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _escape(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    extra = np.concatenate([[0], np.cumsum(_ESCAPED[data])])
    out = np.full(len(data) + int(extra[-1]), ord("\\"), np.uint8)
    out[np.arange(len(data)) + extra[:-1]] = data
    return out, offsets + extra[offsets]


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Puts piece k of ``data`` at ``at[k]``."""
    out[np.arange(len(data)) + np.repeat(at - offsets[:-1], np.diff(offsets))] = data


def assemble(conv: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(one string for each run of equal ``conv``, turns in each, firsts and ends of loss spans with the run of each)."""
    n = len(conv)
    role, role_at = _escape(*_column(roles))
    text, text_at = _escape(*_column(texts))
    role_size, text_size = np.diff(role_at), np.diff(text_at)
    sizes = np.empty((n, 5), np.int64)
    sizes[:] = len(TURN), 0, len(TEXT), 0, len(END)
    sizes[:, 1], sizes[:, 3] = role_size, text_size
    ends = np.cumsum(sizes.ravel()).reshape(n, 5)
    starts = ends - sizes
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, mark in ((0, TURN), (2, TEXT), (4, END)):
        out[(starts[:, k, None] + np.arange(len(mark))).ravel()] = np.tile(np.frombuffer(mark, np.uint8), n)
    _scatter(out, starts[:, 1], role, role_at)
    _scatter(out, starts[:, 3], text, text_at)
    first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]])) if n else np.empty(0, np.int64)
    turns = np.diff(np.append(first, n))
    bounds = np.append(starts[first, 0], len(out)).astype(np.int64)
    whole = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(out)])
    # Spans in characters: code points are the bytes that don't continue one.
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    loss = np.array([r == "assistant" for r in roles.to_pylist()], bool)
    run = np.repeat(np.arange(len(first)), turns)[loss]
    origin = points[bounds[run]]
    spans = np.stack([points[starts[loss, 3]] - origin, points[ends[loss, 3]] - origin], axis=1)
    return whole, turns, spans, run


def format_conversations(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns, formatted and loss_spans (first character, end, ...; escapes included) of each conversation."""
    turns = df.select(df[key].cast("long").alias("conv"), df[turn].alias("turn"), df[role].cast("string").alias("role"), df[text].alias("text"))
    dealt = turns.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def made(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks().to_batches()[0]
            ids = rows.column("conv")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            conv = ids.fill_null(0).to_numpy()
            group = np.cumsum(np.concatenate([[False], (conv[1:] != conv[:-1]) | (null[1:] != null[:-1])]))
            whole, turns_in, spans, of = assemble(group, rows.column("role"), rows.column("text"))
            first = np.cumsum(turns_in) - turns_in
            lists = pa.ListArray.from_arrays(pa.array(2 * np.searchsorted(of, np.arange(len(turns_in) + 1)).astype(np.int32)), pa.array(spans.ravel()))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array(turns_in), whole.cast(pa.string()), lists], ["conv_id", "n_turns", "formatted", "loss_spans"])

        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch.column("conv")[-1]
            first = waiting[0].column("conv")[0] if waiting else None
            if waiting and last.as_py() == first.as_py():  # sorted: the batch goes on with the waiting conversation alone
                waiting.append(batch)
                continue
            ids = batch.column("conv").to_pylist()
            cut = len(ids)
            while cut and ids[cut - 1] == last.as_py():
                cut -= 1
            done = [*waiting, *([batch.slice(0, cut)] if cut else [])]
            if done:
                yield made(pa.Table.from_batches(done))
            waiting = [batch.slice(cut)]
        if waiting:
            yield made(pa.Table.from_batches(waiting))

    return dealt.mapInArrow(run, FORMATTED)


def unescape(text: str) -> str:
    out, at = [], 0
    while at < len(text):
        out.append(text[at])
        at += 2 if text[at] in "<[\\" else 1
    return "".join(out)


def _plain(text: str) -> str:
    return unescape(text) if "<" in text or "[" in text or "\\" in text else text


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns = []
    for piece in formatted.split(END.decode())[:-1]:
        role, text = piece[len(TURN) :].split(TEXT.decode())
        turns.append((_plain(role), _plain(text)))
    return turns


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, from the formatted strings alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, whole, spans in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()):
                turns = parse(whole)
                loss = "".join(_plain(whole[a:b]) for a, b in zip(spans[::2], spans[1::2]))
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                rows.append((conv, len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole)))
            names = [x.split()[0] for x in READ_BACK.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, READ_BACK)
