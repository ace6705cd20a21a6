"""Chat formatting by columnar byte assembly.

A batch of conversations becomes three columns of segments for each turn: opening, escaped text, closing. Their
lengths give every segment's place by a running sum, and index arrays scatter all bytes into one preallocated buffer,
which is the data buffer of the Arrow column that is returned. No string is built for a turn or a conversation.

Template. user: `[INST] text [/INST]`; assistant: `<s>text</s>`; system: `<<SYS>>text<</SYS>>`; any other role:
`[ROLE]role[/ROLE]text[END]`. Inside texts and role names a backslash is doubled and every control string gets a
backslash after its first character, so the formatted text has control strings only where turns begin and end. A
backslash that is taken out together with a following backslash turns back into one; any other is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The control strings, and opening and closing of the known roles.
CONTROLS = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[END]"]
ROLES = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[ROLE]", "[/ROLE]", "[END]")
TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|<s>(?P<assistant>.*?)</s>|<<SYS>>(?P<system>.*?)<</SYS>>|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<other>.*?)\[END\]", re.S)
#: Most bytes of one output batch; larger batches are cut in two.
BATCH_BYTES = 64 << 20


def escape(texts: pa.Array) -> pa.Array:
    texts = pc.replace_substring(texts, "\\", "\\\\")
    for control in CONTROLS:
        texts = pc.replace_substring(texts, control, control[0] + "\\" + control[1:])
    return texts


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn begins at {at}")
        kind = m.lastgroup
        turns.append((unescape(m["role"]) if kind == "other" else kind, unescape(m[kind])))
        at = m.end()
    return turns


def lengths_and_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return np.diff(offs), data[offs[0] : offs[-1]]


def scatter(out: np.ndarray, places: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> None:
    """Copy consecutive segments of data to their places in out."""
    ends = np.cumsum(lengths)
    out[np.repeat(places - (ends - lengths), lengths) + np.arange(len(data))] = data


def assemble(bounds: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """formatted, loss spans and number of turns of conversations whose turns lie between bounds."""
    roles, texts = pc.fill_null(roles, ""), escape(pc.fill_null(texts, ""))
    known = pc.fill_null(pc.index_in(roles, pa.array(list(ROLES))), len(ROLES))
    other = pc.binary_join_element_wise(OTHER[0], escape(roles), OTHER[1], "")
    head = pc.if_else(pc.equal(known, len(ROLES)), other, pc.take(pa.array([a for a, _ in ROLES.values()] + [""]), known))
    tail = pc.take(pa.array([b for _, b in ROLES.values()] + [OTHER[2]]), known)
    segments = [lengths_and_bytes(x) for x in (head, texts, tail)]
    sizes = np.stack([n for n, _ in segments], axis=1)
    places = np.concatenate([[0], np.cumsum(sizes.ravel())])
    out = np.empty(places[-1], np.uint8)
    for k, (n, data) in enumerate(segments):
        scatter(out, places[:-1].reshape(-1, 3)[:, k], n, data)
    offsets = places[3 * bounds]
    formatted = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))
    # Loss spans in code points of the conversation: the texts of assistant turns, without opening and closing.
    points = np.stack([pc.utf8_length(x).to_numpy(zero_copy_only=False) for x in (head, texts, tail)], axis=1).astype(np.int64)
    run = np.concatenate([[0], np.cumsum(points.ravel())])
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    begin = run[1:-1:3] - run[3 * bounds[:-1]][owner] if len(owner) else np.zeros(0, np.int64)
    taught = np.asarray(roles) == "assistant"
    spans = pa.StructArray.from_arrays([pa.array(begin[taught]), pa.array((begin + points[:, 1])[taught])], names=["start", "end"])
    per = np.concatenate([[0], np.cumsum(np.bincount(owner[taught], minlength=len(bounds) - 1))])
    return formatted.cast(pa.string()), pa.ListArray.from_arrays(pa.array(per, pa.int32()), spans), pa.array(np.diff(bounds), pa.int64())


def format_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    turns = batch.column(1)
    flat = turns.flatten()
    bounds = np.asarray(turns.offsets) - turns.offsets[0].as_py()
    if flat.nbytes > BATCH_BYTES and batch.num_rows > 1:
        half = batch.num_rows // 2
        yield from format_batch(batch.slice(0, half))
        yield from format_batch(batch.slice(half))
        return
    formatted, spans, n = assemble(bounds.astype(np.int64), flat.field("role"), flat.field("text"))
    yield pa.RecordBatch.from_arrays([batch.column(0), n, formatted, spans], names=[batch.schema.names[0], "n_turns", "formatted", "loss_spans"])


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans (start and end of assistant texts, in code points).

    Turns stand in order of turn_col (nulls first); equal turn numbers in order of role, then text; repeated rows are
    repeated turns. Null texts and roles are empty. A null conv_id is one conversation. A conversation is one value of
    the result, so its turns meet in one row; very long texts are copied whole. Other columns are not read. An empty table gives an empty table.
    """
    grouped = turns.groupBy(F.col(conv_col)).agg(F.sort_array(F.collect_list(F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from format_batch(batch)

    kind = grouped.schema[0].dataType.simpleString()
    return grouped.mapInArrow(run, f"`{conv_col}` {kind}, n_turns bigint, formatted string, loss_spans array<struct<start: bigint, end: bigint>>")
