"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with character offsets, and the sorted spans of its assistant texts
are intersected with the sorted token spans by binary search. Control tokens stand right around every text, so no
token straddles a span. Control strings inside roles and texts are escaped reversibly.

Rows are dealt by conversation and sorted by turn; a task reads them as a stream and closes a segment at a turn's end
once it has SEGMENT_CHARS characters, so a conversation of any number of turns takes bounded memory. Since control
tokens end each turn, the segments' tokens are those of the whole.

Defined results: null roles and texts are empty; turns go by turn (null first), then role, then text, and repeated
rows are repeated turns; rows without a conv_id are one conversation; a turn is never cut, so a very long one is a
segment of its own, encoded whole; a conversation without turns has no row; an empty table gives no rows; other columns
are dropped.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm import vocabulary
from annalist.llm.arrays import slices

VOCABULARY = "byte_bpe_50k.json"
TURN, TEXT, END = CONTROLS = ("<|turn|>", "<|text|>", "<|end|>")
SEGMENT_CHARS = 1 << 20
LEARNED_ROLE = "assistant"
SCHEMA = "conv_id bigint, segment bigint, n_turns bigint, formatted string, input_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"
_ARROW = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("input_ids", pa.list_(pa.int32())), ("token_starts", pa.list_(pa.int32())), ("token_ends", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_()))])

_OPENING = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)


def escape(text: str) -> str:
    """No control string is left: every `<|`, however many backslashes it has inside, gets one more."""
    return _OPENING.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "|" in text else text


@functools.lru_cache(maxsize=2)
def tokenizer(data: bytes):
    """The tokenizer with the control tokens, reporting offsets that keep leading blanks."""
    from tokenizers import AddedToken, Tokenizer, processors

    out = Tokenizer.from_str(data.decode())
    out.post_processor = processors.ByteLevel(trim_offsets=False)
    out.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in CONTROLS])
    return out


def render(turns: list[tuple[str, str]], role: str = LEARNED_ROLE) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans of the texts to learn."""
    out, spans, size = [], [], 0
    for who, text in turns:
        head, body = f"{TURN}{escape(who)}{TEXT}", escape(text)
        if who == role and body:
            spans.append((size + len(head), size + len(head) + len(body)))
        size += len(head) + len(body) + len(END)
        out += (head, body, END)
    return "".join(out), spans


def encode(formatted: str, spans: list[tuple[int, int]], encoder) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token ids, starts, ends and mask; a token is learned if it lies inside a span."""
    tokens = encoder.encode(formatted, add_special_tokens=False)
    offsets = np.fromiter(itertools.chain.from_iterable(tokens.offsets), np.int32, 2 * len(tokens)).reshape(-1, 2)
    starts, ends = offsets[:, 0], offsets[:, 1]
    mask = np.zeros(len(starts), dtype=bool)
    if spans:
        low = np.searchsorted(starts, [s for s, _ in spans], "left")
        high = np.searchsorted(ends, [e for _, e in spans], "right")
        for a, b in zip(low, high, strict=True):
            mask[a:b] = True
    return np.array(tokens.ids, np.int32), starts, ends, mask


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts of a formatted text."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def read_learned(formatted: str, starts: list[int], ends: list[int], mask: list[bool]) -> str:
    """All text under the mask, run of tokens by run of tokens, unescaped."""
    starts, ends, mask = np.asarray(starts, np.int64), np.asarray(ends, np.int64), np.asarray(mask, bool)
    at = np.flatnonzero(mask)
    if not len(at):
        return ""
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = np.diff(at) != 1
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(at)) - 1
    return "".join(unescape(formatted[starts[at[a]] : ends[at[b]]]) for a, b in zip(heads, tails, strict=True))


def format_conversations(conversations: DataFrame, role: str = LEARNED_ROLE, name: str = VOCABULARY, folder: str = vocabulary.FOLDER) -> DataFrame:
    """Segments of formatted conversations: conv_id, segment (from 0; most conversations have one), n_turns,
    formatted, input_ids, token_starts and token_ends (characters of the segment), loss_mask. A conversation's
    segments stand in order in one partition."""
    shared = vocabulary.share(conversations.sparkSession, name, folder)
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(shared.value)
        done: list[tuple] = []

        def close(conv, segment, turns):
            formatted, spans = render(turns, role)
            done.append((conv, segment, len(turns), formatted, *encode(formatted, spans, encoder)))

        current, segment, turns, size, held = (None,), 0, [], 0, 0
        for part in slices(batches, "text"):
            for conv, who, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if (conv,) != current or size >= SEGMENT_CHARS:
                    if turns:
                        close(*current, segment, turns)
                        held += size
                    segment = segment + 1 if (conv,) == current else 0
                    current, turns, size = (conv,), [], 0
                    if held >= SEGMENT_CHARS:
                        yield _batch(done)
                        done.clear()
                        held = 0
                turns.append((who, text))
                size += len(who) + len(text) + 24
        if turns:
            close(*current, segment, turns)
        if done:
            yield _batch(done)

    return dealt.mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of plain values and numpy arrays as a batch, without Python objects for the arrays' values."""
    columns = []
    for values, kind in zip(zip(*rows, strict=True), _ARROW.types, strict=True):
        if pa.types.is_list(kind):
            edges = np.cumsum([0, *map(len, values)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(values), kind.value_type)))
        else:
            columns.append(pa.array(values, kind))
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)
