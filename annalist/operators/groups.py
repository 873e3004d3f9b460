"""Functions applied to whole subjects, fed by a stream of sorted Arrow batches.

A partition is sorted by subject, so a subject is complete when the next one starts. Only one subject's rows are held
at a time; a subject that spans batches is carried over.
"""

from __future__ import annotations

import itertools
import tempfile
from collections.abc import Iterator
from decimal import Decimal
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

#: Packed rows: the part they belong to, the range of rows they were sorted in, the place there, an Arrow stream.
CHUNKS = "part int, piece int, place bigint, packed binary"


def _plain(value: Any) -> Any:
    """Wide unsigned integers come as decimals."""
    return int(value) if isinstance(value, Decimal) else value


def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
    """Rows as dicts of Python values."""
    for batch in batches:
        wide = [f.name for f in batch.schema if pa.types.is_decimal(f.type)]
        for row in batch.to_pylist():
            for c in wide:
                row[c] = _plain(row[c])
            yield row


def grouped(rows: Iterator[dict[str, Any]], *keys: str) -> Iterator[tuple[tuple, Iterator[dict[str, Any]]]]:
    """Runs of rows with the same keys."""
    return itertools.groupby(rows, key=lambda r: tuple(r[k] for k in keys))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by part as rows of CHUNKS, each within one part."""
    piece, place = TaskContext.get().partitionId(), 0
    schema = pa.schema([("part", pa.int32()), ("piece", pa.int32()), ("place", pa.int64()), ("packed", pa.binary())])
    for batch in batches:
        for part in pc.unique(batch["part"]).to_pylist():
            own, sink = batch.filter(pc.equal(batch["part"], part)), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(own)
            yield pa.RecordBatch.from_pylist([{"part": part, "piece": piece, "place": place, "packed": sink.getvalue().to_pybytes()}], schema=schema)
            place += 1


def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that chunks packed, in order of piece and place. Chunks come in any order and wait in a file; only
    their places are held."""
    with tempfile.TemporaryFile() as file:
        at = []
        for batch in batches:
            for row in batch.to_pylist():
                at.append((row["piece"], row["place"], file.tell(), len(row["packed"])))
                file.write(row["packed"])
        for *_, begin, size in sorted(at):
            file.seek(begin)
            yield from pa.ipc.open_stream(file.read(size))
