"""Rows of Python values as Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa


def in_batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most ``most``, so that small rows of many inputs travel together."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
