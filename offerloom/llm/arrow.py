"""Small helpers for operators that work on Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def slices(batches: Iterator[pa.RecordBatch], column: str, budget: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cut batches into pieces of about `budget` characters of `column` (one row at least).

    Long and short texts may alternate, so the bound is on characters and not on
    rows; what a piece needs in memory is then independent of the batch size.
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
        begin, held = 0, 0
        for i, text in enumerate(texts):
            held += len(text or "") + 16
            if held >= budget:
                yield batch.slice(begin, i + 1 - begin), texts[begin : i + 1]
                begin, held = i + 1, 0
        if begin < len(texts):
            yield batch.slice(begin), texts[begin:]


def fold_key(column) -> "Column":  # noqa: F821
    """crc32 of an id as text: what decides which labelled rows are held out."""
    from pyspark.sql import functions as F

    return F.crc32(column.cast("string"))
