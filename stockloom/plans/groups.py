"""Work on many small groups at the price of a few Arrow batches, where a grouped map would pay for each group.

Rows are dealt and sorted by the keys; groups are cut from the Arrow stream where the keys change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that end where a group ends, with the bounds of their groups."""
    held: list[pa.RecordBatch] = []

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    def cuts(b: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(max(b.num_rows - 1, 0), bool)
        for k in keys:
            c = b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            new |= c[1:] != c[:-1]
        return np.flatnonzero(new) + 1

    for batch in batches:
        if not batch.num_rows:
            continue
        edge = joined([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]) if held else None
        at = cuts(batch)
        if held and not len(at) and not len(cuts(edge)):
            held.append(batch)  # one group goes on
            continue
        b = joined([*held, batch])
        at = cuts(b)
        if len(at):
            yield b.slice(0, int(at[-1])), np.concatenate([[0], at])
            held = [b.slice(int(at[-1]))]
        else:
            held = [b]
    if held:
        b = joined(held)
        yield b, np.array([0, b.num_rows])


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys)
