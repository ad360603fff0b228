"""Small helpers on raw texts that several operators share.

A word is a run of characters other than space and U+0009..U+000D, which is what ``bytes.split`` cuts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def held_out(id_col: str | Column) -> Column:
    """True for the third of the ids that no classifier may learn from."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def chunks(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches whose texts have about ``most`` bytes together (or one longer text); null is empty."""
    for batch in batches:
        texts, at = batch.column(column).cast(pa.large_binary()), 0
        while at < batch.num_rows:
            got, size = [], 0
            while at + len(got) < batch.num_rows and (size < most or not got):
                got.append(texts[at + len(got)].as_py() or b"")
                size += len(got[-1])
            yield batch.slice(at, len(got)), got
            at += len(got)


def ngram_counts(text: bytes, width: int, orders: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    """Counts of hashed byte n-grams in ``width`` (a power of two) bins."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    shift = np.uint32(32 - (width - 1).bit_length())
    out = np.zeros(width, np.float32)
    h = np.zeros(len(b), np.uint32)
    for i in range(max(orders)):
        if len(b) <= i:
            break
        h = h[: len(b) - i] * np.uint32(0x01000193) + b[i:] + np.uint32(1)
        if i + 1 in orders:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)
            out += np.bincount(mixed >> shift, minlength=width)
    return out
