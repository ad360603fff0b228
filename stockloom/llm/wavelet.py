"""Token output as wavelet-matrix files (after the wavelet matrix of Claude, Navarro and Ordonez, 2015).

One file holds a run of documents: their ids and starts, and their tokens as one bit-plane for each bit of the
largest token. A plane keeps its number of zeros, a count of ones before each 512 bits, and its bits, compressed where
that helps. Access, counting and occurrence lookup use rank and select on the planes; a whole file is
decoded plane by plane.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.text import chunks
from stockloom.llm.tokens import encoder
from stockloom.plans.durable import fresh_path, staged

MAGIC, BLOCK, CUT = b"WMT1", 512, 1 << 16
TOKENS_PER_FILE = 1 << 22
_HEAD = struct.Struct("<4sIQI")
_PLANE = struct.Struct("<QQB")


class WaveletMatrix:
    """A sequence of unsigned integers under rank and select."""

    def __init__(self, n: int, planes: list[tuple[int, np.ndarray, np.ndarray]]):
        self.n, self.planes = n, planes  # planes, highest bit first: zeros, ones before each block, packed bits

    @classmethod
    def build(cls, tokens: np.ndarray) -> WaveletMatrix:
        x = np.asarray(tokens)
        x = x.astype(np.uint16 if not len(x) or x.max() < 65536 else np.uint32)
        planes = []
        for b in range(max(int(x.max()).bit_length() if len(x) else 0, 1) - 1, -1, -1):
            one = (x & x.dtype.type(1 << b)).astype(bool)
            packed = np.packbits(one, bitorder="little")
            zeros = len(x) - int(np.count_nonzero(one))
            planes.append((zeros, cls._counts(packed), packed))
            out = np.empty_like(x)
            for at, low, high, left, right in cls._cuts(one, zeros):
                out[left : left + len(low)], out[right : right + len(high)] = x[at].take(low), x[at].take(high)
            x = out
        return cls(len(x), planes)

    @staticmethod
    def _cuts(one: np.ndarray, zeros: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, int, int]]:
        """A stable partition in pieces that fit a processor's cache: slice, its zeros and ones, and where these go."""
        left, right = 0, zeros
        for at in range(0, len(one), CUT):
            part = one[at : at + CUT]
            low, high = np.flatnonzero(~part), np.flatnonzero(part)
            yield slice(at, at + CUT), low, high, left, right
            left, right = left + len(low), right + len(high)

    @staticmethod
    def _counts(packed: np.ndarray) -> np.ndarray:
        ones = np.bitwise_count(packed)
        step = BLOCK // 8
        full = np.add.reduceat(ones.astype(np.uint32), np.arange(0, len(ones), step)) if len(ones) else np.zeros(0, np.uint32)
        return np.concatenate([[0], np.cumsum(full)]).astype(np.uint32)

    def _ones(self, level: int, at: int) -> int:
        """Ones before position ``at`` of a plane."""
        _, counts, packed = self.planes[level]
        block, byte = at // BLOCK, at // 8
        got = int(counts[block]) + int(np.bitwise_count(packed[block * (BLOCK // 8) : byte]).sum())
        return got + (int(packed[byte]) & ((1 << at % 8) - 1)).bit_count() if at % 8 else got

    def _bit(self, level: int, at: int) -> int:
        return int(self.planes[level][2][at // 8]) >> at % 8 & 1

    def access(self, at: int) -> int:
        """The token at a position."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level, (zeros, _, _) in enumerate(self.planes):
            bit, ones = self._bit(level, at), self._ones(level, at)
            value = value << 1 | bit
            at = zeros + ones if bit else at - ones
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        if token >> len(self.planes):
            return 0, 0
        a, b = 0, end
        for level, (zeros, _, _) in enumerate(self.planes):
            x, y = self._ones(level, a), self._ones(level, b)
            a, b = (zeros + x, zeros + y) if token >> (len(self.planes) - 1 - level) & 1 else (a - x, b - y)
        return a, b

    def rank(self, token: int, end: int) -> int:
        """Occurrences of a token before position ``end``."""
        a, b = self._range(token, min(end, self.n))
        return b - a

    def select(self, token: int, nth: int) -> int:
        """The position of the occurrence number ``nth``, from 0; -1 if there are not so many."""
        a, b = self._range(token, self.n)
        at = a + nth
        if not 0 <= nth < b - a:
            return -1
        for level in range(len(self.planes) - 1, -1, -1):
            zeros = self.planes[level][0]
            one = token >> (len(self.planes) - 1 - level) & 1
            want = at - zeros + 1 if one else at + 1
            lo, hi = 0, self.n  # the smallest prefix with so many of the bit
            while lo < hi:
                mid = (lo + hi) // 2
                have = self._ones(level, mid) if one else mid - self._ones(level, mid)
                lo, hi = (mid + 1, hi) if have < want else (lo, mid)
            at = lo - 1
        return at

    def decode(self) -> np.ndarray:
        """All tokens in order."""
        wide = np.uint16 if len(self.planes) <= 16 else np.uint32
        x = np.zeros(self.n, wide)
        for level in range(len(self.planes) - 1, -1, -1):
            zeros, _, packed = self.planes[level]
            one = np.unpackbits(packed, count=self.n, bitorder="little").astype(bool)
            up = np.empty(self.n, wide)
            x[zeros:] |= wide(1 << (len(self.planes) - 1 - level))
            for at, low, high, left, right in self._cuts(one, zeros):
                part = up[at]
                part[low], part[high] = x[left : left + len(low)], x[right : right + len(high)]
            x = up
        return x.astype(np.uint32)


def write_file(doc_ids: np.ndarray, sizes: np.ndarray, tokens: np.ndarray) -> bytes:
    """The bytes of a file. doc_ids: int64, null as the smallest; sizes: tokens of each document."""
    wm = WaveletMatrix.build(tokens)
    squeeze = zstandard.ZstdCompressor(level=1)
    table = squeeze.compress(np.asarray(doc_ids, "<i8").tobytes() + np.asarray(sizes, "<i8").tobytes())
    out = [_HEAD.pack(MAGIC, len(wm.planes), wm.n, len(doc_ids)), struct.pack("<Q", len(table)), table]
    for zeros, counts, packed in wm.planes:
        raw = packed.tobytes()
        small = squeeze.compress(raw)
        used, kind = (small, 1) if len(small) < len(raw) else (raw, 0)
        out += [_PLANE.pack(zeros, len(used), kind), counts.astype("<u4").tobytes(), used]
    return b"".join(out)


def read_file(data: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """``(doc_ids, sizes, matrix)`` of a file's bytes."""
    magic, levels, n, docs = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a wavelet-matrix file")
    spread = zstandard.ZstdDecompressor()
    at = _HEAD.size
    (size,) = struct.unpack_from("<Q", data, at)
    table = np.frombuffer(spread.decompress(data[at + 8 : at + 8 + size]), "<i8")
    at += 8 + size
    planes = []
    for _ in range(levels):
        zeros, size, kind = _PLANE.unpack_from(data, at)
        at += _PLANE.size
        blocks = -(-(-(-n // 8)) // (BLOCK // 8)) + 1
        counts = np.frombuffer(data, "<u4", blocks, at)
        at += 4 * blocks
        raw = data[at : at + size]
        at += size
        planes.append((zeros, counts, np.frombuffer(spread.decompress(raw) if kind else raw, np.uint8)))
    return table[:docs], table[docs:], WaveletMatrix(n, planes)


def _put(folder: str, name: str, data: bytes) -> None:
    """Writes a file whole or not at all: a second try of a task replaces it by the same bytes."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    part = f"{path}/_{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(part) as out:
        out.write(data)
    where.move(part, f"{path}/{name}")


NULL_ID = np.iinfo(np.int64).min


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", per_file: int = TOKENS_PER_FILE) -> DataFrame:
    """Writes the token ids of whole texts (null: none), each with ``end_id``, in ascending id order to files in ``folder``.

    Returns one row for each file, written already: file, part, seq, docs, tokens, start (tokens in the files before it).
    A file is closed at ``per_file`` tokens, so it holds at most that many beside its last document. Rows with equal ids
    are ordered by text; null ids come first. An empty table gives no files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, last, part = encoder(tokenizer, True), np.uint32(end_id).tobytes(), TaskContext.get().partitionId()
        ids, held, size, seq = [], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal ids, held, size, seq
            name = f"part-{part:06d}-{seq:06d}.wm"
            _put(folder, name, write_file(np.array(ids, np.int64), np.array([len(x) // 4 for x in held]), np.frombuffer(b"".join(held), "<u4")))
            row = pa.RecordBatch.from_pylist([{"file": name, "part": part, "seq": seq, "docs": len(ids), "tokens": size}])
            ids, held, size, seq = [], [], 0, seq + 1
            return row

        for own, raw in chunks(batches, 1, 6_000_000):
            for i, got in zip(own.column(0).to_pylist(), e.encode(raw), strict=True):
                ids.append(NULL_ID if i is None else i)
                held.append(got + last)
                size += len(got) // 4 + 1
                if size >= per_file:
                    yield close()
        if ids:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    sorted_rows = rows.repartitionByRange(F.col("_id").asc_nulls_first()).sortWithinPartitions(F.col("_id").asc_nulls_first(), "text")
    files = staged(sorted_rows.mapInArrow(run, "file string, part long, seq long, docs long, tokens long"), "files")
    parts = files.groupBy("part").agg(F.sum("tokens").alias("t"))
    before = parts.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("base"))  # a row for each partition
    within = F.sum("tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("tokens")
    return staged(files.withColumn("_in", within).join(before, "part").select("file", "part", "seq", "docs", "tokens", (F.col("base") + F.col("_in")).alias("start")), "manifest")


def read_tokens(files: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Reads files back: id, start, n_tokens, ids_crc32 and, if asked for, ids, for each document in them."""
    spark = files.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                doc, size, wm = read_file(content.as_py())
                raw = wm.decode().astype("<u4").tobytes()
                stop = np.cumsum(size)
                own = [raw[4 * a : 4 * b] for a, b in zip((stop - size).tolist(), stop.tolist(), strict=True)]
                cols = [pa.array([path.as_py().rsplit("/", 1)[-1]] * len(doc)), pa.array(doc, mask=doc == NULL_ID), pa.array(stop - size), pa.array(size), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(own, pa.binary())] * with_ids, ["file", "_id", "at", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    schema = "file string, _id long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    if not files.take(1):
        return spark.createDataFrame([], schema.replace("file string, ", "").replace("at long", "start long"))
    got = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder).select("path", "content").mapInArrow(run, schema)
    return got.join(files.select("file", F.col("start").alias("_start")), "file").select("_id", (F.col("_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Writes the files and reads them back; see ``write_tokens`` and ``read_tokens``."""
    folder = folder or fresh_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer, end_id, id_col, text_col), folder).withColumnRenamed("_id", id_col)
