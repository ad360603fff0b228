"""Which tokens of two tokenizers stand for the same bytes, over a whole corpus.

1. Texts are encoded by both tokenizers; places where a token of either one ends cut them into groups, and the two tokens that end
   there are linked. Texts are kept in shards of some megabytes: the numbers and group digest of each text, and its links.
2. Link pairs are packed in one int64, the id of the second tokenizer above that of the first. Each task counts its distinct
   pairs (``np.unique``); partial counts are dealt out by ranges of the key and sorted, and a run-length sum of the sorted stream
   writes the totals as sorted files, each a part of one global order. The highest total of each second id falls out on the way.
3. Shards look their distinct pairs up in those files by ``searchsorted``; files are memory-mapped where the shared folder is
   mounted and read one at a time elsewhere.

The files and highest totals are bounded by the vocabularies, not by the corpus.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.text import chunks
from stockloom.llm.tokens import _BYTE_LETTERS, _plain
from stockloom.llm.wavelet import _put
from stockloom.plans.durable import fresh_path, staged

SHARD_BYTES = 2_000_000
MOST_PARTS = 200_000
PARTIAL = 2_000_000  # distinct pairs that a task counts before it passes them on
PAIRS_PER_FILE = 2_000_000
LOOKED_UP = 1_000_000  # links that a task looks up at a time
SPACE_MARK = "▁"


class Pair:
    """Both tokenizers, the bytes of their tokens, and the ids of parts of texts that stand alone."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(first), sentencepiece.SentencePieceProcessor(model_file=second)
        self.a.encode_special_tokens = True
        letters = {chr(x): b for b, x in _BYTE_LETTERS.items()}
        decoded = lambda t: bytes(letters.get(c, ord(c) & 0xFF) for c in t)
        vocabulary = self.a.get_vocab()
        first_bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            first_bytes[i] = decoded(t)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        second_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.bytes = first_bytes, second_bytes
        self.sizes = tuple(np.array([len(x) for x in side], np.int64) for side in self.bytes)
        self.names = [b"%d%b" % (i, c) for side, ends in zip(self.bytes, (b",|", b",;"), strict=True) for i in range(len(side)) for c in (ends[:1], ends[1:])]
        # Texts are cut before single spaces and line breaks only if no token of either side can reach over such a place.
        mark = self.b.piece_to_id(SPACE_MARK)
        regular = '"type":"ByteLevel","add_prefix_space":false' in self.a.to_str() and self.a.normalizer is None
        whole_marks = not any(SPACE_MARK in p.lstrip(SPACE_MARK) or "\n" in p for p in pieces)
        self.cut = regular and whole_marks and self.b.encode("\na")[:1] == [mark] and self.b.encode("a b") == self.b.encode("a") + self.b.encode("b")
        self.known: dict[bytes, tuple[bytes, bytes] | None] = {}

    def _encoded(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """The ids of both sides for each text with a space before it; None where their bytes are not those of the text."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        b, out = self.b.encode(texts, num_threads=1), []
        for t, x, y in zip(texts, a, b, strict=True):
            raw = b" " + t.encode()
            same = all(b"".join(map(side.__getitem__, ids)) == raw for side, ids in zip(self.bytes, (x, y), strict=True))
            out.append((np.array(x, np.int32).tobytes(), np.array(y, np.int32).tobytes()) if same else None)
        return out

    def _learn(self, parts: list[bytes]) -> None:
        """A part follows a space, or begins with a line break, before which the space of a lone text is dropped again."""
        for at in range(0, len(parts), 5000):
            some = parts[at : at + 5000]
            for p, got in zip(some, self._encoded([p.decode() for p in some]), strict=True):
                if got and p[:1] == b"\n":
                    x, y = got
                    own = self.bytes[0][np.frombuffer(x, np.int32, 1)[0]], self.bytes[1][np.frombuffer(y, np.int32, 1)[0]]
                    got = (x[4:], y[4:]) if own == (b" ", b" ") else None
                self.known[p] = got

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, bytes] | None]:
        """As ``_encoded`` for UTF-8 texts; parts that stand alone are encoded once. Empty texts give None."""
        out: list[tuple[bytes, bytes] | None] = [None] * len(texts)
        text = [t.decode("utf-8", "replace") for t in texts]
        own = [i for i, t in enumerate(text) if t and self.cut and _plain(t)]
        if len(self.known) > MOST_PARTS:
            self.known.clear()
        lists = pc.split_pattern(pa.array([text[i].replace("\n", " \n") for i in own], pa.string()), " ")
        coded = lists.flatten().view(pa.binary()).dictionary_encode()
        parts = coded.dictionary.to_pylist()
        self._learn([p for p in parts if p not in self.known])
        ids = [self.known[p] for p in parts]
        at, stops = coded.indices.to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        bad = np.array([x is None for x in ids], bool)[at] if len(at) else np.empty(0, bool)
        sides = []
        for side in (0, 1):
            size = np.array([len(x[side]) // 4 if x else 0 for x in ids], np.int64)
            flat = np.frombuffer(b"".join(x[side] for x in ids if x), np.int32)
            many = size[at] if len(at) else size
            stop = np.concatenate([[0], np.cumsum(many)])
            start = (np.cumsum(size) - size)[at] if len(at) else size
            sides.append((flat[np.arange(stop[-1]) + np.repeat(start - stop[:-1], many)].tobytes(), (4 * stop[stops]).tolist()))
        whole = {i for n, i in enumerate(own) if bad[stops[n] : stops[n + 1]].any()}
        (x, p), (y, q) = sides
        for n, i in enumerate(own):
            out[i] = x[p[n] : p[n + 1]], y[q[n] : q[n + 1]]
        odd = [i for i, t in enumerate(text) if t and (i in whole or out[i] is None)]
        for i, got in zip(odd, self._encoded([text[i] for i in odd]), strict=True):
            out[i] = got
        return out

    def aligned(self, encoded: list[tuple[bytes, bytes] | None]) -> tuple[list[int], list[int], np.ndarray, list[str], np.ndarray, np.ndarray]:
        """``(n_a, n_b, n_links, groups_sha256, a, b)``: of each text, and the ids that are linked in order."""
        count = [[len(x[side]) // 4 if x else 0 for x in encoded] for side in (0, 1)]
        ids = [np.frombuffer(b"".join(x[side] for x in encoded if x), np.int32) for side in (0, 1)]
        a_end, b_end = (np.cumsum(size[x]) for size, x in zip(self.sizes, ids, strict=True))
        at = np.searchsorted(b_end, a_end)
        a_cut = b_end[np.minimum(at, len(b_end) - 1)] == a_end if len(b_end) else np.empty(0, bool)
        b_cut = np.zeros(len(b_end), bool)
        b_cut[at[a_cut]] = True
        last = np.flatnonzero(a_cut), np.flatnonzero(b_cut)  # of each group, on either side
        group = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
        code = np.empty(len(a_end) + len(b_end), np.int64)
        if len(code):
            code[np.arange(len(a_end)) + np.concatenate([[0], last[1] + 1])[group[0]]] = 2 * ids[0] + a_cut
            code[np.arange(len(b_end)) + (last[0] + 1)[group[1]]] = 2 * (ids[1] + len(self.bytes[0])) + b_cut
        names, stop, digests = list(map(self.names.__getitem__, code.tolist())), 0, []
        for n, m in zip(*count, strict=True):
            start, stop = stop, stop + n + m
            digests.append(hashlib.sha256(b"".join(names[start:stop])[:-1]).hexdigest() if n else "")
        ends = np.cumsum(count[0])
        links = np.concatenate([[0], np.cumsum(a_cut)])[np.concatenate([[0], ends])]
        return *count, np.diff(links), digests, ids[0][last[0]], ids[1][last[1]]


@lru_cache(2)
def _pair(first: str, second: str) -> Pair:
    """One for each worker process, so that parts stay known from task to task."""
    return Pair(first, second)


_SHARD = "ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_links array<bigint>, digests array<string>, links binary"


def token_links(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of about ``SHARD_BYTES`` of text, or one longer text: numbers and digests of its texts, and their links packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, squeeze = _pair(first, second), zstandard.ZstdCompressor(level=1)
        for own, raw in chunks(batches, 1, SHARD_BYTES):
            n_a, n_b, links, digests, a, b = pair.aligned(pair.encode(raw))
            wide = "<u2" if max(map(len, pair.bytes)) <= 65536 else "<u4"
            packed = squeeze.compress(wide.encode() + a.astype(wide).tobytes() + b.astype(wide).tobytes())
            lists = [pa.array([c], pa.list_(t)) for c, t in ((own.column(0).to_pylist(), pa.int64()), (n_a, pa.int64()), (n_b, pa.int64()), (links.tolist(), pa.int64()), (digests, pa.string()))]
            yield pa.RecordBatch.from_arrays([*lists, pa.array([packed], pa.binary())], ["ids", "n_a", "n_b", "n_links", "digests", "links"])

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _SHARD)


def _keys(packed: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    a, b = np.frombuffer(raw, raw[:3].decode(), offset=3).reshape(2, -1).astype(np.int64)
    return b << 32 | a


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the distinct pairs of a task's shards."""
    held, size = [], 0
    for batch in batches:
        for packed in batch.column(0):
            u, n = np.unique(_keys(packed.as_py()), return_counts=True)
            held.append((u, n.astype(np.int64)))
            size += len(u)
            if size > 2 * PARTIAL:
                held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > PARTIAL:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, held[0])), ["key", "n"])
                    held, size = [], 0
    if held:
        u, n = _summed(*map(np.concatenate, zip(*held, strict=True)))
        for i in range(0, len(u), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(u[i : i + (1 << 18)]), pa.array(n[i : i + (1 << 18)])], ["key", "n"])


def count_files(shards: DataFrame, folder: str) -> DataFrame:
    """Writes the totals of all pairs to sorted files in ``folder``: keys, then totals, as little-endian int64.

    Returns ``(file, first, last, seconds, most)`` for each file: its range of keys, and for each second id in it the highest total there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, rows = TaskContext.get().partitionId(), 0, []
        keys, n = np.empty(0, np.int64), np.empty(0, np.int64)

        def close(many: int) -> None:
            nonlocal keys, n, seq
            own, total, keys, n = keys[:many], n[:many], keys[many:], n[many:]
            name = f"pairs-{part:06d}-{seq:06d}.bin"
            _put(folder, name, own.astype("<i8").tobytes() + total.astype("<i8").tobytes())
            second = own >> 32
            cut = np.flatnonzero(np.diff(second, prepend=-1))
            rows.append({"file": name, "first": int(own[0]), "last": int(own[-1]), "seconds": second[cut].tolist(), "most": np.maximum.reduceat(total, cut).tolist()})
            seq += 1

        for batch in batches:
            k, m = (c.to_numpy(zero_copy_only=False) for c in (batch.column(0), batch.column(1)))
            keys, n = _summed(np.concatenate([keys, k]), np.concatenate([n, m]))
            while len(keys) > PAIRS_PER_FILE:  # the last key may go on in the next batch
                close(PAIRS_PER_FILE)
        if len(keys):
            close(len(keys))
        yield pa.RecordBatch.from_pylist(rows, _FILE)

    sorted_pairs = shards.select("links").mapInArrow(_partial, "key long, n long").repartitionByRange("key").sortWithinPartitions("key")
    return staged(sorted_pairs.mapInArrow(run, "file string, first long, last long, seconds array<bigint>, most array<bigint>"), "pair_files")


_FILE = pa.schema([("file", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("seconds", pa.list_(pa.int64())), ("most", pa.list_(pa.int64()))])


def look_up(folder: str, files: list[tuple[str, int, int]], keys: np.ndarray) -> np.ndarray:
    """The totals of sorted ``keys``, all of which are in the files; files in order of their keys."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(folder)
    out = np.empty(len(keys), np.int64)
    for name, first, last in files:
        i, j = np.searchsorted(keys, [first, last + 1])
        if i < j:
            spot = f"{path}/{name}"
            raw = pa.memory_map(spot).read_buffer() if isinstance(where, fs.LocalFileSystem) else where.open_input_file(spot).read_buffer()
            known, total = np.frombuffer(raw, "<i8").reshape(2, -1)
            out[i:j] = total[np.searchsorted(known, keys[i:j])]
    return out


def align_tokens(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for each row.

    first: path of a byte-level tokenizer of the tokenizers library; second: of a sentencepiece model that puts a space before a text.
    Both encode the text with a space before it. A link's count is how often its two ids are linked in all texts; ``n_best`` counts
    links with the highest count of their second id, ties included. Null and empty texts, and texts that a tokenizer
    does not give back byte for byte, have no tokens: zeros and an empty digest. Repeated rows count each, null ids stay, an
    empty table gives an empty one; other columns are ignored. One text is held whole. Pair files stay in ``folder``.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "pairs")
    shards = staged(token_links(docs, first, second, id_col, text_col), "links")
    files = count_files(shards, folder)
    at = [(r["file"], r["first"], r["last"]) for r in files.select("file", "first", "last").orderBy("first").collect()]  # at most one for 2 million possible pairs and task
    most = files.select(F.explode(F.arrays_zip("seconds", "most")).alias("m")).groupBy("m.seconds").agg(F.max("m.most").alias("most")).collect()  # a row for each second id
    best = spark.sparkContext.broadcast((at, np.array(sorted(tuple(r) for r in most), np.int64).reshape(-1, 2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files_, highest = best.value
        for batch in batches:
            held, size = [], 0
            for i in range(batch.num_rows):
                held.append(i)
                size += int(batch.column(3)[i].values.to_numpy().sum())
                if size > LOOKED_UP or i == batch.num_rows - 1:
                    own, held, size = batch.slice(held[0], len(held)), [], 0
                    keys = np.concatenate([_keys(x.as_py()) for x in own.column(5)])
                    u, back = np.unique(keys, return_inverse=True)
                    total = look_up(folder, files_, u)
                    top = highest[np.searchsorted(highest[:, 0], u >> 32), 1] == total if len(u) else u
                    ids, n_a, n_b, n_links, digests = (own.column(c).flatten() for c in range(5))
                    ends = np.concatenate([[0], np.cumsum(n_links.to_numpy())])
                    sums = [np.diff(np.concatenate([[0], np.cumsum(x[back])])[ends]).astype(np.int64) for x in (top.astype(np.int64), total)]
                    yield pa.RecordBatch.from_arrays([ids, n_a, n_b, n_links, n_links, pa.array(sums[0]), pa.array(sums[1]), digests], [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return shards.mapInArrow(run, f"{id_col} long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
