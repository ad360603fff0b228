"""Removal of long byte strings that another document has already: a depth-limited radix sort of suffixes.

Only the first ``window`` bytes of a suffix are ever compared, and equal groups of the sort are the repeated windows. The sort
goes from the most significant digit on, in three kinds of passes:

1. The first digit of a window is its anchor: the ``gram``-byte string in it with the smallest hash. It depends on nothing but
   the window's bytes, so equal windows have equal digits, and neighbouring windows mostly share one, so that about one digit in
   14 bytes has to be dealt out. Digits are counted by buckets of their hashes; one that occurs once is done with.
2. The windows around the other anchors go on, as runs of neighbouring windows, each distinct run of a block once. In their
   bucket seven digits of eight bytes finish the sort; a window that is alone after a digit drops out.
3. Buckets of a digit that occurs more than ``hot`` times are not sorted in one task: their windows are dealt out by all their
   bytes, combined before the shuffle.

Documents are packed into blocks of some megabytes, compressed, and written once, in buckets, so that joins leave them where they
are; what moves after that are digits, marks, runs and spans of whole blocks. No step holds more than a block, a bucket of bounded size or a group combined by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.text import chunks
from stockloom.plans.durable import bucketed, staged
from stockloom.plans.groups import dealt, whole_groups

BLOCK_BYTES = 4_000_000
BUCKET_GRAMS, BUCKET_RUNS = 1_000_000, 50_000  # rows that one task sorts
HOT = 50_000
_SLICE = 1 << 20
_PLACES = np.uint64(21)  # low bits of an anchor's key: its place in a slice of a block and the window after it
_BASE, _SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _hashes(x: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all ``k``-byte substrings, from those of powers of two."""
    h, size, power = x.astype(np.uint64) + np.uint64(1), 1, _BASE
    out, have = None, 0
    while size <= k:
        if k & size:
            n = len(x) - have - size + 1
            out = h[:n].copy() if out is None else out[:n] * np.uint64(power) + h[have : have + n]
            have += size
        h = h[:-size] * np.uint64(power) + h[size:] if len(h) > size else h[:0]
        power, size = power * power % 2**64, 2 * size
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    rest = width - span
    return np.minimum(key[: len(key) - rest], key[rest:]) if rest else key


def anchors(body: bytes, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(digit, start, many)``: runs of windows with one anchor; windows do not cross the ends of documents.

    The digit is the hash of the anchor without its low byte, ``start`` the first window's place and ``many`` their number.
    """
    x, got = np.frombuffer(body, np.uint8), []
    begins = np.concatenate([[0], ends[:-1]])
    short = np.maximum(begins, ends - window + 1)  # from here on a document has no whole window
    for at in range(0, len(x) - window + 1, _SLICE):
        part = x[at : at + _SLICE + window - 1]
        m = len(part) - window + 1
        h = _hashes(part, gram)[: m + window - gram]
        low = (np.uint64(1) << _PLACES) - np.uint64(1)
        key = _least(((h >> _PLACES) << _PLACES) | np.arange(len(h), dtype=np.uint64), window - gram + 1)
        spot = (key & low).astype(np.int64)
        edge = np.zeros(m + 1, np.int32)
        np.add.at(edge, np.clip(short - at, 0, m), 1)
        np.add.at(edge, np.clip(ends - at, 0, m), -1)
        spot[np.cumsum(edge[:-1]) > 0] = -1
        cut = np.flatnonzero(np.concatenate([[True], spot[1:] != spot[:-1]]))
        many = np.diff(np.concatenate([cut, [m]]))
        live = spot[cut] >= 0
        got.append((h[spot[cut[live]]], cut[live] + at, many[live]))
    if not got:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    least, start, many = (np.concatenate(c) for c in zip(*got, strict=True))
    digit = least * np.uint64(_SPREAD)  # the smallest hashes lie close together
    return (digit >> np.uint64(8)) << np.uint64(8), start, many


def _bucket(digit: np.ndarray, buckets: int) -> np.ndarray:
    return ((digit >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of about ``BLOCK_BYTES`` of texts, or one longer text."""
    squeeze, part = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId()
    ids, texts, size, seq = [], [], 0, 0

    def close() -> pa.RecordBatch:
        nonlocal ids, texts, size, seq
        row = {"block": (part << 32) + seq, "ids": np.concatenate(ids).astype("<i8").tobytes(), "ends": np.cumsum([len(t) for t in texts]).astype("<i8").tobytes(), "size": size, "body": squeeze.compress(b"".join(texts))}
        ids, texts, size, seq = [], [], 0, seq + 1
        return pa.RecordBatch.from_pylist([row])

    for own, raw in chunks(batches, 1, BLOCK_BYTES // 8):
        ids.append(own.column(0).to_numpy(zero_copy_only=False))
        texts += raw
        size += sum(map(len, raw))
        if size >= BLOCK_BYTES:
            yield close()
    if texts:
        yield close()


def _numbers(raw: bytes, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(raw, kind)


def _opened(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """``(block, ids, ends, body, *columns)`` of each block."""
    spread = zstandard.ZstdDecompressor()
    for batch in batches:
        for row in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ["block", "ids", "ends", "body", *columns]), strict=True):
            block, ids, ends, body, *rest = (c.as_py() for c in row)
            yield block, _numbers(ids), _numbers(ends), spread.decompress(body), *rest


def packed(digits: np.ndarray, squeeze: zstandard.ZstdCompressor) -> bytes:
    """Sorted numbers of eight bytes by columns of their bytes, of which the first and the last hardly change."""
    return squeeze.compress(np.ascontiguousarray(digits.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(raw: bytes, spread: zstandard.ZstdDecompressor) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(spread.decompress(raw), np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.uint64)


def _digits(blocks: DataFrame, window: int, gram: int, buckets: int) -> DataFrame:
    """First pass: the distinct digits of each block in order, cut into buckets; the low byte tells how often one occurs there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for block, _, ends, body in _opened(batches, []):
            u, n = np.unique(anchors(body, ends, window, gram)[0], return_counts=True)
            raw = u | np.ceil(np.log2(n)).astype(np.uint64)
            cut = np.searchsorted(_bucket(u, buckets), np.arange(buckets + 1)).tolist()
            full = [i for i in range(buckets) if cut[i] < cut[i + 1]]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()), pa.array([packed(raw[cut[i] : cut[i + 1]], squeeze) for i in full], pa.binary())], ["bucket", "block", "digits"])

    return blocks.mapInArrow(run, "bucket int, block long, digits binary")


def _marks(digits: DataFrame, hot: int) -> DataFrame:
    """``(block, bucket, mark, runs, hot)``: bit masks of the digits that occur again, and of those that do so over ``hot`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = zstandard.ZstdDecompressor()
        for t, at in whole_groups(batches, ["bucket"]):
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = t.slice(i, j - i)
                parts = [unpacked(x.as_py(), spread) for x in own.column(2)]
                raw = np.concatenate(parts)
                digit, n = raw >> np.uint64(8), np.left_shift(np.int64(1), (raw & np.uint64(255)).astype(np.int64))
                order = np.argsort(digit, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], np.diff(digit[order]) != 0]))
                total = np.add.reduceat(n[order], first)
                kind = np.empty(len(raw), np.int8)
                kind[order] = np.repeat((total > 1).astype(np.int8) + (total > hot), np.diff(np.concatenate([first, [len(raw)]])))
                ends = np.cumsum([len(p) for p in parts])
                kinds = np.split(kind, ends[:-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column(1), own.column(0), pa.array([np.packbits(k > 0).tobytes() + np.packbits(k > 1).tobytes() for k in kinds], pa.binary()),
                        pa.array([int(m[k == 1].sum()) for k, m in zip(kinds, np.split(n, ends[:-1]), strict=True)], pa.int64()), pa.array([int((k > 1).sum()) for k in kinds], pa.int64()),
                    ],
                    ["block", "bucket", "mark", "runs", "hot"],
                )

    return dealt(digits, ["bucket"]).mapInArrow(run, "block long, bucket int, mark binary, runs long, hot long")


class _Runs:
    """The distinct runs of a block whose digit has the wanted mark, in order of their digits, with all their occurrences."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, body: bytes, marks: list, kind: int, window: int, gram: int, buckets: int):
        digit, start, many = anchors(body, ends, window, gram)
        u, at = np.unique(digit, return_inverse=True)
        sizes = np.diff(np.searchsorted(_bucket(u, buckets), np.arange(buckets + 1)))
        own = np.zeros(len(u), bool)
        begin = np.cumsum(sizes) - sizes
        for m in marks:
            b, n = m["bucket"], int(sizes[m["bucket"]])
            both = np.frombuffer(m["mark"], np.uint8).reshape(2, -1)
            again, hot = (np.unpackbits(x, count=n).astype(bool) for x in both)
            own[begin[b] : begin[b] + n] = hot if kind == 2 else again & ~hot
        pick = np.flatnonzero(own[at])
        pick = pick[np.argsort(digit[pick], kind="stable")]
        known: dict[bytes, int] = {}
        which = [known.setdefault(body[s : s + m], len(known)) for s, m in zip(start[pick].tolist(), (many[pick] + window - 1).tolist(), strict=True)]
        order = np.argsort(which, kind="stable")
        self.texts, self.many = list(known), np.array([len(t) - window + 1 for t in known], np.int64)
        self.first = np.flatnonzero(np.diff(np.array(which, np.int64)[order], prepend=-1))  # the first occurrence of each
        self.start = start[pick][order]
        self.digit = digit[pick][order][self.first] if len(pick) else digit[:0]
        self.ids = ids[np.searchsorted(ends, self.start, side="right")] if len(pick) else ids[:0]


_RUNS = "bucket int, block long, lengths binary, body binary, occurs binary, ids binary, starts binary"


def _runs(marked: DataFrame, window: int, gram: int, buckets: int, runs: int) -> DataFrame:
    """Second pass: the runs whose digit occurs again, by block and bucket of the digit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for block, ids, ends, body, marks in _opened(batches, ["marks"]):
            r = _Runs(ids, ends, body, marks, 1, window, gram, buckets)
            cut = np.searchsorted(_bucket(r.digit, runs), np.arange(runs + 1)).tolist()
            first = np.concatenate([r.first, [len(r.start)]])
            rows = []
            for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if i < j:
                    a, z = first[i], first[j]
                    rows.append({"bucket": b, "block": block, "lengths": r.many[i:j].astype("<u2").tobytes(), "body": squeeze.compress(b"".join(r.texts[i:j])), "occurs": np.diff(first[i : j + 1]).astype("<u4").tobytes(), "ids": r.ids[a:z].astype("<i8").tobytes(), "starts": r.start[a:z].astype("<u4").tobytes()})
            if rows:
                yield pa.Table.from_pylist(rows, _SCHEMA).to_batches()[0]

    return marked.mapInArrow(run, _RUNS)


_SCHEMA = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in ("lengths", "body", "occurs", "ids", "starts"))])


def least_ids(body: np.ndarray, place: np.ndarray, low: np.ndarray, window: int) -> np.ndarray:
    """For each window at a place in ``body`` the smallest ``low`` of all windows with the same bytes.

    Digits of eight bytes, the most significant first: each pass sorts the windows of every group by the next one. A window that
    is alone in its group is done.
    """
    words = np.zeros(len(body) - 7, np.uint64)
    for i in range(8):
        words = (words << np.uint64(8)) | body[i : i + len(words)]
    best, live, group = low.copy(), np.arange(len(place)), np.zeros(len(place), np.int64)
    for depth in [*range(0, window - 7, 8), window - 8][: -(-window // 8)]:
        digit = words[place[live] + depth]
        order = np.lexsort((digit, group))
        live, group, digit = live[order], group[order], digit[order]
        first = np.concatenate([[True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])])
        group = np.cumsum(first) - 1
        more = np.bincount(group)[group] > 1
        live, group = live[more], group[more]
        if not len(live):
            return best
    first = np.flatnonzero(np.diff(group, prepend=-1))
    best[live] = np.repeat(np.minimum.reduceat(low[live], first), np.diff(np.concatenate([first, [len(live)]])))
    return best


def _sorted_runs(runs: DataFrame, window: int) -> DataFrame:
    """``(block, spans)`` from the sort of each bucket: places of a block that a smaller document has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = zstandard.ZstdDecompressor()
        for t, at in whole_groups(batches, ["bucket"]):
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = t.slice(i, j - i)
                col = lambda c, kind: [np.frombuffer(x.as_py(), kind) for x in own.column(own.schema.get_field_index(c))]  # noqa: B023, E731
                many = np.concatenate(col("lengths", "<u2")).astype(np.int64)
                body = np.frombuffer(b"".join(spread.decompress(x.as_py()) for x in own.column(3)), np.uint8)
                occurs, ids, starts = np.concatenate(col("occurs", "<u4")).astype(np.int64), np.concatenate(col("ids", "<i8")), col("starts", "<u4")
                row = np.repeat(np.arange(len(starts)), [len(s) for s in starts])
                starts = np.concatenate(starts).astype(np.int64)
                head = np.cumsum(occurs) - occurs
                low, high = np.minimum.reduceat(ids, head), np.maximum.reduceat(ids, head)
                length = many + window - 1
                base = np.cumsum(length) - length
                first = np.cumsum(many) - many  # of a run's windows
                step = np.arange(many.sum()) - np.repeat(first, many)
                best = least_ids(body, np.repeat(base, many) + step, np.repeat(low, many), window)
                lost = np.minimum.reduceat(best, first) < high  # runs with an occurrence to remove
                o = np.flatnonzero(np.repeat(lost, occurs))
                run_of = np.repeat(np.arange(len(many)), occurs)[o]
                each = many[run_of]
                spot = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                gone = best[np.repeat(first[run_of], each) + spot] < np.repeat(ids[o], each)
                o, spot = np.repeat(o, each)[gone], spot[gone]
                if not len(o):
                    continue
                cut = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (spot[1:] != spot[:-1] + 1)]))
                a, z = starts[o[cut]] + spot[cut], starts[o[cut]] + spot[np.concatenate([cut[1:], [len(o)]]) - 1] + window
                r = row[o[cut]]
                edge = np.flatnonzero(np.diff(r, prepend=-1))
                pairs = np.stack([a, z], 1).astype("<u4")
                yield pa.RecordBatch.from_arrays([own.column(1).take(pa.array(r[edge])), pa.array([p.tobytes() for p in np.split(pairs, edge[1:])], pa.binary())], ["block", "spans"])

    return dealt(runs, ["bucket"]).mapInArrow(run, "block long, spans binary")


def _hot_windows(marked: DataFrame, window: int, gram: int, buckets: int) -> DataFrame:
    """``(block, spans)`` of the windows whose first digit is too frequent for one task: grouped by all their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, ends, body, marks in _opened(batches, ["marks"]):
            r = _Runs(ids, ends, body, marks, 2, window, gram, buckets)
            first = np.concatenate([r.first, [len(r.start)]])
            for i in range(0, len(r.texts), 2000):
                rows = []
                for n in range(i, min(i + 2000, len(r.texts))):
                    own, at = r.ids[first[n] : first[n + 1]], r.start[first[n] : first[n + 1]]
                    for s in range(r.many[n]):
                        rows.append({"bytes": r.texts[n][s : s + window], "low": int(own.min()), "high": int(own.max()), "block": block, "ids": own.astype("<i8").tobytes(), "starts": (at + s).astype("<u4").tobytes()})
                yield pa.RecordBatch.from_pylist(rows)

    def lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for least, ids, starts in zip(b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                at = _numbers(starts.as_py(), "<u4")[_numbers(ids.as_py()) > least]
                spans.append(np.stack([at, at + np.uint32(window)], 1).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.binary())], ["block", "spans"])

    rows = staged(marked.where("hot > 0").mapInArrow(run, "bytes binary, low long, high long, block long, ids binary, starts binary"), "hot")
    groups = staged(rows.groupBy("bytes").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most").drop("most"), "hot_groups")
    return rows.join(groups.hint("merge"), "bytes").where("high > least").select("block", "least", "ids", "starts").mapInArrow(lost, "block long, spans binary")


def _cleaned(id_col: str, with_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, ends, body, spans in _opened(batches, ["spans"]):
            pairs = np.concatenate([np.frombuffer(s, "<u4").reshape(-1, 2) for s in spans or []] or [np.empty((0, 2), "<u4")]).astype(np.int64)
            pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
            own = np.searchsorted(ends, pairs[:, 0], side="right")
            a, z = pairs[:, 0] + own, np.maximum.accumulate(pairs[:, 1] + own) if len(own) else pairs[:, 1]  # a gap between documents
            new = np.flatnonzero(np.concatenate([[True], a[1:] > z[:-1]])) if len(own) else own
            own, a, z = own[new], a[new] - own[new], z[np.concatenate([new[1:], [len(z)]]) - 1] - own[new] if len(own) else z
            size = np.diff(ends, prepend=0)
            removed = np.bincount(own, z - a, len(ids)).astype(np.int64)
            many = np.bincount(own, minlength=len(ids))
            stops, kept = np.cumsum(many).tolist(), []
            for d, (e, n) in enumerate(zip(ends.tolist(), size.tolist(), strict=True)):
                at, parts = e - n, []
                for s in range(stops[d] - int(many[d]), stops[d]):
                    parts.append(body[at : a[s]])
                    at = z[s]
                kept.append(b"".join([*parts, body[at:e]]))
            base = np.repeat(ends - size, many)
            pieces = pa.StructArray.from_arrays([pa.array(a - base), pa.array(z - base)], ["start", "stop"])
            columns = [pa.array(ids), pa.array(size), pa.array(removed), pa.array(many.astype(np.int64)), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.ListArray.from_arrays(pa.array([0, *stops], pa.int32()), pieces)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * with_kept, [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"] + ["kept"] * with_kept)

    return run


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False, hot: int = HOT) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256, spans)`` for each row, and the remaining bytes as ``kept`` if asked for.

    A byte of a text (UTF-8; null: empty) is removed if a string of ``window`` bytes that covers it also starts in a document with a
    smaller id. Strings are judged on the input and do not cross documents; ``spans`` are the maximal removed runs of bytes, which may
    cut characters. Rows that share an id do not take bytes from each other, but from smaller ids each by itself. A row without an
    id neither loses nor takes bytes. Texts shorter than ``window`` stay whole. An empty table gives an empty one; other columns
    are ignored. ``window`` is at least 16; ``hot`` only decides where windows are sorted.
    """
    if window < 16:
        raise ValueError("a window has at least 16 bytes")
    gram = window // 2 - 1
    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    own = d.where("_id is not null").select("_id", F.col("_text").cast("binary").alias("_text"))
    blocks = bucketed(own.mapInArrow(_block_rows, "block long, ids binary, ends binary, size long, body binary"), "block", "blocks")
    size = blocks.agg(F.sum("size")).first()[0] or 0
    buckets = 1 + int(size * 2 / (window - gram + 2)) // BUCKET_GRAMS
    marks = staged(_marks(_digits(blocks, window, gram, buckets), hot), "marks")
    total = marks.agg(F.sum("runs").alias("runs"), F.sum("hot").alias("hot")).first()
    per_block = marks.groupBy("block").agg(F.collect_list(F.struct("bucket", "mark")).alias("marks"), F.sum("runs").alias("runs"), F.sum("hot").alias("hot"))
    marked = blocks.drop("size").join(per_block, "block")
    found = _sorted_runs(_runs(marked.where("runs > 0"), window, gram, buckets, 1 + (total["runs"] or 0) // BUCKET_RUNS), window)
    if total["hot"]:
        found = found.unionByName(_hot_windows(marked, window, gram, buckets))
    spans = staged(found, "spans").groupBy("block").agg(F.collect_list("spans").alias("spans"))
    schema = f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, stop: long>>" + ", kept binary" * with_kept
    got = blocks.drop("size").join(spans, "block", "left").mapInArrow(_cleaned(id_col, with_kept), schema)
    text = F.col("_text").cast("binary")
    alone = [F.col("_id").alias(id_col), F.octet_length("_text").cast("long").alias("n_bytes"), *(F.lit(0).cast("long").alias(c) for c in ("n_removed", "n_spans")), F.sha2(text, 256).alias("kept_sha256")]
    none = F.array().cast("array<struct<start: bigint, stop: bigint>>").alias("spans")
    return got.unionByName(d.where("_id is null").select(*alone, none, *[text.alias("kept")] * with_kept))


#: The contract of ``remove_repeats`` with a window of 50 over ``documents``, without spans.
REMOVE_REPEATS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS raw FROM documents),
b AS (SELECT r, doc_id, octet_length(raw) AS n, hex(raw) AS x FROM d),
w AS MATERIALIZED (SELECT r, doc_id, s, md5(x[2*s+1:2*s+100]) AS h FROM (SELECT r, doc_id, x, unnest(range(n - 49)) AS s FROM b WHERE doc_id IS NOT NULL AND n >= 50)),
low AS (SELECT h, min(doc_id) AS first FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT w.r, w.s FROM w JOIN low USING (h) WHERE w.doc_id > low.first),
cut AS (SELECT r, s, s + 50 AS e, CASE WHEN s > max(s + 50) OVER (PARTITION BY r ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM gone),
num AS (SELECT r, s, e, sum(new) OVER (PARTITION BY r ORDER BY s) AS k FROM cut),
spans AS (SELECT r, k, min(s) AS a, max(e) AS z FROM num GROUP BY r, k),
lists AS (SELECT r, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM spans GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(list_sum(z) - list_sum(a), 0)::BIGINT AS n_removed, coalesce(len(a), 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN a IS NULL THEN x ELSE array_to_string(list_transform(range(len(a) + 1), lambda i: x[2 * (CASE WHEN i = 0 THEN 0 ELSE z[i] END) + 1:2 * (CASE WHEN i = len(a) THEN n ELSE a[i + 1] END)]), '') END)) AS kept_sha256
FROM b LEFT JOIN lists USING (r)
"""
