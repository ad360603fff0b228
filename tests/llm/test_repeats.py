"""Removal of repeated byte strings against brute force, on both ways of sorting, odd rows, empty tables and clashing names."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import zstandard
from odd import no_documents, odd_documents, odd_rows

from stockloom.llm import repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows: list[tuple], window: int) -> list[tuple]:
    first: dict[bytes, int] = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - window + 1 if i is not None else 0):
            w = b[s : s + window]
            first[w] = min(i, first.get(w, i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - window + 1 if i is not None else 0):
            if first[b[s : s + window]] < i:
                gone[s : s + window] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=repr)


def planted(seed: int, docs: int) -> list[tuple]:
    """Texts that share passages of many lengths, overlapping, at their ends, in other orders, with copies and periodic runs."""
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice("abcdeé ") for _ in range(n))
    shared = [word(rnd.randint(20, 160)) for _ in range(12)] + ["ab" * 60, "x" * 130]
    rows = []
    for i in range(docs):
        parts = [rnd.choice(shared) if rnd.random() < 0.5 else word(rnd.randint(0, 90)) for _ in range(rnd.randint(0, 6))]
        rows.append((i * 7 % 1000, "".join(parts)))
    rows += [(2000 + i, rows[3][1]) for i in range(20)] + [(5, rows[1][1]), (None, rows[2][1]), (-4, rows[4][1][10:200])]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("window, hot", [(50, 50_000), (50, 3), (50, 0), (20, 10), (16, 10**9)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, window, hot):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(repeats, "BUCKET_RUNS", 40)
    monkeypatch.setattr(repeats, "BUCKET_GRAMS", 300)
    rows = planted(window + hot % 97, 90)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = repeats.remove_repeats(docs, window, with_kept=True, hot=hot).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got], key=repr) == brute(rows, window)
    for r in got:
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans


def test_slices_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_SLICE", 128)
    rows = [(i, t * 3 if i == 7 else t) for i, t in planted(3, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs).collect()]
    assert sorted(got, key=repr) == [r[:5] for r in brute(rows, 50)]


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(4)
    text = bytes(rng.integers(97, 100, 600, np.uint8))
    alone = {}
    for lead in (b"", b"zq", bytes(rng.integers(97, 100, 45, np.uint8))):
        body = lead + text
        digit, start, many = repeats.anchors(body, np.array([len(lead), len(body)]), 50, 24)
        assert many.sum() == len(text) - 49  # each window is in one run; none crosses the edge
        for d, s, m in zip(digit, start, many, strict=True):
            for w in range(s, s + m):
                assert alone.setdefault(body[w : w + 50], d) == d


def test_odd_rows_empty_tables_and_clashing_names(spark):
    want = brute([(r[0], r[1]) for r in odd_rows()], 50)
    for clashing in (False, True):
        got = repeats.remove_repeats(odd_documents(spark, clashing)).drop("spans").collect()
        assert sorted(map(tuple, got), key=repr) == [r[:5] for r in want]
    empty = repeats.remove_repeats(no_documents(spark))
    assert empty.count() == 0 and Counter(empty.columns) == Counter(["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
    with pytest.raises(ValueError):
        repeats.remove_repeats(no_documents(spark), 8)


def test_digits_are_packed_by_columns():
    digits = np.sort(np.random.default_rng(2).integers(0, 2**56, 20_000, np.uint64)) << np.uint64(8)
    raw = repeats.packed(digits, zstandard.ZstdCompressor(level=1))
    assert (repeats.unpacked(raw, zstandard.ZstdDecompressor()) == digits).all() and len(raw) < 0.8 * digits.nbytes
    assert len(repeats.unpacked(repeats.packed(digits[:0], zstandard.ZstdCompressor()), zstandard.ZstdDecompressor())) == 0


def test_blocks_stay_where_they_are_when_spans_are_joined(spark):
    docs = spark.createDataFrame([(i, "one passage that is longer than the window of fifty bytes, twice") for i in range(2)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = repeats.remove_repeats(docs)
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(block") == 1  # that of the spans
        assert sorted((r.doc_id, r.n_removed) for r in got.collect()) == [(0, 0), (1, 64)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
