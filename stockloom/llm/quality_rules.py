"""Quality rules on whole texts, with repetition measured on a suffix array of words.

The words of many texts are put in one array, and one suffix array is built over it by prefix doubling; suffixes
end with their text, so texts never mix. Longest common prefixes of neighbours come from the kept doubling
ranks. A position whose longest common prefix with a neighbour in the array is at least ``min_words`` starts a repeated
substring; those that do not continue the one of the position before are the left ends of the maximal ones. The spans
of all occurrences are united, and the covered share and the longest repeat are limited.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.text import chunks

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 8, 1 / 3, 30

RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_covered_words long, longest_repeat long, spans array<struct<first: long, words: long>>"
)


def suffix_ranks(tok: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of words ``tok`` and the ranks by the first 1, 2, 4, ... words.

    end: for each position, where its text ends. A rank is the number of smaller suffixes, equal for equal starts.
    """
    n = len(tok)
    sa = np.lexsort((tok, end))
    key_new = np.empty(n, bool)
    key_new[0] = True
    key_new[1:] = (tok[sa[1:]] != tok[sa[:-1]]) | (end[sa[1:]] != end[sa[:-1]])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(key_new, np.arange(n), 0))
    levels, k = [rank], 1
    at = np.flatnonzero(~(key_new & np.append(key_new[1:], True)))  # places in sa whose rank is shared
    while len(at):
        pos = sa[at]
        nxt = pos + k
        inside = nxt < end[pos]
        second = np.where(inside, rank[np.minimum(nxt, n - 1)] + 1, 0)
        first = rank[pos]
        order = np.lexsort((second, first))
        pos, first, second = pos[order], first[order], second[order]
        sa[at] = pos
        new = np.empty(len(at), bool)
        new[0] = True
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank = rank.copy()
        rank[pos] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        levels.append(rank)
        at = at[~(new & np.append(new[1:], True))]
        k *= 2
    return sa, levels


def longest_repeats(tok: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each position, the words of the longest substring that starts there and occurs again in its text."""
    n = len(tok)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    sa, levels = suffix_ranks(tok, end)
    p, q = sa[:-1], sa[1:]
    near = np.flatnonzero(levels[0][p] == levels[0][q])
    p, q = p[near], q[near]
    lcp = np.zeros(len(p), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y = p + lcp, q + lcp
        fits = (x < end[p]) & (y < end[q])
        r = levels[level]
        same = fits & (r[np.minimum(x, n - 1)] == r[np.minimum(y, n - 1)])
        lcp[same] += 1 << level
    np.maximum.at(out, p, lcp)
    np.maximum.at(out, q, lcp)
    return out


def _cover(start: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + words, -1)
    return np.cumsum(edge[:-1]) > 0


def _measure(texts: list[bytes], min_words: int) -> list[pa.Array]:
    ids: dict[bytes, int] = {}
    number = count()
    tokens, lines_again, symbols, chars = [], [], [], []
    for t in texts:
        words = t.split()
        tokens.append(np.fromiter((ids[w] if w in ids else ids.setdefault(w, next(number)) for w in words), np.int64, len(words)))
        lines = [x for x in t.split(b"\n") if x.strip()]
        lines_again.append(len(lines) - len(set(lines)))
        symbols.append(sum(map(t.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS))))))
        chars.append(len(t.decode("utf-8", "replace")) - sum(map(t.count, (SPACES[i : i + 1] for i in range(len(SPACES))))))
    size = np.array([len(x) for x in tokens], np.int64)
    stop = np.cumsum(size)
    start = stop - size
    tok = np.concatenate(tokens)
    n = len(tok)
    far = longest_repeats(tok, np.repeat(stop, size))
    total = lambda mask: np.add.reduceat(np.append(mask, 0), np.minimum(start, n)) * (size > 0)
    three = np.flatnonzero(far >= 3)
    again = total(_cover(three, np.full(len(three), 3), n).astype(np.int64))
    left = np.ones(n, bool)
    left[1:] = far[1:] >= far[:-1]  # else the repeat goes on from the position before
    left[start[size > 0]] = True
    at = np.flatnonzero((far >= min_words) & left)
    covered = total(_cover(at, far[at], n).astype(np.int64))
    longest = np.maximum.reduceat(np.append(far, 0), np.minimum(start, n)) * (size > 0)
    cut = np.searchsorted(at, np.append(start, n))
    spans = pa.ListArray.from_arrays(
        pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(at - np.repeat(start, size)[at]), pa.array(far[at])], ["first", "words"])
    )
    plain = (size, chars, symbols, lines_again, again, covered, np.where(longest >= min_words, longest, 0))
    return [*(pa.array(np.asarray(x, np.int64)) for x in plain), spans]


def measure_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_REPEAT) -> DataFrame:
    """The measures of each whole text, one row for each row of ``docs``: id and the columns of ``RESULT``.

    A null text has no words. ``spans`` holds the occurrences of maximal repeated substrings of ``min_words`` words
    or more: first word and number of words. Memory follows the longest text, else about 4 MB of text at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, 1, 4_000_000):
            cols = _measure(texts, min_words)
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat", "spans"]
            yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["_id", *names])

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string")).mapInArrow(run, f"_id long, {RESULT}").withColumnRenamed("_id", id_col)


def verdict(n, again, covered, longest, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, min_words: int = 50, max_repeat_percent: int = 50):
    """``(base_failed, kept)`` from the measures, as columns or as arrays.

    base_failed: fewer than ``min_words`` words, or over ``max_repeat_percent`` percent of them in repeated windows of three.
    kept: not base_failed, repeats cover at most ``max_covered`` of the words, the longest has at most ``max_longest`` words.
    """
    failed = (n < min_words) | (100 * again > max_repeat_percent * n)
    return failed, ~failed & (covered <= max_covered * n) & (longest <= max_longest)


def judge_quality(measures: DataFrame, **limits) -> DataFrame:
    """Adds ``base_failed`` and ``kept``; see ``verdict`` for the rule and its ``limits``."""
    failed, kept = verdict(*(F.col(c) for c in ("n_words", "n_repeat_words", "n_covered_words", "longest_repeat")), **limits)
    return measures.withColumn("base_failed", failed).withColumn("kept", kept)


def filter_quality(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The rows of ``docs`` that ``verdict`` keeps, all columns as they are; repeated rows stay repeated, null and empty texts go."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, at, 4_000_000):
            words, _, _, _, again, covered, longest, _ = _measure(texts, MIN_REPEAT)
            _, kept = verdict(*(x.to_numpy() for x in (words, again, covered, longest)), **limits)
            yield part.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
