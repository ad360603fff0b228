"""How the sources of a language differ in their words: exact divergences of smoothed term frequencies.

1. Each task sorts the term occurrences of its documents by (lang, term, source, document) and scans the runs: a run gives the
   documents and occurrences of a term in a source. These partial runs are dealt out by (lang, term), sorted again, and scanned once
   more as a stream; terms in enough documents of their language stay. A task holds one term of a language at a time.
2. Frequencies are whole numbers: ``p = 1 + floor(10^9 (count + 1) / (N + V))``. A divergence is the sum over all kept terms of
   ``floor((p - q)^2 / q)``. Where a term is missing in one of two sources its summand depends on the other's count alone, so
   these are taken from a histogram of counts. Only terms that both sources have are met one by one, in the sorted
   stream, which emits partial sums for pairs of sources and no pair of documents or terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.text import chunks
from stockloom.plans.durable import staged
from stockloom.plans.groups import dealt, whole_groups

CHUNK_BYTES = 3_000_000
MOST_TERMS, MOST_RUNS = 500_000, 2_000_000  # that a task holds before it passes its runs on
MOST_PAIRS = 1_000_000
#: A-Z become a-z; other ASCII characters than letters end a term.
_LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


class _Numbered(dict):
    """Numbers for keys in order of their first use."""

    def __missing__(self, key) -> int:
        n = self[key] = len(self)
        return n


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.diff(keys[order], prepend=keys[order[:1]] - 1)) if len(keys) else order
    return keys[order][first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values)


def _occurrences(words: np.ndarray, group: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the occurrences sorted by (term, group, document): their keys ``term << 24 | group``, documents and lengths."""
    key = words << 24 | group
    order = np.lexsort((document, key))
    key, document = key[order], document[order]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, bool)
    first = np.flatnonzero(new)
    other = new.copy()
    other[1:] |= document[1:] != document[:-1]
    lengths = np.diff(np.concatenate([first, [len(key)]])) if len(first) else first
    return key[first], np.add.reduceat(other.astype(np.int64), first) if len(first) else first, lengths


def _term_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms, groups, held, size = _Numbered(), _Numbered(), [], 0

    def passed() -> Iterator[pa.RecordBatch]:
        nonlocal terms, groups, held, size
        key, docs, n = _sums(*map(np.concatenate, zip(*held, strict=True)))
        term = pa.array(list(terms), pa.binary()).view(pa.string())
        lang, source = (pa.array([g[i] for g in groups], pa.string()) for i in (0, 1))
        for i in range(0, len(key), 1 << 17):
            k = slice(i, i + (1 << 17))
            own = pa.array(key[k] & (1 << 24) - 1)
            yield pa.RecordBatch.from_arrays([lang.take(own), term.take(pa.array(key[k] >> 24)), source.take(own), pa.array(docs[k]), pa.array(n[k])], ["lang", "term", "source", "docs", "n"])
        terms, groups, held, size = _Numbered(), _Numbered(), [], 0

    for own, raw in chunks(batches, 0, CHUNK_BYTES):
        words = [t.translate(_LETTERS).split() for t in raw]
        many = np.array(list(map(len, words)))
        code = np.fromiter((terms[w] for ws in words for w in ws), np.int64, many.sum())
        group = np.array([groups[g] for g in zip(own.column(1).to_pylist(), own.column(2).to_pylist(), strict=True)], np.int64)
        held.append(_occurrences(code, np.repeat(group, many), np.repeat(np.arange(len(raw)), many)))
        size += len(held[-1][0])
        if size > 2 * MOST_RUNS and len(held) > 1:
            held = [_sums(*map(np.concatenate, zip(*held, strict=True)))]
            size = len(held[0][0])
        if size > MOST_RUNS or len(terms) > MOST_TERMS or len(groups) > 1 << 23:
            yield from passed()
    if held:
        yield from passed()


def _kept_terms(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ["lang", "term"]):
            docs, n = (t.column(c).to_numpy(zero_copy_only=False) for c in (3, 4))
            many = np.diff(at)
            own = np.repeat(np.add.reduceat(docs, at[:-1]) >= least, many)
            source = t.column(2)
            new = np.zeros(t.num_rows, bool)
            new[at[:-1]] = True
            new[1:] |= pc.not_equal(source.slice(1), source.slice(0, t.num_rows - 1)).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new)
            total = np.repeat(np.add.reduceat(n, at[:-1]), many)[first]
            lead = np.isin(first, at[:-1])
            b = pa.RecordBatch.from_arrays([t.column(0).take(pa.array(first)), t.column(1).take(pa.array(first)), source.take(pa.array(first)), pa.array(np.add.reduceat(n, first)), pa.array(total), pa.array(lead.astype(np.int64))], ["lang", "term", "source", "n", "total", "lead"])
            yield b.filter(pa.array(own[first]))

    return run


def term_runs(docs: DataFrame, least: int = 3, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, term, source, n, total, lead)``: occurrences of the terms that stay, in a source and in the language; ``lead`` is 1 once a term.

    A term is a run of letters a-z and of characters beyond ASCII; it stays if ``least`` rows of its language have it. Nulls are empty.
    """
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source")))
    runs = docs.select(text, lang, source).mapInArrow(_term_runs, "lang string, term string, source string, docs long, n long")
    rows = runs.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return rows.mapInArrow(_kept_terms(least), "lang string, term string, source string, n long, total long, lead long")


def _share(count: Column, whole: Column) -> Column:
    """``1 + floor(10^9 (count + 1) / whole)`` without overflow."""
    return F.call_function("div", (count + 1).cast("decimal(19,0)") * F.lit(1_000_000_000).cast("decimal(10,0)"), whole.cast("decimal(19,0)")) + 1


def _gain(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _gains(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, a, b, value)``: what terms that both sources have add to the sums where either one lacks them; a and b are sources' numbers."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    lang, size = None, 0

    def passed() -> Iterator[pa.RecordBatch]:
        nonlocal held, size
        key, value = _sums(*map(np.concatenate, zip(*held, strict=True)))
        held, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key >> 31), pa.array(key & (1 << 31) - 1), pa.array(value)], ["lang", "a", "b", "value"])

    for t, at in whole_groups(batches, ["lang", "term"]):
        number, p, zero = (t.column(c).to_numpy(zero_copy_only=False) for c in (2, 3, 4))
        many = np.repeat(np.diff(at), np.diff(at))
        start = np.repeat(at[:-1], np.diff(at))
        langs = t.column(0).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.concatenate([[True], langs[1:] != langs[:-1]])).tolist()
        for i, j in zip(cut, [*cut[1:], len(langs)], strict=True):
            if langs[i] != lang and held:
                yield from passed()
            lang = langs[i]
            while i < j:  # as many rows as have MOST_PAIRS partners, or one
                z = i + max(1, int(np.searchsorted(np.cumsum(many[i:j]), MOST_PAIRS, side="right")))
                a = np.repeat(np.arange(i, z), many[i:z])
                b = np.arange(len(a)) + np.repeat(start[i:z] - (np.cumsum(many[i:z]) - many[i:z]), many[i:z])
                live = a != b
                a, b = a[live], b[live]
                value = _gains(p[a], p[b]) - _gains(p[a], zero[b]) - _gains(zero[a], p[b]) + _gains(zero[a], zero[b])
                held.append(_sums(number[a] << 31 | number[b], value))
                size += len(held[-1][0])
                if size > 2 * MOST_PAIRS:
                    held = [_sums(*map(np.concatenate, zip(*held, strict=True)))]
                    size = len(held[0][0])
                    if size > MOST_PAIRS:
                        yield from passed()
                i = z
    if held:
        yield from passed()


def source_divergence(docs: DataFrame, least: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far a source is from the others of its language, and by which terms.

    Part ``pair``: for each other source of the language the sum of ``floor((p - q)^2 / q)`` over all kept terms, all ranks; a source without
    any kept term takes part with its smoothed frequencies. Part ``term``: the terms that a source has more often than its language,
    q the language's frequency, up to rank ``top``. Ranks go by value from the largest, ties by the item's UTF-8 bytes. Null texts,
    languages and sources are empty strings; repeated rows are documents of their own. A language without kept terms has
    pairs of value 0. An empty table gives an empty one; other columns are ignored. All arithmetic is exact up to 10^18 occurrences.
    """
    kept = staged(term_runs(docs, least, text_col, lang_col, source_col), "terms")
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source")))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("all"), F.sum("lead").alias("v"))
    groups = docs.select(lang, source).distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["own", "all", "v"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long")  # a row for each source
    none = F.when(F.col("v") > 0, _share(F.lit(0), F.col("own") + F.col("v")))
    groups = staged(groups.withColumn("number", number).withColumn("zero", none), "groups")

    terms = kept.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("own") + F.col("v")))
    q = _share(F.col("total"), F.col("all") + F.col("v"))
    best = terms.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gain(F.col("p"), F.col("q")).alias("value"))

    met = dealt(terms.select("lang", "term", "number", "p", "zero"), ["lang", "term"]).mapInArrow(_met, "lang string, a long, b long, value long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    met = met.groupBy("lang", "a", "b").agg(exact("value").alias("met"))
    counts = terms.groupBy("lang", "number", "p", "zero").agg(F.count("*").alias("times"))
    other = groups.select("lang", F.col("number").alias("b"), F.col("zero").alias("low"))
    alone = counts.join(other, "lang").where("number <> b")
    both = _gain(F.col("zero"), F.col("low"))
    times = F.col("times").cast("decimal(20,0)")
    more = alone.groupBy("lang", F.col("number").alias("a"), "b").agg(F.sum(times * (_gain(F.col("p"), F.col("low")) - both)).alias("more"))
    less = alone.groupBy("lang", F.col("b").alias("a"), F.col("number").alias("b")).agg(F.sum(times * (_gain(F.col("low"), F.col("p")) - _gain(F.col("low"), F.col("zero")))).alias("less"))
    right = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("b"), F.col("zero").alias("low"))
    pairs = groups.withColumnRenamed("number", "a").join(right, "lang").where("a <> b")
    for part in (met, more, less):
        pairs = pairs.join(part, ["lang", "a", "b"], "left")
    whole = F.coalesce(F.col("v").cast("decimal(20,0)") * both, F.lit(0)) + sum((F.coalesce(c, F.lit(0)) for c in ("met", "more", "less")), F.lit(0).cast("decimal(38,0)"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", whole.cast("long").alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= top).unionByName(pairs.withColumn("rank", rank))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


_UPPER = "".join(map(chr, range(65, 91)))

#: The contract of ``source_divergence`` with its default parameters over ``documents``.
SOURCE_DIVERGENCE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
occ AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM occ GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(total) AS whole FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS c FROM occ SEMI JOIN kept USING (lang, term) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(n.c, 0) AS c, 1 + (1000000000 * (coalesce(n.c, 0) + 1)::HUGEINT) // (sum(coalesce(n.c, 0)) OVER (PARTITION BY g.lang, g.source) + l.v) AS p,
         1 + (1000000000 * (k.total + 1)::HUGEINT) // (l.whole + l.v) AS q
      FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
          ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
          UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
