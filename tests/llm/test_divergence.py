"""Source divergence against a plain loop in whole numbers and against SQL, with small batches, odd rows and empty tables."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from compare import plain
from odd import no_documents, odd_documents, odd_rows

from stockloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows: list[tuple], least: int = 3, top: int = 200) -> list[tuple]:
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        text, lang, source = text or "", lang or "", source or ""
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)
        whole = Counter()
        for s in sources:
            whole.update({t: count[lang, s][t] for t in kept})
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[t] for t in kept) + v) for t in kept}  # noqa: B023, E731
        p, q = {s: shares(count[lang, s]) for s in sources}, shares(whole)
        f = lambda x, y: (x - y) ** 2 // y
        for s in sources:
            pair = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, f(p[s][t], q[t])) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, len(pair)), ("term", term, top)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, i, n, r) for r, (i, n) in enumerate(items, 1)]
    return sorted(out)


def texts(seed: int, n: int) -> list[tuple]:
    rnd = random.Random(seed)
    pool = ["Alpha", "beta", "GAMMA", "delta9x", "é", "ÉÉ", "ö_ä", "日本", "zeta-eta", " "] + [f"w{c}{d}" for c in "abcdefgh" for d in "klmnop"]
    rows = []
    for i in range(n):
        k = rnd.randint(0, 40)
        text = " ".join(rnd.choice(pool[: rnd.randint(1, len(pool))]) for _ in range(k))
        rows.append((i, None if k == 7 else text, rnd.choice(["en", "de", None, ""]), rnd.choice(["a", "b", "cé", None, "rare"]) if i % 9 else f"only{i}", 0))
    return rows + [(n, "once", "xx", "a", 0), (n + 1, "only here", "xx", "b", 0), (n + 2, None, "yy", "lone", 0), (n, "once", "xx", "a", 0)]


@pytest.mark.parametrize("small", [False, True])
def test_equals_a_plain_loop(spark, monkeypatch, small):
    if small:
        for name, value in (("CHUNK_BYTES", 300), ("MOST_TERMS", 15), ("MOST_RUNS", 20), ("MOST_PAIRS", 25)):
            monkeypatch.setattr(divergence, name, value)
    rows = texts(5, 160)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(map(tuple, divergence.source_divergence(docs, top=20).collect()))
    assert got == brute(rows, top=20)
    assert sum(r[2] == "pair" and r[4] > 0 for r in got) > 100


def test_equals_its_sql(spark, tmp_path):
    docs = spark.createDataFrame(texts(8, 300), SCHEMA)
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    want = sorted(tuple(map(plain, r)) for r in con.execute(divergence.SOURCE_DIVERGENCE_SQL).fetchall())
    assert sorted(map(tuple, divergence.source_divergence(docs).collect())) == want


def test_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(10**12, 4 * 10**13), (3, 10**18 - 4)], "c long, w long")
    assert [r[0] for r in rows.select(divergence._share(F.col("c"), F.col("w"))).collect()] == [1 + 10**9 * (10**12 + 1) // (4 * 10**13), 1]


def test_odd_rows_empty_tables_and_clashing_names(spark):
    want = brute(odd_rows())
    for clashing in (False, True):
        assert sorted(map(tuple, divergence.source_divergence(odd_documents(spark, clashing)).collect())) == want
    assert divergence.source_divergence(no_documents(spark)).count() == 0
