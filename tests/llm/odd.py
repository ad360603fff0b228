"""Small tables with everything that may go wrong: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "_id _row _size _source _cell _key size shard slot part rep regs length piece target epochs n_shingles component_id score kept label grade tail_1 _copies hash".split()


def words(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(n))


def odd_rows() -> list[tuple]:
    base = words(1, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "en", "b"), (4, words(2, 100), "de", "b"), (5, None, "en", "a"), (6, "", "en", None), (7, " \t\n ", None, "c"),
        (8, "one two three", "en", "c"), (9, "one two three", "en", "c"), (10, words(3, 30_000), "fr", "a"), (11, "same " * 400, "fr", "b"), (12, "Ünïcödé 🙂 ßtraße\nline two\nline two\n", None, "é"),
        (12, "Ünïcödé 🙂 ßtraße\nline two\nline two\n", None, "é"), (None, words(4, 60), "en", "a"), (None, None, None, None), (13, "$$$ ### *** !!!", "en", "b"), (14, "12 34 56", "es", "b"), (15, words(5, 80), "es", "zz"),
        (15, words(6, 80), "es", "zz"), (16, "a\x0bb\x0cc\rd e\x1cf", "en", "zz"),
    ]
    return [(*r, len(r[1]) if r[1] else None) for r in rows]


def odd_documents(spark, clashing: bool = False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("x") for c in CLASHING}) if clashing else df


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
