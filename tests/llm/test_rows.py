"""Operators on odd rows, on empty tables and on tables with clashing names; defined results for each."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from odd import CLASHING, no_documents, odd_documents, odd_rows
from tokenizers import Tokenizer

from stockloom.llm import language, mixing, near_text, near_vectors, packing, quality_model, quality_rules, sharding, toxicity, wavelet

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def operators(spark):
    none = labels(spark)
    return {
        "mix": mixing.mix, "mixed": mixing.mixed_documents, "pack": lambda d: packing.pack_documents(d, BYTES), "measure": lambda d: quality_rules.judge_quality(quality_rules.measure_quality(d)),
        "filter": quality_rules.filter_quality, "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.fit_toxicity(d, none)), "language": lambda d: language.identify_language(d, language.fit_language(d)),
        "quality": lambda d: quality_model.score_quality(d, quality_model.fit_quality(d, none.withColumn("grade", quality_model.rating()))),
        "select": lambda d: quality_model.select_quality(d, quality_model.fit_quality(d, none.withColumn("grade", quality_model.rating()))), "files": lambda d: wavelet.token_files(d, WORDS),
        "near": near_text.near_duplicate_texts, "keep": near_text.keep_one_text, "shards": sharding.shuffle_shards,
    }


ONE_FOR_EACH = "mix measure toxicity language quality files near shards".split()


@pytest.mark.parametrize("name", "mix mixed pack measure filter toxicity language quality select files near keep shards".split())
def test_odd_rows_empty_tables_and_clashing_names(spark, name):
    op = operators(spark)[name]
    got = op(odd_documents(spark)).collect()
    ids = Counter(r.doc_id for r in got)
    if name in ONE_FOR_EACH:
        assert ids == Counter(r[0] for r in odd_rows())
    empty = op(no_documents(spark))
    assert empty.count() == 0
    clash = op(odd_documents(spark, clashing=True))
    if name in ("mixed", "filter", "select", "keep"):
        assert clash.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASHING]
    else:
        assert clash.columns == empty.columns
    assert Counter(r.doc_id for r in clash.select("doc_id").collect()) == ids


def test_mix_reaches_its_targets(spark):
    rows = [(i, "w " * (5 + i % 40), "en", f"s{i % 7:02d}" if i % 3 else "s00", 0) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = mixing.mix(docs).toPandas()
    size = Counter()
    for r in rows:
        size[r[3]] += len(r[1].split())
    order = sorted(size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), float(sum(size.values())), set(order)
    while left > 1e-6:  # share by weight, stop at three times the source, share what is over again
        part = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in sorted(open_):
            target[s] += part * weight[s]
            if target[s] >= 3 * size[s]:
                left += target[s] - 3 * size[s]
                target[s] = 3.0 * size[s]
        open_ -= {s for s in open_ if target[s] >= 3 * size[s]}
    by = got.groupby("source").agg({"size": "sum", "source_size": "first", "target": "first", "taken": "sum"})
    assert dict(by["size"]) == dict(size) == dict(by.source_size)
    assert np.allclose(by.target, [target[s] for s in by.index])
    assert (abs(by.taken - by.target) <= 45 / 2).all() and (got.taken <= 3 * got["size"]).all() and (got.taken == got["size"] * got.copies).all()
    again = mixing.mix(docs.repartition(9)).toPandas()
    key = ["doc_id", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    spread = got.assign(c=got.copies - got.groupby("source").copies.transform("min"))
    assert (spread.c <= 1).all()  # whole epochs come before the fraction
    texts = mixing.mixed_documents(docs).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    assert texts.to_dict() == {r.doc_id: r.copies for r in got.itertuples() if r.copies}


def test_documents_without_words_keep_to_the_epochs(spark):
    rows = [(1, "a b c", None, "a", 0), (2, "", None, "a", 0), (3, None, None, "a", 0), (4, "a " * 900, None, "b", 0), (5, "", None, "b", 0), (6, "", None, "c", 0)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).toPandas().set_index("doc_id")
    assert got.copies.to_dict() == {1: 3, 2: 3, 3: 3, 4: 1, 5: 1, 6: 1}


def test_repeated_rows_meet_their_targets(spark):
    """Each source is one row repeated, or two: only as many of the equal rows are taken as fit."""
    rows = [(1, "w " * 20, "en", "a", 0)] * 100 + [(2, "v " * 20, "en", "b", 0)] * 100 + [(3, "x " * 7, "en", None, 0)] * 90 + [(4, "y " * 20, "en", None, 0)] * 70
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    for share in (1.0, 0.43):
        got = mixing.mix(docs, share=share).toPandas()
        by = got.groupby("source", dropna=False).agg({"target": "first", "taken": "sum"})
        assert (abs(by.taken - by.target) <= 10).all() and len(got) == len(rows)
        assert (got.groupby("doc_id").copies.max() - got.groupby("doc_id").copies.min() <= 1).all()
        texts = mixing.mixed_documents(docs, share=share).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict()
        assert texts == {k: v for k, v in got.groupby("doc_id").copies.sum().to_dict().items() if v}
    assert {tuple(sorted(mixing.mix(docs.repartition(n)).groupBy("doc_id", "copies").count().toPandas().itertuples(index=False, name=None))) for n in (1, 3)}.__len__() == 1


@pytest.mark.parametrize("weight", [1.0, 0.2, 0.05])
def test_key_cells_stay_small_for_every_weight(spark, weight):
    from pyspark.sql import functions as F

    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"))
    cells = mixing._drawn(docs, "doc_id", "text", "source", F.lit(weight), 17).groupBy("_cell").count().toPandas()["count"]
    assert cells.max() <= 0.005 * 20_000


def test_heavier_documents_are_drawn_more_often(spark):
    from pyspark.sql import functions as F

    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 3000, "a").otherwise("b").alias("source"), F.lit(0).alias("n"))
    got = mixing.mix(docs, weights=(1, 2), weight=F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.2)).where("source = 'a'").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("taken").alias("t")).toPandas().set_index("odd").t
    assert got[0] > 1.8 * got[1]


def test_packing_is_gapless_and_close_to_the_bound(spark):
    rows = [(i, "tok " * (i * 37 % 900), "en", "s", 0) for i in range(400)] + [(900, "long " * 9000, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = packing.pack_documents(docs, BYTES, 2048).toPandas()
    t = Tokenizer.from_file(BYTES)
    for d, text, *_ in rows[::40] + rows[-1:]:
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [0], "<u4")
        own = got[got.doc_id == d].sort_values("piece")
        assert own.length.sum() == len(ids) and list(own.start) == [0, *own.length.cumsum()[:-1]] and (own.length[1:] == 2048).all()
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length, strict=True)] == list(own.ids_crc32)
    by = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (by.length.sum() <= 2048).all()
    assert (got.sort_values(["sequence_id", "offset"]).offset == by.length.cumsum() - by.length.transform(lambda x: x)).all()
    assert by.ngroups <= -(-got.length.sum() // 2048) + 1


def test_packing_plan_is_optimal_where_brute_force_can_tell():
    rng = np.random.default_rng(3)
    for _ in range(60):
        cap = int(rng.integers(6, 14))
        items = sorted(map(int, rng.integers(1, cap + 1, 7)), reverse=True)
        counts = np.bincount(items, minlength=cap + 1)
        _, bins = packing.plan(counts, cap)
        best = len(items)

        def fill(i, room, best_so_far):
            if len(room) >= best_so_far:
                return best_so_far
            if i == len(items):
                return len(room)
            for k in sorted({r: k for k, r in enumerate(room) if r >= items[i]}.values()):
                best_so_far = fill(i + 1, [*room[:k], room[k] - items[i], *room[k + 1 :]], best_so_far)
            return fill(i + 1, [*room, cap - items[i]], best_so_far)

        best = fill(0, [], best + 1)
        assert best <= bins <= best + 1
        fixed = counts.copy()
        done = packing.reduce_dominated(fixed, cap)
        rest = [s for s in range(cap, 0, -1) for _ in range(fixed[s])]
        items = rest
        assert sum(b for b, _ in done) + fill(0, [], len(rest) + 1) == best  # fixing dominating sets keeps the optimum


def test_quality_measures_equal_brute_force(spark):
    docs = odd_documents(spark)
    extra = [(100 + i, t, "en", "s", 0) for i, t in enumerate(["a b c a b c d", "x\nx\n\nx \n", "# a | b\n# a | b", "w1 w2 w3 w4 w5 w6 w7 w8 " * 9])]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long"))
    got = {(r.doc_id, r.text): r for r in quality_rules.judge_quality(quality_rules.measure_quality(docs, min_words=4)).join(docs.select("doc_id", "text").distinct(), "doc_id").where("doc_id <> 15").collect()}
    for d, text in {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id and r.doc_id != 15}:
        w = (text or "").encode().split()
        at = lambda n: {k for i in range(len(w) - n + 1) if c[tuple(w[i : i + n])] > 1 for k in range(i, i + n)}  # noqa: E731, B023
        c = Counter(tuple(w[i : i + n]) for n in (3, 4) for i in range(len(w) - n + 1))
        lines = [x for x in (text or "").split("\n") if x.encode().strip()]
        longest = 0
        if len(w) < 2000:
            while longest < len(w) and max(Counter(tuple(w[i : i + longest + 1]) for i in range(len(w) - longest)).values(), default=0) > 1:
                longest += 1
        r = got[d, text]
        assert (r.n_words, r.n_repeat_words, r.n_covered_words, r.n_dup_lines) == (len(w), len(at(3)), len(at(4)), len(lines) - len(set(lines)))
        assert r.word_chars == sum(len(x.decode()) for x in w) and r.n_symbols == sum((text or "").count(x) for x in "#*$%&|<>")
        if len(w) < 2000:
            assert r.longest_repeat == (longest if longest >= 4 else 0)
        assert r.base_failed == (len(w) < 50 or 100 * len(at(3)) > 50 * len(w)) and not (r.kept and r.base_failed)


def test_repeated_spans_are_maximal(spark):
    text = "q w a b c d e f g h z x a b c d e f g h k"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (r,) = quality_rules.measure_quality(docs, min_words=4).collect()
    assert sorted((s.first, s.words) for s in r.spans) == [(2, 8), (12, 8)] and r.n_covered_words == 16


@pytest.mark.parametrize("block", [3, 512])
def test_near_texts_equal_brute_force(spark, monkeypatch, block):
    """In small blocks, where every family and bucket is worked on twice, and in large ones."""
    import random

    monkeypatch.setattr(near_text, "BUCKET_BLOCK", block)
    monkeypatch.setattr(near_text, "FAMILY_BLOCK", block)

    from odd import words

    rnd, rows = random.Random(5), []
    for g in range(25):
        base = words(g, rnd.randint(4, 200)).split()
        for _ in range(rnd.randint(1, 9)):
            w = list(base)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = f"n{rnd.randrange(9999)}"
            rows.append((len(rows), " ".join(w).upper() if rnd.random() < 0.3 else "  ".join(w)))
    rows += [(1000 + i, t) for i, t in enumerate(["", None, "one two", "One  TWO", "lone", " "])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in near_text.near_duplicate_texts(docs, threshold=85).collect()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if (w := (t or "").lower().split()) else set() for d, t in rows}
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == {d: (len(sets[d]), top(d)) for d in sets}
    if block > 3:
        kept = {r.doc_id for r in near_text.keep_one_text(docs, threshold=85).collect()}
        assert kept == {d for d in sets if top(d) == d}


def test_texts_that_share_an_id_are_all_kept(spark):
    from odd import words

    a, b = words(1, 60), words(2, 60)
    rows = [(1, a), (5, b), (5, a), (5, b), (7, words(3, 60)), (7, words(4, 60)), (None, a), (None, None), (8, ""), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = Counter((r.doc_id, r.text) for r in near_text.keep_one_text(docs).collect())
    assert kept == Counter([(1, a), (5, b), (7, words(3, 60)), (7, words(4, 60)), (None, a), (None, None), (8, ""), (8, "")])
    assert sorted((r.doc_id, r.component_id) for r in near_text.near_duplicate_texts(docs.where("text is not null and doc_id is not null and text <> ''")).collect()) == [(1, 1), (5, 1), (5, 5), (5, 5), (7, 7), (7, 7)]


def test_a_large_family_moves_its_texts_a_few_times(spark, monkeypatch):
    """400 near copies and blocks of 20: compared with all others they would move 20 times each."""
    from odd import words

    from stockloom.llm import blocks

    base = words(1, 100).split()
    docs = spark.createDataFrame([(i, " ".join(base[:i % 100] + [f"x{i}"] + base[i % 100 + 1:])) for i in range(400)], "doc_id long, text string")
    moved, deal = [], blocks.map_groups
    monkeypatch.setattr(near_text, "FAMILY_BLOCK", 20)
    monkeypatch.setattr(blocks, "map_groups", lambda df, keys, *rest: (moved.append(df.count()), deal(df, keys, *rest))[1])
    assert near_text.near_duplicate_texts(docs).select("component_id").distinct().count() == 1
    assert 400 in moved and sum(moved[len(moved) - 1 - moved[::-1].index(400) :]) <= 2 * 400


def test_sketches_merge_by_maximum_and_estimate_similarity():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 2**63, 4000, dtype=np.uint64) for _ in "ab")
    both = near_text.registers([np.concatenate([a, b])])[0]
    one = near_text.registers([a, b])
    assert (np.maximum(one[0], one[1]) == both).all()
    for share in (0.5, 0.7, 0.95):
        k = int(4000 * 2 * share / (1 + share))
        x, y = a, np.concatenate([a[:k], b[: 4000 - k]])
        r, n = near_text.registers([x, y]), np.array([4000])
        assert near_text.likely(r[:1], n, r[1:], n, share - 0.15)[0, 0] and not near_text.likely(r[:1], n, r[1:], n, min(share + 0.15, 0.999))[0, 0]


def test_near_vectors_find_what_brute_force_finds(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 32))
    near = base[:120] + rng.standard_normal((120, 32)) * 0.45  # cosines around 0.9
    x = np.vstack([base, near, base[:20], base[:5] * 2]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (903, [1.0, None]), (904, []), (905, [1.0, 0.0]), (906, [1.0, 0.0])]
    got = {r.vec_id: r for r in near_vectors.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    found = sum(got[i].n_links for i in range(len(u)))
    assert 0.97 * hit.sum() <= found <= hit.sum() and all(got[i].n_links <= hit[i].sum() for i in range(len(u)))
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (900, 901, 902, 903, 904)) and got[906].component_id == 905
    assert got[420].component_id == got[0].component_id  # a copy of vector 0
    empty = near_vectors.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert empty.count() == 0


@pytest.mark.parametrize(("n", "k"), [(500, 1), (50_000, 8), (10**9, 22)])
def test_calibration_keeps_recall_at_every_size(n, k):
    bits, tables = near_vectors.calibrate(n, 0.9, 0.985)
    assert bits == k and tables < 400
    rng = np.random.default_rng(2)
    a = rng.standard_normal((4000, 48))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.standard_normal((4000, 48))
    o -= (o * a).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * o / np.linalg.norm(o, axis=1, keepdims=True)
    (ca, pa), (cb, pb) = near_vectors.places(a, bits, tables), near_vectors.places(b, bits, tables)
    met = ((ca == cb) & (np.abs(pa - pb) <= near_vectors.window(0.9))).sum(1)
    assert (met >= near_vectors.MIN_COUNT).mean() > 0.97


def test_shards_are_exact_and_uniform(spark):
    from pyspark.sql import functions as F

    docs = spark.range(0, 20_003, numPartitions=7).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    got = sharding.shuffle_shards(docs, 40).toPandas()
    n = got.groupby("shard").slot.agg(["size", "nunique", "max"])
    assert len(n) == 40 and n["size"].max() - n["size"].min() <= 1 and (n["nunique"] == n["size"]).all() and (n["max"] + 1 == n["size"]).all()
    assert (got["size"] == got.doc_id.astype(str).str.len() + 17).all() and (got.text_crc32 == [zlib.crc32(f"t{d}".encode()) for d in got.doc_id]).all()
    part = got.doc_id // (20_003 // 7 + 1)
    table = np.array([np.bincount(got.shard[part == p], minlength=40) for p in range(7)])
    want = table.sum(1)[:, None] * table.sum(0)[None] / table.sum()
    chi = ((table - want) ** 2 / want).sum()
    assert 140 < chi < 340  # 234 degrees of freedom
    place = got.slot + got.shard * 501
    assert abs(np.corrcoef(place, got.doc_id)[0, 1]) < 0.03


def test_hypergeometric_draws_follow_the_law(spark):
    from math import exp, lgamma

    from pyspark.sql import functions as F

    for n, k, d in ((10, 4, 5), (60, 13, 22), (7, 7, 3), (9, 0, 4), (5, 2, 5), (10_000, 5_000, 5_000), (10_000, 8_000, 3_000), (40_000, 37_000, 22_000), (10**10, 4 * 10**9, 10**9), (10**10, 10**10 - 5000, 6 * 10**9)):
        rows = 12_000 if n > 100 else 4000
        got = spark.range(rows).select(sharding.hypergeometric(F.lit(n), F.lit(k), F.lit(d), [F.lit(5), F.lit(n), F.col("id")]).alias("x")).toPandas().x.to_numpy()
        low, high, mean, sd = max(0, d - n + k), min(d, k), d * k / n, np.sqrt(d * k / n * (1 - k / n) * (n - d) / max(n - 1, 1))
        assert got.min() >= low and got.max() <= high
        if n > 10**6:
            assert abs(got.mean() - mean) < 4 * sd / np.sqrt(rows) and abs(got.std() / sd - 1) < 4 / np.sqrt(2 * rows)
            continue
        choose = lambda a, b: lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)
        xs = np.arange(max(low, int(mean - 8 * sd - 2)), min(high, int(mean + 8 * sd + 2)) + 1)
        law = np.cumsum([exp(choose(k, int(x)) + choose(n - k, d - int(x)) - choose(n, d)) for x in xs])
        seen = np.searchsorted(np.sort(got), xs, "right") / rows
        assert np.abs(seen - law).max() < 1.95 / np.sqrt(rows)  # Kolmogorov's bound at one in a thousand


def test_matrix_of_ten_thousand_million_rows_takes_seconds(spark):
    import time

    parts = spark.range(64).selectExpr("id as part", "156250000 + id * 1000 as n")
    began = time.perf_counter()
    got = sharding.communication_matrix(parts, 40, 23).toPandas()
    assert time.perf_counter() - began < 60
    sent = np.stack(got.sort_values("part").sent.to_numpy())
    assert (sent.sum(1) == 156_250_000 + 1000 * np.arange(64)).all() and sent.sum(0).max() - sent.sum(0).min() <= 1 and (sent >= 0).all()


def test_wavelet_matrix_answers_like_the_plain_sequence():
    rng = np.random.default_rng(4)
    for n, top in ((0, 1), (1, 5), (700, 3), (5000, 49407), (3000, 100_000)):
        x = np.minimum(rng.zipf(1.3, n), top).astype(np.uint32)
        ids, sizes, wm = wavelet.read_file(wavelet.write_file(np.arange(2), np.array([n // 2, n - n // 2]), x))
        assert (wm.decode() == x).all() and sizes.sum() == n and list(ids) == [0, 1]
        for at in rng.integers(0, n, 20) if n else ():
            assert wm.access(int(at)) == x[at]
        for token in set(map(int, x[:15])) | {top + 1}:
            where = np.flatnonzero(x == token)
            assert wm.rank(token, n) == len(where) and wm.rank(token, n // 3) == (where < n // 3).sum()
            assert [wm.select(token, i) for i in range(min(len(where), 8))] == where[:8].tolist() and wm.select(token, len(where)) == -1


def test_token_files_hold_the_ids_in_order(spark, tmp_path):
    docs = odd_documents(spark)
    folder = f"file://{tmp_path}/tokens"
    manifest = wavelet.write_tokens(docs, folder, WORDS, per_file=1000)
    got = wavelet.read_tokens(manifest, folder, with_ids=True).toPandas().sort_values("start")
    assert manifest.count() > 2 and list(got.start) == [0, *got.n_tokens.cumsum()[:-1]]
    t = Tokenizer.from_file(WORDS)
    want = sorted(((d is not None, d or 0, text or ""), np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for d, text, *_ in odd_rows())
    assert [(x is not None and x == x, 0 if x is None or x != x else int(x)) for x in got._id] == [w[0][:2] for w in want]
    assert sorted(map(bytes, got.ids)) == sorted(w[1] for w in want) and (got.ids_crc32 == [zlib.crc32(x) for x in got.ids]).all()


def test_cut_encoding_equals_whole_encoding():
    from stockloom.llm.tokens import Encoder

    texts = [r[1] or "" for r in odd_rows()[:9]] + [
        "a  b", "x\n \ny", " lead", "trail ", "don't  stop\t\tnow", "<|endoftext|> hi <|startoftext|>.", "é é, É.", "Σ ΟΔΟΣ. ΟΔΟΣ\nx", "İx, THE. x).,", "a\n\nb c", "\nlead", "a|b | c", "x y z",
        "it's\nwe'll  go", "a.b,c. 1.,2. 3, ½.", "x y. z", "\r\na b",
    ]
    for path, words in ((BYTES, False), (WORDS, True)):
        e, t = Encoder(path, words), Tokenizer.from_file(path)
        for _ in range(2):
            assert e.encode([x.encode() for x in texts]) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_the_suffix_array_rejects_what_the_base_rule_passes(spark):
    """A long passage twice, and many short ones: under half of the words are in repeated windows, yet too much is said again."""
    from odd import words

    passage, rest = words(70, 60), words(71, 180)
    short = [words(80 + i, 9) for i in range(7)]
    rows = [(1, f"{passage} {rest} {passage}"), (2, " ".join([*short, words(72, 200), *short])), (3, rest), (4, words(73, 300))]
    got = {r.doc_id: r for r in quality_rules.judge_quality(quality_rules.measure_quality(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [got[i].kept for i in (1, 2, 3, 4)] == [False, False, True, True]
    assert got[1].longest_repeat == 60 and got[2].longest_repeat < 30 or got[2].n_covered_words * 3 > got[2].n_words
