"""Learned operators on held-out rows, and the parts of each model on small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.llm import language, quality_model, samples, toxicity
from stockloom.sources.tables import table

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, SF, "labels")


def test_toxicity_on_held_out_rows(docs, labels):
    got = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).where("held_out").join(labels, "doc_id").toPandas()
    flagged, toxic = got.predicted == 1, got.toxic == 1
    assert (flagged & ~toxic).sum() <= 0.02 * toxic.sum() and (flagged & toxic).sum() >= 0.85 * toxic.sum()
    assert got.score.between(0, 1).all() and got[toxic].score.mean() > 0.7 > 0.1 > got[~toxic].score.mean()


def test_held_out_rows_teach_nothing(spark, docs, labels):
    from stockloom.llm.text import held_out

    small = docs.where("doc_id < 1500")
    flipped = labels.withColumn("toxic", F.when(held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit_toxicity(small, labels), toxicity.fit_toxicity(small, flipped)
    assert a.weights == b.weights and all((x[2] == y[2]).all() for x, y in zip(a.trees.nodes, b.trees.nodes, strict=True))


def test_few_toxic_rows_are_calibrated(spark):
    """Too few for a fifth with 20 of each: calibrated all the same, so scores are shares of labels."""
    rare = table(spark, "/root/testdata/sf0.01", "labels")
    few = table(spark, "/root/testdata/sf0.01", "documents")
    model = toxicity.fit_toxicity(few, rare)
    assert model.knots is not None and (np.diff(model.knots[1]) >= 0).all()
    got = toxicity.score_toxicity(few, model).where("not held_out").join(rare, "doc_id").toPandas()
    assert abs(got.score.mean() - got.toxic.mean()) < 0.05


def test_sample_keeps_the_rarer_label_and_its_prior(spark):
    ids = spark.range(6000).select(F.col("id").alias("doc_id"))
    text = F.when(F.col("doc_id") % 40 == 0, "you vile gromble").otherwise("a calm day")
    docs, rare = ids.withColumn("text", text), ids.withColumn("toxic", (F.col("doc_id") % 40 == 0).cast("int"))
    model = toxicity.fit_toxicity(docs, rare, max_rows=400)
    known = rare.where(~toxicity.held_out("doc_id")).agg(F.sum("toxic"), F.count("*")).first()
    sample, dense = samples.label_sample(docs, rare, "toxic", 400)
    assert sample.where("toxic = 1").count() == known[0] and sample.count() == 400 and dense[1] == 1
    assert model.base == pytest.approx(known[0] / known[1])
    got = toxicity.score_toxicity(docs, model).join(rare, "doc_id").groupBy("toxic").agg(F.avg("score").alias("s")).collect()
    assert {r.toxic: r.s > 0.5 for r in got} == {0: False, 1: True}


def test_language_on_held_out_rows(docs):
    got = language.identify_language(docs, language.fit_language(docs)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.98 and got.score.between(0, 1).all()
    assert got[got.ambiguous].shape[0] < 0.05 * len(got)


def test_language_without_letters(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "123 %$ 4"), (4, "der die das und nicht")], "doc_id long, text string")
    learn = spark.createDataFrame([(i, t, x) for i in range(40) for t, x in (("der die das und nicht", "de"), ("the and of with that", "en"))], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify_language(docs, language.fit_language(learn)).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and got[4][0] == "de"


def _many_languages(spark, languages=70, each=9):
    rnd = random.Random(3)
    rows = []
    for k in range(languages):
        own = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 8))) for _ in range(12)]
        rows += [(each * k + i, " ".join(rnd.choice(own) for _ in range(40)), f"x{k:02d}") for i in range(each)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_every_language_is_learned(spark):
    docs = _many_languages(spark)
    model = language.fit_language(docs)
    got = language.identify_language(docs, model).join(docs.drop("text"), "doc_id").toPandas()
    assert len(model.names) == 70 and (got.lang_pred == got.lang).mean() > 0.98


def test_language_sums_in_tasks_give_the_same_weights(spark, monkeypatch):
    docs = _many_languages(spark, 8, 40)
    here, tasks = language.fit_language(docs), language.fit_language(docs, most_here=0)
    assert here.names == tasks.names and np.allclose(here.weights, tasks.weights, atol=1e-4)
    assert np.allclose(here.trust, tasks.trust) and here.sharpness == tasks.sharpness
    one, other = (language.identify_language(docs, m).orderBy("doc_id").toPandas() for m in (here, tasks))
    assert np.allclose(one.score, other.score, atol=1e-4) and (one.ambiguous == other.ambiguous).all()
    monkeypatch.setattr(language, "MOST_SENT", 0)
    joined = language.fit_language(docs)
    assert np.allclose(joined.weights, here.weights, atol=1e-4) and joined.sharpness == here.sharpness
    mixed = docs.withColumn("lang", F.concat(F.lit("x"), (F.xxhash64("doc_id") % 3).cast("string")))  # labels that no text tells
    blind = language.fit_language(mixed, most_here=0)
    assert blind.sharpness < 8 and language.identify_language(docs, blind).where("held_out").agg(F.avg("score")).first()[0] < 0.7


@pytest.mark.parametrize("classes", [2, 3, 4, 5, 12])
def test_codewords_tell_classes_apart(classes):
    code = language.codewords(classes)
    apart = (code.shape[1] - code @ code.T) / 2
    assert apart[~np.eye(classes, dtype=bool)].min() >= max(1, code.shape[1] // 4)


def test_quality_on_held_out_rows(docs, labels):
    model = quality_model.fit_quality(docs, labels.withColumn("grade", quality_model.rating()))
    got = quality_model.score_quality(docs, model).where("held_out").join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.98 and got[got.quality == 0].kept.mean() < 0.1
    assert (got.tail_1 >= got.tail_2).all() and got.expected_grade.between(0, 2).all()
    kept = quality_model.select_quality(docs, model)
    assert kept.columns == docs.columns


def test_null_labels_and_odd_grades_teach_nothing(spark):
    rows = [(0, 0), (1, 1), (1, 0), (None, 0), (1, None), (0, None), (None, None)]
    got = spark.createDataFrame(rows, "quality int, toxic int").select(quality_model.rating().alias("g")).collect()
    assert [r.g for r in got] == [0, 1, 2, None, None, 0, None]
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "good calm words here").otherwise("zzz ### zzz").alias("text"))
    plain = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 2).otherwise(0).alias("grade"))
    odd = plain.withColumn("grade", F.when(F.col("doc_id") % 10 == 0, None).when(F.col("doc_id") % 10 == 5, 7).when(F.col("doc_id") % 10 == 7, -1).otherwise(F.col("grade")))
    assert np.allclose(quality_model.fit_quality(docs, odd).weights, quality_model.fit_quality(docs, plain.where("doc_id % 10 not in (0, 5, 7)")).weights)
    assert quality_model.score_quality(docs, quality_model.fit_quality(docs, plain.where("false"))).where("kept").count() == 60


def test_selection_tail_lies_between_poor_and_good():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 600)
    x = np.zeros((600, 4), np.float32)
    x[np.arange(600), np.minimum(y, 1)] = 1
    assert 0.2 < quality_model.select_tail(x, y, 3, 0.99) < 0.95
    assert quality_model.select_tail(x, np.ones(600, int), 3, 0.99) == 0.5


def test_ordinal_model_recovers_thresholds():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 3)).astype(np.float32)
    s = x @ np.array([1.0, -2.0, 0.5])
    y = (s[:, None] + rng.logistic(size=(3000, 1)) > np.array([-1.0, 0.5, 2.0])).sum(1)
    m = quality_model.fit_ordinal(x, y, 4)
    assert np.allclose(m.weights, [1, -2, 0.5], atol=0.2) and np.allclose(m.cuts, [-1, 0.5, 2], atol=0.25) and (np.diff(m.cuts) > 0).all()


def test_trees_and_isotonic():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    t = toxicity.Trees().fit(x, y)
    assert ((t.margin(x) > 0) == y).mean() > 0.97
    knots, p = toxicity.isotonic(np.array([1.0, 2, 3, 4, 5, 6]), np.array([0.0, 1, 0, 0, 1, 1]))
    assert (np.diff(p) >= 0).all() and (np.diff(knots) > 0).all() and 0 < p[0] < p[-1] < 1


def test_hidden_insults_count():
    lexicon = toxicity._Lexicon({})
    plain, hidden, calm = toxicity._features([b"you idiot now", b"you 1d1o7 now", b"you are fine"], lexicon)
    at = toxicity.FEATURES.index
    assert plain[at("insult_count")] == hidden[at("insult_count")] == 1 and calm[at("insult_count")] == 0
    assert hidden[at("obfuscated")] == 1 and plain[at("near_person")] == 1


def test_first_by_hash_is_the_exact_ranking(spark):
    rows = spark.range(5000).select(F.col("id").alias("_id"), F.when(F.col("id") % 50 == 0, 1).when(F.col("id") % 7 == 0, 2).otherwise(0).alias("g"))
    take = {0: 300, 1: 40, 2: 10_000}
    got = samples.first_by_hash(rows, "g", F.when(F.col("g") == 0, 300).when(F.col("g") == 1, 40).otherwise(10_000)).toPandas()
    every = rows.withColumn("h", F.xxhash64("_id")).toPandas()
    for g, n in take.items():
        assert sorted(got[got.g == g]["_id"]) == sorted(every[every.g == g].sort_values("h")["_id"][:n])
    assert samples.first_by_hash(rows.limit(0), "g", 5).count() == 0
    assert samples.first_by_hash(rows, "g", 0).count() == 0
