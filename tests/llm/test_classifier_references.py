import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from thicket.llm import quality, toxicity

from .fixtures import TEXTS
from .reference import quality_features, quality_scores, quality_vectors, toxicity_scores
from .test_classifiers import brute_fold, corpus


def marks(labels, column, folds, out):
    return {r.doc_id: r[column] for r in labels.collect() if r.doc_id is not None and r[column] is not None and brute_fold(r.doc_id, folds) != out}


def test_quality_against_plain_numpy(spark):
    table, labels, rows = corpus(spark)
    known = marks(labels, "quality", 5, 0)
    everything = [(i, t) for i, t, _ in rows + TEXTS]
    # An id with several rows is learnt from once: the fixtures' ids that repeat are left out on both sides.
    once = [(i, t) for i, t in everything if sum(d == i for d, _ in everything) == 1]
    plain = dict(once)
    clean = table.where(F.col("doc_id").isin([i for i, _ in once if i is not None]) | F.col("doc_id").isNull())
    got = {r.doc_id: r.score for r in quality.classify(clean, labels).collect()}
    want = quality_scores(list(plain.items()), known)
    assert set(got) == set(plain)
    for (i, _), s in zip(plain.items(), want):
        assert got[i] == pytest.approx(s, abs=0.02)


def test_word_vectors_features_and_scores_against_plain_numpy(spark):
    texts = [t for _, t, _ in TEXTS] + ["one two three two one", "Loud WORDS! and $$ signs, twice twice", "a"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    vectors, want = quality.word_vectors(frame), quality_vectors(texts)
    assert np.allclose(vectors, want, atol=1e-5)
    x = quality.pooled(vectors, *quality.Shapes().codes(texts))
    assert np.allclose(x, [quality_features(want, t) for t in texts], atol=1e-4)
    rng = np.random.default_rng(3)
    net = quality.Network(x.mean(0), x.std(0) + 0.1, rng.normal(size=(x.shape[1], 24)) / 10, rng.normal(size=24), rng.normal(size=24), 0.3, 1.7)
    got = np.concatenate(list(quality.QualityModel(vectors, net).scorer()(pa.array(texts, pa.string()))))
    assert np.allclose(got, net.scores(x), atol=1e-5)


def test_toxicity_against_plain_loops(spark):
    table, labels, rows = corpus(spark)
    known = marks(labels, "toxic", 3, 1)
    everything = [(i, t) for i, t, _ in rows + TEXTS]
    plain = {i: t for i, t in everything if sum(d == i for d, _ in everything) == 1}
    clean = table.where(F.col("doc_id").isin([i for i in plain if i is not None]) | F.col("doc_id").isNull())
    got = {r.doc_id: r for r in toxicity.classify(clean, labels).collect()}
    want = toxicity_scores(list(plain.items()), known)
    assert set(got) == set(plain)
    for (i, _), s in zip(plain.items(), want):
        assert got[i].score == pytest.approx(s, abs=1e-4)
        assert bool(got[i].offending) == (got[i].predicted == 1)


def test_training_on_executors_is_the_fit_in_memory(spark):
    table, labels, rows = corpus(spark)
    model = toxicity.train(table.where("doc_id > 10"), labels)
    known = marks(labels, "toxic", 1, 1)
    words = toxicity.WordTable(toxicity.BITS)
    chosen = sorted((i, t) for i, t, _ in rows if i > 10 and i in known)
    want = toxicity.fit_noisy_or([words.sentences(t) for _, t in chosen], [known[i] for i, _ in chosen], toxicity.BITS)
    assert (model.keys == want.keys).all() and np.allclose(model.weights, want.weights, atol=1e-5) and model.bias == pytest.approx(want.bias, abs=1e-6)


def test_the_sample_is_bounded_by_rows_fitted(spark):
    table, labels, _ = corpus(spark)
    repeated = table.unionByName(table).unionByName(table)
    for limit in (5, 40):
        sample = toxicity.labelled(repeated, labels, "toxic", F.lit(True), limit)
        assert sample.select("doc_id").distinct().count() == limit


def test_filters_keep_columns_of_any_name(spark):
    table, labels, rows = corpus(spark)
    clash = table.select("doc_id", "text", *(F.lit(f"own {n}").alias(n) for n in ("__score", "score", "c_0", "label", "x", "words.and dots")))
    good, toxic = quality.train(clash, labels), toxicity.train(clash, labels)
    for out, scores, passes in ((quality.at_least(clash, good, 0.3), quality.score(clash, good), lambda s: s >= 0.3), (toxicity.below(clash, toxic, 0.7), toxicity.score(clash, toxic), lambda s: s < 0.7)):
        assert out.columns == clash.columns
        got = out.collect()
        assert all(r["__score"] == "own __score" and r["words.and dots"] == "own words.and dots" for r in got)
        want = sorted((str(r.doc_id) for r in scores.collect() if passes(r.score)))
        assert sorted(str(r.doc_id) for r in got) == want
    assert quality.at_least(clash.limit(0), good, 0.3).count() == toxicity.below(clash.limit(0), toxic, 0.7).count() == 0
