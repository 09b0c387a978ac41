import zlib

import numpy as np
from pyspark.sql import functions as F

from thicket.llm import quality, toxicity

from .fixtures import TEXTS, docs


def corpus(spark, n=240):
    rng = np.random.default_rng(5)
    rows, marks = [], []
    for i in range(n):
        words = [f"{'abcdefgh'[rng.integers(8)]}{'aeiou'[rng.integers(5)]}{'xyz'[rng.integers(3)]}" for _ in range(60)]
        toxic, good = i % 4 == 0, i % 3 != 0
        if not good:
            words = [w + "%%%" for w in words]
        if toxic:
            words[20:20] = ["vile", "wretch", "Foul!"]
        rows.append((i, ". ".join([" ".join(words[:30]), " ".join(words[30:])]) + ".", "en"))
        marks.append((i, int(good), int(toxic)))
    marks += [(None, 1, 0), (3, None, None), (99_999, 1, 1)]
    return docs(spark, rows + TEXTS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), rows


def brute_fold(i, folds):
    return zlib.crc32(str(i).encode()) % folds


def test_toxicity(spark):
    table, labels, rows = corpus(spark)
    got = toxicity.classify(table, labels).collect()
    assert len(got) == len(rows) + len(TEXTS)
    for r in got:
        assert r.held_out == (r.doc_id is not None and brute_fold(r.doc_id, 3) == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = {r.doc_id: r.predicted for r in got if r.held_out and r.doc_id is not None and r.doc_id >= 11}
    assert held and all(p == int(i % 4 == 0) for i, p in held.items())


def test_toxicity_locates_sentences(spark):
    table, labels, rows = corpus(spark)
    model = toxicity.train(table, labels)
    found = {r.doc_id: r.offending for r in toxicity.score(table, model, spans_from=0.5).collect() if r.doc_id is not None}
    for i, _, _ in rows[12:]:
        assert bool(found[i]) == (i % 4 == 0)
        assert all("vile" in s.text or "wretch" in s.text for s in found[i][:1])


def test_noisy_or_is_the_product_over_sentences():
    model = toxicity.NoisyOr(np.array([1.0, -2.0, 0.5, 3.0], dtype=np.float32), -1.0)
    words, starts = np.array([0, 1, 2, 3]), np.array([0, 3])
    p = [1 / (1 + np.exp(-z)) for z in (1 - 2 + 0.5 - 1, 3 - 1)]
    assert abs(model.score(words, starts) - (1 - (1 - p[0]) * (1 - p[1]))) < 1e-9
    assert model.score(words[:0], starts[:0]) == 0
    assert 0 < toxicity.fit_noisy_or([(words, starts)] * 3, [0, 0, 0], 2).score(words, starts) < 0.5


def test_quality(spark):
    table, labels, rows = corpus(spark)
    got = quality.classify(table, labels).collect()
    assert len(got) == len(rows) + len(TEXTS)
    for r in got:
        assert r.held_out == (r.doc_id is not None and brute_fold(r.doc_id, 5) == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.predicted, int(r.doc_id % 3 != 0)) for r in got if r.held_out and r.doc_id is not None and r.doc_id >= 11]
    assert held and np.mean([a == b for a, b in held]) > 0.95


def test_no_labels_and_no_rows(spark):
    table, labels, _ = corpus(spark, 12)
    for op in (toxicity, quality):
        assert op.classify(table, labels.limit(0)).count() == 12 + len(TEXTS)
        assert op.classify(table.limit(0), labels).count() == 0
        assert op.classify(table, labels.withColumn("quality", F.lit(1)).withColumn("toxic", F.lit(0))).count() == 12 + len(TEXTS)


def test_word_vectors_count_neighbours(spark):
    table = spark.createDataFrame([("one two one",), (None,), ("",)], "text string")
    vectors = quality.word_vectors(table)
    assert vectors.shape == (quality.CORES + quality.SHAPES, quality.DIM) and np.isfinite(vectors).all()
    seen = np.flatnonzero(np.abs(vectors).sum(1))
    codes, _ = quality.Shapes().codes(["one two"])
    assert set(codes >> 16) <= set(seen)
