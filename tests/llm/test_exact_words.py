import xxhash

from thicket.llm import toxicity

from .test_classifiers import corpus


def test_a_clean_word_does_not_weigh_as_a_toxic_one_whose_hash_it_partly_shares(spark):
    table, labels, rows = corpus(spark)
    model = toxicity.train(table, labels)
    place = xxhash.xxh32_intdigest("vile") >> 12  # the first 20 bits, which were all that was compared
    clean = next(w for w in (f"q{i}" for i in range(20_000_000)) if xxhash.xxh32_intdigest(w) >> 12 == place)
    texts = [(1, "one vile day.", "en"), (2, f"one {clean} day.", "en"), (3, "one plain day.", "en")]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(texts, "doc_id long, text string, lang string"), model).collect()}
    assert got[1] > got[3] and got[2] == got[3]
