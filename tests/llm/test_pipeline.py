import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from thicket.llm.encoder import byte_bpe_path

from .reference import quality_scores, toxicity_scores
from .test_substrings import WORD


def write(spark, tmp_path):
    rng = np.random.default_rng(12)
    word = lambda: f"{'abcdefgh'[rng.integers(8)]}{'aeiou'[rng.integers(5)]}{'xyz'[rng.integers(3)]}{rng.integers(400)}"
    passage = " ".join(f"q{j}" for j in range(60))
    rows, marks = [], []
    for i in range(300):
        words, good, toxic = [word() for _ in range(80)], i % 5 != 0, i % 7 == 0
        if not good:
            words = [w + "%%%" for w in words]
        if toxic:
            words[30:30] = ["vile", "wretch", "foul"]
        if i % 11 == 3:
            words[50:50] = passage.split()
        rows.append((i, " ".join(words) + ".", "en", "src0", 10))
        marks.append((i, int(good), int(toxic)))
    for i in range(300, 330):  # near copies of clean documents
        words = rows[(i - 300) * 35 % 300 // 35 * 35 + 1][1].split()
        words[int(rng.integers(len(words)))] = "changed"
        rows.append((i, " ".join(words), "en", "src1", 10))
    rows += [(400, None, "en", "src1", None), (401, "", "en", None, 0), (None, "no id here", "en", "src1", 10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows


def near(a, b):
    sets = []
    for t in (a, b):
        w = WORD.findall((t or "").encode().lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return bool(sets[0] and sets[1]) and 100 * len(sets[0] & sets[1]) >= 80 * len(sets[0] | sets[1])


def test_every_stage_against_brute_force(spark, tmp_path):
    rows = write(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, [sorted(map(tuple, docs.collect()), key=str)]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{n}")
        docs = spark.read.parquet(f"{tmp_path}/stage{n}")
        if n < 4:
            assert docs.columns == columns
        seen.append(sorted(map(tuple, docs.collect()), key=str))
    whole, good, clean, single, short, packed = seen
    assert set(good) <= set(whole) and set(clean) <= set(good) and set(single) <= set(clean)
    ids = lambda x: {r[0] for r in x if r[0] is not None and r[0] < 300}
    assert len(ids(good) ^ {i for i in range(300) if i % 5}) <= 3
    assert len(ids(clean) ^ {i for i in ids(good) if i % 7}) <= 3
    # Near copies: the smallest id of each component stays.
    label = {r[0]: r[0] for r in clean if r[0] is not None}
    for _ in range(5):
        for a in clean:
            for b in clean:
                if a[0] is not None and b[0] is not None and near(a[1], b[1]):
                    label[a[0]] = min(label[a[0]], label[b[0]])
    assert {r[0] for r in single} == {i for i, c in label.items() if i == c} | ({None} & {r[0] for r in clean})
    # Windows of 13 words that start in a smaller id are gone.
    first = {}
    words = {r[0]: WORD.findall((r[1] or "").encode()) for r in single if r[0] is not None}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    texts = {r[0]: r[1] for r in single}
    for r in short:
        if r[0] is not None:
            gone = {x for k in range(len(words[r[0]]) - 12) if first[tuple(words[r[0]][k : k + 13])] < r[0] for x in range(k, k + 13)}
            want = b" ".join(w for k, w in enumerate(words[r[0]]) if k not in gone).decode() if gone else texts[r[0]]
            assert r[1] == want and (not gone or r[4] == len(want))
    assert any(len(r[1] or "") < len(texts[r[0]] or "") for r in short)
    tok = Tokenizer.from_file(byte_bpe_path())
    want = []
    for r in short:
        data = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        want.append((r[0], 0, 0, len(data) // 4, zlib.crc32(data)))
    assert sorted((p[:5] for p in packed), key=str) == sorted(want, key=str)
    assert sorted((tuple(r)[:5] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
    assert len(rows) == len(whole)


def test_classifier_stages_against_plain_versions(spark, tmp_path):
    write(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet").collect()
    for (_, stage), column, folds, out, scores, passes in zip(corpus_pipeline.STAGES, ("quality", "toxic"), (5, 3), (0, 1), (quality_scores, toxicity_scores), (lambda s: s >= 0.3, lambda s: s < 0.7)):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        known = {r.doc_id: r[column] for r in labels if zlib.crc32(str(r.doc_id).encode()) % folds != out}
        plain = dict(zip((i for i, _ in rows), scores(rows, known)))
        kept = stage(spark, docs, str(tmp_path))
        kept.write.parquet(f"{tmp_path}/{column}")
        docs = spark.read.parquet(f"{tmp_path}/{column}")
        got = {r.doc_id for r in docs.collect()}
        sure = {i: s for i, s in plain.items() if abs(s - (0.3 if column == "quality" else 0.7)) > 0.02}
        assert len(sure) > 0.95 * len(plain) and got & sure.keys() == {i for i, s in sure.items() if passes(s)}


def test_stages_take_empty_tables_other_columns_and_repeated_rows(spark, tmp_path):
    write(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = ["__score", "spans", "kept_text", "n_words", "size", "rank", "key", "component_id", "kept", "label"]
    wide = docs.select("*", *(F.lit(f"own {n}").alias(n) for n in names)).unionByName(docs.where("doc_id in (1, 2)").select("*", *(F.lit(f"again {n}").alias(n) for n in names)))
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, wide.limit(0), str(tmp_path)).count() == 0
        out = stage(spark, wide, str(tmp_path))
        out.write.parquet(f"{tmp_path}/wide{n}")
        if n < 4:
            assert out.columns == wide.columns
            wide = spark.read.parquet(f"{tmp_path}/wide{n}")
            assert {r["spans"] for r in wide.select("spans").distinct().collect()} <= {"own spans", "again spans"}
    # Rows that share an id and a text are one document: each of them stays or goes with it.
    left = {r.doc_id: r.n for r in wide.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert all(left.get(i, 2) == 2 for i in (1, 2)) and all(n == 1 for i, n in left.items() if i not in (1, 2))
