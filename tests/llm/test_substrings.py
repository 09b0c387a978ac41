import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from thicket.llm import substring_dedup as sd
from thicket.llm.common import Scratch

from .fixtures import TEXTS, docs

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def brute(rows):
    first = {}
    words = [(i, WORD.findall((t or "").encode())) for i, t, _ in rows]
    for i, w in words:
        if i is not None:
            for k in range(len(w) - 12):
                key = tuple(w[k : k + 13])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for k in range(len(w) - 12):
                if first[tuple(w[k : k + 13])] < i:
                    gone.update(range(k, k + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(seed=4):
    rng = np.random.default_rng(seed)
    shared = [" ".join(f"p{k}w{j}" for j in range(n)) for k, n in enumerate((13, 14, 50, 200, 12, 70))]
    rows = []
    for i in range(80):
        parts = []
        for _ in range(rng.integers(1, 5)):
            parts.append(" ".join(f"u{rng.integers(10**9)}" for _ in range(rng.integers(0, 40))))
            p = shared[rng.integers(len(shared))].split()
            a = rng.integers(0, max(1, len(p) - 13))
            parts.append("  \n".join(p[a : a + rng.integers(5, 200)]))
        rows.append((200 + i * 7 % 80, " ".join(parts), "en"))
    rows += [(400, "same " * 40, "en"), (401, "same " * 30, "en"), (402, "same " * 12, "en"), (-9, shared[2], "en"), (210, shared[3] + " " + shared[3], "en")]
    return rows + [(500 + i, rows[3][1], "de") for i in range(30)]


def test_matches_brute_force(spark):
    rows = TEXTS + passages()
    for batch in (sd.BATCH, 500):
        got = sorted(map(tuple, sd.remove_repeats(docs(spark, rows), batch=batch).collect()), key=str)
        assert got == brute(rows)
    assert sum(r[2] for r in got) > 1000
    assert sd.remove_repeats(docs(spark).limit(0)).count() == 0


def test_texts_and_other_columns_are_kept(spark):
    rows = TEXTS + passages()
    table = docs(spark, rows)
    got = sd.remove_repeats(table, with_text=True)
    assert set(table.columns) - {"text"} <= set(got.columns)
    for r in got.collect():
        assert r.key == "clash" and (r.kept_text is None) == (r.n_words == 0 and r.kept_text is None)
        if r.n_removed:
            assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 and r.spans
        else:
            assert (r.doc_id, r.kept_text) in {(i, t) for i, t, _ in rows}


def test_hash_collisions_remove_nothing(spark, monkeypatch):
    rows = [(i, " ".join(f"a{i}b{j}" for j in range(60)), "en") for i in range(8)]
    table = docs(spark, rows)
    false = spark.createDataFrame([(5, 3, 20, 2, 3)], "doc long, start long, words long, src long, at long")
    monkeypatch.setattr(sd, "repeated_spans", lambda *_: false)
    assert all(r.n_removed == 0 for r in sd.remove_repeats(table).collect())


def test_compact():
    cols = [np.array(x) for x in ([1, 1, 1, 2], [0, 3, 9, 3], [3, 2, 1, 1], [0, 0, 0, 0], [5, 8, 14, 8])]
    assert [x.tolist() for x in sd.compact(*cols)] == [[1, 1, 2], [0, 9, 3], [5, 1, 1], [0, 0, 0], [5, 14, 8]]


def brute_unitigs(rows):
    """Maximal nonbranching paths of the graph of windows that occur in several documents, as tuples of windows."""
    seen = {}
    for i, t, _ in rows:
        w = WORD.findall((t or "").encode())
        for k in range(len(w) - 12):
            seen.setdefault(tuple(w[k : k + 13]), set()).add(i)
    edges = [e for e, ids in seen.items() if len(ids) > 1]
    ways_out, ways_in = {}, {}
    for e in edges:
        ways_out.setdefault(e[:-1], []).append(e)
        ways_in.setdefault(e[1:], []).append(e)
    simple = lambda node: len(ways_out.get(node, [])) == 1 and len(ways_in.get(node, [])) == 1
    out, used = set(), set()
    for e in edges:
        if not simple(e[:-1]):
            path = [e]
            while simple(path[-1][1:]):
                path.append(ways_out[path[-1][1:]][0])
            out.add(tuple(path))
            used.update(path)
    assert used == set(edges)  # no ring among these texts
    return out


def test_paths_are_the_maximal_nonbranching_ones(spark):
    rng = np.random.default_rng(6)
    shared = [[f"p{k}w{j}" for j in range(80)] for k in range(4)]
    shared.append(shared[0][:30] + shared[1][30:])  # a node with two ways in and out at each end
    shared.append([f"z{j}" for j in range(5)] + shared[2][20:60] + [f"y{j}" for j in range(20)])
    rows = []
    for i in range(60):
        p = shared[rng.integers(len(shared))]
        a, z = sorted(rng.choice(len(p) + 1, 2, replace=False))
        rows.append((i * 37 % 60, " ".join([f"u{i}a", *p[a:z], f"u{i}b", *shared[rng.integers(len(shared))][: rng.integers(80)]]), "en"))
    table = docs(spark, rows).selectExpr("doc_id", "text")
    scratch = Scratch(spark, "test")
    spans = sd.repeated_spans(table, scratch, 300)
    asked = scratch.keep(sd._by_source(spans), "asked")
    sources = scratch.keep(table.join(asked, table["doc_id"] == asked["src"]).select("src", "text", "at", "words"), "sources")
    parts = {}
    for r in sd.compacted(scratch, sources, sd.source_runs(asked)).collect():
        parts.setdefault(r.unitig, []).append((r.offset, r.src, r["at"], r.n))
    words = {i: WORD.findall(t.encode()) for i, t, _ in rows}
    got = set()
    for pieces in parts.values():
        path = []
        for offset, src, at, n in sorted(pieces):
            assert offset == len(path)
            path += [tuple(words[src][k : k + 13]) for k in range(at, at + n)]
        got.add(tuple(path))
    want = brute_unitigs(rows)
    if got != want:
        ge, we = {e for p in got for e in p}, {e for p in want for e in p}
        raise AssertionError(str((len(got), len(want), len(ge), len(we), len(ge - we), len(we - ge), [(p[0][0], len(p)) for p in got - want], [(p[0][0], len(p)) for p in want - got])))
    assert any(len(p) > 1 for p in parts.values()) and len(want) > 8


def test_a_common_seed_is_dealt_out(spark, monkeypatch):
    """Lists of common seeds decide where an edge is looked up and nothing else."""
    rows = TEXTS + passages()
    everything = np.unique(np.concatenate([sd._least_seeds(h) for i, t, _ in rows if len(h := sd.WordHashes().of(pa.array([t or ""]))[0]) >= 13]))
    for buckets, hot in ((1, everything[:0]), (7, everything), (7, everything[::2])):
        monkeypatch.setattr(sd, "dealing", lambda _, b=buckets, s=hot: (b, s))
        assert sorted(map(tuple, sd.remove_repeats(docs(spark, rows)).collect()), key=str) == brute(rows)


def test_clashing_names(spark):
    rows = TEXTS + passages()
    names = ["n_words", "n_removed", "spans", "kept_text", "kept_sha256", "c_0", "__score", "key", "body", "src", "at", "claims"]
    table = docs(spark, rows).select("doc_id", "text", "n_chars", *(F.lit(f"own {n}").alias(n) for n in names))
    got = sd.without_repeats(table, length_col="n_chars")
    assert got.columns == table.columns
    want = {(r.doc_id, r.n_words): r.kept_text for r in sd.remove_repeats(docs(spark, rows), with_text=True).collect()}
    texts = {(i, t) for i, t, _ in rows}
    for r in got.collect():
        assert all(r[n] == f"own {n}" for n in names) and r.text in want.values()
        assert (r.doc_id, r.text) in texts or r.n_chars == len(r.text)
    assert sd.remove_repeats(table, with_text=True).columns == [*sd.MADE, "n_chars", *names[5:]]
