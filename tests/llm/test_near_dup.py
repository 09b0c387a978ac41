import re

import numpy as np

from thicket.llm import components as cc
from thicket.llm import minhash
from thicket.llm.common import Scratch
from thicket.llm.components import components, forest

from .fixtures import TEXTS, docs

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def brute_components(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def brute_sets(rows):
    out = []
    for i, t, _ in rows:
        w = WORD.findall((t or "").encode().lower())
        out.append((i, {tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if w else set()))
    return out


def near_copies(seed=1, families=6, size=12):
    rng, rows, at = np.random.default_rng(seed), [], 100
    for f in range(families):
        base = [f"w{rng.integers(10_000)}" for _ in range(rng.integers(20, 200))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.integers(0, max(2, len(base) // 8))):
                copy[rng.integers(len(copy))] = f"edit{rng.integers(10_000)}"
            rows.append((at, " ".join(copy), "en"))
            at += 1
        rows.append((at, "  ".join(base).upper(), "en"))
        at += 1
    return rows


def test_near_duplicates_match_brute_force(spark):
    rows = TEXTS + near_copies()
    got = sorted(map(tuple, minhash.near_duplicates(docs(spark, rows)).collect()), key=str)
    sets = brute_sets(rows)
    links = [(i, j) for i, a in sets for j, b in sets if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b)]
    label = brute_components({i for i, _ in sets if i is not None}, links)
    want = sorted(((i, len(s), label.get(i), True if i is None else label[i] == i) for i, s in sets), key=str)
    assert got == want
    assert len({c for _, _, c, _ in want}) < len(rows) - 20
    assert minhash.near_duplicates(docs(spark).limit(0)).count() == 0


def test_large_groups_go_by_tiles(spark, monkeypatch):
    """Copies of a text that is not there itself: most are linked with few others, so hardly any pair is settled by the heads."""
    for name, value in (("FEW", 3), ("FAMILY", 4), ("CHUNK", 10), ("TILE", 8)):
        monkeypatch.setattr(minhash, name, value)
    rng, rows = np.random.default_rng(9), []
    for f in range(3):
        base = [f"b{f}w{j}" for j in range(160)]
        for i in range(40):
            copy = list(base)
            for k in rng.choice(160, 4 + f, replace=False):
                copy[k] = f"edit{rng.integers(10**9)}"
            rows.append((f * 100 + i, " ".join(copy), "en"))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    sets = brute_sets(rows)
    links = [(i, j) for i, a in sets for j, b in sets if 100 * len(a & b) >= 80 * len(a | b)]
    assert got == brute_components({i for i, _ in sets}, links)
    assert 3 < len(set(got.values())) < 120


def test_estimate_is_close(spark):
    rng = np.random.default_rng(3)
    rows, truth = [], []
    for k in range(60):
        pool = rng.integers(0, 1 << 62, 600).astype(np.uint64)
        a, b = np.unique(pool[:500]), np.unique(pool[k:])
        truth.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        rows.append([tuple(int(v) for v in minhash.packed(minhash.minima(s))) for s in (a, b)])
    kind = "struct<" + ",".join(f"s{i}: long" for i in range(minhash.WORDS)) + ">"
    table = spark.createDataFrame(rows, f"x {kind}, y {kind}")
    got = np.array([r[0] for r in table.select(minhash.estimate("x", "y")).collect()])
    assert np.abs(got - truth).max() < 0.2 and abs((got - truth).mean()) < 0.03


def test_components(spark, monkeypatch):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000)] + [(6000, 6001 + i) for i in range(500)]
    table = spark.createDataFrame([*edges, (None, 3)], "a long, b long").repartition(5)
    for limit in (cc.LOCAL, 10):
        monkeypatch.setattr(cc, "LOCAL", limit)
        got = {r.node: r.component for r in components(Scratch(spark, "test"), table).collect()}
        assert got == brute_components({n for e in edges for n in e}, edges)
    assert components(Scratch(spark, "test"), table.limit(0)).count() == 0
    node, root = forest(np.array([5, 4, 9]), np.array([4, 3, 9]))
    assert node.tolist() == [3, 4, 5, 9] and root.tolist() == [3, 3, 3, 9]
