import math

import numpy as np

from thicket.llm import hamming, vector_dedup

from .test_near_dup import brute_components


def rows_of(seed=6):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(150):
        rows.append((i, rng.normal(size=16).tolist()))
    for i in range(120):
        base = np.array(rows[i % 7][1])
        rows.append((1000 + i, (base * rng.uniform(0.5, 2) + rng.normal(size=16) * rng.choice([0, 0.02, 0.25])).tolist()))
    rows += [(2000 + i, rows[3][1]) for i in range(30)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [None] + [1.0] * 15), (3004, [math.inf] + [1.0] * 15), (3005, [math.nan] * 16), (3006, [1.0, 2.0]), (3007, [2.0, 4.0]), (None, rows[3][1]), (5, rows[9][1])]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, b"x", 2) for i, v in rows], "vec_id long, embedding array<double>, label int, vec binary, cls int").repartition(4)


def test_near_duplicates_match_brute_force(spark):
    rows = rows_of()
    good = [(k, i, np.array(v, dtype=float)) for k, (i, v) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = [(k, m) for k, _, x in good for m, _, y in good if k != m and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.95]
    label = brute_components({i for i, _ in rows if i is not None}, [(rows[k][0], rows[m][0]) for k, m in links])
    degree = [0] * len(rows)
    for k, _ in links:
        degree[k] += 1
    want = sorted(((i, degree[k], label.get(i), True if i is None else label[i] == i) for k, (i, _) in enumerate(rows)), key=str)
    for tile in (4096, 40):
        got = sorted(map(tuple, vector_dedup.near_duplicates(table(spark, rows), tile=tile).collect()), key=str)
        assert got == want
    assert vector_dedup.near_duplicates(table(spark, rows).limit(0)).count() == 0


def test_bound_leaves_no_pair_out():
    rng = np.random.default_rng(1)
    for dim in (3, 64, 2000):
        a = rng.normal(size=(200, dim)) * rng.uniform(0.001, 1000, size=(200, 1))
        b = a[rng.integers(0, 200, 300)] + rng.normal(size=(300, dim)) * np.abs(a).mean() * 0.3
        cos = vector_dedup.unit(a) @ vector_dedup.unit(b).T
        for threshold in (0.5, 0.9, 0.99):
            got = {(i, j) for x, y in vector_dedup.close_pairs(a, b, threshold, False) for i, j in zip(x.tolist(), y.tolist())}
            want = set(zip(*(z.tolist() for z in np.nonzero(cos >= threshold))))
            assert all(abs(cos[p] - threshold) < 1e-12 for p in got ^ want)


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=40).tolist()) for i in range(300)] + [(300 + i, [1.0] * 40) for i in range(40)] + [(900, None), (901, []), (902, [None] * 40), (903, [math.nan] * 40), (904, [1.0] * 8), (None, [1.0] * 40)]
    codes = hamming.sign_codes(table(spark, rows))
    got = {}
    for r in hamming.top_k(codes, codes.where("vec_id % 20 = 0"), 7, block=100, query_block=9).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.vec_id))
    bits = {i: np.array(v) > 0 for i, v in rows[:340]}
    want = {}
    for q in range(0, 340, 20):
        best = sorted((int((bits[q] != b).sum()), i) for i, b in bits.items() if i != q)[:7]
        want[q] = [(n + 1, d, i) for n, (d, i) in enumerate(best)]
    assert {q: sorted(x) for q, x in got.items()} == want
    assert hamming.top_k(codes.limit(0), codes.limit(0)).count() == 0
    assert hamming.top_k(codes.where("vec_id < 3"), codes.where("vec_id = 0")).count() == 2


def test_search_ends_early_and_is_exact():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 16, (40, 4), dtype=np.uint16)
    codes = np.concatenate([base[rng.integers(0, 40, 4000)] ^ (np.uint16(1) << rng.integers(0, 16, (4000, 4), dtype=np.uint16)), rng.integers(0, 1 << 16, (16_000, 4), dtype=np.uint16)])
    index = hamming.MultiIndex(codes, np.arange(len(codes)))
    for q in range(0, 4000, 400):
        best, compared = index.search(codes[q], 5, q)
        distance = np.bitwise_count(codes ^ codes[q]).sum(axis=1)
        assert best == sorted((int(d), i) for i, d in enumerate(distance) if i != q)[:5]
        assert compared < len(codes) // 4


def test_very_large_and_very_small_components_link_by_direction(spark):
    rows = [(1, [1e200, 1e200]), (2, [2e200, 2e200]), (3, [3.0, 3.0]), (4, [1e-200, 1e-200]), (5, [1e-200, 0.0]), (6, [2e-200, 0.0]), (7, [5e-324, 5e-324]), (8, [-1.0, 1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_duplicates(table(spark, rows)).collect()}
    assert got == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (4, 1), 7: (4, 1), 5: (1, 5), 6: (1, 5), 8: (0, 8)}


def test_bounds_are_each_vectors_own():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 32))
    x[0, 0] = 1000  # a spiky vector widens nobody else's step
    alone, together = vector_dedup.quantised(vector_dedup.unit(x[1:])), vector_dedup.quantised(vector_dedup.unit(x))
    assert (alone.step == together.step[1:]).all() and (alone.error == together.error[1:]).all() and (alone.q == together.q[1:]).all()
    assert (np.abs(vector_dedup.unit(x) - together.q * together.step[:, None]) <= together.error[:, None]).all()


def test_codes_of_infinite_components_and_repeated_ids(spark):
    rows = [(1, [math.inf, -1.0]), (2, [5.0, -math.inf]), (2, [-1.0, -1.0]), (2, [-1.0, -1.0]), (20, [1.0, 1.0]), (20, [1.0, 1.0])]
    codes = hamming.sign_codes(table(spark, rows))
    got = [tuple(r) for r in hamming.top_k(codes, codes.where("vec_id = 20"), 9).orderBy("rank").collect()]
    assert got == [(20, 1, 1, 1), (20, 2, 2, 1), (20, 3, 2, 2), (20, 4, 2, 2)]
