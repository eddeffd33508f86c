"""Near vectors against all pairs of a small fixture."""

import numpy as np
import pytest

from sparkloom.llm.near_vectors import Hashing, codes, hadamard, near_vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, rep string, bucket int"


def brute(rows, t=0.98):
    by = {}
    for i, v, label, *_ in rows:
        if i is not None:
            by.setdefault(i, []).append((v, label))
    ids = sorted(by)
    top, n = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def ok(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for p in range(len(ids)):
        for q in range(p):
            (a, la), (b, lb) = by[ids[p]][0], by[ids[q]][0]
            if ok(a, la) and ok(b, lb) and la == lb and len(a) == len(b):
                x, y = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= t:
                    n[ids[p]] += 1
                    n[ids[q]] += 1
                    u, v = find(ids[p]), find(ids[q])
                    top[max(u, v)] = min(u, v)
    return [(i, n[i], find(i), find(i) == i) for i in ids]


def test_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows, base = [], rng.normal(size=(60, 24))
    for i in range(300):
        v = base[rng.integers(60)] + rng.normal(size=24) * rng.choice([0, 0.05, 0.15, 0.25])
        rows.append((i, v.astype(np.float32).tolist(), int(rng.integers(3)), "a", 1))
    rows += [(400, None, 1, "a", 1), (401, [0.0] * 24, 1, "a", 1), (402, [1.0, None] + [0.0] * 22, 1, "", 1), (403, [float("nan")] * 24, 1, "", 1), (404, [float("inf")] * 24, 1, "", 1), (405, rows[0][1], None, "", 1), (406, [], 1, "", 1), (407, [1.0, 2.0], 1, "", 1), (408, [2.0, 4.0], 1, "", 1), (None, rows[0][1], rows[0][2], "", 1), (9, rows[9][1], rows[9][2], "", 1)]
    rows += [(500 + i, (np.array(rows[7][1]) * (1 + i)).tolist(), rows[7][2], "", 1) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    for block in (256, 7):
        got = sorted(tuple(r) for r in near_vectors(df, block=block).collect())
        assert got == want


def test_empty(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rotation_keeps_length():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))


@pytest.mark.parametrize("k", [1, 2, 3])
def test_recall_at_the_threshold(k):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    u = rng.normal(size=a.shape)
    u -= (u * a).sum(1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * u / np.linalg.norm(u, axis=1, keepdims=True)
    x, y = codes(a, Hashing(), k), codes(b, Hashing(), k)
    met = (x[:, :, :, None] == y[:, :, None, :]).any((1, 2, 3))
    assert met.mean() >= 0.98


@pytest.mark.parametrize("dims, k", [(64, 3), (64, 4), (768, 3), (768, 4)])
def test_recall_of_many_hashes_and_wide_vectors(dims, k):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(600, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    u = rng.normal(size=a.shape)
    u -= (u * a).sum(1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * u / np.linalg.norm(u, axis=1, keepdims=True)
    x, y = codes(a, Hashing(), k), codes(b, Hashing(), k)
    met = (x[:, :, :, None] == y[:, :, None, :]).any((1, 2, 3))
    print("recall", dims, k, met.mean())
    assert met.mean() >= 0.98


def test_tiny_and_huge_numbers(spark):
    rows = [(1, [1e-310, 3e-310]), (2, [3e-310, 1e-310]), (3, [2e-310, 6e-310]), (4, [5e-324, 0.0]), (5, [1.0, 0.0]), (6, [1e308, 1.5e308]), (7, [2.0, 3.0]), (8, [1e307, 1.5e307])]
    df = spark.createDataFrame([(i, v, "a") for i, v in rows], "vec_id bigint, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df).collect()}
    assert got == {1: (1, 1), 2: (0, 2), 3: (1, 1), 4: (1, 4), 5: (1, 4), 6: (2, 6), 7: (2, 6), 8: (2, 6)}
