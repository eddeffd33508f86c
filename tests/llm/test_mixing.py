"""Mixing: targets, the knapsack and the invariants of a mix."""

import itertools
import random

import numpy as np
import pytest

from sparkloom.llm.mixing import fit, mix_sources, targets

SCHEMA = "doc_id bigint, text string, source string, size int, src string, budget int"


def test_targets():
    t = targets({"a": 100, "b": 10, "c": 0}, 110, {"a": 1, "b": 2, "c": 3}, 3)
    assert t == {"a": 80.0, "b": 30.0, "c": 0.0}
    assert targets({}, 0, {}, 3) == {}


@pytest.mark.parametrize("seed", range(6))
def test_fit_is_a_best_subset_sum(seed):
    rng = random.Random(seed)
    lengths = np.array(sorted(rng.sample(range(2, 60), 5)))
    counts = np.array([rng.randint(1, 4) for _ in lengths])
    budget = rng.randint(0, int(lengths @ counts) + 5)
    best = max(s for s in (int(lengths @ np.array(c)) for c in itertools.product(*[range(n + 1) for n in counts])) if s <= budget)
    take = fit(lengths, counts, budget)
    assert (take <= counts).all() and int(lengths @ take) == best


def test_fit_of_a_large_budget_is_near():
    rng = np.random.default_rng(1)
    lengths, counts = np.unique(rng.integers(5, 3000, 800)), None
    counts = rng.integers(1, 400, len(lengths))
    budget = int(lengths @ counts) // 3
    take = fit(lengths, counts, budget)
    assert (take <= counts).all() and abs(int(lengths @ take) - budget) <= 5


def test_mix(spark):
    rng, rows = random.Random(2), []
    for i in range(600):
        n = 40 if i % 3 == 0 else rng.choice([0, 1, 3, 7, 20, 90])
        rows.append((i, rng.choice([" ", "\n\t"]).join(["w"] * n) if n or i % 2 else None, rng.choice(["a", "a", "a", "b", "B", None, "é"]), 1, "z", 5))
    rows += [(1000, "x y", "tiny", 1, "", 1), (1001, None, "none", 1, "", 1), (None, "q r s", "a", 1, "", 1), rows[4]]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mix_sources(df)
    got = out.collect()
    assert len(got) == len(rows)
    total = sum(len((t or "").split()) for _, t, *_ in rows)
    order = sorted({s for _, _, s, *_ in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(len((t or "").split()) for _, t, z, *_ in rows if z == s) for s in order}
    want = targets(size, total, {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}, 3)
    for s in order:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == size[s] and abs(r.target - want[s]) < 1e-6 for r in mine)
        assert all(r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 2
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mix_sources(df.repartition(3)).collect()), key=repr)


def test_empty(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fit_of_few_long_documents():
    lengths, counts = np.array([50000, 60000]), np.array([2, 1])
    assert fit(lengths, counts, 100000).tolist() == [2, 0]
    assert fit(np.array([40000, 70000, 90001]), np.array([3, 2, 1]), 180000).tolist() == [1, 2, 0]


@pytest.mark.parametrize("seed", range(4))
def test_fit_of_long_documents_is_a_best_subset_sum(seed):
    rng = random.Random(seed)
    lengths = np.array(sorted(rng.sample(range(30_000, 200_000), 5)))
    counts = np.array([rng.randint(1, 4) for _ in lengths])
    budget = rng.randint(0, int(lengths @ counts))
    best = max(s for s in (int(lengths @ np.array(c)) for c in itertools.product(*[range(n + 1) for n in counts])) if s <= budget)
    take = fit(lengths, counts, budget)
    assert (take <= counts).all() and int(lengths @ take) == best


def test_fit_in_a_coarser_unit():
    rng = np.random.default_rng(3)
    lengths = np.unique(rng.integers(40_000, 400_000, 60))
    counts = rng.integers(1, 3, len(lengths))
    budget = int(lengths @ counts) // 2
    narrow, coarse = (fit(lengths, counts, budget, bits=b) for b in (1, 1 << 24))
    assert (coarse <= counts).all() and int(lengths @ narrow) <= int(lengths @ coarse) <= budget
    assert budget - int(lengths @ coarse) <= 2000
