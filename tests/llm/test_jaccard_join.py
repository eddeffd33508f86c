"""The Jaccard join against all pairs of a small fixture."""

import gc
import random
import re
import time

from fractions import Fraction
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import cluster, jaccard_join
from sparkloom.llm import words as W
from sparkloom.llm.cluster import Scratch, components, join_skewed
from sparkloom.llm.jaccard_join import COUNTED, COUNTERS, Bands, Posts, _light, _segments, _signatures, jaccard_components, posting_counts

SCHEMA = "doc_id bigint, text string, a string, component_id string"


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, k))
    ids = sorted(sets)
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for x in range(len(ids)):
        for y in range(x):
            for a in sets[ids[x]]:
                for b in sets[ids[y]]:
                    if a and b and den * len(a & b) >= num * len(a | b):
                        p, q = find(ids[x]), find(ids[y])
                        top[max(p, q)] = min(p, q)
    return sorted((i, max(map(len, sets[i])), find(i)) for i in ids)


def corpus(seed, n=140):
    rng = random.Random(seed)
    vocab = [f"W{i}" for i in range(3000)]
    rows, base = [], []
    for i in range(n):
        if base and rng.random() < 0.7:
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                if w:
                    at = rng.randrange(len(w))
                    w[at : at + rng.choice([0, 1])] = [rng.choice(vocab)]
        else:
            w = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 4, 9, 20, 21, 30, 60, 120]))]
        base.append(w)
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, " \t"), (None, rows[3][1]), (5, rows[5][1]), (7, rows[60][1]), (950, rows[9][1].upper())]
    return rows


@pytest.mark.parametrize(("seed", "k", "t"), [(1, 3, "0.9"), (2, 5, "0.8")])
def test_against_all_pairs(spark, seed, k, t):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, x, "y", "z") for i, x in rows], SCHEMA).repartition(4)
    num, den = {"0.9": (9, 10), "0.8": (4, 5)}[t]
    want = brute(rows, k, num, den)
    for block in (128, 3):
        got = sorted(tuple(r) for r in jaccard_components(df, shingle=k, threshold=t, block=block).collect())
        assert got == want


def test_empty(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("t", ["0.9", "0.8"])
def test_pairs_within_the_bound_share_a_key(t):
    from fractions import Fraction

    rng, bands = np.random.default_rng(3), Bands(Fraction(t))
    for _ in range(1500):
        n = int(rng.integers(2, 120))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        b = a.copy()
        for _ in range(int(rng.integers(0, 14))):
            if rng.random() < 0.5 and len(b) > 1:
                b = np.delete(b, rng.integers(len(b)))
            else:
                b = np.unique(np.r_[b, rng.integers(0, 1 << 63, 1).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if both < Fraction(t) * (len(a) + len(b) - both) or len(a) == both == len(b):
            continue
        x, y = bands.of(np.array([len(a)]))[0], bands.of(np.array([len(b)]))[0]
        band = int(max(x, y))
        assert abs(int(x) - int(y)) <= 1
        m, light = bands.segments[band], _light(Fraction(t))
        assert set(_signatures(a, band, m, light).tolist()) & set(_signatures(b, band, m, light).tolist())


@pytest.mark.parametrize("t", ["0.9", "0.8"])
def test_frequencies_decide_and_stay_exact(t):
    """Whatever the counters say, pairs within the bound share a key; and they alone say which keys are replaced."""
    rng, bands = np.random.default_rng(5), Bands(Fraction(t))
    for trial in range(900):
        posts = Posts(np.full(COUNTERS, 0, np.uint32) if trial % 3 == 0 else (rng.random(COUNTERS) < (0.5, 1.0)[trial % 2]).astype(np.uint32) * 1_000_000)
        posts.noise = 0
        n = int(rng.integers(2, 120))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        b = a.copy()
        for _ in range(int(rng.integers(0, 14))):
            b = np.delete(b, rng.integers(len(b))) if rng.random() < 0.5 and len(b) > 1 else np.unique(np.r_[b, rng.integers(0, 1 << 63, 1).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if both < Fraction(t) * (len(a) + len(b) - both) or len(a) == both == len(b):
            continue
        band = int(max(bands.of(np.array([len(a)]))[0], bands.of(np.array([len(b)]))[0]))
        m, load = bands.segments[band], bands.starts[band] / bands.segments[band]
        x, y = (_signatures(s, band, m, 0, posts, load) for s in (a, b))
        assert set(x.tolist()) & set(y.tolist())
        edge, _, _, keys = _segments(a, band, m)
        few = np.diff(edge) <= COUNTED
        dear = few & (posts.counters[(keys >> np.uint64(44)).astype(np.int64)] > 0)
        assert set(keys[~dear].tolist()) <= set(x.tolist()) and not set(keys[dear].tolist()) & set(x.tolist())


def test_counters_are_those_of_all_sets(spark):
    """The first pass against a plain count, each set of a task once."""
    rows = [(i, t) for i, t in corpus(4, 70) if t]
    df = spark.createDataFrame([(t,) for _, t in rows], "_text string").coalesce(1)
    got, want, bands = posting_counts(df, 3, Fraction("0.9")), np.zeros(COUNTERS, np.int64), Bands(Fraction("0.9"))
    sets = {tuple(s.tolist()) for c in W.chunks(pa.array([t for _, t in rows]), True) for s in W.shingle_sets(c, 3) if len(s)}
    for s in sets:
        b = int(bands.of(np.array([len(s)]))[0])
        for band in (b, b + 1):
            if bands.segments[band] > 1:
                edge, _, _, keys = _segments(np.array(s, np.uint64), band, bands.segments[band])
                for z, key in zip(np.diff(edge).tolist(), keys.tolist(), strict=True):
                    want[key >> 44] += z <= COUNTED
    assert (got.counters == want).all() and want.sum() > 20


def test_hubs_and_chains(spark):
    """Components of a hub with more edges than a task should get, of chains, repeats and both ends alike."""
    edges = [(0, i) for i in range(1, 700)] + [(i, i + 1) for i in range(1000, 1090)] + [(5, 5), (2000, 699), (2000, 699), (3001, 3000)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    scratch = Scratch(spark, "test")
    got = {r.id: r.component for r in components(df, scratch).collect()}
    want = {i: 0 for i in range(700)} | {i: 1000 for i in range(1000, 1091)} | {2000: 0, 3000: 3000, 3001: 3000}
    assert got == want
    many = spark.createDataFrame([(i % 3 if i < 600 else i, i) for i in range(900)], "k int, x int")
    one = spark.createDataFrame([(i, -i) for i in range(800)], "k int, y int")
    assert sorted(map(tuple, join_skewed(many, one, "k").collect())) == sorted(map(tuple, many.join(one, "k").collect()))


def test_rounds_return_the_memory_of_the_driver(spark, monkeypatch):
    """Rounds have the JVM return its heap's garbage, but not again too soon; what native code has freed goes as well."""
    jvm = spark._jvm
    pid, runtime = jvm.java.lang.ProcessHandle.current().pid(), jvm.java.lang.Runtime.getRuntime()
    used = lambda: (runtime.totalMemory() - runtime.freeMemory()) >> 20
    held = lambda: sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) >> 10
    df, scratch = spark.createDataFrame([(0, 1)], "u bigint, v bigint"), Scratch(spark, "test")
    monkeypatch.setattr(cluster, "DRIVER_SECONDS", 3600.0)
    monkeypatch.setitem(cluster._driver, "last", time.monotonic())
    last = cluster._driver["last"]
    garbage = spark.sparkContext._gateway.new_array(jvm.byte, 200 << 20)
    assert sorted(map(tuple, components(df, scratch).collect())) == [(0, 0), (1, 0)]
    before, was = used(), held()
    assert cluster._driver["last"] == last
    cluster._driver["last"] -= 3600
    del garbage
    gc.collect()
    assert sorted(map(tuple, components(df, scratch).collect())) == [(0, 0), (1, 0)]
    assert cluster._driver["last"] > last and used() < before - 150 and held() < was - 150
    packers = [jvm.java.util.zip.Deflater() for _ in range(1200)]
    for i, x in enumerate(packers):
        if i % 100:
            x.end()  # one that stays keeps what lies below it from going by itself
    jvm.System.gc()
    was = held()
    cluster.give_back_driver(spark)
    assert held() < was - 20
    for x in packers:
        x.end()


def test_only_texts_that_a_wave_reads(spark):
    """All rows of the given ids, repeated and negative ones too, and few others."""
    ids = list(range(-500, 500)) + [2**62, -(2**62), 7, 7]
    texts = spark.createDataFrame([(i, f"text {i}") for i in ids], "_id bigint, _text string")
    want = spark.createDataFrame([(i,) for i in ids if i % 5 == 0 or i == 7], "id bigint")
    got = jaccard_join._only(texts, want).collect()
    few = {r.id for r in want.collect()}
    assert sorted(r._id for r in got if r._id in few) == sorted(i for i in ids if i in few)
    assert len(got) < len([i for i in ids if i in few]) + 10 and all(r._text == f"text {r._id}" for r in got)
    assert jaccard_join._only(texts, want.limit(0)).count() == 0
