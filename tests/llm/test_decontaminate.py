"""Decontamination against exact containment of every pair."""

import random

from fractions import Fraction

import numpy as np

from sparkloom.llm.decontaminate import SPARE, Index, contaminated, decontaminate

DOCS = "doc_id bigint, text string, id string, item bigint"
ITEMS = "item_id bigint, text string, id string"


def shingles(text, k=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def held(text, item, k=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return sum(any(tuple(w[i : i + len(s)]) == s for i in range(len(w))) for s in shingles(item, k))


def fixture():
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(200)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 4, 5, 9, 30, 60])))) for i in range(25)]
    docs = []
    for i in range(80):
        w = [rng.choice(vocab) for _ in range(rng.choice([0, 3, 40, 400]))]
        if rng.random() < 0.7:
            p = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                p[rng.randrange(len(p))] = "X"
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() for x in p]
        docs.append((i, " ".join(w)))
    docs += [(None, items[5][1]), (None, None), (99, None), (99, ""), (7, docs[7][1])]
    items += [(50, None), (None, "v1 v2"), (51, " "), (3, items[3][1])]
    return docs, items


def test_against_all_pairs(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(i, t, "a", 1) for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, "b") for i, t in items], ITEMS)
    want = set()
    for i, t in docs:
        for j, u in items:
            n = len(shingles(u))
            if j is not None and n and 5 * held(t, u) >= 4 * n:
                want.add((i, j, held(t, u), n))
    assert len(want) > 20
    for part in (2_000_000, 40):
        got = [(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in contaminated(d, b, part=part).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    bad = {(i, t) for i, t in docs if any(5 * held(t, u) >= 4 * len(shingles(u)) and shingles(u) for j, u in items if j is not None)}
    clean = decontaminate(d, b, part=60)
    assert clean.columns == d.columns
    assert sorted(map(repr, [(r.doc_id, r.text) for r in clean.collect()])) == sorted(repr(x) for x in docs if x not in bad)


def test_empty(spark):
    d, b = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b c d e f", "", 1)], DOCS)
    assert contaminated(d, b).count() == 0 and contaminated(some, b).count() == 0
    assert decontaminate(some, b).count() == 1


def test_a_band_fixes_sketch_and_cut():
    """Sketch length and cut follow from the largest item of the band; what reaches the cut holds all that is
    contained, and little else."""
    rng = np.random.default_rng(2)
    sizes = [1, 2, 3, 5, 7, 20, 31, 40, 63, 300, 511]
    items = [(i, np.unique(rng.integers(0, 2**63, n).astype(np.uint64))) for i, n in enumerate(sizes)]
    index = Index(items, Fraction("0.8"))
    band = {n: 2 ** (n.bit_length() - 1) for n in sizes}
    for n, sketch, cut in zip(sizes, index.sketch.tolist(), index.cut.tolist(), strict=True):
        most = max(x for x in sizes if band[x] == band[n])
        missing = most - -(-4 * most // 5)
        assert sketch == min(n, missing + SPARE) and cut == max(1, sketch - missing)
    assert index.cut[-1] == SPARE and len(set(index.sketch.tolist())) > 5
    alone = [Index([x], Fraction("0.8")) for x in items]
    assert index.sketch[9] > alone[9].sketch[0]  # without the band's other item the sketch is another
    for share in (0.5, 0.8, 0.9):
        passed = reached = 0
        for i, (_, s) in enumerate(items):
            for _ in range(50):
                n = -(-int(share * 100) * len(s) // 100)
                held = np.sort(rng.choice(s, n, replace=False))
                found = np.flatnonzero(np.isin(index.keys, held))
                ok = len(found) > 0 and i in index.candidates(found).tolist()
                assert ok or 5 * n < 4 * len(s)
                passed += ok
                reached += len(found) > 0
        assert share > 0.6 or passed < reached  # the cut drops what one common hash would let pass


def test_ids_of_any_type_and_clashing_names(spark):
    text = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([("x", text, 1, 1), (None, text + " ten", 2, 2), ("y", "w " * 400_000, 3, 3)], "doc_id string, text string, n_shared int, c0 int")
    items = spark.createDataFrame([(1, text), (1, text), (2, "a b")], "item_id bigint, text string")
    for part in (2_000_000, 3):
        assert sorted(str(r.doc_id) for r in contaminated(docs, items, part=part).collect()) == ["None", "x"]
        assert [tuple(r)[0] for r in decontaminate(docs, items, part=part).collect()] == ["y"]
