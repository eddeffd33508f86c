"""Spelling variants against comparisons of all pairs."""

import random
import zlib
from collections import Counter

import pytest
import regex

from sparkloom.functions.scratch import Scratch
from sparkloom.llm import spelling


def near(a, b):
    x, y = (a, b) if len(a) >= len(b) else (b, a)
    if len(x) - len(y) > 1 or x == y:
        return False
    d = next((i for i, c in enumerate(y) if x[i] != c), len(y))
    return x[d + 1 :] == (y[d + 1 :] if len(x) == len(y) else y[d:])


def brute_counts(docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count = Counter()
    for doc, text, *_ in docs:
        for run in regex.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            count[run[:at] + run[at + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def brute(counts, times=10):
    out = {}
    for w, n in counts.items():
        other = sorted(((-counts[x], x) for x in counts if near(w, x)))
        form = other[0] if other and -other[0][0] >= times * n else None
        out[w] = (form and form[1], n, len(other), form and -form[0])
    rows = []
    for w, (form, *rest) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.append((w, form, root, *rest))
    return sorted(rows)


def random_words(rng, letters, n, longest):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)})


def test_merged_pairs_are_those_one_edit_apart():
    rng = random.Random(4)
    for _ in range(200):
        words = random_words(rng, "abé"[: rng.randint(1, 3)], rng.randint(0, 60), rng.randint(1, 7))
        got = [tuple(sorted(p)) for p in spelling.merge_light(words)]
        want = {(i, j) for j in range(len(words)) for i in range(j) if near(words[i], words[j])}
        assert len(got) == len(set(got)) and set(got) == want


def test_words_in_light_children_are_few():
    """What is merged: at most log2(n) light children hold a word, whatever the trie."""

    words = random_words(random.Random(6), "abcdefgh", 4000, 9)
    n, light = len(words), 0
    stack = [(0, n, 0)]
    while stack:
        lo, hi, d = stack.pop()
        parts, at = [], lo
        while at < hi and len(words[at]) == d:
            light, at = light + 1, at + 1
        while at < hi:
            stop = at
            while stop < hi and words[stop][d] == words[at][d]:
                stop += 1
            parts.append((at, stop, d + 1))
            at = stop
        if parts:
            heavy = max(parts, key=lambda p: p[1] - p[0])
            light += sum(p[1] - p[0] for p in parts if p != heavy)
            stack += [p for p in parts if p[1] - p[0] > 1]
    assert light <= n * n.bit_length()


@pytest.mark.parametrize("limit", [50_000, 20, 1])
def test_random_words_through_the_top(spark, limit):
    """With a small limit most pairs are found by joins, whatever the letters."""
    rng = random.Random(limit)
    words = random_words(rng, "abcé", 300, 7) + ["prefix" * 5 + w for w in random_words(rng, "ab", 100, 6)]
    counts = {w: int(10 ** rng.uniform(0, 6)) for w in words}
    df = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n bigint, best string")
    assert sorted(map(tuple, spelling.spelling_variants(df, limit=limit).collect())) == brute(counts)


def test_forms_lead_over_many_steps(spark):
    counts = {"a" * (7 + i): 10**i for i in range(12)} | {"zzzzzzzzz": 1}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = sorted(map(tuple, spelling.spelling_variants(df).collect()))
    assert got == brute(counts) and {r[2] for r in got} == {"a" * 18, "zzzzzzzzz"}


def test_ties_of_forms(spark):
    counts = {"abcdefg": 1, "abcdefh": 10, "abcdef": 10, "abcdefgé": 10, "xabcdefg": 10}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = {r.word: r for r in spelling.spelling_variants(df).collect()}
    assert got["abcdefg"].form == "abcdef" and got["abcdefg"].n_near == 4 and got["abcdef"].form is None


def test_counts_of_odd_documents(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["Straßenbahn", "ÀÉÎÕÜ×÷ý", "ordinary", "ORDINARY", "short", "naïveté", "a日本語bcdefgh", "x" * 31]) for _ in range(rng.randint(0, 40))) for _ in range(120)]
    docs = [(i, t, "a", i) for i, t in enumerate(texts)] + [(None, texts[3], "", 0), (None, texts[3], "", 0), (5, texts[5], "", 0), (7, None, "", 0), (8, "", "", 0)]
    docs += [(9, "q" * 300_000 + " " + "q" * 300_000 + "é", None, None), (10, "q" * 300_000, None, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, word string, n bigint")
    got = dict(map(tuple, spelling.word_counts(df).collect()))
    assert got == brute_counts(docs) and any(len(w) > 100_000 for w in got)
    rows = spelling.spelling_variants(spelling.word_counts(df), limit=3)
    assert sorted(map(tuple, rows.collect())) == brute(got)
    assert spelling.spelling_variants(spelling.word_counts(df.filter("false"))).count() == 0


def test_counted_words_are_handed_on(spark, monkeypatch):
    run = spelling._counts(7, 31)
    monkeypatch.setattr(spelling, "COUNTED", 3)
    docs = [(i, f"wordaaa{chr(97 + i)} wordaaa{chr(98 + i)}") for i in range(20)]
    batch = spelling.pa.RecordBatch.from_arrays([spelling.pa.array([str(d) for d, _ in docs]), spelling.pa.array([t for _, t in docs])], ["id", "t"])
    out = list(run(iter([batch])))
    total = Counter()
    for b in out:
        total.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
    assert len(out) > 3 and {w: n for w, n in total.items() if n >= 2} == brute_counts(docs)


def test_no_words(spark):
    empty = spark.createDataFrame([], "word string, n bigint")
    assert spelling.spelling_variants(empty).count() == 0 and spelling.near_words(empty, Scratch(spark, "test")).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(empty, times=1)
    nulls = spark.createDataFrame([(None, 3), ("abcdefg", None), ("abcdefh", 2)], "word string, n bigint")
    assert [tuple(r) for r in spelling.spelling_variants(nulls).collect()] == [("abcdefh", None, "abcdefh", 2, 0, None)]
