"""Substring dedup against a direct statement of the rule."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import words as W
from sparkloom.llm.substrings import substring_dedup

SCHEMA = "doc_id bigint, text string, bucket string, _id int"


def brute(rows, width=20):
    rows = sorted(((i if i is not None else -(1 << 63)), t or "", i) for i, t in rows)
    seen, out = {}, []
    lists = [(i, real, re.findall(r"[^\x20\x09-\x0d]+", t)) for i, t, real in rows]
    offset = {}
    gone = []
    for i, _, w in lists:
        base = offset.get(i, 0)
        offset[i] = base + len(w)
        for s in range(len(w) - width + 1):
            key, at = tuple(w[s : s + width]), (i, base + s)
            seen[key] = min(seen.get(key, at), at)
        gone.append(base)
    for (i, real, w), base in zip(lists, gone, strict=True):
        mask = [False] * len(w)
        for s in range(len(w) - width + 1):
            if seen[tuple(w[s : s + width])] < (i, base + s):
                mask[s : s + width] = [True] * width
        kept = " ".join(x for x, m in zip(w, mask, strict=True) if not m)
        out.append((real, len(w), sum(mask), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()], key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)] + ["é", "Straße", " x", "a b"]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(19, 70))] for _ in range(6)]
    rows = []
    for i in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randint(0, 5)
            at = rng.randint(0, len(w))
            w[at:at] = p[a:]
        rows.append((i, rng.choice([" ", "\n", "\t ", "\x0b"]).join(w)))
    rows += [(3, rows[3][1]), (None, rows[5][1]), (None, None), (500, ""), (501, None), (502, " \n "), (503, "x " * 3000), (504, rows[9][1]), (504, "other " + rows[9][1])]
    df = spark.createDataFrame([(i, t, "b", 1) for i, t in rows], SCHEMA).repartition(5)
    assert got(substring_dedup(df)) == brute(rows)


def test_empty_and_spans(spark):
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    out = substring_dedup(spark.createDataFrame([(1, text, None, 2), (2, "a b " + text + " c", None, 3)], SCHEMA), carry=("bucket",)).orderBy("doc_id").collect()
    assert out[0].removed == [] and [tuple(x) for x in out[1].removed] == [(2, 32)] and out[1].kept_text == "a b c"
    with pytest.raises(ValueError):
        substring_dedup(spark.createDataFrame([], SCHEMA), width=10, block=10)


def test_bucket_is_sparks(spark):
    ids = np.array([0, 1, -5, 1 << 40, -(1 << 63)], np.int64)
    want = [r[0] for r in spark.createDataFrame([(int(i),) for i in ids], "i bigint").select(F.pmod(F.xxhash64("i"), F.lit(97))).collect()]
    assert W.spark_bucket(ids, 97).tolist() == want


def test_pack_round_trip():
    a, b = np.array([3, 1 << 60, 7], np.uint64), np.array([-4, 5, 6], np.int64)
    x, y = W.unpack(W.pack(a, b), np.uint64, np.int64)
    assert x.tolist() == a.tolist() and y.tolist() == b.tolist()


def test_words_are_the_pattern():
    import pyarrow as pa

    texts = ["a b", None, "", " x\ty\x0bz\x0cq\r\n", " n\u0085m  ", "tail", "tail2 tail"]
    (c,) = list(W.chunks(pa.array(texts), False))
    assert np.diff(c.offsets).tolist() == [len(re.findall(r"[^\x20\x09-\x0d]+", t or "")) for t in texts]
    assert c.hashes[c.offsets[5]] == c.hashes[c.offsets[6] + 1]
    up, down = W.powers(12345679, 1000)
    assert ((up * down) == 1).all()
