"""Tries of conversations against a brute-force version over all prefixes."""

import hashlib
import random
import re
import zlib

import pytest

from sparkloom.functions.scratch import Scratch
from sparkloom.llm import conversation_trie as trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, k1 string, seq string"


def brute(rows, group=20):
    convs = {}
    for c, t, r, x, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in convs.items()}
    again = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        again[c] = own.get(c - abs(c) % group * (1 if c >= 0 else -1), [])[:h] + v[h:]
    nodes = {}
    for c, s in again.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    children = dict.fromkeys(nodes, 0)
    for k in nodes:
        if k:
            children[k[:-1]] += 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for k, members in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(members) - 1) * words
            leaves[k[:d]] += children[k] == 0
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(again[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def made(spark, rows, **how):
    return sorted(map(tuple, trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), **how).collect()), key=repr)


def random_rows(rng, n):
    """Conversations from few turns, so that prefixes, whole conversations and turn numbers repeat."""
    rows = []
    for c in rng.sample(range(-60, 200), n):
        for _ in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([None, 0, 1, 2, 3, 4, 5]), rng.choice(["user", "", None]), rng.choice(["a b", "a  b c", "", None, "d"]), "x", None))
    return rows


@pytest.mark.parametrize("how", [{}, {"limit": 4, "block": 2}, {"limit": 0, "block": 1}, {"limit": 12, "block": 3}])
def test_random_conversations(spark, how):
    rows = random_rows(random.Random(str(how)), 60)
    assert made(spark, rows, **how) == brute(rows)


def test_a_hot_first_turn_copies_and_a_long_conversation(spark):
    """A third of all conversations is one, another third begins alike; one has thousands of turns."""
    rows = [(c, t, "user", f"turn {t}", "", "") for c in range(0, 120) for t in range(4)]
    rows += [(c, t, "user", "turn 0" if t == 0 else f"own {c} {t % 3}", "", "") for c in range(200, 300) for t in range(5)]
    rows += [(400, t, "user", f"{t % 2}", "", "") for t in range(3000)]
    rng = random.Random(1)
    rng.shuffle(rows)
    want = brute_long(rows)
    for how in ({"block": 100}, {"limit": 50, "block": 7}):
        assert [x[:7] for x in made(spark, rows, **how)] == want


def brute_long(rows):
    """As brute(), but sums walk up parents; digests are left out."""
    own, again = {}, {}
    for c, t, r, x, *_ in sorted(rows):
        own.setdefault(c, []).append((r, x))
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        again[c] = own.get(c - c % 20, [])[:h] + v[h:]
    ids, nodes = {}, [[None, 0, [], 0]]
    for c, s in again.items():
        at = 0
        nodes[0][2].append(c)
        for d, turn in enumerate(s, 1):
            if (at, turn) not in ids:
                ids[at, turn] = len(nodes)
                nodes.append([at, d, [], len(turn[1].split())])
            at = ids[at, turn]
            nodes[at][2].append(c)
    children, leaves, saved = [0] * len(nodes), [0] * len(nodes), [(len(m) - 1) * w for _, _, m, w in nodes]
    for i in range(len(nodes) - 1, -1, -1):
        leaves[i] = leaves[i] or 1
        if i:
            p = nodes[i][0]
            children[p] += 1
            leaves[p] += leaves[i]
            saved[p] += saved[i]
    return sorted(((min(m), d, None if p is None else min(nodes[p][2]), len(m), children[i], leaves[i], saved[i]) for i, (p, d, m, _) in enumerate(nodes)), key=repr)


def test_digests_of_many_ids_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "ID_BLOCK", 7)
    rows = [(c, 0, "user", "hello", "", "") for c in range(-50, 150)]
    assert made(spark, rows) == brute(rows)


def test_odd_tables(spark):
    assert made(spark, []) == [] and made(spark, [(None, 1, "user", "x", "", "")]) == []
    twice = [(20, 1, "user", "x", "", ""), (20, 1, "user", "x", "", ""), (21, None, None, None, None, None), (None, None, None, None, None, None)]
    assert made(spark, twice) == brute(twice)
    long = [(3, 0, "user", "word " * 200_000, "", ""), (4, 0, "user", "word " * 200_000, "", "")]
    assert made(spark, long) == brute(long)
    alone = [(c, 0, "user", "x", "", "") for c in range(1, 9)]  # without their first turns, and nothing to take instead
    assert made(spark, alone) == brute(alone) and any(r[3] > 1 for r in brute(alone))


def test_places_of_turns_over_many_ranges(spark):
    rows = [(c, (t * 7) % 50, "user", f"{t}", "", "") for c in (1, 2) for t in range(50)]
    turns = trie.ordered_turns(spark.createDataFrame(rows, SCHEMA).repartition(8), Scratch(spark, "test"))
    got = {(r.conv, r.r) for r in turns.collect()}
    assert got == {(c, r) for c in (1, 2) for r in range(50)}


def test_places_of_turns_where_ranges_stay_apart(spark):
    """Small ranges are not put together, so a conversation lies in several and its places go on from one to the next."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        rows = [(c, (t * 7) % 50, "user", f"{t}", "", "") for c in (1, 2) for t in range(50)]
        turns = trie.ordered_turns(spark.createDataFrame(rows, SCHEMA).repartition(8), Scratch(spark, "test"))
        assert sorted((r.conv, r.r) for r in turns.collect()) == [(c, r) for c in (1, 2) for r in range(50)]
        assert made(spark, rows) == brute(rows)
    finally:
        spark.conf.set(name, before)
