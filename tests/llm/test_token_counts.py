"""Token attribution: offsets, rules, and an exact round trip."""

import random

import numpy as np
import pytest

from sparkloom.llm.token_counts import RULES, VOCABULARY, attribute, count_tokens, encode, encoder, line_bounds, spans

TEXTS = ["", "Hello world\nand you", "naïve café — 日本語\n\n🙂🙂 x", "a" * 5000 + "\n" + " " * 300, "don't\r\nstop  \n", "\n", "é\n" * 50]


def test_spans_are_the_tokens():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    for text in TEXTS:
        e = t.encode(text, add_special_tokens=False)
        assert e.ids == encoder(VOCABULARY)[0].encode_ordinary(text)
        got = spans(text, VOCABULARY)
        assert len(got) == len(e.ids) and (not text or got[-1][1] == len(text) and got[0][0] == 0)
        ascii_only = [tuple(x) for x in got.tolist()] if text.isascii() else None
        assert ascii_only is None or ascii_only == [tuple(o) for o in e.offsets]


@pytest.mark.parametrize("rule", RULES)
def test_rules_against_brute_force(rule):
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 40)
        cuts = sorted({0, n, *(rng.randint(0, n) for _ in range(5))})
        at = sorted({0, n, *(rng.randint(0, n) for _ in range(9))})
        tokens = list(zip(at[:-1], at[1:], strict=True))
        want = np.zeros(len(cuts) - 1)
        for a, b in tokens:
            held = [max(0, min(y, b) - max(x, a)) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            full = [i for i, h in enumerate(held) if h]
            if rule == "share":
                want += np.array(held) / (b - a)
            else:
                want[{"first": full[0], "last": full[-1], "most": held.index(max(held))}[rule]] += 1
        got = attribute(np.array(tokens), np.array(cuts), rule)
        assert np.allclose(got, want) and np.isclose(got.sum(), len(tokens))


def test_frame(spark):
    schema = "doc_id bigint, text string, id string, t string, section int"
    rows = [(i, x, "a", None, 1) for i, x in enumerate(TEXTS)] + [(1, TEXTS[1], "a", "b", 1), (None, "x y", "", "", 1), (99, None, "", "", 1)]
    df = spark.createDataFrame(rows, schema)
    enc = encoder(VOCABULARY)[0]
    got = count_tokens(df).collect()
    per = {}
    for r in got:
        per[r.doc_id] = per.get(r.doc_id, 0) + r.n_tokens
    for i, x in enumerate(TEXTS):
        assert per.get(i, 0) == len(enc.encode_ordinary(x)) * (2 if i == 1 else 1)
    assert 99 not in per and per[None] == 2
    for i, x in enumerate(TEXTS):
        assert len([r for r in got if r.doc_id == i]) == (len(line_bounds(x)) - 1) * (2 if i == 1 else 1)
    fields = count_tokens(df, text_col=["id", "text", "t"], rule="share").collect()
    assert all(r.section in (0, 1, 2) for r in fields)
    assert count_tokens(df.filter("false")).count() == 0
    with pytest.raises(ValueError):
        count_tokens(df, rule="none")


def test_long_runs_are_cut_as_the_pattern_cuts():
    plain = encoder(VOCABULARY)[0].encode_ordinary
    for run in (" " * 5000, "\t" * 3000, "\n" * 2001 + " ", "\r\n" * 2000, " \u3000\xa0" * 700, "a" * 5000, "\x1c" * 3000):
        for text in (run, run + "a", run + "'s", run + "\n!", "a" + run, "a" + run + " b", "x  " + run + "1" + run + "y" + run):
            assert encode(text, VOCABULARY) == plain(text)
    for text in (" " * 900_000, "b" * 1_000_000, "1" * 1_000_000):
        assert encode(text, VOCABULARY) == plain(text)


@pytest.mark.parametrize("sign", [" ", "\t", "\n", "a", "\u3000"])
def test_very_long_texts(spark, sign):
    """A round trip: the tokens of each line cover its text, however long a run of one character is."""
    texts = [sign * 1_000_000 + "a", "a " + sign * 1_000_000, sign * 2_000_000 + "\n" + sign * 1_500_000 + "b c"]
    for text in texts:
        got = spans(text, VOCABULARY)
        assert got[0][0] == 0 and got[-1][1] == len(text) and (got[1:, 0] <= got[:-1, 1]).all()
    df = spark.createDataFrame([(0, texts[0]), (1, "word"), (2, None)], "doc_id bigint, text string")
    per = {r.doc_id: r.n for r in count_tokens(df).groupBy("doc_id").sum("n_tokens").toDF("doc_id", "n").collect()}
    assert per == {0: len(spans(texts[0], VOCABULARY)), 1: len(spans("word", VOCABULARY))}
