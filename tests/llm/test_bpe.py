"""Byte-pair encoding against the library, exact merges against a plain loop, and exact round trips."""

import hashlib
import random

import public_tokenizers
import pytest
from oracle import DIR
from tokenizers import Tokenizer

from sparkloom.llm import bpe
from sparkloom.llm.registry import QUERIES, table

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    v, classes = bpe.vocabulary(PATH), bpe._classes(bpe.character_classes(PATH))
    return lambda texts: v.encode(texts, classes).to_pylist()


def random_texts(kind, n, rng):
    parts = {
        "pieces": ["a", "b", "th", "'s", "'re", "'", "' ", "  ", " ", "\n", "\t", "é", "日", "1", "23", "!", "...", "<|endoftext|>", "\u3000", "\r\n", "don't", "'ll", "'l", "'LL", "\x1c", "\u200b", "'ve'd", "<|endof", "text|>", "\x00"],
        "few": list("ab aA=- \n.'s"),
        "any": [chr(rng.choice([rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF), rng.randint(0, 0x300)])) for _ in range(5000)],
    }[kind]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("kind", ["pieces", "few", "any"])
def test_random_texts(own, library, kind):
    texts = random_texts(kind, 5000, random.Random(kind))
    assert own(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_runs_of_each_length(own, library):
    """Equal neighbours are ties of one merge, which goes leftmost first."""
    texts = [unit * n for unit in ("a", "ab", " ", "=", "\n", "é", "ha", "0") for n in range(1, 150)]
    assert own(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_very_long_texts(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "GROUP_CHARS", 5000)
    texts = ["aba " * 100_000, "x" * 50_000, "\n" * 50_000 + "b", "a b\n" * 3000 + "<|endoftext|>" * 500 + "é" * 20_000]
    assert own(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def plain_merge(v, word):
    part = [v._byte[b] for b in word]
    while True:
        found = [(v.pairs[p], i) for i, p in enumerate(zip(part, part[1:])) if p in v.pairs]
        if not found:
            return part
        (_, token), i = min(found)
        part[i : i + 2] = [token]


def test_pairs_that_pass_are_the_encoding():
    """What the compatibility check says of proposals, against merges of the whole word."""
    v, rng = bpe.vocabulary(PATH), random.Random(2)
    words = list({bytes(rng.choice(b"aeinorsttth") for _ in range(rng.randint(1, 14))) for _ in range(4000)})
    for word in words:
        stop = bpe.np.array([len(word)])
        ids, begins = v.propose(bpe.np.frombuffer(word, bpe.np.uint8), stop)
        want = plain_merge(v, word)
        assert v.compatible(ids[:-1], ids[1:]).all() == (ids.tolist() == want)
        assert v._scan([v._byte[b] for b in word]) == v._heap([v._byte[b] for b in word]) == want
    assert begins[0] == 0


def test_kept_words_are_bounded(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 50)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 300)
    texts = random_texts("pieces", 300, random.Random(5)) + ["y" * 200]
    assert own(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_odd_rows(spark, library):
    schema = "ids string, text string, t string, id int"
    rows = [("a", "Hello world", "x", 1), ("a", "Hello world", None, 1), (None, "naïve\n", "", 2), ("b", None, "", 3), ("c", "", "", 4), ("d", "<|endoftext|>x", "", 5)]
    df = spark.createDataFrame(rows, schema)
    got = bpe.bpe_decode(bpe.bpe_encode(df, PATH, id_col="ids").withColumnRenamed("ids", "key").toDF("key", "tokens"), PATH, id_col="key", ids_col="tokens")
    assert got.columns == ["key", "tokens", "decoded"]
    want = [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t, *_ in rows]
    assert sorted(((r.key, r.tokens, r.decoded) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert bpe.bpe_encode(df.filter("false"), PATH, id_col="ids").count() == 0


def test_decoding_of_odd_tokens(spark, library):
    cut = library.encode("日", add_special_tokens=False).ids[:1]
    rows = [(1, [15496, None, 995]), (2, None), (3, []), (4, cut), (5, [50256, 999_999, -3, 995])]
    got = dict((r.k, r.decoded) for r in bpe.bpe_decode(spark.createDataFrame(rows, "k int, ids array<int>"), PATH, id_col="k").collect())
    assert got == {1: "Hello world", 2: "", 3: "", 4: library.decode(cut, skip_special_tokens=False), 5: "<|endoftext|> world"}


def test_query_of_whole_documents(spark, library):
    docs = [(r.doc_id, r.text or "") for r in table(spark, DIR, "documents").collect()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for (i, _), e in zip(docs, library.encode_batch([t for _, t in docs], add_special_tokens=False)):
        want[i] = (len(e.ids), sha(",".join(map(str, e.ids))), sha(library.decode(e.ids, skip_special_tokens=False)))
    got = QUERIES["op11_bpe"](spark, DIR)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.schema["n_tokens"].dataType.typeName() == "long"
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want and got.count() == len(docs)
