"""Registered queries against their SQL, and the pipeline against a brute-force version of its stages."""

import pytest
from oracle import DIR, check, connection
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm.registry import ORACLES, QUERIES, table


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    check(spark, con, QUERIES[name], ORACLES[name])


def test_every_operator_has_its_query():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13


def test_extraction_of_whole_pages(spark):
    """The fixture's pages keep the main text in one article element."""
    import html
    import re

    want = {}
    for r in table(spark, DIR, "pages").collect():
        body = r.html[r.html.index("<article>") : r.html.index("</article>")].replace("<br>", " ")
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1|article)>", body))
        want[r.page_id] = "\n\n".join(p for p in parts if p)
    got = QUERIES["op9_html_extraction"](spark, DIR).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_pipeline_stages(spark):
    docs = table(spark, DIR, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language_id"](spark, docs, DIR).cache()
    assert one.columns == docs.columns
    pred = QUERIES["op8_language_id"](spark, DIR)
    assert sorted(r.doc_id for r in one.collect()) == sorted(r.doc_id for r in pred.filter(f"lang_pred <> 'und' and score >= {corpus_pipeline.LEAST_SCORE}").collect())
    assert one.count() >= 0.97 * docs.count()

    from test_jaccard_join import brute as components

    two = stages["ngram_jaccard_join"](spark, one, DIR).cache()
    want = {i for i, _, c in components([(r.doc_id, r.text) for r in one.collect()], 5, 4, 5) if i == c}
    assert {r.doc_id for r in two.collect()} == want and two.count() == len(want) and two.columns == docs.columns

    from test_substrings import brute as kept

    three = stages["substring_dedup"](spark, two, DIR).cache()
    n_gone = {i: g for i, _, g, _ in kept([(r.doc_id, r.text) for r in two.collect()])}
    assert three.count() == two.count() and three.columns == docs.columns
    for r in three.collect():
        own = rows[r.doc_id].text
        assert (r.text == own) if not n_gone[r.doc_id] else (len(r.text.split()) == len(own.split()) - n_gone[r.doc_id])
        assert r.n_chars == len(r.text)

    from test_decontaminate import held, shingles

    items = [r.text for r in table(spark, DIR, "benchmark").collect()]
    four = stages["benchmark_decontamination"](spark, three, DIR).cache()
    index = [(t, shingles(t)) for t in items]
    first = {s for _, x in index for s in x}
    want = set()
    for r in three.collect():
        near = first & shingles(r.text)
        if not near or not any(5 * held(r.text, t) >= 4 * len(x) for t, x in index if near & x):
            want.add(r.doc_id)
    assert {r.doc_id for r in four.collect()} == want and four.columns == docs.columns

    five = stages["mixing"](spark, four, DIR)
    r = five.groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).collect()
    assert five.count() == four.count() and all(abs(x.n - x.t) <= 0.01 * x.t + 30 for x in r)
    assert corpus_pipeline.run(spark, DIR).count() == four.count()


def test_pipeline_of_odd_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, c0 string, lang_pred string"
    words = " ".join(f"the word{i} and of" for i in range(30))
    rows = [(1, words, "en", "a", 1, "x", "y"), (2, words, "en", None, 1, None, None), (2, words, "en", None, 1, None, None), (3, None, None, None, None, None, None), (None, words + " more", None, "a", 1, "", ""), (4, "", "en", "a", 0, "", "")]
    rows += [(10 + i, f"the text {i} of some other kind " * 3, "en", "b", 1, "", "") for i in range(40)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, DIR).cache()
            assert docs.schema.names == schema.replace(",", "").split()[::2], name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, DIR).count() == docs.count()
    assert {r.doc_id for r in stage_two(spark, rows, schema).collect()} >= {1, None}


def stage_two(spark, rows, schema):
    return corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, schema), DIR)


def test_near_duplicates_of_shared_and_missing_ids(spark):
    schema = "doc_id bigint, text string, row string"
    text = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcd"}
    rows = [(1, text["a"], "first"), (5, text["a"] + " more", "copy"), (5, text["b"], "unlike"), (5, text["c"], "unlike too"), (7, text["c"] + " more", "copy of a shared id")]
    rows += [(None, text["d"], "none"), (None, text["d"], "none"), (None, text["d"] + " more", "none"), (9, "", "empty"), (10, None, "null")]
    got = sorted(((r.doc_id or 0, (r.text or "")[:2]) for r in stage_two(spark, rows, schema).collect()))
    assert got == [(0, "d0"), (1, "a0"), (5, "b0"), (5, "c0"), (9, ""), (10, "")]


def test_names_that_stages_use_themselves_pass_through(spark):
    own = "n_words n_removed kept_text removed _id _text bucket row component_id draw target"
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in own.split())
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(i, text if i < 2 else f"the text {i} of some other kind", "en", "a", 1, *own.split()) for i in range(12)]
    docs = spark.createDataFrame(rows, schema)
    for name in ("ngram_jaccard_join", "substring_dedup", "benchmark_decontamination"):
        docs = dict(corpus_pipeline.STAGES)[name](spark, docs, DIR)
        got = docs.collect()
        assert docs.columns == [c.split()[0] for c in schema.split(", ")], name
        assert len(got) == 11 and all([r[c] for c in own.split()] == own.split() for r in got)
