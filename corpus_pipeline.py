"""A corpus pipeline of five of the operators; each stage works on what the one before it kept.

Stages take tables with the columns doc_id, text, lang, source and n_chars; further columns, of any name, pass
through and decide nothing. Ids are whole numbers, may be null and may repeat. Empty tables give empty results. Texts
are judged whole, whatever their length. What a null, an empty text, a tie or a repeated row gives is said by stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import language_id
from sparkloom.llm.cluster import Scratch
from sparkloom.llm.decontaminate import decontaminate
from sparkloom.llm.folds import learnable
from sparkloom.llm.jaccard_join import jaccard_components
from sparkloom.llm.mixing import mix_sources
from sparkloom.llm.substrings import substring_dedup

#: A document whose most probable language is less probable than this is rejected.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language the model names with LEAST_SCORE or more. Others go: null and empty
    texts, and those of signs alone. Of equal scores the first language by name counts. Repeated rows are judged
    alike; rows with a null id or language are judged but not learned from."""
    model = language_id.fit(learnable(docs))
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    out = language_id.predict(inner, model, tuple(inner.columns), f"c{names.index('text')}")
    return out.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).drop("lang_pred", "score").toDF(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null, empty and wordless texts link with nothing and stay. Of each group linked by five-word shingles at Jaccard 0.8, the row of smallest doc_id, and one of its rows
    without a doc_id. Rows are told apart by doc_id where it is present and distinct; otherwise each row has a
    saved number of its own, so rows that share a doc_id and are unlike all stay."""
    names, scratch = docs.columns, Scratch(spark, "near-duplicates")
    odd = docs.groupBy("doc_id").count().filter("doc_id is null or count > 1")
    if odd.isEmpty():
        found = jaccard_components(docs, shingle=5, threshold="0.8")
        gone = found.filter("component_id <> doc_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(names)
    inner = [f"c{i}" for i in range(len(names))]  # no name of the input can clash with these
    rows = scratch.save(docs.toDF(*inner).withColumn("row", F.monotonically_increasing_id()))
    doc, text = inner[names.index("doc_id")], inner[names.index("text")]
    found = scratch.save(jaccard_components(rows, "row", text, shingle=5, threshold="0.8"))
    member = found.join(rows.select("row", F.col(doc).alias("doc")), "row")
    kept = member.groupBy("component_id", F.col("doc").isNull().alias("none")).agg(F.min(F.struct("doc", "row")).alias("first")).select("first.row")
    gone = found.join(kept, "row", "left_anti").select("row")
    return rows.join(gone, "row", "left_anti").select(inner).toDF(*names)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages of 20 words that start earlier elsewhere. Null and empty texts,
    and those that lose nothing, stay as they are. A repeated row stays too, without the words of its windows. A
    null id comes before all others; rows of one id come in order of their texts."""
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]  # no name of the input can clash with what the operator adds
    doc, text, size = (inner[names.index(c)] for c in ("doc_id", "text", "n_chars"))
    rest = tuple(c for c in inner if c not in (doc, text, size))
    out = substring_dedup(docs.toDF(*inner), doc, text, carry=rest, rejoin=False)
    out = out.withColumn(text, F.col("kept_text")).withColumn(size, F.length("kept_text").cast("bigint"))
    return out.select(inner).toDF(*names)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of the five-word shingles of every test item. Rows are judged one by one:
    null and empty texts hold nothing and stay, repeated rows stay or go together, ids make no difference. Items
    without words are held by none."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document left; weights 1, 2, 3 in turn by source, null last. Null and
    empty texts have size 0 and give none. Ties go to the smaller id; repeated rows are taken in either order, with
    the same result."""
    return mix_sources(docs)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", substrings),
    ("benchmark_decontamination", benchmark),
    ("mixing", mixture),
]

#: Language ID and mixing are not expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of a folder; each result is written and read again."""
    docs, scratch, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline"), []
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
