"""Readers and writers of whitespace text formats, with validation.

A line's number is its place in its split of a file, and the lines of all splits before: files in order of their
names, splits in order of their bytes. So splits are read side by side, and a short table of splits, one row for each,
is summed up. Blank lines, CRLF and a missing last line end are handled. Readers keep duplicates and stored zeros, and
raise ValueError for malformed input. Writers write ordered parts, whose names are in the order of their lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.scratch import save
from sparkloom.operators.sparse import prefix_sum


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0), tokens (array of strings)."""
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    raw = spark.read.text(path).select("value", *where, F.monotonically_increasing_id().alias("i"))
    splits = raw.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = raw.join(splits.select("file", "start", (before - F.col("first")).alias("shift")), ["file", "start"]).withColumn("line", F.col("i") + F.col("shift"))
    text = F.trim(F.regexp_replace("value", r"\s+", " "))
    return rows.select("line", F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " ")).alias("tokens"))


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def _counts(df: DataFrame, *bad: Column) -> list[int]:
    """Rows, and rows of which each condition holds, in one pass."""
    return list(df.agg(F.count("*"), *[F.coalesce(F.count_if(b), F.lit(0)) for b in bad]).first())


def file_stats(spark: SparkSession, path: str) -> DataFrame:
    """nlines, ntokens, max_line_tokens, nbytes (of the files as they are, whatever their line ends)."""
    raw = spark.read.text(path)
    text = F.trim(F.regexp_replace("value", r"\s+", " "))
    n = F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))
    size = spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("nbytes"))
    counts = raw.agg(F.count("*").alias("nlines"), F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("ntokens"), F.coalesce(F.max(n), F.lit(0)).cast("bigint").alias("max_line_tokens"))
    return counts.join(F.broadcast(size))


def read_adjacency(spark: SparkSession, path: str, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """vertices(id), edges(src, dst), 0-based. Line 1 is ``nvtxs nedges``, then a line of 1-based neighbours a
    vertex; a blank line is a sink, the first vertex's too. `partitions` deals edges out by source, sorted."""
    all_lines = save(lines(spark, path), "adjacency")
    head = all_lines.filter("line = 0").first()
    _require(head is not None and len(head.tokens) == 2 and all(t.isdigit() for t in head.tokens), "the first line must be: nvtxs nedges")
    n, m = map(int, head.tokens)
    body = all_lines.filter(F.col("line").between(1, n))
    _, own, after = _counts(all_lines, F.col("line").between(1, n), (F.col("line") > n) & (F.size("tokens") > 0))
    _require(own == n, f"the file ends before all {n} vertices")
    _require(after == 0, "lines after the last vertex")
    edges = body.select((F.col("line") - 1).alias("src"), F.explode("tokens").alias("t")).select("src", "t", F.expr("try_cast(t as bigint)").alias("id"))
    found, bad = _counts(edges, F.col("id").isNull() | (F.col("id") < 1) | (F.col("id") > n))
    _require(bad == 0, f"neighbour ids must lie in 1..{n}")
    _require(found == m, f"the header names {m} edges, the lines have another number")
    edges = edges.select("src", (F.col("id") - 1).alias("dst"))
    if partitions:
        edges = edges.repartition(partitions, "src").sortWithinPartitions("src", "dst")
    return spark.range(n).select("id"), edges


def read_csr(spark: SparkSession, path: str, values: bool = True, numbering: int = 0, header: bool = False) -> DataFrame:
    """row, col, val from lines of ``(col val)*``; `values` False: columns only, each 1.0. `numbering` is the
    first column's number in the file. `header`: a first line ``nrows ncols nnz``, columns numbered from 1."""
    body = save(lines(spark, path), "csr")
    want = None
    if header:
        head = body.filter("line = 0").first()
        _require(head is not None and len(head.tokens) == 3 and all(t.isdigit() for t in head.tokens), "the header must be: nrows ncols nnz")
        want, numbering, values = list(map(int, head.tokens)), 1, True
        body = body.filter("line > 0").withColumn("line", F.col("line") - 1)
    if values:
        _require(_counts(body, F.size("tokens") % 2 == 1)[1] == 0, "a line has a column without a value")
        pairs = F.transform(F.sequence(F.lit(0), F.size("tokens") - 2, F.lit(2)), lambda i: F.struct(F.col("tokens")[i].alias("c"), F.col("tokens")[i + 1].alias("v")))
        cells = body.filter(F.size("tokens") > 0).select(F.col("line").alias("row"), F.explode(pairs).alias("p")).select("row", "p.c", F.expr("try_cast(p.v as double)").alias("val"))
    else:
        cells = body.select(F.col("line").alias("row"), F.explode("tokens").alias("c")).withColumn("val", F.lit(1.0))
    cells = cells.withColumn("col", F.expr("try_cast(c as bigint)") - numbering)
    found, no_column, no_value = _counts(cells, F.col("col").isNull() | (F.col("col") < 0), F.col("val").isNull())
    _require(no_column == 0, f"column numbers must be integers from {numbering}")
    _require(no_value == 0, "values must be numbers")
    if want is not None:
        _require(body.filter(F.col("line") < want[0]).count() == want[0], f"the file ends before all {want[0]} rows")
        _require(found == want[2], f"the header names {want[2]} values, the lines have another number")
    return cells.select("row", "col", "val")


def _numbers(spark: SparkSession, path: str) -> DataFrame:
    """k (from 0), v: the file's numbers as one stream; line ends do not matter."""
    counted = lines(spark, path).withColumn("n", F.size("tokens").cast("bigint"))
    flat = prefix_sum(counted, "line", "n").select("before", F.posexplode("tokens").alias("p", "t"))
    out = save(flat.select((F.col("before") + F.col("p")).alias("k"), F.expr("try_cast(t as double)").alias("v")), "numbers")
    _require(_counts(out, F.col("v").isNull())[1] == 0, f"{path} has a token that is not a number")
    return out


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """id, label: a count, then so many numbers."""
    k = _numbers(spark, path)
    head = k.filter("k = 0").first()
    _require(head is not None, "the label file is empty")
    out = k.filter((F.col("k") >= 1) & (F.col("k") <= int(head.v))).select((F.col("k") - 1).alias("id"), F.col("v").alias("label"))
    _require(out.count() == int(head.v), "the label file ends early")
    return out


def read_points(spark: SparkSession, points: str, labels: str) -> DataFrame:
    """id, features, label. Points are ``n d`` and n * d numbers; the label file's count overrides n."""
    k, y = _numbers(spark, points), read_labels(spark, labels)
    head = {r.k: int(r.v) for r in k.filter("k < 2").collect()}
    _require(len(head) == 2, "the point file must begin with: n d")
    d, n = head[1], y.count()
    cells = k.filter((F.col("k") >= 2) & (F.col("k") < 2 + n * d)).select(F.floor((F.col("k") - 2) / d).alias("id"), ((F.col("k") - 2) % d).alias("j"), "v")
    _require(cells.count() == n * d, "the point file ends early")
    rows = cells.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda c: c["v"]).alias("features"))
    return rows.join(y, "id").select("id", "features", "label")


def write_lines(ordered: DataFrame, path: str, one_file: bool = False) -> None:
    """One column of ordered lines as numbered parts, side by side; the parts' names are in the order of the lines.
    One file, by one task, only with `one_file`."""
    (ordered.coalesce(1) if one_file else ordered).write.mode("overwrite").text(path)


def write_keys(keys: DataFrame, path: str) -> None:
    """The number of keys, then a key a line, ascending."""
    n = keys.sparkSession.createDataFrame([(0, keys.count())], "part int, value bigint")
    write_lines(n.unionByName(keys.select(F.lit(1).alias("part"), "value")).orderBy("part", "value").select(F.col("value").cast("string")), path)


def write_ranks(ranks: DataFrame, path: str) -> None:
    """A rank a line in vertex order, as %.3e."""
    write_lines(ranks.orderBy("id").select(F.format_string("%.3e", "pr").alias("value")), path)


def write_neighbors(found: DataFrame, path: str) -> None:
    """``query neighbour similarity`` a line, grouped by query, most similar first."""
    write_lines(found.orderBy("query", F.desc("sim"), "neighbor").select(F.format_string("%8d %8d %.3f", "query", "neighbor", "sim").alias("value")), path)


def dump_graph(edges: DataFrame) -> DataFrame:
    """src and its sorted neighbours as text, for inspection."""
    return edges.groupBy("src").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list("dst")), lambda x: x.cast("string"))).alias("nbrs")).orderBy("src")
