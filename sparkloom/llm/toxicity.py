"""Toxicity by cumulative-link ordinal regression on sparse text features.

``P(grade <= k) = sigmoid(threshold_k - w . x)`` with one weight vector for all ordered thresholds, which are a
first one and positive steps. Features are hashed words and beginnings of words. An L1 penalty leaves few
weights, those of words that many toxic texts share. The model is fitted on a bounded sample of labelled rows;
scoring is one pass over the texts without a shuffle, and the output is the expected grade.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.scratch import bound_batches
from sparkloom.llm.text_features import Sparse, scores, sigmoid, words


@dataclass(frozen=True)
class Settings:
    """dims: hashed features. rows: bound on the fitted sample. seen: rows of the sample a feature must be in.
    weight: of rows of grade 1 or more. toxic: expected grade from which a text is toxic."""

    dims: int = 1 << 18
    rows: int = 8000
    seen: int = 3
    steps: int = 300
    still: float = 1e-6
    l1: float = 5e-4
    weight: float = 3.0
    toxic: float = 0.5
    seed: int = 5


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    settings: Settings

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        """Of each score, the probability of each grade."""
        below = sigmoid(self.thresholds[None, :] - z[:, None])
        edge = np.concatenate([np.zeros((len(z), 1)), below, np.ones((len(z), 1))], 1)
        return np.diff(edge, axis=1)


def ordinal(rows: list[Sparse], grades: np.ndarray, n_grades: int, s: Settings) -> Model:
    """Shared weights and ordered thresholds of least penalised log loss, which is convex: accelerated proximal
    gradient steps; the L1 penalty shrinks weights, thresholds are kept in order. Only features that `seen` rows
    have are worked on. Steps end early where no weight moves by `still`."""
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(a) for a, _ in rows])
    col, val = np.concatenate([a for a, _ in rows]), np.concatenate([x for _, x in rows])
    often = np.bincount(col, minlength=s.dims) >= s.seen
    ok, used = often[col], np.flatnonzero(often)
    row, col, val = row[ok], (np.cumsum(often) - 1)[col[ok]], val[ok]
    if not len(used):
        used, row, col, val = np.zeros(1, np.int64), row[:0], col[:0].astype(np.int64), val[:0]
    weight = np.where(grades > 0, s.weight, 1.0)
    weight = weight / weight.sum()

    def into(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, val * w[col], minlength=len(rows))

    def back(g: np.ndarray) -> np.ndarray:
        return np.bincount(col, val * g[row], minlength=len(used))

    u, bound = np.random.default_rng(s.seed).normal(size=len(used)), 1.0
    for _ in range(20):  # the largest curvature, by power iteration
        u = back(into(u) * weight)
        bound = max(1e-9, float(np.linalg.norm(u)))
        u /= bound
    step = 1 / (0.5 * 1.1 * bound + 0.5)
    share = np.clip([weight[grades <= k].sum() for k in range(n_grades - 1)], 1e-3, 1 - 1e-3)
    w, cut = np.zeros(len(used)), np.log(share / (1 - share))
    ahead_w, ahead_cut, t = w, cut, 1.0
    high, low = grades < n_grades - 1, grades > 0
    for _ in range(s.steps):
        z = into(ahead_w)
        up = np.where(high, sigmoid(ahead_cut[np.minimum(grades, n_grades - 2)] - z), 1.0)
        down = np.where(low, sigmoid(ahead_cut[np.maximum(grades - 1, 0)] - z), 0.0)
        p = np.maximum(1e-9, up - down)
        du, dl = weight * up * (1 - up) / p, weight * down * (1 - down) / p
        by_cut = np.bincount(grades[low] - 1, dl[low], minlength=n_grades - 1) - np.bincount(grades[high], du[high], minlength=n_grades - 1)
        new_w = ahead_w - step * back(du - dl)
        new_w = np.sign(new_w) * np.maximum(0.0, np.abs(new_w) - step * s.l1)
        new_cut = np.maximum.accumulate(ahead_cut - step * by_cut + 1e-3 * np.arange(0, -(n_grades - 1), -1)) + 1e-3 * np.arange(n_grades - 1)
        more = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead_w, ahead_cut = new_w + (t - 1) / more * (new_w - w), new_cut + (t - 1) / more * (new_cut - cut)
        ahead_cut = np.maximum.accumulate(ahead_cut)
        moved = max(np.abs(new_w - w).max(), np.abs(new_cut - cut).max())
        w, cut, t = new_w, new_cut, more
        if moved < s.still:
            break
    whole = np.zeros(s.dims)
    whole[used] = w
    return Model(whole, cut, s)


def graded(rows: list[Sparse], toxic: np.ndarray, s: Settings) -> Model:
    """A model of three grades from labels 0 and 1. A first fit of the labels scores the toxic rows; those above
    their median are grade 2, severe. A second fit is ordinal over the three grades."""
    first = ordinal(rows, toxic, 2, s)
    z = scores(rows, first.weights)
    return ordinal(rows, np.where(toxic > 0, 1 + (z > np.median(z[toxic > 0])), 0), 3, s)


def _places(dims: int):
    """The features of each text, which is the last column, 4 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [at.astype(np.int32).tobytes() for at, _ in words(batch.columns[-1], dims)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.binary())], [*batch.schema.names[:-1], "features"])

    return run


def _draw(pairs: DataFrame, n: int, s: Settings) -> DataFrame:
    """Of rows with id, mark (a hash of the text) and grade, `n` in all, those with a `draw` within the sample's share."""
    draw = F.pmod(F.xxhash64(F.lit(s.seed), "id", "mark", "grade"), F.lit(1 << 30)) / float(1 << 30)
    return pairs.withColumn("draw", draw).filter(F.col("draw") < F.lit(min(1.0, s.rows / max(1, n))))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", settings: Settings = Settings(), labels: DataFrame | None = None) -> Model:
    """A model from rows with a text and a grade (0, 1, ...). About `settings.rows` of them are used, twice as many
    at most, by a seeded hash of id, text and grade, the same in every run; only their features come to the driver.
    Where only grades 0 and 1 occur, the toxic rows are graded as `graded` says. Without any rows, or with one grade
    only, every text has grade 0. Null ids take part; a null grade or text is left out; rows that repeat are in or
    out together; other columns, of any name, are not looked at.

    Where the grades are a table of their own, `labels`, the rows are those of the inner join by id. Ids and hashes
    alone are joined then; the sample's go to where the texts are, so no text is shuffled."""
    s = settings
    bound_batches(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([] if labels is not None else [F.col(grade_col).cast("int").alias("grade")])).filter("text is not null").withColumn("mark", F.xxhash64("text"))
    if labels is None:
        rows = rows.filter("grade >= 0")
        drawn = _draw(rows, rows.count(), s).withColumn("times", F.lit(1))
    else:
        given = labels.select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade")).filter("id is not null and grade >= 0").groupBy("id", "grade").agg(F.count("*").alias("times"))
        marks = rows.filter("id is not null").groupBy("id", "mark").agg(F.count("*").alias("rows"))
        pairs = marks.join(given.hint("merge"), "id")
        n = pairs.agg(F.sum(F.col("rows") * F.col("times"))).first()[0] or 0
        few = _draw(pairs, n, s).select("id", "mark", "grade", "times", "draw").orderBy("draw", "id", "mark", "grade").limit(2 * s.rows)
        drawn = rows.join(F.broadcast(few), ["id", "mark"]).withColumn("times", F.least("times", F.lit(2 * s.rows)).cast("int"))
    made = drawn.select("draw", "grade", "times", "text").mapInArrow(_places(s.dims), "draw double, grade int, times int, features binary")
    made = made.withColumn("times", F.explode(F.sequence(F.lit(1), "times")))
    sample = made.select("draw", "grade", "features").orderBy("draw", "grade", "features").limit(2 * s.rows).collect()
    grades = np.array([r.grade for r in sample], np.int64)
    top = int(grades.max(initial=0)) + 1
    if top < 2 or not (grades == 0).any():
        return Model(np.zeros(s.dims), np.array([35.0]), s)
    made = [(at := np.frombuffer(r.features, np.int32), np.ones(len(at), np.float32)) for r in sample]
    return graded(made, grades, s) if top == 2 else ordinal(made, grades, top, s)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.probabilities(scores(words(batch.column(1), model.settings.dims), model.weights))
            made = [pa.array(p @ np.arange(p.shape[1])), pa.array(1 - p[:, 0])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["id", "severity", "p"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, severity (expected grade), p_toxic (grade 1 or more), toxic: a row for each row.

    Whole texts are scored. A null or wordless text has severity 0. Rows that repeat are scored alike; null ids
    are kept; other columns, of any name, are not looked at. Empty table: empty result."""
    bound_batches(docs.sparkSession)
    inner = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = inner.schema["id"].dataType.simpleString()
    blank = inner.select("id", F.coalesce(F.col("t"), F.lit("")).rlike(r"[^\x20\x09-\x0D]").alias("some"), "t")
    out = blank.filter("some").select("id", "t").mapInArrow(_score(model), f"id {kind}, severity double, p double")
    rest = blank.filter("not some").select("id", F.lit(0.0).alias("severity"), F.lit(0.0).alias("p"))
    out = out.unionByName(rest)
    return out.select(F.col("id").alias(id_col), "severity", F.col("p").alias("p_toxic"), (F.col("severity") >= model.settings.toxic).alias("toxic"))
