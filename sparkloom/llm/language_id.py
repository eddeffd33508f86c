"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three characters of the lower-cased text; a feature's weight is
``(1 + log tf) * idf``, vectors have length 1. Document frequencies cover all documents that may be learned
from. The model is fitted by follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties on a
bounded sample. The L1 penalty is the largest of a few whose log loss, on a part of the sample that is not fitted,
is near the least, so that most weights are exactly 0. On the same part one temperature calibrates the scores. Scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.scratch import bound_batches
from sparkloom.llm import words as W
from sparkloom.llm.cluster import give_back

UNKNOWN = "und"
_SIGN = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Settings:
    """dims: hashed features, a power of two. rows: bound on the fitted sample, shared evenly by labels."""

    dims: int = 1 << 15
    longest: int = 3
    rows: int = 4000
    epochs: int = 2
    alpha: float = 0.5
    beta: float = 1.0
    l1: tuple[float, ...] = (0.01, 0.03, 0.1, 0.3)  # the largest that costs no more than `slack` of log loss
    slack: float = 0.01
    l2: float = 1e-4
    calibrate: int = 5  # a row in so many of the sample is for the temperature
    seed: int = 11


def has_letter(text: str | None) -> bool:
    """Whether a text has a character of Unicode's letter categories; signs such as \u00b2 or \u2167 are none."""
    return any(m[0].isalpha() for m in _SIGN.finditer(text)) if text else False


def counts(text: str, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Features of a whole text and how often each occurs."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    total, key = np.zeros(s.dims, np.int64), np.zeros(len(c), np.uint32)
    shift = np.uint32(32 - (s.dims.bit_length() - 1))
    for n in range(1, s.longest + 1):
        if len(c) < n:
            break
        key = key[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] + np.uint32(n)
        total += np.bincount((key * np.uint32(0x9E3779B1)) >> shift, minlength=s.dims)
    at = np.flatnonzero(total)
    return at, total[at]


def vector(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF of features and their counts, of length 1."""
    x = (1 + np.log(n)) * idf[at]
    return at.astype(np.int32), (x / max(float(np.sqrt(x @ x)), 1e-12)).astype(np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, s: Settings, l1: float) -> np.ndarray:
    """Weights (dims + 1, classes) of multinomial logistic regression; the last row is the intercept."""
    z, n = np.zeros((s.dims + 1, classes)), np.zeros((s.dims + 1, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    rng = np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        for i in rng.permutation(len(rows)):
            at, x, label = rows[i]
            at, x = np.r_[at, s.dims], np.r_[x, 1.0]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p[None, :]
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / s.alpha * w
            n[at] = more
    return weights(z, n)


def log_loss(z: np.ndarray, labels: np.ndarray) -> float:
    p = softmax(z)
    return -float(np.log(np.maximum(p[np.arange(len(z)), labels], 1e-12)).mean())


def temperature(z: np.ndarray, labels: np.ndarray) -> float:
    """What the scores are divided by for the least log loss; golden section over its logarithm."""

    def loss(t: float) -> float:
        return log_loss(z / np.exp(t), labels)

    lo, hi, r = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float
    settings: Settings

    def scores(self, text: str) -> np.ndarray:
        at, x = vector(*counts(text, self.settings), self.idf)
        return x @ self.weights[at] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.scores(text) / self.temperature)
        i = int(p.argmax())
        return self.labels[i], float(p[i])


def _frequencies(s: Settings):
    """Documents of each label (feature -1) and of each feature, by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, labels = np.zeros(s.dims, np.int64), {}
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if has_letter(text := text.as_py()):
                    df[counts(text, s)[0]] += 1
                    labels[label] = labels.get(label, 0) + 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, np.full(len(labels), -1)], pa.int64()), pa.array([None] * len(at) + list(labels), pa.string()), pa.array(np.r_[df[at], np.array(list(labels.values()), np.int64)].astype(np.int64))], ["feature", "label", "n"])

    return run


def _counted(s: Settings):
    """Rows as their features' counts, packed: at most 8 bytes a feature, whatever the length of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(2)]
            keep = pa.array([has_letter(t) for t in texts], pa.bool_())
            made = [W.pack(*(x.astype(np.uint32) for x in counts(t, s))) for t, ok in zip(texts, keep, strict=True) if ok.as_py()]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(made, pa.binary())], ["draw", "label", "features"])

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", settings: Settings = Settings()) -> Model:
    """A model from the rows of `docs` that have a text with a letter and a label.

    Document frequencies are over all of them; the fitted sample has about `settings.rows` rows and twice as many
    at most, chosen by a seeded hash of id and text, evenly over the labels, the same in every run. Only feature
    counts come to the driver. Without such rows the model predicts `und` always. Null ids take part; rows that
    repeat are in or out together; other columns, of any name, are not looked at."""
    s = settings
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"), F.col(id_col).alias("id")).filter(F.col("text").isNotNull() & F.col("label").isNotNull())
    seen = rows.select("text", "label").mapInArrow(_frequencies(s), "feature bigint, label string, n bigint").groupBy("feature", "label").agg(F.sum("n").alias("n")).collect()
    n = {r.label: r.n for r in seen if r.feature < 0}
    total = sum(n.values())
    df = np.zeros(s.dims)
    for r in seen:
        if r.feature >= 0:
            df[r.feature] = r.n
    del seen
    idf = np.log((1 + total) / (1 + df)) + 1
    if not n:
        return Model([], np.zeros((s.dims + 1, 0)), idf, 1.0, s)
    labels = sorted(n)
    share = F.lit(0.0)
    for x in labels:
        share = F.when(F.col("label") == x, F.lit(min(1.0, s.rows / len(labels) / n[x]))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit(s.seed), "id", "text"), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.withColumn("draw", draw).filter(F.col("draw") < share).select("draw", "label", "text")
    sample = drawn.mapInArrow(_counted(s), "draw double, label string, features binary").orderBy("draw", "label", "features").limit(2 * s.rows).collect()
    made = [(*vector(*W.unpack(r.features, np.uint32, np.uint32), idf), labels.index(r.label)) for r in sample]
    del sample
    give_back()
    fitted, held = [x for i, x in enumerate(made) if i % s.calibrate], [x for i, x in enumerate(made) if not i % s.calibrate]
    if len(held) < 20 or len(labels) < 2:
        return Model(labels, ftrl(fitted or made, len(labels), s, min(s.l1)).astype(np.float32), idf, 1.0, s)
    y, tried = np.array([y for *_, y in held]), []
    for l1 in sorted(s.l1):
        model = Model(labels, ftrl(fitted, len(labels), s, l1).astype(np.float32), idf, 1.0, s)
        z = np.array([x @ model.weights[at] + model.weights[-1] for at, x, _ in held])
        model.temperature = temperature(z, y)
        tried.append((log_loss(z / model.temperature, y), model))
    least = min(loss for loss, _ in tried)
    return next(model for loss, model in reversed(tried) if loss <= least + s.slack)


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            made = [pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], "p", "q"])

    return run


def predict(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """`carry` columns, lang_pred and score of each row, from its whole text alone.

    A null text, or one without a letter, is `und` with score 0. Rows that repeat are scored alike; other
    columns, of any name, are not looked at. Empty table: empty result."""
    bound_batches(docs.sparkSession)
    give_back()  # what the fit has left
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(text_col).alias("t"))
    fields = ", ".join(f"c{i} {inner.schema[i].dataType.simpleString()}" for i in range(len(carry)))
    return inner.mapInArrow(_predict(model), f"{fields}, p string, q double").toDF(*carry, "lang_pred", "score")
