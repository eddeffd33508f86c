"""Quality by co-training: a classifier of the text's content and one of the page's metadata and layout.

Each view has its own logistic regression. In a round, both score all unlabelled rows on the executors, and each row
of which one view is sure carries that pseudo-label into the other's training set. There may be as many of them as
documents, so they are trained on where they are: the executors sum, over all rows that one view is sure of, the
gradient and the curvature of the other's loss, by label, in whole numbers, so that no order of adding changes them.
The driver then takes the labelled rows, which it has, and the pseudo-labelled ones' second-order expansion, and fits
the view again; a round does so a few times with the same pseudo-labels. On labelled rows that were not fitted each
view's score is calibrated, and the calibrated log-odds are averaged. Only the labelled sample is bounded. A step is
one pass over all documents, scoring is another; what is shuffled is a few vectors of each task.

The text view is hashed character n-grams, and how varied and how long the words are. The metadata view is source,
language, length, and the page's layout: its lines, how many of them differ, and its shares of signs, capitals and
white space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.scratch import bound_batches
from sparkloom.llm import language_id
from sparkloom.llm import words as W
from sparkloom.llm.text_features import Sparse, logistic, platt, scores, sigmoid, unit

_GRAMS = language_id.Settings(dims=1 << 14, longest=2)
_META = 1 << 12


@dataclass(frozen=True)
class Settings:
    """rows: bound on the labelled sample. rounds: exchanges of pseudo-labels. steps: fits in a round. sure: least
    confidence of a pseudo-label. trust: weight of all pseudo-labelled rows beside the labelled ones. calibrate: a
    labelled row in so many is for calibration. keep: least quality of a kept document."""

    rows: int = 4000
    rounds: int = 3
    steps: int = 1
    sure: float = 0.95
    trust: float = 0.25
    calibrate: int = 4
    keep: float = 0.5
    seed: int = 3


#: Gradients are summed in whole numbers of this unit, so that no order of adding changes them.
_UNIT = 1 << 24
#: Tasks whose sums are added first, by the number of their partition, before all are.
_FIRST = 64


#: Places of the text view after its n-grams: how varied its words are, how long, and an intercept.
_VARIED, _LONG = 64, 32


def text_view(text: str | None) -> Sparse:
    """n-grams of characters; log distinct words by log words, and characters a word, as indicators of ranges."""
    text = text or ""
    at, x = unit(*language_id.counts(text, _GRAMS))
    own = text.split()
    varied = int((_VARIED - 1) * (np.log1p(len(set(own))) / np.log1p(len(own)))) if own else 0
    long = min(_LONG - 1, int(len(text) / len(own))) if own else 0
    return np.r_[at, _GRAMS.dims + np.array([varied, _VARIED + long, _VARIED + _LONG])], np.r_[x, 0.5, 0.5, 1.0]


def _crc(s: str) -> int:
    import zlib

    return zlib.crc32(s.encode()) % (_META - 64)


def meta_view(text: str | None, source: str | None, lang: str | None) -> Sparse:
    """Metadata and layout as indicators of categories and of ranges, and an intercept; by one rule for any length."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, len(data))
    letters = int(np.count_nonzero(((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)))
    space = int(np.count_nonzero((data == 32) | (data == 10)))
    upper = int(np.count_nonzero((data >= 65) & (data <= 90)))
    lines = text.split("\n")
    numbers = {
        "chars": np.log2(1 + len(text)),
        "lines": np.log2(len(lines)),
        "line": np.log2(1 + len(text) / len(lines)),
        "unlike": 10 * len(set(lines)) / len(lines),
        "symbols": 20 * (n - letters - space) / n,
        "upper": 20 * upper / n,
        "blank": 20 * space / n,
    }
    names = [f"source={source}", f"lang={lang}"] + [f"{k}>{int(v)}" for k, v in numbers.items()]
    at = np.unique([_crc(x) for x in names] + [_META - 1])
    return at, np.ones(len(at)) / np.sqrt(len(at))


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    text_scale: tuple[float, float] = (1.0, 0.0)
    meta_scale: tuple[float, float] = (1.0, 0.0)
    settings: Settings = field(default_factory=Settings)

    def predict(self, text: list[Sparse], meta: list[Sparse]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = scores(text, self.text) * self.text_scale[0] + self.text_scale[1]
        b = scores(meta, self.meta) * self.meta_scale[0] + self.meta_scale[1]
        return sigmoid(a), sigmoid(b), sigmoid((a + b) / 2)


_DIMS = {"text": _GRAMS.dims + _VARIED + _LONG + 1, "meta": _META}


def _sums(first: dict[str, np.ndarray], w: dict[str, np.ndarray], s: Settings):
    """Of each task, by view and label: the rows to which the other view's weights in `first` give that label, and
    the sums of the gradient and of the diagonal curvature of their log loss under the weights `w`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        many: dict[tuple, int] = {}
        for batch in batches:
            for i, text in enumerate(batch.column(0)):
                text = text.as_py()
                views = {"text": text_view(text), "meta": meta_view(text, batch.column(1)[i].as_py(), batch.column(2)[i].as_py())}
                for v, other in (("text", "meta"), ("meta", "text")):
                    at, x = views[v]
                    p = float(sigmoid(x @ first[v][at]))
                    if max(p, 1 - p) >= s.sure:
                        key = (other, int(p >= 0.5))
                        at, x = views[other]
                        if key not in total:
                            total[key] = np.zeros(_DIMS[other], np.int64), np.zeros(_DIMS[other], np.int64)
                        q = float(sigmoid(x @ w[other][at]))
                        total[key][0][at] += np.rint((q - key[1]) * x * _UNIT).astype(np.int64)
                        total[key][1][at] += np.rint(q * (1 - q) * x * x * _UNIT).astype(np.int64)
                        many[key] = many.get(key, 0) + 1
        yield _row([(*k, many[k], *total[k]) for k in total])

    return run


def _row(found: list[tuple]) -> pa.RecordBatch:
    columns = [[f[c] for f in found] for c in range(3)] + [[W.pack(f[c]) for f in found] for c in (3, 4)]
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], ["view", "label", "n", "slope", "bend"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of the rows of a view and label."""
    key, n, total = None, 0, None
    for batch in batches:
        for i in range(batch.num_rows):
            key = key or [batch.column(c)[i].as_py() for c in ("view", "label")]
            n += batch.column("n")[i].as_py()
            own = [W.unpack(batch.column(c)[i].as_buffer(), np.int64)[0] for c in ("slope", "bend")]
            total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
    if total is not None:
        yield _row([(*key, n, *total)])


def exchange(pool: DataFrame, first: dict[str, np.ndarray], w: dict[str, np.ndarray], s: Settings) -> dict[tuple[str, int], tuple[int, np.ndarray, np.ndarray]]:
    """By view and label: how many rows of `pool` (text, source, lang) the other view is sure of under `first`, and
    the means of the gradient and of the curvature of their loss under `w`."""
    fields = "view string, label int, n bigint, slope binary, bend binary"
    sums = pool.mapInArrow(_sums(first, w, s), fields).withColumn("part", F.spark_partition_id() % _FIRST)
    sums = sums.groupBy("part", "view", "label").applyInArrow(_added, fields).groupBy("view", "label").applyInArrow(_added, fields)
    found = sums.orderBy("view", "label").collect()
    return {(r.view, r.label): (r.n, *(W.unpack(r[c], np.int64)[0] / (r.n * _UNIT) for c in ("slope", "bend"))) for r in found}


def refit(w: np.ndarray, rows: list[Sparse], labels: np.ndarray, pseudo: list[tuple[int, np.ndarray, np.ndarray]], trust: float, steps: int = 120, rate: float = 0.05) -> np.ndarray:
    """Weights from `w` on by AdaGrad steps over all of: the labelled rows' log loss, classes weighted evenly, and
    `trust` times the expansion at `w` of the pseudo-labelled rows' loss, labels weighted evenly too."""
    at, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    share = min(max(float(labels.mean()), 1e-9), 1 - 1e-9)
    weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)) / len(labels)
    slope, bend = (trust * sum(p[k] for p in pseudo) / max(1, len(pseudo)) for k in (1, 2))
    start, w, g2 = w, w.copy(), np.full(len(w), 1e-12)
    for _ in range(steps):
        off = weight * (sigmoid(np.bincount(row, x * w[at], len(rows))) - labels)
        g = np.bincount(at, off[row] * x, len(w)) + slope + bend * (w - start)
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
    return w


def cotrain(text: list[Sparse], meta: list[Sparse], labels: np.ndarray, pool: DataFrame, s: Settings) -> Model:
    held = np.arange(len(labels)) % s.calibrate == 0
    own = np.flatnonzero(~held).tolist()
    rows = {v: [x[i] for i in own] for v, x in (("text", text), ("meta", meta))}
    w = {v: logistic(x, labels[own], _DIMS[v]) for v, x in rows.items()}
    first = w
    for step in range(s.rounds * s.steps):
        if step % s.steps == 0:
            first = dict(w)  # what decides the pseudo-labels of a round
        given = exchange(pool, first, w, s)
        if not given:
            break
        for v in w:
            if pseudo := [x for (view, _), x in sorted(given.items()) if view == v]:
                w[v] = refit(w[v], rows[v], labels[own], pseudo, s.trust)
    model = Model(w["text"], w["meta"], settings=s)
    at = np.flatnonzero(held).tolist()
    if len(set(labels[at].tolist())) == 2:
        model.text_scale = platt(scores([text[i] for i in at], w["text"]), labels[at])
        model.meta_scale = platt(scores([meta[i] for i in at], w["meta"]), labels[at])
    return model


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both views of labelled rows, packed: their features alone come to the driver."""
    for batch in batches:
        made = []
        for t, a, b in zip(batch.column("text"), batch.column("source").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            t = t.as_py()
            at, x = text_view(t)
            made.append((W.pack(at.astype(np.uint32), x.astype(np.float32)), meta_view(t, a, b)[0].astype(np.int32).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("draw"), batch.column("y"), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.binary())], ["draw", "y", "t", "m"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", settings: Settings = Settings()) -> Model:
    """A model from the rows of `docs` (text, source, lang) that `labels` (id, 0 or 1) names, and all others with a
    text. Of the labelled ones about `settings.rows` are used, twice as many at most, by a seeded hash, the same in
    every run; the others are all used, on the executors, and so are labelled rows beyond the sample, as rows without
    a label: the ids to leave out are then few, wherever the texts are, and no text is shuffled. Without two classes:
    quality 0.5. Null ids are not labelled; of labels that repeat an id the largest counts; other columns, of any
    name, are not looked at."""
    s = settings
    bound_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(id_col).alias("id"), F.col("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang")).filter("text is not null")
    draw = F.pmod(F.xxhash64(F.lit(s.seed), "id"), F.lit(1 << 30)) / float(1 << 30)
    few = known.withColumn("draw", draw).filter(F.col("draw") < F.lit(min(1.0, s.rows / max(1, known.count())))).orderBy("draw", "id").limit(2 * s.rows)
    # Where many rows share a labelled id, a hash of their texts keeps the sample within its bound.
    drawn = rows.join(F.broadcast(few), "id").withColumn("draw", F.xxhash64(F.lit(s.seed), "id", "text", "source", "lang").cast("double")).select("draw", "y", "text", "source", "lang")
    sample = drawn.mapInArrow(_views, "draw double, y int, t binary, m binary").orderBy("draw", "y", "t", "m").limit(2 * s.rows).collect()
    y = np.array([r.y for r in sample], float)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(_DIMS["text"]), np.zeros(_META), settings=s)
    text, meta = [], []
    for r in sample:
        at, x = W.unpack(r.t, np.uint32, np.float32)
        text.append((at.astype(np.int64), x.astype(np.float64)))
        at = np.frombuffer(r.m, np.int32).astype(np.int64)
        meta.append((at, np.ones(len(at)) / np.sqrt(len(at))))
    pool = rows.join(F.broadcast(few.select("id")), "id", "left_anti").select("text", "source", "lang")
    return cotrain(text, meta, y, pool, s)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [t.as_py() for t in batch.column(1)]
            meta = [meta_view(*x) for x in zip(text, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            made = [pa.array(x) for x in model.predict([text_view(t) for t in text], meta)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["id", "a", "b", "q"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """`id_col`, p_text, p_meta (calibrated, by view), quality (combined), keep: a row for each row.

    Whole texts are scored; null texts, sources and languages are values of their own, an empty text is its
    lack of n-grams. Rows that repeat are scored alike; null ids are kept; other columns, of any name, are not
    looked at. Empty table: empty result."""
    bound_batches(docs.sparkSession)
    inner = docs.select(F.col(id_col).alias("id"), F.col("text").alias("t"), F.col("source").cast("string").alias("s"), F.col("lang").cast("string").alias("l"))
    kind = inner.schema["id"].dataType.simpleString()
    out = inner.mapInArrow(_score(model), f"id {kind}, a double, b double, q double")
    return out.select(F.col("id").alias(id_col), F.col("a").alias("p_text"), F.col("b").alias("p_meta"), F.col("q").alias("quality"), (F.col("q") >= model.settings.keep).alias("keep"))
