"""Language ID, toxicity and quality: accuracy on rows that were not learned from, and odd rows."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.llm import language_id, quality, registry, toxicity
from sparkloom.llm.folds import held_out, learnable
from sparkloom.llm.text_features import platt, sigmoid, words

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, p string, id string, label string"
ODD = [(1, None, None, None, None, "", "", ""), (2, "", "en", "s", 0, "", "", ""), (3, "12 ... \n", "en", "s", 8, "", "", ""), (None, "hello there my friend", None, None, None, "", "", ""), (2, "w " * 60000, "en", "s", 1, "", "", "")]


def test_language_held_out_accuracy(spark):
    docs = registry.table(spark, SF, "documents")
    got = registry.op8_language_id(spark, SF)
    r = got.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == F.col("lang_pred")).alias("ok")).first()
    assert got.count() == docs.count() and r.n > 100 and r.ok >= 0.95 * r.n


def test_fold_is_crc32(spark):
    import zlib

    ids = [0, 7, 123456789, -4]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "doc_id bigint").select(held_out()).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]


def test_language_of_odd_rows(spark):
    docs = registry.table(spark, SF, "documents")
    model = language_id.fit(learnable(docs))
    odd = spark.createDataFrame(ODD, SCHEMA)
    got = sorted((r.doc_id or 0, r.lang_pred, r.score) for r in language_id.predict(odd, model).collect())
    assert [x[:2] for x in got if x[1] == "und"] == [(1, "und"), (2, "und"), (3, "und")]
    assert all(0 <= s <= 1 for *_, s in got) and len(got) == 5
    none = language_id.fit(odd.filter("false"))
    assert {r.lang_pred for r in language_id.predict(odd, none).collect()} == {"und"}
    assert language_id.predict(odd.filter("false"), model).count() == 0
    assert (model.weights == 0).mean() > 0.02  # the elastic net leaves weights at 0


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(4000, 3)) * 2
    p = language_id.softmax(z)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert abs(language_id.temperature(z * 3, y) - 3) < 0.4


def test_toxicity(spark):
    docs, labels = registry.table(spark, "/root/testdata/sf0.1", "documents"), registry.table(spark, "/root/testdata/sf0.1", "labels")
    train = docs.join(labels.select("doc_id", F.col("toxic").alias("grade")), "doc_id").filter("doc_id % 4 <> 0").select("doc_id", "text", "grade")
    model = toxicity.fit(train)
    got = toxicity.score(docs, model).join(labels.select("doc_id", F.col("toxic").alias("y")), "doc_id").filter("doc_id % 4 = 0")
    r = got.agg(F.count_if(F.expr("toxic and y = 1")).alias("hit"), F.count_if(F.expr("y = 1")).alias("bad"), F.count_if(F.expr("toxic and y = 0")).alias("false"), F.count_if(F.expr("y = 0")).alias("good")).first()
    assert r.hit >= 0.9 * r.bad and r["false"] <= 0.01 * r.good
    odd = toxicity.score(spark.createDataFrame(ODD, SCHEMA), model).collect()
    assert len(odd) == 5 and all(0 <= x.severity <= 2 for x in odd) and sum(x.severity == 0 for x in odd) >= 2
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.score(docs.limit(3), toxicity.fit(train.limit(0))).filter("toxic").count() == 0


def test_ordinal_thresholds_ascend():
    rng = np.random.default_rng(1)
    texts, grades = [], []
    for _ in range(600):
        g = int(rng.integers(4))
        texts.append(" ".join(["bad"] * (3 * g) + [f"w{rng.integers(50)}" for _ in range(10)]))
        grades.append(g)
    s = toxicity.Settings(dims=1 << 12, l1=1e-4)
    model = toxicity.ordinal(words(pa.array(texts), s.dims), np.array(grades), 4, s)
    assert (np.diff(model.thresholds) > 0).all()
    p = model.probabilities(np.array([-5.0, 0.0, 5.0]))
    assert np.allclose(p.sum(1), 1) and (np.diff(p @ np.arange(4)) > 0).all()


def test_quality(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = registry.table(spark, sf, "documents"), registry.table(spark, sf, "labels")
    model = quality.fit(docs, labels.filter("doc_id % 4 <> 0"))
    got = quality.score(docs, model).join(labels.select("doc_id", "quality").withColumnRenamed("quality", "y"), "doc_id").filter("doc_id % 4 = 0")
    r = got.agg(F.count_if(F.expr("keep and y = 1")).alias("kept"), F.count_if(F.expr("y = 1")).alias("good"), F.count_if(F.expr("not keep and y = 0")).alias("gone"), F.count_if(F.expr("y = 0")).alias("bad")).first()
    assert r.kept >= 0.98 * r.good and r.gone >= 0.85 * r.bad
    odd = quality.score(spark.createDataFrame(ODD, SCHEMA), model).collect()
    assert len(odd) == 5 and all(0 <= x.quality <= 1 for x in odd)
    assert {r.quality for r in quality.score(docs.limit(2), quality.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def test_platt():
    rng = np.random.default_rng(2)
    z = rng.normal(size=3000) * 2
    a, b = platt(z * 2, (rng.random(3000) < sigmoid(z + 1)).astype(float))
    assert abs(a - 0.5) < 0.1 and abs(b - 1) < 0.2


def test_signs_are_no_letters(spark):
    assert not any(language_id.has_letter(t) for t in (None, "", "\u00b2 \u00bd \u2460 \u2167", "12_ .", "\u0660")) and language_id.has_letter("\u00b2\u00aa") and language_id.has_letter("1\u4e00")
    signs = spark.createDataFrame([(i, "\u00b2 \u00bd \u2460 \u2167 " * 9, "en") for i in range(9)], "doc_id bigint, text string, lang string")
    assert language_id.fit(signs).labels == []
    model = language_id.fit(signs.unionByName(spark.createDataFrame([(100 + i, f"word {i} of a text", x) for i in range(40) for x in ("en", "de")], signs.schema)))
    assert model.labels == ["de", "en"] and {(r.lang_pred, r.score) for r in language_id.predict(signs, model).collect()} == {("und", 0.0)}


def test_the_penalty_makes_weights_zero(spark):
    """Of the features that the sample has, and against a fit without the penalty."""
    docs = learnable(registry.table(spark, SF, "documents"))
    model, plain = language_id.fit(docs), language_id.fit(docs, settings=language_id.Settings(l1=(0.0,)))
    touched = np.abs(plain.weights[:-1]).max(1) > 0
    assert touched.sum() > 3000
    assert (model.weights[:-1][touched] == 0).mean() > 0.3 > 0.01 > (plain.weights[:-1][touched] == 0).mean()


def test_language_scores_by_brute_force(spark):
    """A plain statement of the features and of the score, character by character."""
    docs = registry.table(spark, SF, "documents")
    model, s = language_id.fit(learnable(docs)), language_id.Settings()
    for text in ["Stra\u00dfe und Weg", "the \U0001f600 cat", "\u00e9t\u00e9 \u00e0 la mer " * 30, "x"] + [r.text for r in docs.filter("text is not null").limit(5).collect()]:
        own = {}
        low = text.lower()
        for n in range(1, s.longest + 1):
            for i in range(len(low) - n + 1):
                key = 0
                for k, c in enumerate(low[i : i + n], 1):
                    key = (key * 0x01000193 + ord(c) + k) % 2**32
                at = key * 0x9E3779B1 % 2**32 >> 32 - 15
                own[at] = own.get(at, 0) + 1
        x = {at: (1 + np.log(n)) * model.idf[at] for at, n in own.items()}
        norm = sum(v * v for v in x.values()) ** 0.5
        z = [(sum(v / norm * model.weights[at, j] for at, v in x.items()) + model.weights[-1, j]) / model.temperature for j in range(len(model.labels))]
        e = np.exp(np.array(z) - max(z))
        label, score = model.predict(text)
        assert label == model.labels[int(e.argmax())] and abs(score - (e / e.sum()).max()) < 1e-4


def test_repeats_and_null_ids_are_drawn_alike(spark):
    rows = [(None if i % 3 else i, f"word {i % 40} of the text", "en" if i % 40 < 20 else "de") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    s = language_id.Settings(rows=100)
    a, b = language_id.fit(docs, settings=s), language_id.fit(docs.repartition(5), settings=s)
    assert (a.weights == b.weights).all() and a.temperature == b.temperature


def plain_hash(data):
    """The hash of a word's bytes, in whole numbers."""
    mask = 2**64 - 1
    x = sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 2**64) for i, b in enumerate(data)) + len(data) * 0xFF51AFD7ED558CCD & mask
    return plain_mix(x)


def plain_mix(x):
    mask = 2**64 - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
    x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
    return x ^ x >> 31


def plain_places(text, dims):
    out = set()
    for word in re.split(r"[\s!-&(-,./:-@\[-`{-~]+", text, flags=re.A):
        word = "".join(c.lower() if "A" <= c <= "Z" else c for c in word).encode()
        if word:
            out.add((plain_hash(word) >> 32) % dims)
        for k in (5, 7):
            if len(word) > k:
                out.add((plain_mix(plain_hash(word[:k]) + k & 2**64 - 1) >> 32) % dims)
    return out


def test_toxicity_by_brute_force(spark):
    docs, labels = registry.table(spark, SF, "documents"), registry.table(spark, SF, "labels")
    model = toxicity.fit(docs.join(labels.select("doc_id", F.col("toxic").alias("grade")), "doc_id"))
    docs = docs.filter("doc_id % 9 = 0")
    got = {r.doc_id: (r.severity, r.p_toxic) for r in toxicity.score(docs, model).collect()}
    assert len(got) > 50
    for r in docs.collect():
        z = sum(model.weights[i] for i in plain_places(r.text or "", model.settings.dims))
        below = [1 / (1 + np.exp(z - c)) for c in model.thresholds]
        p = np.diff([0, *below, 1])
        want = (sum(k * q for k, q in enumerate(p)), 1 - p[0]) if (r.text or "").strip() else (0, 0)
        assert np.allclose(got[r.doc_id], want, atol=1e-6)


def test_ordinal_is_the_least_of_its_loss():
    rng = np.random.default_rng(3)
    s = toxicity.Settings(dims=64, l1=1e-3, steps=4000, still=1e-9, seen=1)
    rows, grades = [], []
    for _ in range(300):
        g = int(rng.integers(3))
        at = np.unique(np.r_[rng.integers(0, 40, 4), rng.integers(40, 44 + 4 * g, 2)]).astype(np.int64)
        rows.append((at, np.ones(len(at))))
        grades.append(g)
    grades = np.array(grades)
    model = toxicity.ordinal(rows, grades, 3, s)
    weight = np.where(grades > 0, s.weight, 1.0)

    def loss(w, cut):
        z = np.array([w[at].sum() for at, _ in rows])
        edge = np.concatenate([np.zeros((300, 1)), sigmoid(cut[None] - z[:, None]), np.ones((300, 1))], 1)
        p = np.diff(edge, axis=1)[np.arange(300), grades]
        return -(weight * np.log(np.maximum(p, 1e-12))).sum() / weight.sum() + s.l1 * np.abs(w).sum()

    least = loss(model.weights, model.thresholds)
    for _ in range(300):
        size = 10 ** rng.uniform(-3, 0)
        assert least <= loss(model.weights + size * rng.normal(size=64) * (rng.random(64) < 0.2), model.thresholds + size * rng.normal(size=2) * 0.5) + 1e-5


def test_exchange_by_brute_force(spark):
    """Each confident row of the pool gives the other view its gradient, copies and long texts too."""
    docs = registry.table(spark, SF, "documents").filter("text is not null")
    s = quality.Settings(sure=0.8)
    rng = np.random.default_rng(5)
    first, w = ({"text": rng.normal(size=quality._DIMS["text"]) * 2, "meta": rng.normal(size=quality._META) * 2} for _ in range(2))
    pool = docs.unionByName(docs.filter("doc_id % 3 = 0")).select("text", "source", "lang")
    want = {}
    for r in pool.collect():
        views = {"text": quality.text_view(r.text), "meta": quality.meta_view(r.text, r.source, r.lang)}
        for v, other in (("text", "meta"), ("meta", "text")):
            p = sigmoid(views[v][1] @ first[v][views[v][0]])
            if max(p, 1 - p) >= s.sure:
                own = want.setdefault((other, int(p >= 0.5)), [0, np.zeros(quality._DIMS[other]), np.zeros(quality._DIMS[other])])
                at, x = views[other]
                q = sigmoid(x @ w[other][at])
                own[0] += 1
                own[1][at] += (q - (p >= 0.5)) * x
                own[2][at] += q * (1 - q) * x * x
    got = quality.exchange(pool.repartition(7), first, w, s)
    assert {k: g[0] for k, g in got.items()} == {k: n for k, (n, *_) in want.items()} and sum(g[0] for g in got.values()) > 500
    for k, (n, slope, bend) in want.items():
        assert np.allclose(got[k][1], slope / n, atol=1e-6) and np.allclose(got[k][2], bend / n, atol=1e-6)


def test_refitting_lowers_the_loss_of_both_kinds_of_rows():
    """The expansion stands for the pseudo-labelled rows: their loss falls as it does where they are all at hand."""
    rng = np.random.default_rng(3)
    truth = rng.normal(size=60) * 3
    made = [(np.unique(rng.integers(0, 60, 12)).astype(np.int64),) for _ in range(900)]
    made = [(at, np.ones(len(at)) / np.sqrt(len(at))) for (at,) in made]
    y = np.array([float(truth[at] @ x > 0) for at, x in made])

    def loss(w, rows, y):
        z = np.array([x @ w[at] for at, x in rows])
        return float(np.mean(np.log1p(np.exp(np.where(y > 0, -z, z)))))

    few, rest = made[:40], made[40:]
    w = start = quality.logistic(few, y[:40], 60)
    for _ in range(3):
        pseudo = []
        for label in (0, 1):
            slope, bend, n = np.zeros(60), np.zeros(60), 0
            for (at, x), k in zip(rest, y[40:], strict=True):
                if k == label:
                    q = sigmoid(x @ w[at])
                    slope[at] += (q - label) * x
                    bend[at] += q * (1 - q) * x * x
                    n += 1
            pseudo.append((n, slope / n, bend / n))
        w = quality.refit(w, few, y[:40], pseudo, 1.0)
    assert loss(w, rest, y[40:]) < 0.8 * loss(start, rest, y[40:])


def test_pseudo_labels_teach_the_other_view(spark):
    """Words that no labelled page has stand on pages whose source tells their quality: only the exchange can teach
    the text view what they mean."""
    rng = np.random.default_rng(9)
    sets = [["alpha beta gamma delta".split(), "zulu yankee xray whisky".split()], ["mmmo nnno oopp ppoo".split(), "ddee eedd ffgg ggff".split()]]

    def page(known, good):
        return " ".join(rng.choice(sets[1 - known][good], 30))

    docs = [(i, page(True, i % 2), "en", f"s{i % 2}") for i in range(60)] + [(i, page(False, i % 2), "en", f"s{i % 2}") for i in range(60, 1060)]
    test = [(i, page(False, i % 2), "xx", f"other{i}") for i in range(2000, 2200)]
    schema = "doc_id bigint, text string, lang string, source string"
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    right = {}
    for rounds in (0, 2):
        model = quality.fit(spark.createDataFrame(docs, schema), labels, settings=quality.Settings(rounds=rounds, sure=0.7))
        got = quality.score(spark.createDataFrame(test, schema), model).collect()
        right[rounds] = np.mean([(r.p_text >= 0.5) == (r.doc_id % 2 == 1) for r in got])
    assert right[2] > 0.95 and right[0] < 0.8, right


def test_one_rule_for_texts_of_any_length():
    """A text said a thousand times over differs in size and length of line alone; a word more makes no jump."""
    names = [set(quality.meta_view("Some words, OF each kind. " * k, "s", "en")[0].tolist()) for k in (4, 160, 4000)]
    assert all(len(a ^ b) <= 4 for a, b in zip(names, names[1:]))
    own = ["".join(chr(97 + i // 26**k % 26) for k in range(6)) for i in range(4002)]
    for n in (3998, 3999, 4000, 4001):
        a, b = (quality.text_view(" ".join(own[:k]))[0][-3:].tolist() for k in (n, n + 1))
        assert a == b and quality.meta_view(" ".join(own[:n]), "s", "en")[0].tolist() == quality.meta_view(" ".join(own[: n + 1]), "s", "en")[0].tolist()


def test_quality_scores_by_brute_force(spark):
    docs, labels = registry.table(spark, SF, "documents"), registry.table(spark, SF, "labels")
    model = quality.fit(docs, labels)
    again = quality.fit(docs.repartition(3), labels.repartition(2))
    assert (model.text == again.text).all() and (model.meta == again.meta).all()
    docs = docs.filter("doc_id % 9 = 0")
    got = {r.doc_id: (r.p_text, r.p_meta, r.quality) for r in quality.score(docs, model).collect()}
    for r in docs.collect():
        a = sum(model.text[i] * x for i, x in zip(*quality.text_view(r.text), strict=True)) * model.text_scale[0] + model.text_scale[1]
        b = sum(model.meta[i] * x for i, x in zip(*quality.meta_view(r.text, r.source, r.lang), strict=True)) * model.meta_scale[0] + model.meta_scale[1]
        assert np.allclose(got[r.doc_id], [1 / (1 + np.exp(-z)) for z in (a, b, (a + b) / 2)], atol=1e-9)


def test_samples_of_odd_rows(spark):
    """Clashing names, null and shared ids, ties, repeated rows and a very long text in what models learn from."""
    docs = [(i if i % 4 else 4, f"word{i % 7} in a text", "en", "s", 1, i % 2, "x") for i in range(60)] + [(None, "n", None, None, None, None, None), (70, "long " * 300_000, "en", "s", 1, 1, None), (71, None, None, None, None, 1, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, draw int, grade int, y string")
    model = toxicity.fit(df, settings=toxicity.Settings(rows=20))
    assert toxicity.score(df, model).count() == len(docs)
    labels = spark.createDataFrame([(i, i % 2, "a") for i in range(1, 30)] + [(4, 1, "b"), (None, 1, "c"), (70, 0, "d"), (71, 0, "e")], "doc_id bigint, quality int, text string")
    few = quality.Settings(rows=10)
    one, two = quality.fit(df, labels, settings=few), quality.fit(df.repartition(3), labels, settings=few)
    assert (one.text == two.text).all() and quality.score(df, one).count() == len(docs)


def shuffled(spark, run):
    """Bytes that the stages of run() write to shuffle files."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty()
        jvm = spark.sparkContext._jvm
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    before = stages()
    run()
    return sum(v for k, v in stages().items() if k not in before)


def test_texts_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Also where labels are too many to be broadcast: op5 and op6 join ids."""
    rng = np.random.default_rng(2)
    text = [" ".join(rng.integers(0, 1 << 40, 400).astype(str).tolist()) for _ in range(400)]
    docs = [(i, ("vile " if i % 5 == 0 else "kind ") + x, "en", "s") for i, x in enumerate(text)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0), int(i % 5 > 0)) for i in range(0, 400, 2)], "doc_id bigint, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    size = sum(len(d[1]) for d in docs)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        control = registry.table(spark, str(tmp_path), "documents").repartition(4, "doc_id")
        assert shuffled(spark, lambda: control.write.format("noop").mode("overwrite").save()) > 0.3 * size
        assert shuffled(spark, lambda: registry.op5_toxicity(spark, str(tmp_path)).collect()) < 0.05 * size
        monkeypatch.setattr(quality, "_sums", lambda *how: lambda batches: iter(()))  # the sums of so few rows would outweigh them
        assert shuffled(spark, lambda: registry.op6_quality_classifier(spark, str(tmp_path)).collect()) < 0.05 * size
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_toxicity_with_labels_apart(spark):
    """The sample is that of the join: null and shared ids, repeated rows and labels."""
    rows = [(i % 40 or None, f"word{i % 7} in a text {i % 50}") for i in range(160)] + [(5, None), (77, "no label")]
    labels = [(i, i % 2) for i in range(1, 38)] * 2 + [(4, 1), (None, 1), (5, None), (6, -1), (99, 1)]
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, grade int")
    for n in (30, 8000):
        s = toxicity.Settings(rows=n, seen=1)
        one, two = toxicity.fit(docs.join(labels, "doc_id"), settings=s), toxicity.fit(docs, settings=s, labels=labels)
        assert (one.weights == two.weights).all() and (one.thresholds == two.thresholds).all() and one.weights.any()
    assert not toxicity.fit(docs, labels=labels.limit(0)).weights.any()


def test_quality_exchanges_labelled_rows_beyond_the_sample(spark, monkeypatch):
    """Every row with a text is in the sample or in the pool."""
    pools = []
    monkeypatch.setattr(quality, "exchange", lambda pool, first, w, s: pools.append(pool.count()) or {})
    docs = spark.createDataFrame([(i if i < 390 else None, f"word{i % 7} in text {i}", "en", "s") for i in range(400)], "doc_id bigint, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id bigint, quality int")
    s, seen = quality.Settings(rows=40), []
    plain = quality.cotrain
    monkeypatch.setattr(quality, "cotrain", lambda text, *rest: seen.append(len(text)) or plain(text, *rest))
    quality.fit(docs, labels, settings=s)
    assert 0 < seen[0] <= 80 and pools == [400 - seen[0]]
