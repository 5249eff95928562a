"""Language ID and quality: held-out accuracy and odd rows."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from simloom.llm import language_id, quality

DATA = "/root/testdata/sf0.01"


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_language_id(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    odd = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "12 !?", "en", "s", 0), (-3, "", None, "s", 0), (None, "Les mots de la langue avec une", None, "s", 0)], docs.schema)
    net = language_id.fit(docs.unionByName(odd), per_language=80)
    found = language_id.identify(docs.unionByName(odd), net).collect()
    out = [r for r in found if r.doc_id is not None and r.doc_id >= 0 and r.held_out]
    assert all(r.held_out == held_out(r.doc_id) for r in found if r.doc_id is not None)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out]) >= 0.97
    rows = {r.doc_id: r for r in found if r.doc_id is None or r.doc_id < 0}
    assert [rows[k].lang_pred for k in (-1, -2, -3)] == ["und"] * 3 and rows[-1].score == 0
    assert all(0 <= r.score <= 1 for r in found)
    kept = language_id.keep_identified(odd, net)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [None]
    nothing = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(odd, nothing).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), net).count() == 0


def test_every_byte_is_seen():
    data, offsets = np.arange(1, 252, dtype=np.uint8).repeat(5), np.array([0, 3, 3, 1255])
    start, stop, text = language_id.cut(offsets)
    windows = language_id.cut_out(data, start, stop)
    assert set(text) == {0, 2} and set(windows[text == 2].ravel()) >= set(data[3:])
    assert (stop - start <= language_id.WINDOW).all() and (stop > start).all()


def plain_prediction(net, text):
    """The network by its definition: one window, filter and place after another."""
    data, size, step = text.encode(), language_id.WINDOW, language_id.WINDOW - max(language_id.WIDTHS) + 1
    total, at = np.zeros(len(net.languages)), 0
    while at < len(data) and (at == 0 or len(data) - at >= max(language_id.WIDTHS)):
        window = data[at : at + size]
        x = net.embedding[np.frombuffer(window.ljust(size), np.uint8)]
        pooled = [
            max(0.0, max(float((x[i : i + w].ravel() * bank[:, f]).sum()) for i in range(size - w + 1)) + float(bias[f]))
            for w, bank, bias in zip(language_id.WIDTHS, net.filters, net.biases)
            for f in range(language_id.FILTERS)
        ]
        z = np.array(pooled) @ net.weights + net.bias
        e = np.exp(z - z.max())
        total += e / e.sum() * len(window)
        at += step
    return net.languages[int(total.argmax())], total.max() / total.sum()


def test_language_id_against_its_definition(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    net = language_id.fit(docs, per_language=30)
    rows = [r for r in docs.collect() if r.text and 20 < len(r.text) < 900][:8]
    rows += rows[:2]  # repeated rows
    monkeypatch.setattr(language_id, "CUT", 3)
    for r, lang, score in zip(rows, *language_id.predict(net, pa.array([r.text for r in rows]))):
        theirs = plain_prediction(net, r.text)
        assert lang == theirs[0] and abs(score - theirs[1]) < 1e-4
    long = " ".join(r.text for r in rows) * 300
    lang, score = language_id.predict(net, pa.array([long]))
    assert lang[0] in net.languages and 0 <= score[0] <= 1


def test_language_id_odd_rows(spark):
    """Repeated ids, clashing names, one language only, none at all."""
    rows = [(i % 5, f"one text of many number {i % 7}", "en", i) for i in range(300)] + [(9, "12 !?", "en", 0), (10, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lot long")
    windows, labels, languages = language_id.sample_windows(docs, "doc_id", "text", "lang", 20, 5)
    assert languages == ["en"] and 0 < len(labels) <= 2 * 20 * 5
    kept = language_id.keep_identified(docs, language_id.fit(docs, per_language=20))
    assert kept.count() == 300 and kept.columns == docs.columns
    nothing = language_id.fit(docs.where("lang IS NULL"))
    assert language_id.keep_identified(docs, nothing).count() == 300


def test_gradients():
    r = np.random.default_rng(0)
    net = language_id.Network.fresh(["a", "b"])
    for p in net.parameters():
        p += 0.05 * r.standard_normal(p.shape).astype(np.float32)
    windows, labels = r.integers(0, 256, (8, language_id.WINDOW)).astype(np.uint8), np.arange(8) % 2
    loss = lambda: -np.log(net.probabilities(windows)[np.arange(8), labels]).mean()
    for p, g in zip(net.parameters(), net.gradients(windows, labels)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        before = p[at]
        p[at] = before + 1e-2
        up = loss()
        p[at] = before - 1e-2
        down = loss()
        p[at] = before
        assert abs((up - down) / 2e-2 - g[at]) < 0.1 * abs(g[at]) + 1e-3


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(None, None, "en", "s", 0), (-2, "", "en", "s", 0)], docs.schema)
    model = quality.fit(docs, labels)
    found = quality.score(docs.unionByName(odd), model).collect()
    assert len(found) == docs.count() + 2 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    out = [(r.score, truth[r.doc_id]) for r in found if r.doc_id in truth and r.held_out]
    good, bad = [s for s, q in out if q == 1], [s for s, q in out if q == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc >= 0.9
    flat = quality.fit(docs, labels.where("quality = 1"))
    assert len({r.score for r in quality.score(docs, flat).collect()}) == 1
    assert quality.score(docs.limit(0), model).count() == 0


def test_quality_odd_rows_and_lookups(spark):
    """Scores are sums of table entries; repeated ids are learned from once."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    more = docs.limit(3)
    clash = docs.unionByName(more).unionByName(more).withColumn("label", F.lit(9)).withColumn("features", F.lit("x"))
    model = quality.fit(clash, labels)
    again = quality.fit(docs, labels)
    assert model.base == again.base and all((a == b).all() for a, b in zip(model.tables, again.tables))
    found = {r.doc_id: r for r in quality.score(clash, model).collect()}
    for r in docs.limit(40).collect():
        x = quality.text_features(pa.array([r.text], pa.string()))[0]
        bins = [int((c <= v).sum()) for c, v in zip(model.edges, x)]
        total = model.base + sum(float(t[b]) for t, b in zip(model.tables, bins))
        total += sum(float(t[model.coarse[i][bins[i]], model.coarse[j][bins[j]]]) for (i, j), t in zip(model.pairs, model.pair_tables))
        assert abs(found[r.doc_id].score - 1 / (1 + np.exp(-total))) < 1e-9
    text = "Ünd one " * 200_000
    assert quality.score(docs.limit(1).withColumn("text", F.lit(text)), model).count() == 1


def test_additive_model_learns_an_interaction():
    r = np.random.default_rng(2)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_model(x, y)
    assert (1, 0) in model.pairs and ((model.scores(x) > 0.5) == y).mean() > 0.97


def test_features_are_those_of_the_text_alone():
    texts = ["One two. Three!\nFOUR four", "", None, "x" * 5000, "a a a a"]
    together = quality.text_features(pa.array(texts))
    apart = np.concatenate([quality.text_features(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, apart) and not together[1:3].any()
