import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from weftline.llm import toxicity as T
from weftline.llm.language import held_out


def documents(n=1500, seed=10):
    """Toxic: an insult where a group is named; either alone is not."""
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice("alfa bravo coda delta eko fox golf hotel".split()) + rnd.choice(["", "s", "ly"]) for _ in range(rnd.randrange(5, 40))]
        insult, group = rnd.random() < 0.5, rnd.random() < 0.5
        words += ["MORON"] * insult + ["martians"] * group
        rnd.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(insult and group)))
    return rows, labels


def test_pairs_are_learned_and_held_out(spark):
    rows, labels = documents()
    rows += [(10_000, None), (10_001, ""), (10_002, "x " * 30_000), (None, "moron martians"), (3, rows[3][1]), (3, rows[3][1])]
    labels += [(10_000, None), (None, 1), (50_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("SCORE", F.lit("clash")).withColumn("held", held_out("doc_id", 4, 2))
    marked = spark.createDataFrame(labels, "doc_id long, toxic int").where(~held_out("doc_id", 4, 2))
    model = T.fit_toxicity(df, marked)
    out = T.score_toxicity(df, model)
    assert out.columns == ["doc_id", "text", "held", "score"]
    got = out.collect()
    want = dict(labels)
    right = [(r.score >= 0.3) == bool(want[r.doc_id]) for r in got if r.held and r.doc_id in want and want[r.doc_id] is not None]
    assert len(right) > 300 and np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and all(r.held == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    empty = {r.score for r in got if not r.text}
    assert len(empty) == 1 and empty.pop() < 0.3
    again = T.score_toxicity(df.repartition(5), T.fit_toxicity(df.repartition(3), marked.repartition(2))).collect()
    assert sorted((str(r.doc_id), r.score) for r in got) == sorted((str(r.doc_id), r.score) for r in again)
    # The pair's product, not the weights, tells the toxic ones.
    solo = [T.raw_score(model, T.terms(t)) for t in ("moron", "martians", "moron martians")]
    assert solo[2] > max(solo[:2])


def test_score_equals_brute_force():
    rng = np.random.default_rng(2)
    place = np.full(T.BUCKETS, -1, np.int32)
    buckets = T.terms("one two three four")
    place[buckets[1:]] = np.arange(len(buckets) - 1)
    model = T.ToxicityModel(0.5, rng.random(len(buckets) - 1).astype(np.float32), rng.random((len(buckets) - 1, 3)).astype(np.float32), place)
    n = len(buckets) - 1
    pairs = sum(float(model.vectors[i].astype(float) @ model.vectors[j].astype(float)) for i in range(n) for j in range(i))
    assert T.raw_score(model, buckets) == pytest.approx(0.5 + model.weights.astype(float).sum() + pairs / n)


def test_terms_do_not_depend_on_chunks(monkeypatch):
    text = "Été moron x_y " * 50
    whole = T.terms(text).tolist()
    monkeypatch.setattr(T, "_CHUNK", 7)
    assert T.terms(text).tolist() == whole and T.terms("").tolist() == []


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.fit_toxicity(df, labels) is None
    assert T.score_toxicity(df, None).count() == 0
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert [r.score for r in T.score_toxicity(one, T.fit_toxicity(one, labels)).collect()] == [0.0]
    assert T.fit_toxicity(one, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")) is not None


def test_pairs_decide_where_single_terms_cannot():
    rnd = random.Random(4)
    texts, labels = [], []
    for _ in range(3000):
        words = rnd.sample("alfa bravo coda delta eko fox golf hotel india jul".split(), 5)
        one, other = rnd.random() < 0.5, rnd.random() < 0.5
        words += ["moron"] * one + ["martians"] * other
        texts.append(T.terms(" ".join(words)))
        labels.append(float(one != other))
    labels = np.array(labels)
    model = T.train(texts[:2000], labels[:2000])
    flat = T.ToxicityModel(model.bias, model.weights, np.zeros_like(model.vectors), model.place)
    right = [np.mean([(T.raw_score(m, t) >= 0) == (y > 0.5) for t, y in zip(texts[2000:], labels[2000:])]) for m in (model, flat)]
    assert right[0] > 0.97 and right[1] < 0.85


def test_rows_of_one_key_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(T, "SAMPLE", 20)
    df = spark.createDataFrame([(1, f"moron {i % 40}") for i in range(400)] + [(2, "nice")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(T, "_eligible", lambda sample: seen.append(sample.count()) or np.arange(T.BUCKETS))
    assert T.fit_toxicity(df, labels) is not None and seen == [20]
