import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from weftline.llm import language as L

ALPHABETS = {"aa": "abcde ", "bb": "fghij ", "éé": "éèçàù "}


def documents(n=150):
    rnd = random.Random(9)
    return [(i, "".join(rnd.choice(ALPHABETS[g]) for _ in range(rnd.randrange(20, 400))), g) for i in range(n) for g in [rnd.choice(list(ALPHABETS))]]


def plain_counts(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    words = " " + " ".join(letters.split(" ")).strip()
    while "  " in words:
        words = words.replace("  ", " ")
    words = words if not letters or letters[-1] != " " and words[-1] == " " else words
    words = words.rstrip(" ") + " "
    return Counter(words[i : i + n] for n in (1, 2, 3) for i in range(len(words) - n + 1))


def test_counts_cover_every_gram(monkeypatch):
    for text in ("Hello  wörld 42", "a", "x" * 50, "Ünder-Score_ß"):
        total, letters = L.counts(text)
        assert total.sum() == sum(plain_counts(text).values()) and letters == sum(c.isalpha() for c in text)
    assert L.counts("")[1] == 0 and L.counts("")[0].sum() == 0
    whole, _ = L.counts("abc def " * 100)
    monkeypatch.setattr(L, "_CHUNK", 8)
    parts, n = L.counts("abc def " * 100)
    assert n == 600 and np.count_nonzero(parts) <= np.count_nonzero(whole) + 20


def test_held_out_accuracy(spark):
    rows = documents() + [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !?", "aa"), (1003, "abc" * 40_000, None), (None, "fghij", "bb"), (7, "fgh ij", "bb"), (7, "fgh ij", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("Score", F.lit("clash"))
    df = df.withColumn("held", L.held_out("doc_id", 5, 0))
    model = L.fit_languages(df.where("not held"))
    assert model.languages == ["aa", "bb", "éé"] and len(model.centroids) <= 3 * L.CENTROIDS
    out = L.predict_languages(df.drop("lang"), model)
    assert out.columns == ["doc_id", "text", "held", "lang_pred", "score", "rejected"]
    got = out.collect()
    want = {i: g for i, _, g in documents()}
    for r in got:
        assert r.held == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        if r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        elif r.doc_id in want and r.doc_id != 7:
            assert r.lang_pred == want[r.doc_id] and not r.rejected
    again = L.predict_languages(df.repartition(7), L.fit_languages(df.where("not held").repartition(3))).collect()
    assert sorted((str(r.doc_id), r.lang_pred, r.score) for r in got) == sorted((str(r.doc_id), r.lang_pred, r.score) for r in again)


def test_prediction_is_nearest_centroid():
    rng = np.random.default_rng(1)
    centroids = L._unit(rng.random((6, L.DIMENSIONS)).astype(np.float32))
    model = L.LanguageModel(["x", "y"], np.ones(L.DIMENSIONS, np.float32), centroids, np.array([0, 0, 0, 1, 1, 1]), np.zeros(24))
    for text in ("hello there", "été", "zzz"):
        tf, _ = L.counts(text)
        v = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0)
        cos = [float(v @ c / np.linalg.norm(v)) for c in centroids]
        pred, score, _ = L.identify(model, [text])[0]
        assert pred == "xy"[int(np.argmax(cos)) // 3] and abs(score - max(cos)) < 1e-4


def test_far_texts_are_rejected(spark):
    df = spark.createDataFrame(documents(), "doc_id long, text string, lang string")
    model = L.fit_languages(df)
    assert L.identify(model, ["漢字仮名交じり文を書く" * 20])[0][2] and not L.identify(model, ["abcde cab " * 20])[0][2]


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE", 10)
    df = spark.createDataFrame(documents(), "doc_id long, text string, lang string")
    assert all(r["count"] <= 10 for r in L._sampled(df, "doc_id", "lang").groupBy("__lang").count().collect())


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = L.fit_languages(df)
    assert L.predict_languages(df, model).count() == 0
    assert L.identify(model, ["abc"]) == [("und", 0.0, True)]


def test_counts_do_not_depend_on_chunks(monkeypatch):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abΣé  .1İ") for _ in range(rnd.randrange(70))) for _ in range(100)]
    whole = [L.counts(t) for t in texts]
    for chunk in (1, 2, 8):
        monkeypatch.setattr(L, "_CHUNK", chunk)
        for t, (total, letters) in zip(texts, whole):
            part, n = L.counts(t)
            assert n == letters and (part == total).all()


def test_repeated_keys_do_not_widen_the_sample(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE", 10)
    rows = [(7, "abc " * (1 + i % 50), "aa") for i in range(500)] + [(8, "fgh", "bb")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit_languages(df)
    assert model.languages == ["aa", "bb"]
    assert {r.lang_pred for r in L.predict_languages(df, model).where("doc_id = 8").collect()} == {"bb"}


def test_no_language_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(L, "LANGUAGES", 2)
    df = spark.createDataFrame([(i, f"text of {k} number {i}", k) for i, k in enumerate("abc" * 5)], "doc_id long, text string, lang string")
    assert len(L.fit_languages(df.where("lang <> 'c'")).languages) == 2
    with pytest.raises(ValueError, match="3 languages"):
        L.fit_languages(df)
