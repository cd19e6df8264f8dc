import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import katz
from weftline.llm.katz import Discounts, score_texts
from weftline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


class Plain:
    """The model by dictionaries, from its definition."""

    def __init__(self, texts):
        self.one, self.two, self.after = Counter(), Counter(), defaultdict(set)
        for t in texts:
            tokens = [("start",), *words(t), ("end",)]
            self.one.update(tokens[1:])
            for u, w in zip(tokens, tokens[1:]):
                self.two[u, w] += 1
                self.after[u].add(w)
        self.d1, self.d2 = (Discounts.of(Counter(c.values())) for c in (self.one, self.two))
        self.n = sum(self.one.values())
        known = np.array(sorted(self.one.values()))
        self.unknown = 1 - math.fsum(self.d1.times(known)) / max(self.n, 1)
        self.history = Counter()
        for (u, _), c in self.two.items():
            self.history[u] += c

    def unigram(self, w):
        return float(self.d1.times(np.array([self.one[w]]))[0]) / self.n if self.one[w] else self.unknown

    def weight(self, u):
        seen = self.after[u]
        return (1 - sum(self.bigram(u, w) for w in seen)) / (1 - sum(self.unigram(w) for w in seen))

    def bigram(self, u, w):
        if self.two[u, w]:
            return float(self.d2.times(np.array([self.two[u, w]]))[0]) / self.history[u]
        return self.weight(u) * self.unigram(w) if self.history[u] else self.unigram(w)

    def score(self, text):
        tokens = [("start",), *words(text), ("end",)]
        return sum(math.log10(self.bigram(u, w)) for u, w in zip(tokens, tokens[1:]))

    def base(self, text):
        tokens = [*words(text), ("end",)]
        below = self.n + 0.5 * (len(self.one) + 1)
        return sum(math.log10((self.one[w] + 0.5) / below) for w in tokens), sum(self.one[w] > 0 for w in tokens), len(tokens)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def made(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["The", "É", "$", "^", "start", "end"]
    return ["\n ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=rng.randint(0, 40))) for _ in range(n)]


EDGES = [None, "", " \t\n", "never seen at all", "The the THE", "start end", "x" * 5000, " ".join(["w1 w2"] * 800)]


def hold(got, texts, trains):
    model = Plain([t for t, own in zip(texts, trains) if own])
    assert len(got) == len(texts)
    for r in got:
        base, known, n = model.base(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens, r.trains) == (n, known, model.n, trains[r.doc_id])
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(model.score(texts[r.doc_id]), rel=1e-8, abs=1e-12)


@pytest.mark.parametrize("size", [1 << 30, 300])  # one block, and many
def test_scores_by_definition(spark, monkeypatch, size):
    monkeypatch.setattr(katz, "BLOCK_BYTES", size)
    texts = [*EDGES, *made(1, 150)]
    texts += texts[20:25] * 4
    trains = [i % 3 != 1 for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, own, "x") for i, (t, own) in enumerate(zip(texts, trains))], "doc_id long, text string, own boolean, trains string")
    hold(score_texts(df.repartition(4), F.col("own")).collect(), texts, trains)


def test_probabilities_sum_to_one():
    model = Plain(made(2, 200))
    unknown = model.unigram("never")
    assert unknown > 0 and sum(map(model.unigram, model.one)) + unknown == pytest.approx(1)
    for u in [("start",), "^", "w0", "w7", "w59", "É"]:
        assert model.weight(u) > 0
        assert sum(model.bigram(u, w) for w in model.one) + model.bigram(u, "never") == pytest.approx(1)


def test_every_count_is_discounted():
    for n in ({}, {1: 5}, {1: 100, 2: 90, 3: 1}, {1: 1000, 2: 300, 3: 120, 4: 80, 5: 50, 6: 40, 7: 33}, {7: 3}, {1: 3, 2: 50, 3: 900}):
        d = Discounts.of(n)
        r = np.arange(1, 10**4)
        assert (d.times(r) < r).all() and (d.times(r) > 0).all() and d.times(np.array([0]))[0] == 0


def test_nothing_to_learn_from_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    got = score_texts(df, F.lit(False)).collect()
    assert len(got) == 3 and all(r.n_known == 0 and r.train_tokens == 0 and r.score == pytest.approx(0) for r in got)
    assert score_texts(df.limit(0), F.lit(True)).collect() == []
    assert score_texts(df, F.lit(None).cast("boolean")).where("trains").count() == 3


def test_op13_over_the_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: r.text for r in rows}
    got = QUERIES["op13_katz"](spark, SF).withColumn("trains", ~F.col("held_out")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in got)
    model = Plain([t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1])
    known = {}
    unigram, weight = model.unigram, model.weight
    model.unigram = lambda w: known[w] if w in known else known.setdefault(w, unigram(w))
    weights = {}
    model.weight = lambda u: weights[u] if u in weights else weights.setdefault(u, weight(u))
    assert len(got) == len(texts)
    for r in got:
        base, n_known, n = model.base(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, n_known, model.n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(model.score(texts[r.doc_id]), rel=1e-8)
    held = [(r.score, r.base_score) for r in got if r.held_out]
    assert sum(s for s, _ in held) > sum(b for _, b in held)
