import math
import random
import re

import pytest
from pyspark.sql import functions as F
from weftline.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    seen, windows = {}, [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def documents():
    rnd = random.Random(7)
    rows = []
    for i in range(60):
        words = [rnd.choice("le la un été 😀 #a b|c <d>".split()) for _ in range(rnd.randrange(60))]
        if words and i % 3 == 0:
            words += words[: rnd.randrange(len(words) + 1)] * rnd.randrange(4)
        rows.append((i, "".join(w + rnd.choice([" ", "\n", "\t", " \n ", "\x0b"]) for w in words)))
    return rows + [(100, None), (101, ""), (102, "\n\n \n"), (103, "a " * 30), (104, "x " * 20_000), (None, "a b c"), (5, rows[5][1]), (5, rows[5][1]), (105, "a b\x1cc d")]


def test_rules_equal_brute_force(spark):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("N_Words", F.lit("clash")).withColumn("other", F.lit(1))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1)], "doc_id long, quality int")
    out = Q.quality_rules(df, labels)
    assert out.columns[:3] == ["doc_id", "text", "other"]
    got = sorted(((r.doc_id, r.text, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect()), key=str)
    assert got == sorted(((i, t, *plain(t)) for i, t in rows), key=str)
    assert not [r for r in out.collect() if r.base_failed and r.kept]


def test_score_equals_brute_force(spark):
    rows = [(i, t) for i, t in documents() if i is not None and i < 60]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(60)], "doc_id long, quality int")
    words = {w for _, t in rows for w in WORD.findall(t)}
    h = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").withColumn("h", F.xxhash64("w")).collect()}

    def grams(t):
        hs = [h[w] for w in WORD.findall(t)]
        return [x & (Q.BUCKETS - 1) for x in hs] + [((a ^ ((b & (2**64 - 1)) >> 7)) & (Q.BUCKETS - 1)) + Q.BUCKETS for a, b in zip(hs, hs[1:])]

    counts = {}
    for i, t in rows:
        for g in grams(t):
            c = counts.setdefault(g, [0, 0])
            c[0] += i < 20
            c[1] += 1
    sums = [[sum(c[k] for g, c in counts.items() if (g >= Q.BUCKETS) == half) for k in (0, 1)] for half in (0, 1)]
    scale = [s[1] / s[0] for s in sums]
    ratio = {g: round(math.log((c[0] * scale[g >= Q.BUCKETS] + 1) / (c[1] + 1)) * Q.UNIT) for g, c in counts.items()}
    for r in Q.quality_rules(df, labels, threshold=-1000).collect():
        g = grams(r.text)
        if not g:
            assert r.score is None
            continue
        total = sum(ratio[x] for x in g)
        assert r.score == pytest.approx(total / len(g) / Q.UNIT, abs=1e-6)
        assert r.base_failed or abs(total + 1000 * len(g)) <= len(g) or r.kept == (total >= -1000 * len(g))


def test_clean_stays_and_symbols_go(spark):
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randrange(2, 9))) for _ in range(40)]
    rows = [(i, " ".join((w + "###" if i >= 250 else w) for w in rnd.choices(vocabulary, k=120))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in Q.quality_rules(df, labels).collect()}
    assert all(got[i] for i in range(250)) and not any(got[i] for i in range(250, 300))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.quality_rules(df, labels).count() == 0
    assert [r.kept for r in Q.quality_rules(spark.createDataFrame([(1, "a b " * 3)], "doc_id long, text string"), labels).collect()] == [False]
