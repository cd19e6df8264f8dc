import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as C
from weftline.llm import simhash as S
from weftline.llm.common import join_lookup, stored
from weftline.llm.graph import components


def plain(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(prints):
    """Smallest id reachable, from (id, unsigned fingerprint)."""
    ids = [i for i, _ in prints]
    group = {n: n for n in range(len(prints))}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for x in range(len(prints)):
        for y in range(x):
            if (prints[x][1] ^ prints[y][1]).bit_count() <= 3:
                a, b = root(x), root(y)
                group[max(a, b)] = min(a, b)
    least = {}
    for n in range(len(prints)):
        if ids[n] is not None:
            least[root(n)] = min(ids[n], least.get(root(n), ids[n]))
    return sorted(((ids[n], least.get(root(n))) for n in range(len(prints))), key=str)


def test_fingerprints(monkeypatch):
    rnd = random.Random(1)
    texts = [None, "", " \n\t", "one", "One Two", "É A b\x0bC d e", "a b c"] + [" ".join(rnd.choice(["a", "B", "çé", "dd"]) for _ in range(rnd.randrange(60))) for _ in range(50)]
    for chunk in (1 << 20, 7):
        monkeypatch.setattr(S, "_CHUNK", chunk)
        for t in texts:
            assert S.fingerprint(t) & (2**64 - 1) == plain(t)


@pytest.mark.parametrize("hot", [512, 1])
def test_groups_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "BLOCK", 5)
    rnd = random.Random(2)
    base = [" ".join(rnd.choice("alpha beta gamma delta eps zeta".split()) + str(rnd.randrange(9)) for _ in range(200)) for _ in range(12)]
    rows, i = [], 0
    for t in base:
        for _ in range(6):
            words = t.split()
            for _ in range(rnd.randrange(4)):
                words[rnd.randrange(len(words))] = "x" + str(rnd.randrange(99))
            rows.append((i, " ".join(words)))
            i += 1
    rows += [(1000, None), (999, ""), (None, base[0]), (None, "only here"), (7, base[3]), (7, base[3]), (5000, "A B C"), (5001, "a b c")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("clash")).withColumn("extra", F.lit(1))
    got = S.near_duplicate_groups(df).collect()
    want = brute([(i, plain(t)) for i, t in rows])
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == want
    kept = S.keep_one_of_each_group(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c in want if c is not None})
    assert ids.count(None) == 1


def test_pairs_of_close_fingerprints(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**62), 2**62, 40)
    values = {int(x) for x in base}
    for x in base:
        for d in (1, 2, 3, 4):
            y = int(x)
            for b in rng.choice(64, d, replace=False):
                y ^= int(np.array([1 << int(b)], np.uint64).view(np.int64)[0])
            values.add(y)
    got = {frozenset((r.a, r.b)) for r in S.near_pairs(spark.createDataFrame([(v,) for v in values], "fingerprint long")).collect()}
    want = {frozenset((a, b)) for a in values for b in values if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (100, 100), (200, None), (300, 301), (301, 302), (302, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 300: 300, 301: 300, 302: 300}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert S.near_duplicate_groups(df).count() == 0
    assert S.keep_one_of_each_group(df).count() == 0


def test_similar_texts_are_one_group(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(40):
        base = rnd.choices(words, k=rnd.randrange(6, 300))
        texts.append(" ".join(base))
        for n in (1, 2, 4, 8, 12):
            changed = base[:]
            for at in rnd.sample(range(len(base)), min(n, len(base))):
                changed[at] = rnd.choice(words)
            texts.append(" ".join(changed))
    rows = [*enumerate(texts), (1000, None), (1001, ""), (1002, "one two"), (1003, "One  TWO"), (1004, "one three")]

    def shingles(text):
        found = (text or "").lower().split()
        return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()

    sets, prints, group = {i: shingles(t) for i, t in rows}, {i: S.fingerprint(t) for i, t in rows}, {i: i for i, _ in rows}
    beyond = 0
    for i in sets:
        for j in (j for j in sets if j < i):
            far = ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() > 3
            alike = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and sets[i]
            beyond += bool(alike and far)
            if alike or not far:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if g == old else g for k, g in group.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.near_duplicate_groups(df, similarity=0.8).collect()}
    assert beyond > 50 and got == group
    assert C.near_dedup(spark, df, "").count() == len(set(group.values()))
    assert S.keep_one_of_each_group(df).count() > len(set(group.values()))


def test_a_set_is_compared_once_however_often_it_is_stored(spark):
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(999)}" for _ in range(120)]
    near = " ".join([*base[:60], "other", *base[61:]])
    rows = [(None, " ".join(base))] * 2000 + [(7, near)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    of = F.struct(F.lit(None).cast("long").alias("id"), F.md5(F.lit(" ".join(base))).alias("t"))
    hanging = spark.range(1).select(F.lit(1).cast("long").alias("x"), F.lit(5).cast("long").alias("fp"), of.alias("of"))
    other = F.struct(F.lit(7).cast("long").alias("id"), F.md5(F.lit(near)).alias("t"))
    hanging = hanging.union(spark.range(1).select(F.lit(2).cast("long"), F.lit(6).cast("long"), other))
    sets = S._asked_sets(df, hanging, "text", "doc_id", 5).collect()
    assert sorted((r.x, r.fp, len(r.h) // 8) for r in sets) == [(1, 5, 116), (2, 6, 116)]
    assert {r.component_id for r in S.near_duplicate_groups(df, similarity=0.8).collect()} == {7}


def test_a_lookup_beyond_its_limit_stays_off_the_driver(spark):
    rows = spark.range(200).select((F.col("id") % 40).alias("k"), "id")
    lookup = stored(spark.range(0, 40, 3).select(F.col("id").alias("k"), F.lit(True).alias("found")))
    got = join_lookup(rows, lookup, "k", limit=10)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r.found) for r in got.collect()} == {(i, True if i % 40 % 3 == 0 else None) for i in range(200)} and got.count() == 200
