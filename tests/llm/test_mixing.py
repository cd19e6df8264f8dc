import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from weftline.llm import mixing as M


def fill(sizes, weights, total, cap):
    """Targets by sharing out the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    most = {s: cap * sizes[s] for s in names}
    full, budget = set(), total * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        left = budget - sum(most[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        new = {s for s in rest if share[s] > most[s]}
        if not new:
            return {**{s: most[s] for s in full}, **share}
        full |= new


def documents(seed, n=400):
    rnd = random.Random(seed)
    rows = [(i, " ".join("w" * (1 + i % 3) for _ in range(int(rnd.paretovariate(0.9) * 5) % 3000)), rnd.choice(["a", "a", "a", "b", "é", "Z", None])) for i in range(n)]
    return rows + [(n, None, "b"), (n + 1, " \t\x0b", "empty only"), (None, "one two", "b"), (5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2])]


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("Target", F.lit("clash"))
    sized = df.withColumn("size", M.word_count("text"))
    return df, M.mix_sources(sized)


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rows = documents(seed)
    df, mixed = run(spark, rows)
    assert mixed.columns == ["doc_id", "text", "source", "size", "source_size", "target", "copies", "taken"]
    got = mixed.toPandas()
    assert len(got) == len(rows)
    sizes = got.groupby("source", dropna=False)["size"].sum()
    want = fill({None if pd.isna(k) else k: int(v) for k, v in sizes.items()}, (3, 1, 2), 1.5, 2)
    for name, part in got.groupby("source", dropna=False):
        name = None if pd.isna(name) else name
        assert part["target"].iat[0] == pytest.approx(want[name])
        assert abs(part["taken"].sum() - want[name]) <= max(2, 0.02 * want[name]), name
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] == got["copies"] * got["size"]).all()
    again = M.mix_sources(df.repartition(7).withColumn("size", M.word_count("text"))).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    copies = M.repeat_copies(mixed, df.drop("Target").columns)
    assert copies.count() == got["copies"].sum() and copies.columns == ["doc_id", "text", "source"]


def test_equals_sql(spark, monkeypatch):
    rows = documents(3)
    _, mixed = run(spark, rows)
    documents_ = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", documents_)
    want = con.sql(M.MIX_SQL).fetchall()
    got = mixed.select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    monkeypatch.setattr(M, "BUCKETS", 1)
    assert sorted(map(str, map(tuple, run(spark, rows)[1].select("doc_id", "size", "source_size", "target", "taken").collect()))) == sorted(map(str, want))


def test_many_sources_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr("weftline.llm.common.BROADCAST_ROWS", 1)
    monkeypatch.setattr(M, "join_lookup", lambda a, b, on: __import__("weftline.llm.common", fromlist=["x"]).join_lookup(a, b, on, limit=1, salts=3))
    rows = documents(4, 100)
    got = run(spark, rows)[1].collect()
    assert len(got) == len(rows) and all(r.target is not None for r in got)


def test_unequal_probabilities(spark):
    rows = [(i, "w " * (4 if i % 2 else 250), "a") for i in range(3000)]
    got = run(spark, rows)[1].where("size in (4, 250)").groupBy("size").agg(F.avg("copies").alias("c")).collect()
    mean = {r.size if not callable(r.size) else r["size"]: r.c for r in got}
    assert mean[250] == pytest.approx(1.5, abs=0.1) and mean[4] < 0.75


def test_empty(spark):
    assert run(spark, [])[1].count() == 0
    assert [r.taken for r in run(spark, [(1, None, None), (2, "", "a")])[1].collect()] == [0, 0]


@pytest.mark.parametrize("rows", [
    [(7, "w " * 10, "a")] * 1000, [(None, "w " * (10, 11, 12)[i % 3], "a") for i in range(1000)],
    [(None, "w " * 10, None)] * 500 + [(i, "w " * 30, "b") for i in range(200)],
])
def test_repeated_rows_come_near_the_target(spark, rows):
    for parts in (3,):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        got = M.mix_sources(df.withColumn("size", M.word_count("text"))).toPandas()
        for _, part in got.groupby("source", dropna=False):
            assert abs(part["taken"].sum() - part["target"].iat[0]) <= 0.01 * part["target"].iat[0]
        con = duckdb.connect()
        con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
        want = con.sql(M.MIX_SQL).df()
        assert sorted(zip(got["size"], got["taken"])) == sorted(zip(want["size"], want["taken"]))
