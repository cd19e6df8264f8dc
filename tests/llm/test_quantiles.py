import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm.queries import QUERIES
from weftline.llm.quantiles import FINE, LEAST, PIECES, add, fit, invert, merge_parts, money_rows, quantile_report

SF = "/root/testdata/sf0.001"


def curve_of(values):
    x, n = np.unique(np.asarray(values, np.int64), return_counts=True)
    high = np.cumsum(n).astype(float)
    return x, high - n, high


def heights(curve, at):
    """The curve just below and at a place, by its definition."""
    x, low, high = curve
    for i, place in enumerate(x):
        if at == place:
            return low[i], high[i]
        if at < place:
            if i == 0:
                return 0, 0
            inside = high[i - 1] + (low[i] - high[i - 1]) * (at - x[i - 1]) / (place - x[i - 1])
            return inside, inside
    return high[-1], high[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-50, 300), min_size=1, max_size=400), st.floats(0, 40))
def test_fit_stays_within_the_error(values, error):
    whole = curve_of(values)
    got = fit(whole, error)
    assert len(got[0]) >= min(LEAST, len(whole[0])) and set(got[0]) <= set(whole[0])
    assert got[0][0] == whole[0][0] and got[0][-1] == whole[0][-1] and got[2][-1] == len(values)
    for x, low, high in zip(*whole):
        below, upto = heights(got, x)
        assert abs(below - low) <= error + 1e-6 and abs(upto - high) <= error + 1e-6


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 99), min_size=1, max_size=60), min_size=1, max_size=6))
def test_sum_of_exact_curves_is_the_curve_of_all_rows(parts):
    total, whole = add([curve_of(p) for p in parts]), curve_of(sum(parts, []))
    for a, b in zip(total, whole):
        assert np.allclose(a, b)


def test_points_are_bounded():
    rng = np.random.default_rng(1)
    for values in (rng.integers(0, 10**6, 20000), rng.zipf(1.3, 20000) % 10**6, np.arange(20000), np.repeat(np.arange(700), 30)):
        assert len(fit(curve_of(values), len(values) / PIECES)[0]) <= 2 * PIECES + 2


def test_invert_gives_exact_ranks_of_an_exact_curve():
    values = sorted([3, 3, 3, 8, 9, 9, 40])
    assert invert(curve_of(values), np.arange(1, 8)).tolist() == values


def brute(rows, parts, least):
    """Exact ranks by sorting."""
    groups = defaultdict(list)
    for stream, grp, batch, x in rows:
        groups[stream, grp, batch].append(x)
        groups[stream, grp, -1].append(x)
    found = {}
    for key, xs in groups.items():
        xs.sort()
        if len(xs) >= least:
            for i in range(1, parts):
                t = -(-i * len(xs) // parts)
                found[*key, i] = (len(xs), t, xs[t - 1], xs)
    return found


def check(got, wanted, bound=0.02):
    assert {(r.stream, r.grp, r.batch, r.i) for r in got} == set(wanted)
    last = {}
    for r in sorted(got, key=lambda r: (r.stream, r.grp, r.batch, r.i)):
        n, t, x, xs = wanted[r.stream, r.grp, r.batch, r.i]
        below, upto = int(np.searchsorted(xs, r.answer, "left")), int(np.searchsorted(xs, r.answer, "right"))
        assert (r.n, r.target, r.exact_x, r.n_below, r.n_upto) == (n, t, x, below, upto)
        assert r.rank_error == max(0, below + 1 - t, t - upto) and r.rank_error <= max(1, bound * n)
        assert min(LEAST, len(set(xs))) <= r.points <= min(n, 400) and xs[0] <= r.answer <= xs[-1]
        assert r.answer >= last.get((r.stream, r.grp, r.batch), r.answer)
        last[r.stream, r.grp, r.batch] = r.answer


def test_skewed_keys_over_many_partitions(spark):
    rng = np.random.default_rng(7)
    rows = [("s", "hot", int(b), int(x)) for b, x in zip(rng.integers(0, 4, 30000), rng.lognormal(6, 2, 30000))]
    rows += [("s", f"g{i % 50}", i % 3, int(x)) for i, x in enumerate(rng.integers(0, 40, 3000))] + [("t", "one", 0, 5)] * 500
    df = spark.createDataFrame(rows, "stream string, grp string, batch int, x long")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 90)  # more parts of a key than are merged at a time
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = quantile_report(df).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    check(got, brute(rows, 10, 20))


def test_merging_in_levels(spark):
    rng = np.random.default_rng(3)
    parts = [np.sort(rng.integers(0, 10**5, 300)) for _ in range(130)]
    rows = [("s", "g", 0, p, 300, *[a.tolist() for a in curve_of(v)]) for p, v in enumerate(parts)]
    df = spark.createDataFrame(rows, "stream string, grp string, batch int, part int, n long, x array<long>, low array<double>, high array<double>")
    left = merge_parts(df).collect()
    assert 1 < len(left) <= 3 and sum(r.n for r in left) == 130 * 300
    total, xs = add([tuple(map(np.array, (r.x, r.low, r.high))) for r in left]), np.sort(np.concatenate(parts))
    for t in range(1000, 39000, 1000):
        a = invert(total, np.array([t]))[0]
        assert abs(np.searchsorted(xs, a, "right") - t) <= 3 * len(xs) / FINE + 3


def test_edges(spark):
    schema = "stream string, grp string, id long, money double, extra string"
    rows = [("s", None, 1, 1.0, ""), ("s", "a", 2, None, ""), ("s", "a", 2, float("nan"), ""), ("s", "a", 2, float("inf"), ""), ("s", "a", None, 1.005, ""), ("s", "a", 7, -2.0, "")]
    got = money_rows(spark.createDataFrame(rows, schema), 8).collect()
    b = zlib.crc32(b"7") % 8
    assert sorted(map(tuple, got)) == sorted([("s", "a", 0, int(np.floor(100 * 1.005 + 0.5))), ("s", "a", b, -200 + 1000 * b)])
    assert quantile_report(money_rows(spark.createDataFrame([], schema), 8)).collect() == []
    assert quantile_report(money_rows(spark.createDataFrame(rows, schema), 8)).collect() == []


@pytest.mark.parametrize("batches", [8])
def test_op11_over_the_shop(spark, batches):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    items = {r.item_id: (r.brand, r.price) for r in read("items").collect()}
    rows = {}
    for r in read("clicks").select("click_id", "client_id", "value").collect():
        if r.client_id is not None and r.value is not None:
            rows[r.click_id] = ("value", str(r.client_id), r.click_id, r.value)
    rows = list(rows.values())
    for r in read("sale_lines").select("item_id", "vendor_id").collect():
        brand, price = items.get(r.item_id, (None, None))
        if brand is not None and price is not None:
            rows.append(("price", brand, r.vendor_id, price))
    placed = []
    for stream, grp, id, money in rows:
        b = zlib.crc32(str(id).encode()) % batches
        placed.append((stream, grp, b, int(np.floor(100 * money + 0.5)) + 1000 * b))
    got = QUERIES["op11_quantiles"](spark, SF).withColumn("i", F.col("i")).collect()
    assert all(r.within for r in got)
    check(got, brute(placed, 10, 20))
