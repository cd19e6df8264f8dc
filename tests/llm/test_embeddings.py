import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from weftline.llm import embeddings as E


def brute(rows, cosine=0.98):
    """n_links and component of each row, ids unique."""
    good = {}
    for i, v, g in rows:
        if i is not None and g is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            good[i] = (g, x / np.linalg.norm(x))
    links = {i: set() for i, _, _ in rows}
    for a, b in itertools.combinations(sorted(good), 2):
        if good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= cosine:
            links[a].add(b)
            links[b].add(a)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            todo += (new := links[todo.pop()] - seen)
            seen |= new
        out[i] = (len(links[i]), None if i is None else min(x for x in seen if x is not None))
    return out


def vectors(seed, n=300, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        c = centres[int(rng.integers(12))] if i % 2 else rng.normal(size=dim)
        rows.append((i, [float(x) for x in (c + rng.normal(size=dim) * 0.06).astype(np.float32)], int(rng.integers(2))))
    odd = [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), rows[1][1][:8], [x * 3 for x in rows[1][1]]]
    rows += [(1000 + k, v, rows[1][2]) for k, v in enumerate(odd)]
    rows += [(2000, rows[1][1], None), (None, rows[1][1], rows[1][2])] + [(3000 + k, rows[3][1], rows[3][2]) for k in range(20)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("clash"))


@pytest.mark.parametrize("block", [512, 3])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rows = vectors(1)
    got = E.near_duplicate_vectors(frame(spark, rows).repartition(5)).collect()
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], g) for i, v, g in rows])
    assert len(got) == len(rows)
    right = [(r.n_links, r.component_id) == want[r.vec_id] for r in got]
    total = sum(n for n, _ in want.values())
    found = sum(r.n_links for r in got)
    assert all(r.n_links <= want[r.vec_id][0] for r in got)
    assert found >= 0.97 * total and np.mean(right) > 0.95
    assert all(r.kept == (None if r.vec_id is None else r.vec_id == r.component_id) for r in got)
    for r in got:
        if r.vec_id is None or 1000 <= r.vec_id <= 1005 or r.vec_id == 2000:
            assert (r.n_links, r.component_id) == (0, r.vec_id)


def test_recall_in_64_dimensions(spark):
    rows = vectors(2, 600, 64)
    rows = [(i, v, g) for i, v, g in rows if i is not None and (i < 1000 or i >= 3000)]
    want = brute([(i, [float(np.float32(x)) for x in v], g) for i, v, g in rows])
    got = {r.vec_id: r.n_links for r in E.near_duplicate_vectors(frame(spark, rows)).collect()}
    assert sum(got.values()) >= 0.99 * sum(n for n, _ in want.values())


def test_lattice():
    roots = E.e8_roots()
    assert len({tuple(r) for r in roots}) == 240 and np.allclose((roots**2).sum(1), 2)
    x = np.random.default_rng(3).normal(size=(400, 8)) * 2
    near = E.nearest_e8(x)
    # Points of E8, and none of the 240 neighbours is nearer.
    assert np.allclose((near * 2) % 1, 0) and np.allclose(near.sum(1) % 2, 0)
    own = ((x - near) ** 2).sum(1)
    assert (own <= 1 + 1e-9).all()
    assert (own[:, None] <= ((x[:, None] - near[:, None] - roots[None]) ** 2).sum(2) + 1e-9).all()


def test_repeated_ids_and_empty(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (1, v, 0), (2, [1.0, 2.0, 3.1], 0)]
    got = E.near_duplicate_vectors(frame(spark, rows)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert E.near_duplicate_vectors(frame(spark, [])).count() == 0
