"""Near-duplicate embeddings by lattice hashing.

Each table projects unit vectors at random to BLOCKS times eight dimensions and decodes each eight to the nearest
point of the E8 lattice; the points are the vector's own cell. It also asks in the cells next to its own, PROBES lattice
neighbours of each block in order of nearness. Vectors with equal labels that meet in a cell, one of them at home
there, are verified by cosine in double precision.

Copies (equal label and components) are one class with a size and meet nothing but other classes. Cells where nothing
can meet are dropped by id before any vector is sent; a crowded cell is cut into blocks that are compared pair by
pair, so no task holds a cell. A pair counts where it is met first (table by table), which both vectors' cells tell,
so links are counted once although no list of pairs is made: a block sends on a count and a root for each vector.

Edge cases: vectors that are null, empty or zero or hold a null or a non-finite component link with nothing, nor do
rows with a null label or id; vectors of different length don't link; rows with one id are one vertex, whose links add
up; copies count as links; an empty table gives an empty result; other input columns
are left out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append, cut, with_fields
from .graph import components

COSINE = 0.98
#: Tables, lattice points a table, width of a cell in units of the unit sphere's radius, neighbours asked for each point.
TABLES, BLOCKS, SCALE, PROBES = 4, 2, 0.65, 2
SEED = 20
#: Rows of a crowded cell that one task compares with as many others.
BLOCK = 512
WAYS = 1 + BLOCKS * PROBES


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest whole points with an even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.nonzero(near.sum(1).astype(np.int64) & 1)[0]
    worst = np.abs(off).argmax(1)[odd]
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8: whole coordinates with an even sum, or all of them moved by a half."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


@lru_cache(1)
def e8_roots() -> np.ndarray:
    """The 240 steps from a lattice point to its nearest neighbours."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            root = np.zeros(8)
            root[i], root[j] = a, b
            found.append(root)
    found += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(found)


@lru_cache(64)
def _projection(dim: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim, table])
    weights = rng.integers(0, 1 << 63, 8 * BLOCKS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return rng.normal(size=(dim, 8 * BLOCKS)) / np.sqrt(8) / SCALE, weights


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def cells(vectors: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Keys of the cells of unit vectors, shape (n, TABLES, WAYS); the first way is a vector's own cell."""
    out = np.empty((len(vectors), TABLES, WAYS), np.uint64)
    for table in range(TABLES):
        matrix, weights = _projection(vectors.shape[1], table)
        at = vectors @ matrix
        points = [nearest_e8(at[:, 8 * b : 8 * b + 8]) for b in range(BLOCKS)]
        # Doubled coordinates are whole numbers; the key is their wrapping weighted sum.
        parts = [(p * 2).astype(np.int64).view(np.uint64) @ weights[8 * b : 8 * b + 8] for b, p in enumerate(points)]
        own = np.sum(parts, axis=0, dtype=np.uint64) + labels * weights[-1]
        out[:, table, 0] = own
        steps = (e8_roots() * 2).astype(np.int64).view(np.uint64)
        for b in range(BLOCKS):
            nearness = (at[:, 8 * b : 8 * b + 8] - points[b]) @ e8_roots().T
            order = np.argsort(-nearness, axis=1, kind="stable")[:, :PROBES]
            moved = steps @ weights[8 * b : 8 * b + 8]
            out[:, table, 1 + b * PROBES : 1 + (b + 1) * PROBES] = own[:, None] + moved[order]
    return out


def _met(own_a: np.ndarray, all_a: np.ndarray, own_b: np.ndarray, all_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a asks in b's own cell, and b in a's; the own cell is asked too."""
    return (all_a == own_b[:, None]).any(1), (all_b == own_a[:, None]).any(1)


def _first_here(i: np.ndarray, j: np.ndarray, ids: np.ndarray, keys: np.ndarray, table: int, key: np.uint64) -> np.ndarray:
    """Whether the pairs (i, j) of members of this cell count here."""
    here = np.ones(len(i), bool)
    for t in range(table):
        a, b = _met(keys[i, t, 0], keys[i, t], keys[j, t, 0], keys[j, t])
        here &= ~(a | b)
    a, b = _met(keys[i, table, 0], keys[i, table], keys[j, table, 0], keys[j, table])
    home_i, home_j = keys[i, table, 0] == key, keys[j, table, 0] == key
    # Both at home: here. Else one asks in the other's cell; if both ask, the one with the smaller id does.
    asks_i, asks_j = ~home_i & home_j & a, ~home_j & home_i & b
    both = a & b
    return here & ((home_i & home_j) | (asks_i & (~both | (ids[i] < ids[j]))) | (asks_j & (~both | (ids[j] < ids[i]))))


def compare(ids, sizes, labels, vectors, keys, left, right, table: int, key: np.uint64, cosine: float):
    """Counts and roots of the members that link here: (id, links, root id) arrays.

    ``left`` and ``right`` are positions of two blocks' members, the same ones for a block with itself.
    """
    near = vectors[left] @ vectors[right].T >= cosine
    near &= labels[left][:, None] == labels[right][None, :]
    i, j = np.nonzero(near)
    i, j = left[i], right[j]
    one_block = len(left) == len(right) and (left == right).all()
    keep = i < j if one_block else i != j
    i, j = i[keep], j[keep]
    here = _first_here(i, j, ids, keys, table, key)
    i, j = i[here], j[here]
    if not len(i):
        return ids[:0], sizes[:0], ids[:0]
    links = np.bincount(i, sizes[j], len(ids)) + np.bincount(j, sizes[i], len(ids))
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    root, before = rank.copy(), None
    while before is None or (root != before).any():
        before = root.copy()
        np.minimum.at(root, i, before[j])
        np.minimum.at(root, j, before[i])
    used = np.nonzero(links)[0]
    return ids[used], links[used].astype(np.int64), np.sort(ids, kind="stable")[root[used]]


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of a list column, short ones filled up with zeros, and their lengths."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lengths), int(lengths.max(initial=1))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return unit(out), lengths


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors, lengths = _matrix(batch.column("vector"))
        labels = batch.column("label").to_numpy(zero_copy_only=False).view(np.uint64)
        out = np.empty((batch.num_rows, TABLES * WAYS), np.int64)
        for n in np.unique(lengths):
            at = np.nonzero(lengths == n)[0]
            out[at] = cells(vectors[at, :n], labels[at]).reshape(len(at), -1).view(np.int64)
        offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * (TABLES * WAYS)
        yield append(batch, ["keys"], [pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))])


def _verify(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Compare the members of each run of rows with one (table, cell, i, j); runs may cross batches."""
    held = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
        if held is None or not held.num_rows:
            continue
        part = held.combine_chunks()
        number = {c: part.column(c).to_numpy() for c in ("cid", "size", "label", "table", "cell", "own", "i", "j")}
        marks = np.stack([number[c] for c in ("table", "cell", "i", "j")], 1)
        edges = np.concatenate(([0], np.nonzero((marks[1:] != marks[:-1]).any(1))[0] + 1))
        # The last run may go on in the next batch.
        ends = np.concatenate((edges[1:], [part.num_rows] if batch is None else np.zeros(0, int)))
        if len(ends):
            done = part.slice(0, int(ends[-1]))
            vectors, _ = _matrix(done.column("vector").combine_chunks())
            keys = done.column("keys").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, TABLES, WAYS)
            found = []
            for start, end in zip(edges, ends):
                if end - start > 1:
                    run = slice(start, end)
                    left, right = (np.nonzero(number["own"][run] == number[c][start])[0] for c in ("i", "j"))
                    table, cell = int(number["table"][start]), np.uint64(int(number["cell"][start]) & (2**64 - 1))
                    found.append(compare(number["cid"][run], number["size"][run], number["label"][run], vectors[run], keys[run], left, right, table, cell, cosine))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]), pa.int64()) for k in range(3)], ["id", "n", "root"])
        held = part.slice(int(edges[-1]))


def _usable(vector: str) -> Column:
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicate_vectors(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE
) -> DataFrame:
    """(key, n_links long, component_id, kept): one row for each row of ``df``."""
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & _usable("vector")
    # Two hashes of 96 bits together stand for a vector wherever only its identity matters.
    rows = rows.withColumn("ok", usable).withColumn("h", F.when(F.col("ok"), F.struct(F.xxhash64("vector").alias("x"), F.hash("vector").alias("y"))))
    named = rows.groupBy("label", "h").agg(F.min("id").alias("cid"), F.count("*").alias("size"), F.min_by("vector", "id").alias("vector"))
    named = named.where("h is not null").select("cid", "size", "label", "h", "vector")
    classes = named.select("cid", "size", F.xxhash64("label", F.size("vector")).alias("label"), "vector")
    coded = cut(classes.mapInArrow(_code, with_fields(classes, "keys array<bigint>")))
    # Ids and keys alone tell which cells matter.
    asked = coded.select("cid", F.posexplode("keys").alias("way", "cell"))
    asked = asked.select("cid", "cell", F.floor(F.col("way") / WAYS).cast("int").alias("table"), (F.col("way") % WAYS == 0).alias("home"))
    crowd = asked.groupBy("table", "cell").agg(F.count("*").alias("n"), F.max("home").alias("used")).where("used and n > 1").drop("used")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    met = asked.drop("home").distinct().join(crowd, ["table", "cell"]).withColumn("own", F.pmod(F.xxhash64("cid"), blocks).cast("int"))
    # Blocks are dealt after the join by id, which spreads a crowded cell's rows before they are repeated.
    work = met.withColumn("blocks", blocks).join(coded, "cid").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    work = work.withColumn("i", F.least("own", "with")).withColumn("j", F.greatest("own", "with")).drop("n", "blocks", "with")
    work = work.repartition("table", "cell", "i", "j").sortWithinPartitions("table", "cell", "i", "j", "cid")
    links = cut(work.mapInArrow(lambda batches: _verify(batches, cosine), "id long, n long, root long"))
    roots = components(links.select("id", "root"), "id", "root").select(F.col("node").alias("cid"), F.col("root").alias("group"))
    counted = links.groupBy(F.col("id").alias("cid")).agg(F.sum("n").alias("n")).join(roots, "cid", "left")
    # Back to the rows, by hashes, and only of classes that have links or copies.
    told = rows.where("ok").groupBy("label", "h").agg(F.min("id").alias("cid"), F.count("*").alias("size"))
    told = told.join(counted, "cid", "left").where("n is not null or size > 1")
    told = told.select("label", "h", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n"), F.coalesce("group", "cid").alias("group"))
    out = rows.select("id", "label", "h").join(told, ["label", "h"], "left")
    component = F.coalesce("group", "id")
    return out.select(
        F.col("id").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )
