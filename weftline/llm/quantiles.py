"""Mergeable quantile summaries: error-bounded splines of cumulative counts.

A summary is a piecewise linear cumulative count: knots at integer places, each with the counts just below its place and
up to it. Where the two differ the curve jumps: a double knot, kept as one point with two heights. Between neighbouring
knots the curve runs straight from the upper height of one to the lower height of the next.

* Fit: a greedy shrinking cone. From the last knot, the cone of slopes that pass every place since within ``error`` rows of
  both its heights is narrowed place by place; the first place that no such line reaches makes its predecessor a knot.
  So heights are exact at knots and at most ``error`` off elsewhere, and two neighbouring pieces rise by more than
  ``error`` together: n rows with ``error`` n / PIECES leave at most 2 * PIECES + 2 points. A place of more than
  ``2 * error`` rows can't be passed and becomes a double knot. Evenly spaced places are added up to ``LEAST`` points.
* Merge: the curves are added at all their knots, lower and upper heights apart, and the sum is fitted again. Errors add
  up: n / PIECES for each of the two published fits, n / FINE for each fit on the way.
* Invert: the smallest integer whose height is at least target - 1/2 (counts are whole, errors below 1/2 then do nothing).

Rows are counted by (keys, x, batch) first, so repeats meet before anything is sorted; then they are sorted by range over all
keys, and a key with any share of the rows lies in as many tasks as it fills. A task's part of a key becomes one row, a *run*.
Parts of a key are merged ``FAN`` at a time, so no task gathers a hot key's rows, runs or summaries. Exact ranks are sums over
runs; a target-th smallest value is looked up in the one run that holds it, found by prefix sums of two levels over runs.

Edge cases: rows whose key or money is null, and money that is not finite, are dropped; a null id is in batch 0; repeated rows
count as often as they stand there; a key with one value has one point; an empty table gives an empty result; columns
beside those named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: A published summary is off by n / PIECES rows and its fit; one on the way by n / FINE.
PIECES, FINE = 150, 1000
#: Points that a summary keeps at least, if there are so many places.
LEAST = 4
#: Summaries merged at a time, as a power of two.
FAN = 6
#: Batch number of the whole.
WHOLE = -1

Curve = tuple[np.ndarray, np.ndarray, np.ndarray]


def fit(curve: Curve, error: float, least: int = LEAST) -> Curve:
    """The knots of a greedy spline within ``error`` of ``curve`` (places, heights below, heights up to), ``least`` points at least."""
    x, low, high = curve
    if len(x) <= least or len(x) < 3 or 2 * error < (high - low)[1:-1].min():
        return curve  # no place can be passed
    xs, lows, highs = x.tolist(), low.tolist(), high.tolist()
    keep, at, height, steep, flat = [0], xs[0], highs[0], float("inf"), float("-inf")
    for j in range(1, len(xs)):
        run = xs[j] - at
        slope = (lows[j] - height) / run
        if slope < flat or slope > steep:
            keep.append(j - 1)
            at, height, steep, flat = xs[j - 1], highs[j - 1], float("inf"), float("-inf")
            run = xs[j] - at
        flat, steep = max(flat, (highs[j] - error - height) / run), min(steep, (lows[j] + error - height) / run)
    keep.append(len(xs) - 1)
    if len(keep) < least:
        keep = np.union1d(keep, np.linspace(0, len(xs) - 1, least).round().astype(int))
    return x[keep], low[keep], high[keep]


def add(curves: list[Curve]) -> Curve:
    """The sum of piecewise linear cumulative counts, at all their knots."""
    if len(curves) == 1:
        return curves[0]
    places = np.unique(np.concatenate([c[0] for c in curves]))
    sums = [np.zeros(len(places)), np.zeros(len(places))]
    for x, low, high in curves:
        for total, side in zip(sums, ("left", "right")):
            after = np.searchsorted(x, places, side)  # the first knot beyond a place, itself included on the left side
            i = np.clip(after, 1, len(x) - 1)
            if len(x) > 1:
                inside = high[i - 1] + (low[i] - high[i - 1]) * ((places - x[i - 1]) / (x[i] - x[i - 1]))
            else:
                inside = np.zeros(len(places))
            total += np.where(after == 0, 0, np.where(after == len(x), high[-1], inside))
    steps = np.maximum.accumulate(np.stack(sums, 1).ravel())  # rounding must not make the curve fall
    return places, steps[::2], steps[1::2]


def invert(curve: Curve, targets: np.ndarray) -> np.ndarray:
    """For each target the smallest integer whose height is at least the target less 1/2."""
    x, low, high = curve
    t = np.asarray(targets, float) - 0.5
    j = np.minimum(np.searchsorted(high, t, "left"), len(x) - 1)
    i = np.maximum(j - 1, 0)
    rise = np.where((j > 0) & (low[j] >= t) & (low[j] > high[i]), low[j] - high[i], np.inf)
    between = np.ceil(x[i] + (x[j] - x[i]) * ((t - high[i]) / rise)).astype(np.int64)
    return np.where(np.isinf(rise), x[j], np.clip(between, x[i], x[j]))


def batch_of(id: Column, batches: int) -> Column:
    """crc32 of an id in decimal, modulo ``batches``; 0 for a null id."""
    return F.pmod(F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")), F.lit(batches)).cast("int")


def place(money: Column, batch: Column) -> Column:
    return F.floor(100 * money + 0.5) + 1000 * batch


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _curves(column: pa.ListArray) -> list[list[tuple[int, int, Curve]]]:
    """(batch, n, curve) of each row's list of summaries."""
    rows, ends = column.values, column.offsets.to_numpy()
    parts = [_lists(rows.field(k)) for k in ("x", "low", "high")]
    flat = list(zip(rows.field("batch").to_pylist(), rows.field("n").to_pylist(), zip(*parts)))
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _map(df: DataFrame, schema: str, turn: Callable[[pa.RecordBatch], Iterator[tuple]]) -> DataFrame:
    """``turn`` gives rows as tuples for each record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(turn(batch))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    probe = df.sparkSession.createDataFrame([], schema).schema
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    names, types = probe.names, [kinds[f.dataType.simpleString()] for f in probe.fields]
    return df.mapInArrow(run, schema)


def counted_runs(rows: DataFrame) -> DataFrame:
    """(stream, grp, part, x, batch, n as lists by x) from rows (stream, grp, batch, x) or such with their number ``n``, a row for each task's part of a key."""
    how_many = F.sum("n") if "n" in rows.columns else F.count("*")
    counts = rows.groupBy("stream", "grp", "batch", "x").agg(how_many.alias("n"))
    ranged = counts.repartitionByRange("stream", "grp", "x", "batch").sortWithinPartitions("stream", "grp", "x", "batch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if whole is None or not whole.num_rows:
            return
        stream, grp = whole.column("stream").combine_chunks(), whole.column("grp").combine_chunks()
        codes = [c.dictionary_encode().indices.to_numpy() for c in (stream, grp)]
        starts = np.concatenate(([0], np.nonzero((np.diff(codes[0]) != 0) | (np.diff(codes[1]) != 0))[0] + 1))
        step = 2000
        for at in range(0, len(starts), step):
            own = starts[at : at + step]
            end = starts[at + step] if at + step < len(starts) else whole.num_rows
            ends = pa.array(np.append(own, end) - own[0], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, whole.column(c).combine_chunks().slice(own[0], end - own[0])) for c in ("x", "batch", "n")]
            part = pa.array(np.full(len(own), TaskContext.get().partitionId()), pa.int32())
            yield pa.RecordBatch.from_arrays([stream.take(pa.array(own)), grp.take(pa.array(own)), part, *lists], names=["stream", "grp", "part", "x", "batch", "n"])

    return stored(ranged.mapInArrow(run, "stream string, grp string, part int, x array<bigint>, batch array<int>, n array<bigint>"))


SUMMARY = "stream string, grp string, batch int, part int, n bigint, x array<bigint>, low array<double>, high array<double>"


def summarise_runs(runs: DataFrame) -> DataFrame:
    """A summary of each batch in each run."""

    def turn(b: pa.RecordBatch) -> Iterator[tuple]:
        keys = zip(*(b.column(k).to_pylist() for k in ("stream", "grp", "part")))
        for (stream, grp, part), x, batch, n in zip(keys, *(_lists(b.column(k)) for k in ("x", "batch", "n"))):
            for own in np.unique(batch):
                of = batch == own
                high = np.cumsum(n[of]).astype(float)
                curve = fit((x[of], high - n[of], high), high[-1] / FINE)
                yield stream, grp, int(own), part, int(high[-1]), *curve

    return _map(runs, SUMMARY, turn)


def _merged(parts: list[tuple[int, int, Curve]], pieces: int) -> tuple[int, Curve]:
    n = sum(p[1] for p in parts)
    return n, fit(add([p[2] for p in parts]), n / pieces)


def merge_parts(summaries: DataFrame) -> DataFrame:
    """Summaries of the same key and batch, merged until at most 2 ** FAN of them are left of each."""
    most = summaries.agg(F.max("part")).first()[0] or 0
    while most >> FAN:
        some = summaries.withColumn("part", F.shiftright("part", FAN)).groupBy("stream", "grp", "batch", "part")
        some = some.agg(F.collect_list(F.struct("batch", "n", "x", "low", "high")).alias("of"))

        def turn(b: pa.RecordBatch) -> Iterator[tuple]:
            for stream, grp, batch, part, of in zip(*(b.column(k).to_pylist() for k in ("stream", "grp", "batch", "part")), _curves(b.column("of"))):
                n, curve = _merged(of, FINE)
                yield stream, grp, batch, part, n, *curve

        summaries, most = stored(_map(some, SUMMARY, turn)), most >> FAN
    return summaries


def merge_batches(summaries: DataFrame) -> DataFrame:
    """The published summary of each batch and, merged from these alone, of the whole (batch -1)."""
    merged = merge_parts(summaries).groupBy("stream", "grp").agg(F.collect_list(F.struct("batch", "n", "x", "low", "high")).alias("of"))

    def turn(b: pa.RecordBatch) -> Iterator[tuple]:
        for stream, grp, of in zip(b.column("stream").to_pylist(), b.column("grp").to_pylist(), _curves(b.column("of"))):
            batches = []
            for own in sorted({p[0] for p in of}):
                n, curve = _merged([p for p in of if p[0] == own], PIECES)
                batches.append((own, n, curve))
                yield stream, grp, own, 0, n, *curve
            n, curve = _merged(batches, PIECES)
            yield stream, grp, WHOLE, 0, n, *curve

    return _map(merged, SUMMARY, turn)


def quantiles(summaries: DataFrame, parts: int, least: int) -> DataFrame:
    """(stream, grp, batch, n, points, answers): the estimates of ranks ceil(i n / parts) of summaries of ``least`` rows or more."""

    def turn(b: pa.RecordBatch) -> Iterator[tuple]:
        keys = zip(*(b.column(k).to_pylist() for k in ("stream", "grp", "batch", "n")))
        for (stream, grp, batch, n), *curve in zip(keys, *(_lists(b.column(k)) for k in ("x", "low", "high"))):
            yield stream, grp, batch, n, len(curve[0]), invert(tuple(curve), targets(n, parts))

    rows = summaries.where(F.col("n") >= least)
    return _map(rows, "stream string, grp string, batch int, n bigint, points bigint, answers array<bigint>", turn)


def targets(n: int, parts: int) -> np.ndarray:
    return np.array([-(-i * n // parts) for i in range(1, parts)], np.int64)


def _rows_before(sizes: DataFrame) -> DataFrame:
    """``sizes`` (stream, grp, batch, part, n) with the sum of n over a key's earlier parts, in two levels."""
    keys = ["stream", "grp", "batch"]
    sizes = sizes.withColumn("chunk", F.shiftright("part", 8))
    earlier = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    near = sizes.withColumn("near", F.coalesce(F.sum("n").over(earlier([*keys, "chunk"], "part")), F.lit(0)))
    far = sizes.groupBy(*keys, "chunk").agg(F.sum("n").alias("all")).withColumn("far", F.coalesce(F.sum("all").over(earlier(keys, "chunk")), F.lit(0)))
    return near.join(far.drop("all"), [*keys, "chunk"]).select(*keys, "part", (F.col("near") + F.col("far")).alias("before"))


def exact_ranks(runs: DataFrame, summaries: DataFrame, answers: DataFrame, parts: int) -> DataFrame:
    """Each answer beside the exact value of its rank and the exact numbers of rows below it and up to it."""
    sizes = summaries.select("stream", "grp", "batch", "part", "n")
    sizes = sizes.union(sizes.groupBy("stream", "grp", "part").agg(F.sum("n").alias("n")).select("stream", "grp", F.lit(WHOLE).alias("batch"), "part", "n"))
    told = _rows_before(sizes).join(answers, ["stream", "grp", "batch"])
    told = told.groupBy("stream", "grp", "part").agg(F.collect_list(F.struct("batch", "before", "n", "points", "answers")).alias("told"))
    both = runs.withColumnsRenamed({"batch": "batches", "n": "ns"}).join(told, ["stream", "grp", "part"])

    def turn(b: pa.RecordBatch) -> Iterator[tuple]:
        asked, ends = b.column("told").values, b.column("told").offsets.to_numpy()
        asked = list(zip(*(asked.field(k).to_pylist() for k in ("batch", "before", "n", "points")), _lists(asked.field("answers"))))
        keys = zip(b.column("stream").to_pylist(), b.column("grp").to_pylist(), ends[:-1], ends[1:])
        for (stream, grp, first, last), x, batch, n in zip(keys, *(_lists(b.column(k)) for k in ("x", "batches", "ns"))):
            for own, before, size, points, answer in asked[first:last]:
                of = slice(None) if own == WHOLE else batch == own
                xs, high = x[of], np.concatenate(([0], np.cumsum(n[of])))
                want = targets(size, parts)
                inside = (want > before) & (want <= before + high[-1])
                exact = xs[np.clip(np.searchsorted(high, want - before, "left") - 1, 0, len(xs) - 1)].tolist()
                below, upto = (high[np.searchsorted(xs, answer, side)].tolist() for side in ("left", "right"))
                for i, t in enumerate(want.tolist()):
                    yield stream, grp, own, i + 1, size, t, points, int(answer[i]), below[i], upto[i], exact[i] if inside[i] else None

    schema = "stream string, grp string, batch int, i int, n bigint, target bigint, points bigint, answer bigint, below bigint, upto bigint, exact bigint"
    found = _map(both, schema, turn).groupBy("stream", "grp", "batch", "i", "n", "target", "points", "answer")
    found = found.agg(F.max("exact").alias("exact_x"), F.sum("below").alias("n_below"), F.sum("upto").alias("n_upto"))
    return found.withColumn("rank_error", F.greatest(F.lit(0), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto")))


def quantile_report(rows: DataFrame, parts: int = 10, least: int = 20) -> DataFrame:
    """Summaries of rows (stream, grp, batch, x, and their number n if there is such a column), and how exact they are."""
    runs = counted_runs(rows)
    partial = stored(summarise_runs(runs))
    answers = stored(quantiles(merge_batches(partial), parts, least))
    return exact_ranks(runs, partial, answers, parts)


def money_rows(streams: DataFrame, batches: int) -> DataFrame:
    """(stream, grp, batch, x) and n of rows (stream, grp, id, money) and n; those without group or finite money go."""
    batch = batch_of(F.col("id"), batches)
    money = F.col("money").cast("double")
    whole = streams.where(F.col("grp").isNotNull() & money.isNotNull() & ~F.isnan(money) & (F.abs(money) < float("inf")))
    return whole.select("stream", "grp", batch.alias("batch"), place(money, batch).alias("x"), *["n"] * ("n" in streams.columns))


def shop_streams(clicks: DataFrame, sale_lines: DataFrame, items: DataFrame, batches: int) -> DataFrame:
    """The rows of the streams ``value`` (one for each click_id, the least where copies differ) and ``price``, counted.

    Lines are counted by item and batch before they meet their items, so a hot item is a few rows by then.
    """
    some = clicks.where("client_id is not null and value is not null").groupBy("click_id").agg(F.min(F.struct("client_id", "value")).alias("c"))
    value = some.select(F.lit("value").alias("stream"), F.col("c.client_id").cast("string").alias("grp"), F.col("click_id").alias("id"), F.col("c.value").alias("money"))
    value = money_rows(value, batches).withColumn("n", F.lit(1).cast("long"))
    lines = sale_lines.where("item_id is not null").groupBy("item_id", batch_of(F.col("vendor_id"), batches).alias("batch")).agg(F.count("*").alias("n"))
    priced = lines.join(items.select("item_id", "brand", F.col("price").cast("double").alias("price")), "item_id")
    priced = priced.where("brand is not null and price is not null and not isnan(price) and abs(price) < double('infinity')")
    price = priced.select(F.lit("price").alias("stream"), F.col("brand").alias("grp"), "batch", place(F.col("price"), F.col("batch")).alias("x"), "n")
    return value.union(price)
