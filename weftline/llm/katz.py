"""Katz backoff language model: Good-Turing discounted n-gram counts, exactly normalised.

Counts are taken over all training texts, of orders 1 and 2 here: a token after its predecessor, the first one after the
start mark. r rows of an n-gram count as d(r) * r: Turing's estimate (r + 1) n(r + 1) / (r n(r)) up to RELIABLE, where it lies
between 0 and 1, and beyond that the log-linear one of Gale and Sampson, (1 + 1 / r) ** (slope + 1) with a slope below -1. Every
d(r) is below 1, so each history keeps something for what has not followed it. With C(u) the count of history u:

    P(w)     = d1(c) c / N, and 1 less the sum of these for all unknown words together
    P(w | u) = d2(c(u w)) c(u w) / C(u) where u w was seen, else a(u) P(w); P(w) where u was never a history
    a(u)     = (1 - sum of P(w | u) over w seen after u) / (1 - sum of P(w) over the same w)

How it is stored and asked: texts are laid out in *blocks* of some megabytes, as a table bucketed by block. A block sends its
distinct n-grams, each once with its training count, to the partitions of the n-gram tables (``bucket``, by the n-gram's hash);
a partition sums them over all blocks and sends each block the counts of what it asked for, in the order in which it asked.
A block then evaluates its tokens one by one. So no row is a token, a frequent n-gram is one entry a block, and neither
table nor block is ever broadcast or in one task. The sums of a(u) run over distinct bigrams: of the blocks that hold a
bigram in training, the first one (the *owner*) adds it. Unseen bigrams wait for a(u), which a join brings.

N-grams are told by 64-bit hashes (XXH64 of the word, mixed for bigrams): 4 in 10^5 that any two of 41 million collide.

Edge cases: a null or empty text has the end token alone; words are lower-cased A-Z and split at ASCII white space; repeated
rows each count and score alike; a null id is an id like any other; with no training text every token has the probability
of unknown words, 1; an empty table gives an empty result; columns named like an output column are replaced. Memory follows
BLOCK_BYTES or the longest single text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_at_exit, drop_folder, ensure_checkpoint_dir, join_lookup, small_slices, stored, texts_of

#: Bytes of text in a block, and about how many of them answer for one bucket of the n-gram tables.
BLOCK_BYTES, BUCKET_BYTES = 10 << 20, 8 << 20
#: Counts up to which Turing's estimate may be taken, and up to which n(r) enters the log-linear fit.
RELIABLE, FITTED = 5, 100
#: The log-linear slope is kept below this, so that every count is discounted.
SLOPE = -1.1
#: Words that a worker keeps the hashes of.
MEMO = 1_000_000
START, END = b" start", b" end"  # no word holds a blank

COUNTED = "bucket int, kind int, block bigint, counts array<int>, owns array<boolean>"
SPECTRUM = "bucket int, kind int, block bigint, counts array<int>, owns array<boolean>, r array<int>, n array<bigint>"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_hashes = _Hashes()


def token_hashes(text: str) -> np.ndarray:
    """The hashes of the start mark, the words and the end."""
    words = text.encode().lower().split()  # of bytes: A-Z only, ASCII white space
    found = np.empty(len(words) + 2, np.uint64)
    found[0], found[-1] = _hashes[START], _hashes[END]
    found[1:-1] = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    return found


def bigram_hashes(tokens: np.ndarray) -> np.ndarray:
    mixed = (tokens[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (tokens[1:] + (tokens[:-1] >> np.uint64(29)))
    mixed ^= mixed >> np.uint64(32)
    return mixed * np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Block:
    """Tokens of a block's texts: hashes of predecessor and token in a row, their bigrams, each text's place and part."""

    before: np.ndarray
    token: np.ndarray
    bigram: np.ndarray
    ends: np.ndarray
    trains: np.ndarray

    @classmethod
    def of(cls, texts: list[str], trains: np.ndarray) -> Block:
        rows = [token_hashes(t) for t in texts]
        sizes = np.array([len(r) - 1 for r in rows])
        before, token = np.concatenate([r[:-1] for r in rows]), np.concatenate([r[1:] for r in rows])
        return cls(before, token, np.concatenate([bigram_hashes(r) for r in rows]), np.cumsum(sizes), np.repeat(trains, sizes))


def _asked(keys: np.ndarray, trains: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys by bucket and value, which of them each place has, their training counts, and where buckets begin."""
    distinct, which = np.unique(keys, return_inverse=True)
    counts = np.bincount(which, weights=trains, minlength=len(distinct)).astype(np.int32)
    # Keys are sorted as unsigned numbers, and so are buckets of equal ranges of them.
    starts = np.searchsorted(distinct, [b * (2**64 // buckets) for b in range(buckets)] if buckets > 1 else [0])
    return distinct, which, counts, np.append(starts, len(distinct))


def held_block(size: int, limit: int) -> Iterator[int]:
    """A worker's block numbers: a new one once ``limit`` bytes are in one."""
    number, held = TaskContext.get().partitionId() << 20, 0
    while True:
        held += size
        size = yield number
        if held >= limit:
            number, held = number + 1, 0


def _blocks(df: DataFrame, key: str, text: str, trains: Column) -> tuple[DataFrame, str, int]:
    """The texts as a table bucketed by block, its name, and the number of buckets for n-grams."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, size = None, 0
        for batch in batches:
            for part in small_slices([batch], "text"):
                size = part.column("text").nbytes
                if numbers is None:
                    numbers = held_block(size, BLOCK_BYTES)
                    number = next(numbers)
                else:
                    number = numbers.send(size)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, number), pa.int64())], names=[*part.schema.names, "block"])

    slim = df.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(trains, F.lit(True)).alias("trains"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields)
    laid = slim.mapInArrow(run, f"{kinds}, block bigint").withColumn("row", F.monotonically_increasing_id())
    name = f"weftline_blocks_{uuid.uuid4().hex}"
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    drop_at_exit(spark, folder)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid.write.option("path", folder).option("compression", "zstd").bucketBy(n, "block").format("parquet").saveAsTable(name)
    blocks = spark.table(name)
    size = blocks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return blocks, folder, max(64, size // BUCKET_BYTES)


def _ask(blocks: DataFrame, buckets: int) -> DataFrame:
    """What each block asks of each bucket: kind 0 for tokens, 1 for bigrams; distinct keys and their training counts."""

    def run(table: pa.Table) -> pa.Table:
        block = Block.of(texts_of(table, "text"), table.column("trains").to_numpy())
        number, rows = table.column("block")[0].as_py(), []
        for kind, keys in enumerate((block.token, block.bigram)):
            distinct, _, counts, ends = _asked(keys, block.trains, buckets)
            distinct = distinct.view(np.int64)
            rows += [(b, kind, number, distinct[i:j], counts[i:j]) for b, (i, j) in enumerate(zip(ends[:-1], ends[1:])) if j > i]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["bucket", "kind", "block", "keys", "counts"])

    return blocks.groupBy("block").applyInArrow(run, "bucket int, kind int, block bigint, keys array<bigint>, counts array<int>")


def _count(asked: DataFrame) -> DataFrame:
    """A bucket's counts over all blocks, for each block in its own order, and once a bucket how many n-grams have each count."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block").combine_chunks()
        keys, counts = table.column("keys").combine_chunks(), table.column("counts").combine_chunks()
        ends, flat, own = keys.offsets.to_numpy(), keys.values.to_numpy(), counts.values.to_numpy()
        distinct, which = np.unique(flat, return_inverse=True)
        total = np.bincount(which, weights=own, minlength=len(distinct)).astype(np.int64)
        # The first block that holds an n-gram in training owns it.
        first = np.full(len(distinct), len(flat))
        held = np.nonzero(own > 0)[0]
        np.minimum.at(first, which[held], held)
        owns = np.arange(len(flat)) == first[which]
        r, n = np.unique(total[total > 0], return_counts=True)
        answer = np.minimum(total[which], 2**31 - 1).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v)) for v in (answer, owns)]
        at_first = lambda v, kind: pa.array([v.astype(kind), *[[]] * (table.num_rows - 1)], pa.list_(pa.from_numpy_dtype(kind)))
        return pa.table([table.column("bucket"), table.column("kind"), table.column("block"), *lists, at_first(r, np.int32), at_first(n, np.int64)],
                        names=["bucket", "kind", "block", "counts", "owns", "r", "n"])

    return asked.groupBy("bucket", "kind").applyInArrow(run, SPECTRUM)


@dataclass
class Discounts:
    """What r occurrences count as, of one order."""

    few: tuple[float, ...]  # d(1), d(2), ... as far as Turing's estimate holds
    slope: float

    @classmethod
    def of(cls, n: dict[int, int]) -> Discounts:
        """From numbers n(r) of n-grams seen r times, r up to FITTED."""
        r = np.array(sorted(k for k in n if 0 < k <= FITTED and n[k] > 0))
        slope = -2.0
        if len(r) >= 3:
            # Gale and Sampson: each n(r) is spread over the gap to its neighbours.
            gaps = np.diff(np.concatenate(([0], r, [2 * r[-1] - r[-2]])))
            z = np.array([n[k] for k in r.tolist()]) / ((gaps[:-1] + gaps[1:]) / 2)
            slope = float(np.polyfit(np.log(r), np.log(z), 1)[0])
        slope = min(slope, SLOPE)
        few = []
        for k in range(1, RELIABLE + 1):
            d = (k + 1) * n.get(k + 1, 0) / (k * n[k]) if n.get(k) else 0
            if not 0 < d < 1 or min(n[k], n[k + 1]) < 10:
                break
            few.append(d)
        return cls(tuple(few), slope)

    def times(self, r: np.ndarray) -> np.ndarray:
        """d(r) * r, 0 for 0."""
        r = np.asarray(r, float)
        with np.errstate(divide="ignore"):
            found = np.where(r > 0, r * np.exp((self.slope + 1) * np.log1p(1 / np.maximum(r, 1))), 0)
        for k, d in enumerate(self.few, 1):
            found[r == k] = d * k
        return found

    def column(self, r: str) -> Column:
        """d(r) * r of a column of counts of at least 1."""
        found = F.col(r) * F.exp((self.slope + 1) * F.log1p(1 / F.col(r)))
        for k, d in enumerate(self.few, 1):
            found = F.when(F.col(r) == k, F.lit(d * k)).otherwise(found)
        return found


@dataclass
class Model:
    """The numbers of the model that don't grow with the corpus."""

    tokens: int
    words: int
    one: Discounts
    two: Discounts
    kept: float  # sum of d1(c) c over all known words

    def unigram(self, c: np.ndarray) -> np.ndarray:
        """P(w) of words seen c times; what unknown words have together for 0."""
        return np.where(c > 0, self.one.times(c) / max(self.tokens, 1), 1 - self.kept / max(self.tokens, 1))


def fit_model(spectrum: DataFrame) -> Model:
    """From rows (kind, r, n): how many n-grams have each count; a few sums reach the driver."""
    by = spectrum.groupBy("kind", "r").agg(F.sum("n").alias("n"))
    by = stored(by)
    low = {(x.kind, x.r): x.n for x in by.where(F.col("r") <= FITTED).collect()}
    one, two = (Discounts.of({r: n for (k, r), n in low.items() if k == kind}) for kind in (0, 1))
    sums = by.where("kind = 0").agg(F.sum(F.col("n") * F.col("r")), F.sum("n"), F.sum(F.col("n") * one.column("r"))).first()
    return Model(int(sums[0] or 0), int(sums[1] or 0), one, two, float(sums[2] or 0))


SCORED = "row bigint, n_tokens bigint, n_known bigint, base double, seen double, waits array<bigint>, u array<bigint>, c array<bigint>, s1 array<double>, s2 array<double>"


def _evaluate(blocks: DataFrame, counted: DataFrame, buckets: int, model: Model) -> DataFrame:
    """Scores of each text up to what waits for a(u), and once a block its part of the sums of a(u)."""

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        block = Block.of(texts_of(table, "text"), table.column("trains").to_numpy())
        told = told.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        counts, owns = (told.column(c).combine_chunks() for c in ("counts", "owns"))
        kind = np.repeat(told.column("kind").to_numpy(), np.diff(counts.offsets.to_numpy()))
        flat, own = counts.values.to_numpy(), owns.values.to_numpy(zero_copy_only=False)
        words, word, _, _ = _asked(block.token, block.trains, buckets)
        pairs, pair, _, _ = _asked(block.bigram, block.trains, buckets)
        c_word, c_pair, owned = flat[kind == 0].astype(np.int64), flat[kind == 1].astype(np.int64), own[kind == 1]
        if len(c_word) != len(words) or len(c_pair) != len(pairs):
            raise RuntimeError("a block's texts are not those that asked")
        c, p = c_word[word], model.unigram(c_word)[word]
        # A history's count is its word's: what has been a token is followed once. The start mark has been in front of every training text.
        at = np.minimum(np.searchsorted(words, block.before), len(words) - 1)
        known = words[at] == block.before
        history = np.where(known, c_word[at], -1)
        history[block.before == np.uint64(_hashes[START])] = starts
        both = c_pair[pair]
        if (history[both > 0] <= 0).any():
            raise RuntimeError("a history of a seen bigram is unknown")
        seen = both > 0
        logs = np.log10(np.where(seen, model.two.times(both) / np.maximum(history, 1), p))
        waits = ~seen & (history > 0)
        bounds = np.concatenate(([0], block.ends[:-1]))
        add = lambda v: np.add.reduceat(v, bounds)
        base = np.log10((c + 0.5) / (model.tokens + 0.5 * (model.words + 1)))
        sizes, held = np.diff(np.concatenate(([0], block.ends))), np.concatenate(([0], np.cumsum(add(waits.astype(np.int64)))))
        open_ends = block.before[waits].view(np.int64)
        # One place of each owned bigram.
        place = np.full(len(pairs), -1)
        place[pair] = np.arange(len(pair))
        mine = place[owned]
        us, of = np.unique(block.before[mine], return_inverse=True)
        s1 = np.bincount(of, weights=model.two.times(both[mine]), minlength=len(us))
        s2 = np.bincount(of, weights=p[mine], minlength=len(us))
        size = np.zeros(len(us), np.int64)
        size[of] = history[mine]
        rest = [[]] * (table.num_rows - 1)
        lists = [[v, *rest] for v in (us.view(np.int64), size, s1, s2)]
        columns = [table.column("row").to_numpy(), sizes, add((c > 0).astype(np.int64)), add(base), add(logs), [open_ends[i:j] for i, j in zip(held[:-1], held[1:])], *lists]
        return pa.table([pa.array(v, t) for v, t in zip(columns, kinds)], names=names)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
    names = [f.split()[0] for f in SCORED.split(", ")]
    starts = blocks.where("trains").count()
    return blocks.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(run, SCORED)


def score_texts(df: DataFrame, trains: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, trains, n_tokens, n_known, train_tokens, base_score, score): the model learnt from the rows where ``trains`` holds."""
    spark = df.sparkSession
    blocks, folder, buckets = _blocks(df, key, text, trains)
    counted = stored(_count(_ask(blocks, buckets)))
    model = fit_model(counted.select("kind", F.explode(F.arrays_zip("r", "n")).alias("x")).select("kind", "x.r", "x.n"))
    scored = stored(_evaluate(blocks, counted.select("block", "kind", "bucket", "counts", "owns"), buckets, model))
    sums = scored.select(F.explode(F.arrays_zip("u", "c", "s1", "s2")).alias("x")).groupBy("x.u").agg(
        F.max("x.c").alias("c"), F.sum("x.s1").alias("s1"), F.sum("x.s2").alias("s2"))
    waits = scored.select("row", F.explode("waits").alias("u")).groupBy("row", "u").agg(F.count("*").alias("times"))
    asked = waits.select("u").distinct()
    weight = F.log10((1 - F.col("s1") / F.col("c")) / (1 - F.col("s2")))
    weights = stored(sums.join(asked, "u", "left_semi").select("u", weight.alias("weight")))
    backed = join_lookup(waits, weights, "u").groupBy("row").agg(F.sum(F.col("times") * F.col("weight")).alias("backed"))
    ids = stored(blocks.select("row", "id", "trains"))
    found = ids.join(scored.select("row", "n_tokens", "n_known", "base", "seen"), "row").join(backed, "row", "left")
    found = stored(found.select(
        F.col("id").alias(key), "trains", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"),
        (F.col("seen") + F.coalesce("backed", F.lit(0.0))).alias("score")))
    spark.sql(f"DROP TABLE {folder.rpartition('/')[2]}")
    drop_folder(spark, folder)
    return found
