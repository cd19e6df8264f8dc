"""SimHash near-duplicates by multi-index hashing.

Fingerprints within three bits differ by at most one bit in one of their two 32-bit halves. Each half of each
distinct fingerprint is a table key; the small Hamming ball around a half (itself and its 32 one-bit
neighbours) is enumerated, the table's matches are fetched by an equi join, and the complete 64-bit distance is
verified. A one-bit neighbour has the other parity, so only halves of odd parity need to enumerate theirs.

Copies meet before any of this: only distinct fingerprints are looked up. Keys that more than ``HOT`` distinct
fingerprints share leave the join and are compared in blocks, which send on a spanning forest of the links
rather than all of them; components stay whole.

Edge cases: a null or empty text, or one of white space only, has fingerprint zero and is linked like any other;
a text of one or two words is one shingle; rows with equal ids share what their texts get; a group's id is its
smallest id that is not null, null only if it has none; an empty table gives an empty result; input columns named
like an output column are replaced. A text is hashed in chunks, so memory does not follow its length (in
``similar_links`` it does, by 8 bytes a shingle). n sets of shingles that hang together are compared in (n / 2048)^2 / 2
pairs of blocks; sets that no text shares or nearly shares cost nothing there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, HOT_SHARE, join_hot, join_lookup, stored, text_column, without
from .graph import components

WORDS, MAX_BITS, SEED = 3, 3, 42
#: Distinct fingerprints on one table key beyond which they are compared in blocks of BLOCK.
HOT, BLOCK = 512, 2048
#: Texts that share this part of their shingles of so many words are near copies, whatever their fingerprints.
SIMILARITY, SIMILAR_WORDS = 0.8, 5
BANDS, ROWS = 40, 8
#: Sets, and shingles in them, that make a block of the verification.
PER_BLOCK, BLOCK_SHINGLES = 2048, 1 << 21
SKETCH = "struct<fp:long,x:long,n:long,bands:array<long>>"
_COLUMNS = 4096
_FACTORS = np.random.default_rng(SEED).integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def shingle_hashes(text: str | None, words: int) -> Iterator[list[int]]:
    """The hashes of all runs of ``words`` words, in chunks; a text with fewer words is one run, one with none has none."""
    data = (text or "").encode().lower()  # of bytes: A-Z only
    tail, at, some = [], 0, False
    digest = xxhash.xxh64_intdigest
    while at < len(data):
        stop = _SPACE.search(data, at + _CHUNK)
        end = stop.start() if stop else len(data)
        found = tail + data[at:end].split()
        hashes = [digest(b" ".join(s), SEED) for s in zip(*(found[i:] for i in range(words)))]
        if hashes:
            some = True
            yield hashes
        tail, at = found[len(found) - min(len(found), words - 1) :], end
    if not some and tail:
        yield [digest(b" ".join(tail), SEED)]


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint as a signed 64-bit number."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, words):
        for i in range(0, len(hashes), 1 << 16):
            bits = np.unpackbits(np.array(hashes[i : i + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def simhash(df: DataFrame, text: str = "text", out: str = "fingerprint", words: int = WORDS) -> DataFrame:
    """``df`` with the fingerprint of ``text`` as a long."""
    df = without(df, out)
    prints = text_column(df.sparkSession, "long", lambda: lambda texts: pa.array([fingerprint(t, words) for t in texts], pa.int64()))
    return df.withColumn(out, prints(text))


def _forest(left: np.ndarray, right: np.ndarray, same: bool, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks of fingerprints."""
    values = left if same else np.concatenate((left, right))
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    links = []
    for i in range(len(left)):
        near = np.nonzero(np.bitwise_count(values[i + 1 :] ^ left[i]) <= bits)[0] + i + 1
        for j in near.tolist():
            if (x := root(i)) != (y := root(j)):
                parent[max(x, y)] = min(x, y)
                links.append((int(values[i]), int(values[j])))
    return links


def _by_blocks(members: DataFrame, bits: int) -> DataFrame:
    """Links among ``members`` (key k, s; n members of the key; fp), compared block against block."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    cells = (
        members.withColumn("own", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("k", "s", "fp", "own", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))
    )

    def run(part: pd.DataFrame) -> pd.DataFrame:
        i, j = part["i"].iat[0], part["j"].iat[0]
        left = np.unique(part.loc[part["own"] == i, "fp"].to_numpy(np.int64))
        right = np.unique(part.loc[part["own"] == j, "fp"].to_numpy(np.int64))
        return pd.DataFrame(_forest(left, right, i == j, bits), columns=["a", "b"]).astype("int64")

    return cells.groupBy("k", "s", "i", "j").applyInPandas(run, "a long, b long")


def near_pairs(fingerprints: DataFrame, fp: str = "fingerprint") -> DataFrame:
    """Links (a, b) that join distinct fingerprints within MAX_BITS exactly as all such pairs would.

    Every pair that meets on a key of at most HOT fingerprints is returned; on other keys a spanning forest is.
    """
    halves = F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.expr(f"cast(shiftrightunsigned(fp, {32 * k}) & 4294967295L as bigint)").alias("s")) for k in (0, 1)
    ])).alias("h")
    table = fingerprints.select(F.col(fp).alias("fp")).distinct().select("fp", halves).select("fp", "h.k", "h.s")
    table = stored(table)
    flips = F.array(*[F.lit(1 << i) for i in range(32)])
    probes = table.where("bit_count(s) % 2 = 1").select("k", F.explode(F.transform(flips, lambda f: F.col("s").bitwiseXOR(f))).alias("s"), "fp")
    # Rows are told by a lookup whether their key is hot, so that no task gathers those of a hot key.
    one = F.col("s") * 2 + F.col("k")
    hot = stored(table.groupBy(one.alias("ks")).count().where(F.col("count") > HOT).select("ks", F.lit(True).alias("hot")))
    cool, asked, more = table, probes, None
    if not hot.isEmpty():
        table, probes = (join_lookup(rows.withColumn("ks", one), hot, "ks") for rows in (table, probes.select(*table.columns)))
        cool, asked = (rows.where("hot is null").drop("ks", "hot") for rows in (table, probes))
        members = table.union(probes).where("hot")
        sizes = stored(members.groupBy("ks").agg(F.count("*").alias("n")))
        more = _by_blocks(join_lookup(members, sizes, "ks"), MAX_BITS)
    # One join serves both: a table row meets its equals (each pair once) and its one-bit neighbours.
    wanted = asked.select("k", "s", "fp", F.lit(True).alias("flip")).union(cool.select("k", "s", "fp", F.lit(False)))
    near = (F.bit_count(F.col("t.fp").bitwiseXOR(F.col("q.fp"))) <= MAX_BITS) & (F.col("flip") | (F.col("q.fp") < F.col("t.fp")))
    on = (F.col("q.k") == F.col("t.k")) & (F.col("q.s") == F.col("t.s")) & near
    links = wanted.alias("q").join(cool.alias("t"), on).select(F.col("q.fp").alias("a"), F.col("t.fp").alias("b"))
    return links if more is None else links.union(more)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    parts = [np.unique(np.array(h, np.uint64)) for h in shingle_hashes(text, words)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _sketches(texts: list[str | None], words: int) -> pa.StructArray:
    """Fingerprint, name (64-bit digest) and size of the set of shingles, and a key for each band of its min-hashes."""
    prints, names, sizes, bands = [], [], [], []
    for t in texts:
        found = shingle_set(t, words)
        least = np.full(len(_FACTORS), 2**64 - 1, np.uint64)
        for i in range(0, len(found), 1024):
            np.minimum(least, (_FACTORS[:, None] * found[None, i : i + 1024]).min(1), out=least)
        raw = least.tobytes()
        prints.append(fingerprint(t))
        names.append(xxhash.xxh64_intdigest(found.tobytes()))
        sizes.append(len(found))
        bands.append(np.array([xxhash.xxh64_intdigest(raw[i : i + 8 * ROWS], i) for i in range(0, len(raw), 8 * ROWS)], np.uint64).view(np.int64))
    columns = [pa.array(prints, pa.int64()), pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
    return pa.StructArray.from_arrays(columns, ["fp", "x", "n", "bands"])


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Number of elements that each of the ``left`` sets shares with each of the ``right`` ones (positions in ``sets``)."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[code] > 1
    code, owner = (np.cumsum(times > 1) - 1)[code[shared]], owner[shared]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    both = np.zeros((len(left), len(right)))
    for start in range(0, int(code[-1]) + 1 if len(code) else 0, _COLUMNS):
        low, high = np.searchsorted(code, (start, start + _COLUMNS))
        has = np.zeros((len(sets), _COLUMNS), np.float32)
        has[owner[low:high], code[low:high] - start] = 1
        both += has[left] @ has[right].T
    return both


def _alike(table: pa.Table, similarity: float) -> pa.Table:
    """Links (a, b) of fingerprints that join the sets of two blocks just as all their similar pairs would."""
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    own, prints = table.column("own").to_numpy(), table.column("fp").to_numpy()
    sets = [np.frombuffer(h.as_buffer(), np.uint64) for h in table.column("h")]
    left, right = np.nonzero(own == i)[0], np.nonzero(own == j)[0]
    both, sizes = _overlaps(sets, left, right), np.array([len(s) for s in sets])
    near = both / (sizes[left][:, None] + sizes[right][None, :] - both) >= similarity
    a, b = np.nonzero(near)
    a, b = left[a], right[b]
    root, before = np.arange(len(sets)), None
    while before is None or (root != before).any():
        before = root.copy()
        np.minimum.at(root, a, before[b])
        np.minimum.at(root, b, before[a])
    far = np.nonzero(prints != prints[root])[0]
    return pa.table({"a": pa.array(prints[far], pa.int64()), "b": pa.array(prints[root[far]], pa.int64())})


def similar_links(df: DataFrame, sketched: DataFrame, text: str, key: str, similarity: float = SIMILARITY, words: int = SIMILAR_WORDS) -> DataFrame:
    """Links (a, b) of fingerprints that join all texts whose sets of shingles have a Jaccard similarity of ``similarity`` or more.

    SimHash can't find these: at 0.8 about ten of 64 bits differ, and a ball of that radius can't be enumerated. Sets that
    agree in a band of ROWS min-hashes are candidates. A pair at 0.8 agrees in none of the BANDS bands with probability
    (1 - 0.8^8)^40, 6 in 10^4, one at 0.85 with 3 in 10^6. Sets that hang together by candidates are compared on all
    their shingles, in blocks of PER_BLOCK sets or BLOCK_SHINGLES shingles, and each pair of blocks that has a candidate
    sends on a spanning forest of its links. So no list of pairs is made, however large a group of near copies is.
    """
    sets = sketched.where("n > 0").groupBy("x").agg(
        F.min("n").alias("n"), F.min("fp").alias("fp"), F.min(F.struct("id", "t")).alias("of"), F.min("bands").alias("bands"))
    sets = stored(sets)
    equal = sketched.where("n > 0").select("x", F.col("fp").alias("a")).distinct().join(sets.select("x", F.col("fp").alias("b")), "x").where("a <> b").select("a", "b")
    banded = sets.select("x", F.explode("bands").alias("s")).repartition("s")
    first = banded.groupBy("s").agg(F.min("x").alias("c"), F.max("x").alias("m")).where("c <> m").select("s", "c")
    crowded = stored(banded.join(first, "s"))
    hanging = components(crowded.select("x", "c"), "x", "c").select(F.col("node").alias("x"), "root")
    hanging = stored(hanging.join(sets.drop("bands"), "x"))
    weights = hanging.groupBy("root").agg(F.greatest(F.count("*") / PER_BLOCK, F.sum("n") / BLOCK_SHINGLES).alias("load"))
    own = F.pmod(F.xxhash64("x"), F.ceil("load")).cast("int").alias("own")
    placed = crowded.select("x", "s").join(hanging.select("x", "root").join(weights, "root").select("x", "root", own), "x")
    blocks = placed.select("s", F.col("own").alias("other")).distinct()
    cells = placed.join(blocks, "s").select("x", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).distinct()
    work = cells.join(_asked_sets(df, hanging, text, key, words), "x").select("root", "i", "j", "own", "fp", "h")
    return equal.union(work.groupBy("root", "i", "j").applyInArrow(lambda t: _alike(t, similarity), "a long, b long"))


def _asked_sets(df: DataFrame, hanging: DataFrame, text: str, key: str, words: int) -> DataFrame:
    """(x, fp, h): the shingles of each set once, however many rows of one id and text have it."""
    asked = hanging.select(F.col("of.id").alias("__id"), F.col("of.t").alias("__t"), "x", "fp")
    if asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    hashes = text_column(df.sparkSession, "binary", lambda: lambda texts: pa.array([shingle_set(t, words).tobytes() for t in texts], pa.binary()))
    texts = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    wanted = texts.join(asked, F.col("id").eqNullSafe(F.col("__id")) & (_text_name("text") == F.col("__t"))).select("x", "fp", hashes("text").alias("h"))
    # Repeats go before the shuffle by x, which the join with the cells then finds done.
    return wanted.groupBy("x").agg(F.first("fp").alias("fp"), F.first("h").alias("h"))


def _text_name(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def near_duplicate_groups(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float | None = None) -> DataFrame:
    """(key, fingerprint long, component_id): component_id is the smallest key reachable by links.

    With ``similarity``, texts whose five-word shingles are at least that similar (Jaccard) are linked as well.
    """
    docs = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    if similarity is None:
        prints = stored(simhash(docs, "text", "fp").select("id", "fp"))
    else:
        sketch = text_column(df.sparkSession, SKETCH, lambda: lambda texts: _sketches(texts, SIMILAR_WORDS))
        prints = stored(docs.select("id", _text_name("text").alias("t"), sketch("text").alias("s")).select("id", "t", "s.*"))
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    links = near_pairs(nodes, "fp")
    if similarity is not None:
        links = links.union(similar_links(df, prints, text, key, similarity))
    roots = components(links, "a", "b")
    linked = roots.join(nodes.select(F.col("fp").alias("node"), "least"), "node")
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.join(named, "root").select(F.col("node").alias("fp"), "component_id", F.lit(True).alias("linked"))
    groups = nodes.join(linked, "fp", "left").where("n > 1 or linked")
    groups = groups.select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("group_id"), F.lit(True).alias("found"))
    hot = nodes.where(F.col("n") * HOT_SHARE > nodes.agg(F.sum("n")).first()[0]) if not nodes.isEmpty() else nodes
    # Of a lone fingerprint nothing needs to be looked up.
    return join_hot(prints.select("id", "fp"), groups, "fp", hot, F.col("id")).select(
        F.col("id").alias(key), F.col("fp").alias("fingerprint"),
        F.when(F.col("found"), F.col("group_id")).otherwise(F.col("id")).alias("component_id"),
    )


def keep_one_of_each_group(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float | None = None) -> DataFrame:
    """``df`` without near-duplicates: of each group the row with the smallest key stays.

    Of several rows with that key the one with the least text stays (null first). Rows with a null key are
    compared by text: they go if their group holds a key, else one of each fingerprint stays.
    """
    groups = stored(near_duplicate_groups(df, key, text, similarity))
    # The keys that go are fewer than those that stay, and the texts need no shuffle while they are few.
    first = F.max(F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
    gone = groups.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(key)).agg(first.alias("first")).where("not first")
    gone = stored(gone.select(F.col(key), F.lit(True).alias("__gone")))
    kept = join_lookup(df, gone, key).where(F.col("__gone").isNull() & F.col(key).isNotNull()).select(*df.columns)
    if groups.groupBy(key).count().where((F.col("count") > 1) & F.col(key).isNotNull()).limit(1).count():
        kept = _first_rows(kept, key, text)
    if groups.where(F.col("component_id").isNull()).limit(1).count():
        bare = simhash(df.where(F.col(key).isNull()), text, "__fp")
        lone = groups.where(F.col("component_id").isNull()).select(F.col("fingerprint").alias("__fp")).distinct()
        kept = kept.union(_first_rows(bare.join(lone, "__fp", "left_semi"), "__fp", text).drop("__fp"))
    return kept


def _first_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """The first row of each key, by text and then by the other columns; only hashes are aggregated, not texts."""
    rank = F.struct(F.sha2(text, 256), F.xxhash64(*[F.col(c) for c in df.columns]))
    cols = df.columns
    least = df.groupBy(F.col(key).alias("__key")).agg(F.min(rank).alias("__least"))
    same = df.withColumn("__rank", rank).join(least, F.col(key) == F.col("__key")).where(F.col("__rank") == F.col("__least"))
    return same.dropDuplicates([key]).select(*cols)
