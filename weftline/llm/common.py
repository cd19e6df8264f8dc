"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as a word wherever the operators speak of words (ASCII white space separates).
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a lookup table is broadcast after its rows have been counted.
BROADCAST_ROWS = 100_000
#: Texts in one Arrow batch at most, lest a batch of long ones fill the memory that JVM and worker share.
BATCH_ROWS = 500
#: A key with more than one in so many rows is hot; there can be no more hot keys than that.
HOT_SHARE = 1000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``.

    Where that is unset, a folder is used only on one machine (tests); a cluster of several has to name one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="weftline-checkpoint-"))
    drop_at_exit(spark, sc.getCheckpointDir())


def drop_at_exit(spark: SparkSession, folder: str) -> None:
    """Have ``folder``, which holds what this application has put there, removed when the application ends."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


def drop_folder(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession) -> None:
    """At most BATCH_ROWS rows go to a Python worker at a time; a lower number that somebody has set stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The name of a new folder in the shared checkpoint folder, which goes when the application ends."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    drop_at_exit(spark, folder)
    return folder


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` written to a folder of its own in the shared checkpoint folder and read again: compressed, and gone when the application ends.

    Unlike a checkpoint's, small parts are read several to a task, and ``folder`` can be dropped when no longer needed.
    """
    folder = folder or shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns whose names clash (in any letter case) with an operator's own output columns."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def with_fields(df: DataFrame, extra: str) -> T.StructType:
    """The schema of ``df`` followed by the fields of the DDL string ``extra``."""
    more = T.StructType.fromDDL(extra)
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in [*df.schema.fields, *more.fields]])


def small_slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of ``column`` in each hold about ``limit`` bytes (one row at least).

    A Python worker then holds a few megabytes of decoded text at a time, however long the texts are.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a column, null read as empty."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def text_column(spark: SparkSession, kind: str, work: Callable[[], Callable[[list[str | None]], pa.Array]], limit: int = 4 << 20):
    """A column function of texts: ``work()`` is called once a task and gives what turns a list of texts into an array of ``kind``.

    Only the text goes to the worker, about ``limit`` bytes at a time, and only the result comes back.
    """
    bound_batches(spark)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        turn = work()
        for batch in batches:
            parts = [turn(part.column(0).to_pylist()) for part in small_slices([pa.RecordBatch.from_arrays([batch], names=["text"])], "text", limit)]
            yield pa.concat_arrays(parts) if parts else turn([])

    # Else a condition on the result would be pushed below it and have every text read twice.
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind).asNondeterministic()


def append(batch: pa.RecordBatch, names: list[str], columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])


def join_lookup(left: DataFrame, lookup: DataFrame, on: str, limit: int = BROADCAST_ROWS, salts: int = 32) -> DataFrame:
    """Left join to a lookup table with one row per key (nulls match).

    Up to ``limit`` counted rows the table is broadcast; beyond that the left side is salted, and the
    lookup repeated once a salt, so that one hot key still spreads over ``salts`` tasks. The planner takes the repeated
    table for as small as the plain one, so it is told to merge; else all repeats would go through the driver.
    """
    key = f"__{on}_key"
    table = lookup.withColumnRenamed(on, key)
    if table.limit(limit + 1).count() <= limit:
        return left.join(F.broadcast(table), F.col(on).eqNullSafe(F.col(key)), "left").drop(key)
    salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    cols = [F.col(f.name) for f in left.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    spread = left.withColumn("__row_salt", F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int"))
    on_both = F.col(on).eqNullSafe(F.col(key)) & (F.col("__row_salt") == F.col("__salt"))
    return spread.join(salted.hint("merge"), on_both, "left").drop(key, "__salt", "__row_salt")


def join_hot(left: DataFrame, lookup: DataFrame, on: str, hot: DataFrame, salt: Column, salts: int = 32) -> DataFrame:
    """Left join to a lookup table with one row per key; ``hot`` holds keys that each have over 1 / HOT_SHARE of the rows.

    There are HOT_SHARE of these at most, so they are broadcast; ``left`` is salted by ``salt`` for them alone, and only
    their rows of the lookup are repeated.
    """
    mark = F.broadcast(hot.select(on).distinct().withColumn("__hot", F.lit(True)))
    spread = left.join(mark, on, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(salt), F.lit(salts))).otherwise(0).cast("int"))
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    table = lookup.join(mark, on, "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    return spread.drop("__hot").join(table, [on, "__salt"], "left").drop("__salt")
