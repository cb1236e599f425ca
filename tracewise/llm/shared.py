"""Scratch tables in the cluster's shared folder, and column helpers used by several operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One class of white space for every operator here: blank, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"

#: Scratch tables that this process wrote: the only ones that release() may drop. Who drops the rest is told by collected().
_mine: set[str] = set()
_collector: ContextVar[list[str] | None] = ContextVar("collector", default=None)


@contextmanager
def collected():
    """The paths of the scratch tables written inside. Who opens this drops them, once nothing reads them any more; other callers' tables aren't among them."""
    out: list[str] = []
    token = _collector.set(out)
    try:
        yield out
    finally:
        _collector.reset(token)


def collecting() -> bool:
    return _collector.get() is not None


@cache
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tracewise-')}"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where that is unset on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own_folder()


#: Setting by which Spark removes an action's shuffle files when the action ends, not when the driver's garbage goes.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting of the session for the actions inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def shuffles_dropped(spark: SparkSession):
    """For actions whose plan isn't run again: their shuffle files go with them."""
    return setting(spark, CLEAN_UP, "true")


def batches_of(spark: SparkSession, rows: int):
    """For actions whose rows may be long: how many go to a Python worker at a time."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def settle(spark: SparkSession) -> None:
    """Let go of what finished actions left: Spark drops their broadcasts on executors, and their plans and records of tasks, once the driver has collected them as garbage."""
    gc.collect()
    spark._jvm.System.gc()


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, which cuts the lineage.

    Row order and partition ids of a recomputed plan don't matter after this: lost
    executors re-read files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    _mine.add(path)
    if collecting():
        _collector.get().append(path)
    settle(spark)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _mine.discard(path)


def release(*stored: DataFrame) -> None:
    """Drop stored tables ahead of the rest, so that they don't stand on disk beside later ones. Nothing may read them after this, lazy plans included."""
    for df in stored:
        names = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
        for path in [p for p in _mine if p.rsplit("/", 1)[-1] in names]:
            drop(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, use) -> Column:
    """use(value) with value computed once per row, though use mentions it many times.

    Projections that are merged would copy the expression to each mention; a lambda's
    variable isn't copied.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def boxed(df: DataFrame, **own: Column) -> DataFrame:
    """df's rows as one struct `row`, beside the columns named here: so no name inside an operator meets one of the input's."""
    return df.select(F.struct(*(F.col(quoted(c)) for c in df.columns)).alias("row"), *(c.alias(n) for n, c in own.items()))


def unboxed(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The input's columns, then the new ones. A new column replaces one of the input's that has its name, in its place."""
    at = {n.lower(): n for n in new}
    kept = [new[at[c.lower()]].alias(at[c.lower()]) if c.lower() in at else F.col(f"row.{quoted(c)}") for c in columns]
    had = {c.lower() for c in columns}
    return df.select(*kept, *(c.alias(n) for n, c in new.items() if n.lower() not in had))


#: Bits per key of a filter over keys, and the most bits: 8 MB, or a million rows of a broadcast table.
BITS_PER_KEY = 16
MOST_BITS = 1 << 26


def with_hit(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """df with _hit: whether its column key may be among keys; a key that is among them always hits.

    The filter has BITS_PER_KEY bits for each row of keys (count them where they are stored),
    MOST_BITS at most. It is broadcast as a table of 64-bit words: as a constant it would be
    printed in every plan that the driver keeps. Past MOST_BITS more rows pass than need be,
    which costs shuffled rows, not results: an exact join follows each filter.
    """
    bits = min(MOST_BITS, 1 << max(12, (BITS_PER_KEY * keys.count()).bit_length()))
    bit = F.pmod(F.xxhash64(F.lit(3), F.col(key)), F.lit(bits))
    place = F.pmod(bit, F.lit(64)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), place)
    found = keys.select(F.shiftright(bit, 6).cast("int").alias("_at"), one.alias("w")).groupBy("_at").agg(F.bit_or("w").alias("_word"))
    both = df.withColumn("_at", F.shiftright(bit, 6).cast("int")).join(F.broadcast(store(found, "bits")), "_at", "left")
    hit = F.call_function("shiftrightunsigned", F.col("_word"), place).bitwiseAND(F.lit(1)) == 1
    return both.withColumn("_hit", F.coalesce(hit, F.lit(False))).drop("_at", "_word")


def hits(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return with_hit(df, keys, key).where("_hit").drop("_hit")


def words(text: Column) -> Column:
    """Words of a text: maximal runs without blank, tab to carriage return. Null gives no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def spread(spark: SparkSession, least: int = 8) -> int:
    """How many salts to deal one hot key to: as many as there are shuffle partitions."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
