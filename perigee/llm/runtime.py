"""Shared-folder handling, row locators and skew-safe lookups used by the operators of this package.

Whatever driver and executors exchange as files lies below ``spark.checkpoint.dir``; a folder of this
process's own is set only where that setting is missing, as in tests on one machine.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

#: A lookup of up to so many rows and bytes is sent to every executor; a larger one is joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
#: Rows that a key may have at least before its rows are dealt to several tasks.
HOT_ROWS = 64


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in the session, or one of this machine's own where none is set and all tasks run on it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="perigee-checkpoint-"))
        current = sc._jsc.sc().getCheckpointDir()
    return named or current.get()


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; the caller removes it with :func:`remove`."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; Spark's cleaner drops the files with the last reference."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Arrow batches of few rows while whole texts pass to Python: some are very long, and both sides hold a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def trim() -> None:
    """Give freed memory back to the system, where the C library can; else a worker keeps what it held at most."""
    with contextlib.suppress(OSError, AttributeError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def locator(df: DataFrame) -> Column | None:
    """Where a row's content lies: hash of the file's path and row index, if ``df`` reads files directly, else None.

    Paths are few and known to the driver, so it is checked there that their hashes differ.
    """
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        df.select(place)
    except AnalysisException:
        return None
    paths = set(df.inputFiles())
    if len({xxhash.xxh64_intdigest(p.encode(), 42) for p in paths}) < len(paths):
        raise ValueError("two input files have one path hash; rename one")
    return place


def shielded(df: DataFrame) -> tuple[list[Column], dict[str, str]]:
    """``df``'s columns under names that nothing here uses, and from old to new names."""
    names = {c: f"v{i}" for i, c in enumerate(df.columns)}
    return [F.col(f"`{c}`").alias(n) for c, n in names.items()], names


def restored(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(n).alias(c) for c, n in names.items()))


def located(df: DataFrame, work: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with shielded names and a column ``_at`` (file, row) that names each row, also among equal rows.

    A frame that doesn't read files directly is first written below ``work``.
    """
    columns, names = shielded(df)
    place = locator(df)
    if place is None:
        df.select(*columns).write.mode("overwrite").parquet(f"{work}/rows")
        df = df.sparkSession.read.parquet(f"{work}/rows")
        columns, place = list(names.values()), locator(df)
    return df.select(*columns, place.alias("_at")), names


def _bytes(df: DataFrame) -> Column:
    """About what a row takes: its strings and byte strings, and 16 bytes for each column."""
    long = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    return F.lit(16 * len(df.columns)) + sum(long, F.lit(0))


def is_small(keys: DataFrame) -> bool:
    """Whether ``keys`` (settled) stays under the bounds of a broadcast, by its own count."""
    n, size = keys.agg(F.count(F.lit(1)), F.sum(_bytes(keys))).first()
    return n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def small_enough(keys: DataFrame) -> DataFrame:
    """``keys`` (settled), marked for broadcast if a count shows that it is small; texts then stay where they are."""
    return F.broadcast(keys) if is_small(keys) else keys


def hot_keys(sizes: DataFrame, key: str, partitions: int) -> DataFrame:
    """(_hot, _copies) of the keys in ``sizes`` (key, n) with over a quarter of a task's share of all rows.

    There are fewer than four for each partition, whatever the data, so the result may be broadcast.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    share = max(HOT_ROWS, total // (4 * partitions))
    return sizes.where((F.col("n") > share) & F.col(key).isNotNull()).select(F.col(key).alias("_hot"), F.ceil(F.col("n") / share).cast("int").alias("_copies"))


def spread_join(rows: DataFrame, lookup: DataFrame, key: str, by: Sequence[str], how: str = "left", sizes: DataFrame | None = None) -> DataFrame:
    """Join on ``key`` where many rows may share one; ``lookup`` (settled) has each key at most once.

    A small lookup is broadcast. Else the rows of hot keys are dealt to several tasks by the hash of ``by`` and of their
    partition, which a repeated task finds alike, and only the lookup's rows of those keys are repeated. A null key
    finds nothing and goes to any task. ``sizes`` (key, n): how many rows have a key, if that is known already.
    """
    if is_small(lookup):
        return rows.join(F.broadcast(lookup), key, how)
    spark = rows.sparkSession
    sizes = settle(sizes if sizes is not None else rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")))
    hot = F.broadcast(settle(hot_keys(sizes, key, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    turn = F.xxhash64(*by) + F.spark_partition_id()
    salt = F.when(F.col(key).isNull(), turn).when(F.col("_copies").isNotNull(), F.pmod(turn, F.col("_copies"))).otherwise(F.lit(0))
    spread = rows.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", salt.cast("long")).drop("_hot", "_copies")
    copies = lookup.join(hot, F.col(key) == F.col("_hot"), "left")
    copies = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_copies", F.lit(1)).cast("long") - 1))).drop("_hot", "_copies")
    return spread.join(copies, [key, "_salt"], how).drop("_salt")


def released(out: DataFrame, work: str) -> DataFrame:
    """``out``, which may read rows that :func:`located` wrote: if there are any, it is settled and they go."""
    spark = out.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{work}/rows")
    if path.getFileSystem(conf).exists(path):
        out = settle(out)
    remove(spark, work)
    return out


def own(text: str = "text") -> Column:
    """A text column where null counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))
