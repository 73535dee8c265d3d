"""Exact deduplication by a streaming query with keyed, disk-backed state that never expires.

Rows are landed as (identifier, SHA-256, content locator) and streamed through a keyed aggregation
whose RocksDB state keeps, for every digest seen, the largest identifier with its locator and the
number of hits. Texts aren't in the state: the content of all hits is read again and compared byte
for byte (it is the grouping key), and digests that hold several texts are resolved by text.

Defined results: null texts count as empty; a null identifier is below every other; of equal rows
(same identifier and text) the one that lies last stays; very long texts are digested and compared whole, and aren't in the
state; an empty table gives an empty result;
columns other than the two named ones are ignored by :func:`exact_dedup` and kept by :func:`drop_exact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import located, own, released, remove, restored, settle, small_enough, spread_join, work_dir

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": _ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    # Else every partition's store sets some megabytes of disk aside, however little it holds.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    # Else every partition's store keeps four threads and their memory; the state is read back by the run that wrote it.
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
}


def _run_state(spark: SparkSession, landing: str, key: Column, work: str, batch_bytes: int) -> DataFrame:
    """Stream the landed rows through the keyed state; of the keys hit more than once: digest, keep (id, at), hits."""
    saved = {k: spark.conf.get(k, None) for k in _STATE_CONF}
    for k, v in _STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(spark.read.parquet(landing).schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(landing)
        state = stream.groupBy(key.alias("digest")).agg(F.max(F.struct("id", "at")).alias("keep"), F.count(F.lit(1)).alias("hits"))
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        rows = spark.read.format("statestore").load(f"{work}/state")
        (name,), value = rows.schema["key"].dataType.names, rows.schema["value"].dataType.names
        return settle(rows.select(F.col(f"key.`{name}`").alias("digest"), F.col(f"value.`{value[0]}`").alias("keep"), F.col(f"value.`{value[1]}`").alias("hits")).where("hits > 1"))
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _decide(docs: DataFrame, id_col: str, text_col: str, work: str, digest_bytes: int, batch_bytes: int) -> tuple[DataFrame, dict[str, str], DataFrame]:
    """The located rows with their names, and per row: at, id, sha, keep (id, at), hits."""
    spark = docs.sparkSession
    rows, names = located(docs, work)
    id_col, text_col = names[id_col], names[text_col]
    sha = F.unhex(F.sha2(own(text_col), 256))
    rows.select(F.col(id_col).alias("id"), sha.alias("sha"), F.col("_at").alias("at")).write.parquet(f"{work}/landing")
    landed = spark.read.parquet(f"{work}/landing")
    if landed.isEmpty():
        return rows, names, landed.withColumns({"keep": F.struct("id", "at"), "hits": F.lit(1).cast("long")})
    key = F.substring("sha", 1, digest_bytes)
    state = _run_state(spark, f"{work}/landing", key, work, batch_bytes)
    # Full bytes of all hits: the text itself is the grouping key, so a hot text leaves one row per task.
    hits = rows.select(own(text_col).alias("text")).withColumn("digest", F.substring(F.unhex(F.sha2("text", 256)), 1, digest_bytes)).join(small_enough(state.select("digest")), "digest", "left_semi")
    texts = hits.groupBy("text").agg(F.first("digest").alias("digest"))
    mixed = settle(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1"))
    found = spread_join(landed.withColumn("digest", key), state, "digest", ["at"], sizes=state.select("digest", F.col("hits").alias("n")))
    if not mixed.isEmpty():
        # Several texts under one digest: group those rows by their bytes.
        odd = rows.select(F.col("_at").alias("at"), F.col(id_col).alias("id"), own(text_col).alias("text")).withColumn("digest", F.substring(F.unhex(F.sha2("text", 256)), 1, digest_bytes)).join(mixed.select("digest"), "digest", "left_semi")
        by_text = settle(odd.groupBy("text").agg(F.max(F.struct("id", "at")).alias("true_keep"), F.count(F.lit(1)).alias("true_hits")))
        true = spread_join(odd, by_text, "text", ["at"], "inner", by_text.select("text", F.col("true_hits").alias("n"))).select("at", "true_keep", "true_hits")
        found = found.join(true, "at", "left").withColumns({"keep": F.coalesce("true_keep", "keep"), "hits": F.coalesce("true_hits", "hits")}).drop("true_keep", "true_hits")
    return rows, names, found.select("at", "id", "sha", F.coalesce("keep", F.struct("id", "at")).alias("keep"), F.coalesce("hits", F.lit(1).cast("long")).alias("hits"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32, batch_bytes: int = 8 << 30) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``digest_bytes`` shortens the digest that keys the state; results stay exact for any length.
    ``batch_bytes`` bounds what one micro-batch takes of the landed rows.
    """
    spark = docs.sparkSession
    work = work_dir(spark, "exact")
    _, _, found = _decide(docs, id_col, text_col, work, digest_bytes, batch_bytes)
    out = settle(
        found.select(
            F.col("id").alias("doc_id"),
            F.col("keep.id").alias("keep_id"),
            F.col("hits").alias("group_size"),
            (F.col("at") == F.col("keep.at")).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )
    remove(spark, work)
    return out


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32, batch_bytes: int = 8 << 30) -> DataFrame:
    """``docs`` without the rows whose text a kept row already has; all columns as they came."""
    spark = docs.sparkSession
    work = work_dir(spark, "exact")
    rows, names, found = _decide(docs, id_col, text_col, work, digest_bytes, batch_bytes)
    dropped = settle(found.filter(F.col("at") != F.col("keep.at")).select(F.col("at").alias("_at")))
    return released(restored(rows.join(small_enough(dropped), "_at", "left_anti"), names), work)
