"""Global shuffle of a table into shards of equal row counts, in two passes.

First pass: every record goes to a bucket by a seeded hash; buckets are as many as keep one in a task's memory.
Second pass: each bucket is put in one fixed order, shuffled by Fisher-Yates with a generator seeded by bucket,
and cut into shards. A record's place in the whole order is its bucket's first place and its place within, and
shard and slot follow from that, so counts differ by one at most. Reruns and lost tasks give the same order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlode.llm.common import free, small, workers_find_package
from reviewlode.session import land

SHARDS = 24
SEED = 20
BUCKET_BYTES = 24 * 1024 * 1024
# A record's size beyond its text.
RECORD_BYTES = 8


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A shuffle of ``range(n)``: every place from the last swaps with one at or before it."""
    order = np.arange(n)
    swaps = np.random.default_rng([seed, bucket]).integers(0, np.arange(1, n + 1))
    for i in range(n - 1, 0, -1):
        j = swaps[i]
        order[i], order[j] = order[j], order[i]
    return order


def shard_rows(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shards: int = SHARDS,
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` added.

    The law is ``rows``: row counts of shards differ by one at most, so ``grown_shard`` is null. Size counts
    UTF-8 bytes and ``RECORD_BYTES``; a null text has none and the checksum of an empty one. Records are
    scattered by a hash of id and text. Rows that repeat both are alike, so their order among themselves is
    open; if they are too many for a bucket, they are numbered and spread. An empty table gives no row. New
    columns whose names clash get underscores.
    """
    spark = docs.sparkSession
    made = {n: free(docs.columns, n) for n in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")}
    hidden = {n: free(docs.columns, f"shuffle_{n}") for n in ("bucket", "first", "print", "salt", "of")}
    whole = F.coalesce(F.col(text), F.lit(""))
    size, check = F.octet_length(whole).cast("long") + RECORD_BYTES, F.crc32(whole)
    prints = land(docs.select(size.alias("size"), F.xxhash64(F.col(key), check, F.lit(seed)).alias("print")), "records")
    n_buckets = max(1, -(-int(prints.agg(F.sum("size")).first()[0] or 0) // bucket_bytes))
    heavy = prints.groupBy("print").agg(F.sum("size").alias("size")).where(F.col("size") > bucket_bytes // 2)
    salt = F.lit(0)
    if not heavy.isEmpty():
        # So many equal rows would fill a bucket; a stored number per row tells them apart.
        docs = land(docs.withColumn(hidden["salt"], F.monotonically_increasing_id()), "numbered")
        salt = F.col(hidden["salt"])
    sized = docs.withColumn(made["size"], size).withColumn(made["text_crc32"], check)
    sized = sized.withColumn(hidden["print"], F.xxhash64(F.col(key), F.col(made["text_crc32"]), F.lit(seed)))
    turn = F.pmod(F.xxhash64(F.col(hidden["print"]), salt), F.lit(n_buckets))
    sized = sized.withColumn(hidden["bucket"], turn)
    counts = sized.groupBy(F.col(hidden["bucket"]).alias(hidden["of"])).agg(F.count(F.lit(1)).alias("n"))
    counts = land(counts, "buckets")
    before = Window.orderBy(hidden["of"]).rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(hidden["of"], F.coalesce(F.sum("n").over(before), F.lit(0)).alias(hidden["first"]))
    sized = sized.join(small(firsts), F.col(hidden["bucket"]) == F.col(hidden["of"])).drop(hidden["of"])
    place, first, bucket = free(sized.columns, "place"), hidden["first"], hidden["bucket"]
    columns = [c for c in sized.columns if c not in hidden.values()]
    ties = [hidden["print"], key, made["text_crc32"]]

    def shuffle(rows: pa.Table) -> pa.Table:
        number, start = rows.column(bucket)[0].as_py(), rows.column(first)[0].as_py()
        rows = rows.sort_by([(c, "ascending") for c in ties])
        rows = rows.take(pa.array(fisher_yates(rows.num_rows, seed, number)))
        places = pa.array(np.arange(start, start + rows.num_rows))
        return rows.select(columns).append_column(place, places)

    workers_find_package(spark)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.schema if f.name in columns)
    shuffled = sized.groupBy(bucket).applyInArrow(shuffle, f"{schema}, `{place}` bigint")
    at = F.col(place)
    return shuffled.select(
        *columns,
        F.lit("rows").alias(made["law"]),
        F.pmod(at, F.lit(shards)).cast("int").alias(made["shard"]),
        F.expr(f"`{place}` div {shards}").alias(made["slot"]),
        F.lit(None).cast("int").alias(made["grown_shard"]),
    )


def write_shards(docs: DataFrame, path: str, **options: int) -> None:
    """Write the shuffled rows to one folder per shard, in slot order."""
    rows = shard_rows(docs, **options)
    shard, slot = free(docs.columns, "shard"), free(docs.columns, "slot")
    rows.repartition(shard).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
