"""Token totals by source, language and tokenizer version, maintained from signed changes.

A change inserts, deletes or revises a document's count. Each becomes one or two signed rows; their sums per
group are the batch's delta, which is all that is stored. Totals are the sum of all deltas, so batches may
come in any order. A batch is committed under its id in one step: a second commit of the id is skipped, and one
that failed half-way left no commit mark and is written anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GROUPS = ("source", "lang", "tokenizer")
MEASURES = ("n_docs", "n_tokens", "n_bytes")
DELTA = T.StructType(
    [T.StructField(g, T.StringType()) for g in GROUPS] + [T.StructField(m, T.LongType()) for m in MEASURES]
)


def signed(changes: DataFrame) -> DataFrame:
    """Signed rows of changes: (op, source, lang, tokenizer, n_tokens, n_bytes, and ``old_`` forms of these).

    ``insert`` adds the row, ``delete`` takes it away, ``revise`` takes the old values away and adds the new
    ones, which may lie in another group. Other ops and null ones are errors. Null counts are 0, null groups
    are groups. Repeated changes count as often as they are there.
    """

    def side(sign: int, prefix: str) -> Column:
        counts = [F.coalesce(F.col(f"`{prefix}{m}`").cast("long"), F.lit(0)) * sign for m in MEASURES[1:]]
        return F.struct(
            *[F.col(f"`{prefix}{g}`").cast("string").alias(g) for g in GROUPS],
            F.lit(sign).cast("long").alias(MEASURES[0]),
            *[c.alias(m) for c, m in zip(counts, MEASURES[1:], strict=True)],
        )

    op = F.lower("op")
    rows = (
        F.when(op == "insert", F.array(side(1, "")))
        .when(op == "delete", F.array(side(-1, "")))
        .when(op == "revise", F.array(side(-1, "old_"), side(1, "")))
        .otherwise(F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("op", F.lit("null")))))
    )
    return changes.select(F.explode(rows).alias("row")).select("row.*")


def delta(changes: DataFrame) -> DataFrame:
    """Sums of the signed rows per group; groups that cancel out are left out."""
    sums = signed(changes).groupBy(*GROUPS).agg(*[F.sum(m).alias(m) for m in MEASURES])
    return sums.where(" or ".join(f"{m} <> 0" for m in MEASURES))


class Rollup:
    """Totals in a folder of committed deltas; the folder may be in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False when it has been committed before. ``batch`` names a folder."""
        if not batch or any(c in batch for c in "/=\\:*?"):
            raise ValueError(f"not a batch id: {batch!r}")
        folder = f"{self.path}/batch={batch}"
        if self._exists(f"{folder}/_SUCCESS"):
            return False
        # The number of groups is small beside the changes; the mark is written last.
        delta(changes).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(folder)
        return True

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        if not self._exists(self.path):
            return []
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        listed = root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(root)
        names = [x.getPath().getName() for x in listed]
        return sorted(
            n.removeprefix("batch=") for n in names if n.startswith("batch=") and self._exists(f"{self.path}/{n}/_SUCCESS")
        )

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens, n_bytes) over all committed batches.

        Groups whose documents have all gone are left out; without a batch the table is empty.
        """
        folders = [f"{self.path}/batch={b}" for b in self.batches()]
        if not folders:
            return self.spark.createDataFrame([], DELTA)
        rows = self.spark.read.schema(DELTA).parquet(*folders)
        sums = rows.groupBy(*GROUPS).agg(*[F.sum(m).alias(m) for m in MEASURES])
        return sums.where(" or ".join(f"{m} <> 0" for m in MEASURES))
