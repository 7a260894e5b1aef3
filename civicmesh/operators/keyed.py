"""Tables by key: changes rewrite the partitions of their keys' hashes and no others, each numbered batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import written

BUCKET, BATCHES = "__bucket", "_batches"
Merge = Callable[[DataFrame, DataFrame], DataFrame]


def upsert(keys: list[str]) -> Merge:
    """A change takes the place of the row with its keys; null keys are keys as well."""

    def merge(old: DataFrame, changes: DataFrame) -> DataFrame:
        new = changes.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        return old.join(new, same, "left_anti").unionByName(changes.select(*old.columns))

    return merge


class KeyedTable:
    """A Parquet table below ``path``, partitioned by the hash of ``keys`` into ``buckets`` parts.

    One writer at a time. A batch's rows are computed from the parts they touch, written aside, and then put in their place;
    its number is noted last. A batch that broke off is done again from the start, and one that was done changes nothing."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64, schema: T.StructType | None = None):
        """``schema``: of an existing table; without it the files are asked, which a table without rows does not answer."""
        self.spark, self.path, self.keys, self.buckets, self.schema = spark, path, keys, buckets, schema

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame) -> KeyedTable:
        """Writes all rows; a table that is there is an error."""
        rows.withColumn(BUCKET, self._bucket()).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/rows")
        self.schema = rows.schema
        return self

    def _stored(self) -> DataFrame:
        known = self.spark.read if self.schema is None else self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())]))
        return known.parquet(f"{self.path}/rows")

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def _at(self, place: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{place}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def done(self, number: int) -> bool:
        path, files = self._at(f"{BATCHES}/{number}")
        return files.exists(path)

    def apply(self, changes: DataFrame, merge: Merge | None = None, number: int | None = None) -> list[int]:
        """The buckets that were rewritten. ``merge(old, changes)`` gives the rows of the buckets that ``changes`` touches, by
        default with each change in place of its key's row; of several changes of a key, the caller decides before."""
        if number is not None and self.done(number):
            return []
        changes = written(changes.withColumn(BUCKET, self._bucket()), "changes")
        touched = sorted(r[BUCKET] for r in changes.select(BUCKET).distinct().collect())  # ``buckets`` numbers at most
        if touched:
            old = self._stored().where(F.col(BUCKET).isin(touched))
            new = (merge or upsert(self.keys))(old.drop(BUCKET), changes.drop(BUCKET))
            # aside first: a job must not overwrite what it reads
            aside = written(new.withColumn(BUCKET, self._bucket()).repartition(BUCKET), "aside")
            aside.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{self.path}/rows")
            full = {r[BUCKET] for r in aside.select(BUCKET).distinct().collect()}
            for bucket in touched:  # overwriting leaves alone what has no rows any more
                if bucket not in full:
                    path, files = self._at(f"rows/{BUCKET}={bucket}")
                    files.delete(path, True)
        if number is not None:
            path, files = self._at(f"{BATCHES}/{number}")
            files.mkdirs(path)
        return touched


def sink(table: KeyedTable, prepare: Callable[[DataFrame], DataFrame] = lambda batch: batch, merge: Merge | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that applies each batch of a stream once, also if the stream repeats it after a restart."""
    return lambda batch, number: table.apply(prepare(batch), merge, number) and None
