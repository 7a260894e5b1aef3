"""The content archive: one table for each content type, partitioned by the day of fetching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_common = [T.StructField("id", T.StringType()), T.StructField("source_id", T.StringType()), T.StructField("content_hash", T.StringType()), T.StructField("fetched_at", T.TimestampType())]
_text = [T.StructField("text", T.StringType()), T.StructField("mentions", T.ArrayType(T.StringType())), T.StructField("hashtags", T.ArrayType(T.StringType()))]
_media = [T.StructField("permalink", T.StringType()), T.StructField("engagement", T.MapType(T.StringType(), T.DoubleType()))]

#: Schemas of the content types.
SCHEMAS: dict[str, T.StructType] = {
    "posts": T.StructType([*_common, *_text, *_media, T.StructField("author", T.StringType()), T.StructField("published_at", T.TimestampType())]),
    "stories": T.StructType([*_common, *_text, T.StructField("expires_at", T.TimestampType())]),
    "short_videos": T.StructType([*_common, *_text, *_media]),
    "long_videos": T.StructType([*_common, *_text, *_media, T.StructField("duration", T.DoubleType())]),
    "pages": T.StructType([*_common, T.StructField("markdown", T.StringType()), T.StructField("title", T.StringType()), T.StructField("links", T.ArrayType(T.StringType()))]),
    "feeds": T.StructType([*_common, T.StructField("items", T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("title", T.StringType())])))]),
    "search_results": T.StructType([*_common, T.StructField("query", T.StringType()), T.StructField("results", T.ArrayType(T.StringType()))]),
    "files": T.StructType([*_common, T.StructField("url", T.StringType()), T.StructField("mime_type", T.StringType()), T.StructField("text", T.StringType())]),
}


def append(df: DataFrame, root: str, kind: str) -> None:
    """Rows at the end of a content type's table; columns beyond its schema are refused, missing ones are null."""
    schema = SCHEMAS[kind]
    if extra := {*df.columns} - {*schema.names}:
        raise ValueError(f"no columns of {kind}: {sorted(extra)}")
    rows = df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
    rows.withColumn("fetched_date", F.to_date("fetched_at")).write.mode("append").partitionBy("fetched_date").parquet(f"{root}/{kind}")


def read(spark: SparkSession, root: str, kind: str) -> DataFrame:
    return spark.read.schema(T.StructType([*SCHEMAS[kind].fields, T.StructField("fetched_date", T.DateType())])).parquet(f"{root}/{kind}")


def recent(spark: SparkSession, root: str, kind: str, limit: int = 100) -> DataFrame:
    """The newest rows, 100 at most."""
    return read(spark, root, kind).orderBy(F.desc("fetched_at"), "id").limit(min(limit, 100))


def by_source(spark: SparkSession, root: str, kind: str, source_id: str, limit: int = 100) -> DataFrame:
    return read(spark, root, kind).where(F.col("source_id") == source_id).orderBy(F.desc("fetched_at"), "id").limit(limit)


def unseen(df: DataFrame, known: DataFrame, keys: tuple[str, ...] = ("source_id", "content_hash")) -> DataFrame:
    """Rows whose keys are not known yet, each once."""
    return df.dropDuplicates([*keys]).join(known.select(*keys).distinct(), [*keys], "left_anti")


def freshness(spark: SparkSession, root: str, kinds: tuple[str, ...] = tuple(SCHEMAS)) -> DataFrame:
    """When each source was last fetched, by content type."""
    out = None
    for kind in kinds:
        one = read(spark, root, kind).groupBy("source_id").agg(F.max("fetched_at").alias("last_scraped")).withColumn("content_type", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def report(df: DataFrame, path: str) -> None:
    """Rejected signals as JSON lines."""
    df.write.mode("overwrite").json(path)


def everything(tables: dict[str, DataFrame]) -> DataFrame:
    """All content types below each other, with ``kind``."""
    out = None
    for kind, df in tables.items():
        one = df.withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out
