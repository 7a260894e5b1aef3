"""Run logs: ordered events of each run, as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ordered

EVENT = T.StructType([T.StructField("seq", T.IntegerType()), T.StructField("ts", T.TimestampType()), T.StructField("type", T.StringType()), T.StructField("url", T.StringType()), T.StructField("title", T.StringType()), T.StructField("similarity", T.DoubleType())])
RUN = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("region", T.StringType()), T.StructField("started_at", T.TimestampType()), T.StructField("finished_at", T.TimestampType()), T.StructField("stats", T.MapType(T.StringType(), T.LongType())), T.StructField("events", T.ArrayType(EVENT))])


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN).json(path, multiLine=True)


def numbered(events: DataFrame, run: str = "run_id", ts: str = "ts", tie: str = "type") -> DataFrame:
    """Events with their place in their run, which may have any number of them; ``tie`` tells events of one time apart."""
    return ordered.numbered(events, run, [ts, tie])


def save(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").partitionBy("region").json(path)


def events(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", "region", F.explode("events").alias("e")).select("run_id", "region", "e.*")
