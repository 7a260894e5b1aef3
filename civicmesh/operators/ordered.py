"""Ordered folds: positions, running sums, trailing counts and rate limits of groups of any size.

Rows are sorted over all tasks by group and order, so a group with very many rows lies in many partitions; what a
partition needs to know of those before it is a few numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed

PART = "__part"


def ranged(df: DataFrame, by: str, order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` sorted by group and order over ``parts`` partitions (as many as shuffles have), checkpointed, with each row's partition."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(parts, by, *order).sortWithinPartitions(by, *order).withColumn(PART, F.spark_partition_id()))


def running(df: DataFrame, by: str, order: list[str], value: Column, name: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over a group's rows up to this one. ``order`` must tell rows of a group apart.

    Sums run within partitions; the sums of whole partitions before, a row for each partition of a group, are added. Null is a group as well."""
    rows = ranged(df.withColumn("__v", value), by, order, parts)
    within = Window.partitionBy(PART, by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("__by").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(F.col(by).alias("__by"), F.col(PART).alias("__p")).agg(F.sum("__v").alias("__s"))
    before = sums.select("__by", "__p", F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__before"))
    local = rows.withColumn("__local", F.sum("__v").over(within))
    joined = local.join(before, (F.col(PART) == F.col("__p")) & F.col(by).eqNullSafe(F.col("__by")))
    return joined.withColumn(name, F.col("__local") + F.col("__before")).drop(PART, "__v", "__local", "__before", "__by", "__p")


def numbered(df: DataFrame, by: str, order: list[str], name: str = "seq", parts: int | None = None) -> DataFrame:
    """``df`` with each row's place in its group, from zero."""
    return running(df, by, order, F.lit(1), "__n", parts).withColumn(name, (F.col("__n") - 1).cast("int")).drop("__n")


def trailing_counts(df: DataFrame, by: str, at: str, key: str, span: int, name: str = "n", parts: int | None = None) -> DataFrame:
    """``by``, ``key`` and ``name``: the rows of a group with ``at`` (a whole number) from ``span`` before a row's to the row's own, ties included.

    Each row asks twice, before the first row that counts and behind the last; a running count over rows and questions answers."""
    ask = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), (F.col(at) - back).alias("at")) for k, back in ((0, span), (1, 0), (2, 0)))))
    rows = df.select(by, key, ask.alias("q")).select(by, key, "q.kind", F.col("q.at").alias("__at"))
    counted = running(rows, by, ["__at", "kind", key], (F.col("kind") == 1).cast("long"), "__c", parts)
    sign = F.when(F.col("kind") == 2, F.col("__c")).when(F.col("kind") == 0, -F.col("__c")).otherwise(0)
    return counted.groupBy(by, key).agg(F.sum(sign).alias(name))


def rate_limited(events: DataFrame, limit: int, seconds: int, parts: int | None = None) -> DataFrame:
    """user_id, event_id and allowed: an event passes if fewer than ``limit`` of its user passed in the ``seconds`` before it (ties by event_id).

    What passes depends on what passed before: a partition needs the last ``limit`` times that its first user passed before it.
    Partitions are folded without them first. Only where one user fills a whole partition does what it hands on depend on what it
    was handed; such partitions are folded again while that changes. Two histories meet as soon as they pass the same events, so a
    few rounds do; at worst there is one for each partition that a user fills. The driver holds ``limit`` times a partition."""
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    rows = ranged(events.select("user_id", "event_id", at), "user_id", ["at", "event_id"], parts)
    window = seconds * 1_000_000

    def folded(passed: list[int], times: list[int]) -> list[bool]:
        out = []
        for when in times:
            while passed and passed[0] <= when - window:
                passed.pop(0)
            out.append(len(passed) < limit)
            if out[-1]:
                passed.append(when)
        return out

    def walk(batches: Iterator[pd.DataFrame], handed: dict[int, list[int]]) -> Iterator[tuple[pd.DataFrame, list[bool], tuple]]:
        """Each batch with its answers and (first user, last user, what the last one hands on, single)."""
        user, first, passed, single, started = None, None, [], True, False
        for batch in batches:
            if not len(batch):
                continue
            out: list[bool] = []
            runs = batch["user_id"].ne(batch["user_id"].shift()) & ~(batch["user_id"].isna() & batch["user_id"].shift().isna())
            bounds = sorted({0, *runs.to_numpy().nonzero()[0].tolist(), len(batch)})
            for start, end in zip(bounds, bounds[1:], strict=False):
                who = batch["user_id"].iloc[start]
                who = None if pd.isna(who) else int(who)
                if not started:
                    first, passed, started = who, list(handed.get(int(batch[PART].iloc[0]), [])), True
                elif who != user:
                    passed, single = [], False
                user = who
                out += folded(passed, batch["at"].iloc[start:end].tolist())
            yield batch, out, (first, user, list(passed), single)

    def ends_of(handed: dict[int, list[int]], only: set[int] | None) -> dict[int, tuple]:
        def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last = None
            for batch, _, end in walk(batches, handed):
                last = (int(batch[PART].iloc[0]), *end)
            if last:
                yield pd.DataFrame({"part": [last[0]], "first": pd.array([last[1]], dtype="Int64"), "last": pd.array([last[2]], dtype="Int64"), "passed": [last[3]], "single": [last[4]]})

        schema = "part int, first long, last long, passed array<long>, single boolean"
        source = rows if only is None else rows.where(F.col(PART).isin(sorted(only)))
        return {r["part"]: (r["first"], r["last"], r["passed"], r["single"]) for r in source.mapInPandas(ends, schema).collect()}

    ends = ends_of({}, None)
    handed: dict[int, list[int]] = {}
    order = sorted(ends)
    while True:
        changed = set()
        for before, part in zip(order, order[1:], strict=False):
            now = ends[before][2] if ends[before][1] == ends[part][0] else []
            if now != handed.get(part, []):
                handed[part] = now
                if ends[part][3]:
                    changed.add(part)
        if not changed:
            break
        ends.update(ends_of(handed, changed))

    def answered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, out, _ in walk(batches, handed):
            yield pd.DataFrame({"user_id": batch["user_id"], "event_id": batch["event_id"], "allowed": out})

    return rows.mapInPandas(answered, "user_id long, event_id long, allowed boolean")
