from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from civicmesh.operators import ordered

START = datetime(2024, 1, 1)


def events(seed, n, users, span, hot=0.7):
    """A hot user, some others, one without id; equal times; users in any order."""
    rng = np.random.default_rng(seed)
    who = [0 if rng.random() < hot else None if (u := int(rng.integers(users))) == users - 1 else u for _ in range(n)]
    return [(u, i, START + timedelta(seconds=int(rng.integers(span)))) for i, u in enumerate(who)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp").repartition(3)


def groups(rows):
    out = {}
    for u, i, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        out.setdefault(u, []).append((i, int((ts - START).total_seconds())))
    return out


def plain_limit(rows, limit, seconds):
    out = {}
    for of in groups(rows).values():
        passed = []
        for i, at in of:
            passed = [p for p in passed if p > at - seconds]
            out[i] = len(passed) < limit
            if out[i]:
                passed.append(at)
    return out


def test_numbers_sums_and_trailing_counts_of_a_user_over_many_partitions(spark):
    rows = events(1, 900, 12, 400)
    df = frame(spark, rows)
    spread = ordered.ranged(df, "user_id", ["ts", "event_id"], 16)
    assert spread.where("user_id = 0").select(ordered.PART).distinct().count() >= 8  # no task has the hot user whole
    seq = {r.event_id: r.seq for r in ordered.numbered(df, "user_id", ["ts", "event_id"], parts=16).collect()}
    spent = {r.event_id: r.spent for r in ordered.running(df, "user_id", ["ts", "event_id"], F.col("event_id") % 7, "spent", 16).collect()}
    counts = ordered.trailing_counts(df.withColumn("at", F.unix_seconds("ts")), "user_id", "at", "event_id", 60, "n", 16)
    n = {r.event_id: r.n for r in counts.collect()}
    assert len(seq) == len(spent) == len(n) == len(rows)
    for of in groups(rows).values():
        total = 0
        for k, (i, at) in enumerate(of):
            total += i % 7
            assert (seq[i], spent[i]) == (k, total)
            assert n[i] == sum(at - 60 <= x <= at for _, x in of)


@pytest.mark.parametrize("limit, seconds, span", [(1, 10, 3000), (2, 60, 3000), (3, 5, 900), (5, 1, 200), (2, 5000, 3000)])
def test_rate_limits_of_a_user_over_many_partitions(spark, limit, seconds, span):
    rows = events(limit, 800, 6, span, hot=0.85)
    got = {r.event_id: r.allowed for r in ordered.rate_limited(frame(spark, rows), limit, seconds, 12).collect()}
    assert got == plain_limit(rows, limit, seconds)


def test_histories_that_never_meet_take_a_round_for_each_partition(spark):
    rows = [(1, i, START + timedelta(seconds=i)) for i in range(400)]  # every third passes, wherever one begins
    got = {r.event_id: r.allowed for r in ordered.rate_limited(frame(spark, rows), 1, 3, 8).collect()}
    assert got == plain_limit(rows, 1, 3)


def test_no_events(spark):
    df = frame(spark, [])
    assert ordered.rate_limited(df, 2, 60).count() == 0
    assert ordered.numbered(df, "user_id", ["ts"]).count() == 0
    assert ordered.trailing_counts(df.withColumn("at", F.unix_seconds("ts")), "user_id", "at", "event_id", 60).count() == 0
