"""Many patterns at once: which texts contain which of any number of strings, by an automaton over all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import written

#: Bytes of patterns in one automaton at most (its nodes take some fifty times as much); more are split by their hash.
PART_BYTES = 8 << 20
HIT = "__hit"


def _parts(patterns: DataFrame, pattern: str) -> Iterator[list[str]]:
    """The distinct patterns in lists of about PART_BYTES, a list on the driver at a time; null is no pattern."""
    one = patterns.select(F.col(pattern).alias("p")).dropna().distinct()
    size = one.agg(F.sum(F.octet_length("p") + 1)).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    if parts > 1:
        one = written(one, "patterns")
    for k in range(parts):
        yield sorted(r["p"] for r in one.where(F.pmod(F.xxhash64("p"), F.lit(parts)) == k).collect())


def _finder(patterns: list[str]) -> Callable[[str], Iterator[str]]:
    """A function of a text that gives the patterns in it, each as often as it occurs; an empty one occurs once."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for p in patterns:
        if p:
            automaton.add_word(p, p)
    automaton.make_automaton()
    empty = [""] if "" in patterns else []

    def found(text: str) -> Iterator[str]:
        yield from empty
        if len(automaton):
            for _, p in automaton.iter(text):
                yield p

    return found


def matches(texts: DataFrame, patterns: DataFrame, text: str = "text", pattern: str = "pattern") -> DataFrame:
    """text and pattern of each text that contains a pattern, once for each distinct pattern and row. A null text contains none."""
    source = texts.select(F.col(text).alias("text")).dropna()
    schema = "text string, pattern string"
    out = None
    for part in _parts(patterns, pattern):

        def run(batches: Iterator[pa.RecordBatch], part: list[str] = part) -> Iterator[pa.RecordBatch]:
            found = _finder(part)
            for batch in batches:
                pairs = [(t, p) for t in batch.column(0).to_pylist() for p in sorted(set(found(t)))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*pairs, strict=True)] or [pa.array([], pa.string())] * 2, names=["text", "pattern"])

        one = source.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out


def found_in(rows: DataFrame, patterns: DataFrame, fields: list[str], id: str = "id", pattern: str = "pattern") -> DataFrame:
    """id, field (its place in ``fields``) and pattern of each row's field that contains a pattern, once for each distinct pattern. Rows are read
    once for each part of the patterns, stay where they are, and leave without their texts."""
    source = rows.select(F.col(id).alias("id"), *(F.col(f).alias(f"f{i}") for i, f in enumerate(fields)))
    schema = T.StructType([source.schema["id"], T.StructField("field", T.IntegerType()), T.StructField("pattern", T.StringType())])
    out = None
    for part in _parts(patterns, pattern):

        def run(batches: Iterator[pa.RecordBatch], part: list[str] = part) -> Iterator[pa.RecordBatch]:
            found = _finder(part)
            for batch in batches:
                for k in range(1, batch.num_columns):
                    sets = [sorted(set(found(t.as_py()))) if t.is_valid else [] for t in batch.column(k)]
                    at = pa.array([i for i, s in enumerate(sets) for _ in s], pa.int32())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([k - 1] * len(at), pa.int32()), pa.array([p for s in sets for p in s], pa.string())], names=["id", "field", "pattern"])

        one = source.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out


def containing(rows: DataFrame, patterns: DataFrame, text: str = "text", pattern: str = "pattern") -> DataFrame:
    """The rows whose text contains at least one pattern, columns unchanged. With several parts of patterns, rows are written between them."""
    out = rows.withColumn(HIT, F.lit(False))
    at = out.columns.index(text)
    schema = T.StructType([*rows.schema.fields, T.StructField(HIT, T.BooleanType())])
    first = True
    for part in _parts(patterns, pattern):

        def run(batches: Iterator[pa.RecordBatch], part: list[str] = part) -> Iterator[pa.RecordBatch]:
            found = _finder(part)
            for batch in batches:
                known, texts = batch.column(batch.num_columns - 1).to_pylist(), batch.column(at).to_pylist()
                hit = [k or (t is not None and next(found(t), None) is not None) for k, t in zip(known, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hit, pa.bool_())], schema=batch.schema)

        out = (out if first else written(out, "patterns-met")).mapInArrow(run, schema)
        first = False
    return out.where(HIT).drop(HIT)
