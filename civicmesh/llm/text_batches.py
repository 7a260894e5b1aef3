"""Arrow batches of texts, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are turned into Python objects at a time, and characters of one text that are split into words at a time.
PIECE_BYTES, CHUNK_CHARS = 1 << 20, 1 << 20
#: A single space between other characters: no pre-token of the tokenizers reaches over its left side.
_gap = regex.compile(r"(?<=\S) (?=\S)")


def chunks(text: str) -> Iterator[str]:
    """A text in parts of about CHUNK_CHARS, cut where every pre-tokenizer here cuts as well."""
    start = 0
    while len(text) - start > CHUNK_CHARS and (m := _gap.search(text, start + CHUNK_CHARS)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:] if start else text


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose texts have about PIECE_BYTES; a longer text is a slice by itself."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if size and size + n > PIECE_BYTES:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(df: DataFrame, text: str, added: list[T.StructField], make: Callable[[], Callable[[list[bytes] | list[str]], list[pa.Array]]], keep: list[str], binary: bool = False) -> DataFrame:
    """The columns ``keep`` and the ``added`` ones, which ``make()(texts)`` gives for a list of texts (null: empty).

    A kept column that has the name of an added one gives way to it. ``binary``: the texts come as UTF-8 bytes."""
    keep = [c for c in dict.fromkeys(keep) if c not in {f.name for f in added}]
    source = df.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary" if binary else "string").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            for piece in pieces(batch, batch.num_columns - 1):
                out = of(piece.column(piece.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], *out], names=[f.name for f in schema.fields])

    return source.mapInArrow(run, schema)
