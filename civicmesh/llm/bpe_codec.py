"""BPE encoding and decoding (3): speculate and verify.

Distinct words of a batch get their tokens by greedy longest match; one vectorised test over all adjacent
pairs finds the words whose proposal ordinary merging would not give, and only those are merged exactly.
``merges`` has the tables and the argument why a proposal without a clash is the encoding.

Texts are cut as the vocabulary's file says: special strings first, then NFC, lower case and the word
pattern, by the library's own version of Unicode (``library_text``); white space goes. Null and empty texts have no tokens and decode to the empty text. The longest
texts are cut into parts at single spaces, so a text's words are never all in memory at once.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .library_text import Differences, differences
from .merges import MergeTable, table_for
from .text_batches import chunks, map_texts

#: Fixed value: the word pattern of the vocabulary's file.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
#: The same for texts of ASCII and accented Latin letters, without a look-up of properties.
LATIN_WORDS = re.compile(r"[a-zA-Zß-öø-ÿÀ-ÖØ-Þ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s0-9a-zA-Zß-öø-ÿÀ-ÖØ-Þ]+", re.ASCII)
NOT_LATIN = re.compile("[^\t-\r -~ß-öø-ÿÀ-ÖØ-Þ]")
#: Distinct words that a worker remembers; beyond it forgets them all and goes on.
REMEMBERED = 120_000


def vocabulary(path: str) -> tuple[str, str]:
    """A vocabulary file's name and JSON text, read on the driver (files are a few MB at most)."""
    with open(path, encoding="utf-8") as f:
        return path, f.read()


def normalize(text: str) -> str:
    """NFC and lower case, letter by letter: a final capital sigma has no form of its own."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def split_words(text: str, odd: Differences) -> list[str]:
    """The normalized text's words."""
    if not text.isascii() and odd.any.search(text):
        text = odd.composed(text).replace("Σ", "σ").translate(odd.small).lower()
        return [text[slice(*m.span())] for m in WORDS.finditer(text.translate(odd.classes))]
    text = normalize(text)
    return WORDS.findall(text) if NOT_LATIN.search(text) else LATIN_WORDS.findall(text)


class Encoder:
    """Token ids of texts, with what a worker remembers about words."""

    def __init__(self, table: MergeTable, odd: Differences):
        self.table, self.odd, self.known = table, odd, {}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(table.special, key=len, reverse=True))) + ")") if table.special else None

    def words(self, text: str) -> Iterator[list[str]]:
        """Lists of words; a special string is a list of itself alone."""
        for part in chunks(text):
            if not any(map(part.__contains__, self.table.special)):
                yield split_words(part, self.odd)
                continue
            for i, run in enumerate(self.split.split(part)):
                if run:
                    yield [run] if i % 2 else split_words(run, self.odd)

    def learn(self, words: list[str]) -> None:
        known = self.known
        new = [w for w in {*words} if w not in known]
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list({*words})
            known.update((w, tuple(t)) for w, t in zip(new, self.table.encode(new), strict=True))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out, special = [], self.table.special
        held = [[*self.words(t)] if len(t) < 1 << 16 else None for t in texts]
        self.learn([w for lists in held if lists for ws in lists for w in ws if len(ws) > 1 or w not in special])
        for text, lists in zip(texts, held, strict=True):
            parts = []
            for ws in lists if lists is not None else self.words(text):
                if len(ws) == 1 and ws[0] in special:
                    parts.append(np.array([special[ws[0]]], np.int32))
                    continue
                try:
                    got = [*chain.from_iterable(map(self.known.__getitem__, ws))]
                except KeyError:
                    self.learn(ws)
                    got = [*chain.from_iterable(map(self.known.__getitem__, ws))]
                parts.append(np.array(got, np.int32))
            out.append(parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.int32))
        return out


class Decoder:
    """Texts of token ids: the tokens' strings joined by spaces, as the vocabulary's file names no decoder.
    Ids outside the vocabulary give nothing."""

    def __init__(self, table: MergeTable):
        self.strings = np.array(table.strings, object)

    def __call__(self, ids: np.ndarray) -> str:
        inside = ids[(ids >= 0) & (ids < len(self.strings))] if len(ids) and (ids.min() < 0 or ids.max() >= len(self.strings)) else ids
        return " ".join(self.strings[inside].tolist())


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32()))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` without ``text``, with an array of token ids and, if ``decoded`` names a column, the text that the ids decode to.

    Other columns pass through; ones named ``ids`` or ``decoded`` give way. Rows, repeated ones too, stay as they are."""
    name, data = vocabulary(path)
    shared = df.sparkSession.sparkContext.broadcast((data, differences()))
    added = [T.StructField(ids, T.ArrayType(T.IntegerType(), False))] + [T.StructField(decoded, T.StringType())] * bool(decoded)

    def make():
        table = table_for(name, shared.value[0])
        encoder, decoder = Encoder(table, shared.value[1]), Decoder(table)

        def of(texts: list[str]) -> list[pa.Array]:
            got = encoder(texts)
            return [_lists(got)] + ([pa.array([decoder(x) for x in got], pa.string())] if decoded else [])

        return of

    return map_texts(df, text, added, make, [c for c in df.columns if c != text])


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``df`` without ``ids``, with the text that they decode to; null ids give the empty text, null elements nothing."""
    name, data = vocabulary(path)
    shared = df.sparkSession.sparkContext.broadcast(data)
    keep = [c for c in df.columns if c not in (ids, text)]
    source = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{ids}`").cast("array<int>").alias("__ids"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(table_for(name, shared.value))
        for batch in batches:
            texts = [decoder(np.array([x for x in row or () if x is not None], np.int64)) for row in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[f.name for f in schema.fields])

    return source.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` without ``text``, with n_tokens, and the SHA-256 of the ids (decimal, one space between) and of the text that they decode to.

    Encoded and decoded in one task, so neither ids nor decoded texts leave it. Other columns pass through; ones of these names give way."""
    name, data = vocabulary(path)
    shared = df.sparkSession.sparkContext.broadcast((data, differences()))
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def make():
        table = table_for(name, shared.value[0])
        encoder, decoder = Encoder(table, shared.value[1]), Decoder(table)
        numbers = np.array([*map(str, range(table.size))], object)

        def of(texts: list[str]) -> list[pa.Array]:
            got = encoder(texts)
            spelled = (" ".join(numbers[x].tolist()) for x in got)
            sha = lambda strings: pa.array([hashlib.sha256(s.encode()).hexdigest() for s in strings], pa.string())
            return [pa.array([len(x) for x in got], pa.int64()), sha(spelled), sha(map(decoder, got))]

        return of

    return map_texts(df, text, added, make, [c for c in df.columns if c != text])
