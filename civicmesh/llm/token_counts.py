"""Token counts (8): whole-token shortcut.

Offline, the merge tables prove which vocabulary strings encode alone as one token (``MergeTable.is_alone``).
Pre-tokens among these count one without any merging; only the rest are encoded, and a worker remembers
their counts. Null and empty texts have no tokens. Special strings count one, as the library takes them by
default.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe_codec import NOT_LATIN, vocabulary
from .merges import MergeTable, table_for
from .text_batches import chunks, map_texts

#: Fixed value: the pattern that cuts a text before the merges of byte-level vocabularies.
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: The same for texts of ASCII and accented Latin letters, without a look-up of properties.
LATIN = re.compile(r" ?[a-zA-Zß-öø-ÿÀ-ÖØ-Þ]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s0-9a-zA-Zß-öø-ÿÀ-ÖØ-Þ]+|\s+(?!\S)|\s+", re.ASCII)
#: Pre-tokens whose counts a worker remembers; beyond it forgets all but the proven ones.
REMEMBERED = 200_000


def whole_tokens(table: MergeTable) -> dict[str, int]:
    """The proven strings, spelled as text, with the count 1; tokens that are no whole UTF-8 text are no pre-tokens."""
    back = {s: b for b, s in enumerate(table.symbols)}
    out = {}
    for string, i in table.ids.items():
        if table.is_alone[i]:
            try:
                out[bytes(map(back.__getitem__, string)).decode()] = 1
            except UnicodeDecodeError:
                continue
    return out


class Counter:
    def __init__(self, table: MergeTable):
        self.table, self.proven = table, whole_tokens(table)
        self.known = dict(self.proven)
        self.split = regex.compile("|".join(map(regex.escape, sorted(table.special, key=len, reverse=True)))) if table.special else None

    def learn(self, words: list[str]) -> None:
        new = [w for w in {*words} if w not in self.known]
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.known = dict(self.proven)
                new = [w for w in {*words} if w not in self.known]
            self.known.update((w, len(t)) for w, t in zip(new, self.table.encode(new), strict=True))

    def runs(self, text: str) -> tuple[list[str], int]:
        """The text between special strings, and how many of these there are."""
        if not any(map(text.__contains__, self.table.special)):
            return [text], 0
        runs = self.split.split(text)
        return runs, len(runs) - 1

    def words(self, text: str) -> tuple[Iterator[list[str]], int]:
        """Lists of pre-tokens, and how many special strings are between them."""
        runs, n = self.runs(text)
        return ((PRE_TOKENS if NOT_LATIN.search(part) else LATIN).findall(part) for run in runs for part in chunks(run)), n

    def __call__(self, texts: list[str]) -> list[int]:
        held = [([*lists], n) if len(t) < 1 << 16 else None for t in texts for lists, n in [self.words(t)]]
        self.learn([w for x in held if x for ws in x[0] for w in ws])
        out = []
        for text, x in zip(texts, held, strict=True):
            lists, n = x or self.words(text)
            for ws in lists:
                try:
                    n += sum(map(self.known.__getitem__, ws))
                except KeyError:
                    self.learn(ws)
                    n += sum(map(self.known.__getitem__, ws))
            out.append(n)
        return out


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """``df`` without ``text``, with n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens).

    Other columns pass through; ones with these names give way. Rows, repeated ones too, stay as they are."""
    name, data = vocabulary(path)
    shared = df.sparkSession.sparkContext.broadcast(data)
    added = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]

    def make():
        count = Counter(table_for(name, shared.value))

        def of(texts: list[bytes]) -> list[pa.Array]:
            return [pa.array([len(t) for t in texts], pa.int64()), pa.array(count([t.decode("utf-8", "replace") for t in texts]), pa.int64())]

        return of

    out = map_texts(df, text, added, make, [c for c in df.columns if c not in (text, "over_limit")], binary=True)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
