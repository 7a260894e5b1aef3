import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from civicmesh.llm import bpe_codec, text_batches, token_counts
from civicmesh.llm.library_text import SCANNED, differences
from civicmesh.llm.merges import MergeTable

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ALPHABET = ["a", "b", "A", "É", "é", "İ", "ß", "Σ", "ς", "é", "\n", "\t", "  ", "\x1c", "\x85", "'s", "'t", " 're", "1", "²", "٣", "!", "***", "<|endoftext|>", "<|startoftext|>", " ", "漢", "😀", "​", "the", "ing", "thth"]


def texts(n=3000, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", " ", "<|endoftext|>", "ΟΣ ΑΣ", "a" * 300, "ab" * 200, "=" * 500, "it's WE'RE I'll"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_proposals_merges_and_the_library_agree(path):
    with open(path, encoding="utf-8") as f:
        table = MergeTable(f.read())
    rng = random.Random(1)
    words = ["".join(rng.choice("aehinorst1é*") for _ in range(rng.randint(1, 20))) for _ in range(4000)] + ["a" * n for n in range(1, 70)]
    model = Tokenizer.from_file(path).model
    spelled = [table.spelled(w) for w in words]
    want = [[t.id for t in model.tokenize(s)] for s in spelled]
    assert table.encode(words) == want
    assert table.merge_all(spelled) == want
    assert [table.merge(s) for s in spelled] == want


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_strings_that_encode_alone(path):
    with open(path, encoding="utf-8") as f:
        table = MergeTable(f.read())
    for token, i in random.Random(2).sample(sorted(table.ids.items()), 3000):
        inner = token.removesuffix(table.suffix) if table.suffix else token
        if inner != token or not table.suffix:
            assert table.is_alone[i] == (table.merge(inner) == [i])


def test_encode_and_decode_like_the_library(spark):
    library, rows = Tokenizer.from_file(WORD), [*enumerate(texts()), (-1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(-5))
    got = {r.doc_id: r for r in bpe_codec.digests(df, WORD).collect()}
    whole = {r.doc_id: (r.ids, r.decoded) for r in bpe_codec.encode(df, WORD, decoded="decoded").collect()}
    for i, t in rows:
        e = library.encode(t or "", add_special_tokens=False)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert whole[i] == (e.ids, library.decode(e.ids, skip_special_tokens=False)), t
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(e.ids), sha(" ".join(map(str, e.ids))), sha(library.decode(e.ids, skip_special_tokens=False))), t


def test_every_code_point_is_cut_like_the_library():
    library, found = Tokenizer.from_file(WORD), differences()
    with open(WORD, encoding="utf-8") as f:
        encoder = bpe_codec.Encoder(MergeTable(f.read()), found)
    odd = sorted({*found.classes, *found.small, *found.marks})
    some = [*odd, *range(0x300, 0x370), *random.Random(4).sample(SCANNED, 20_000), *range(0x3FFF0, 0x40010), 0xF0000, 0x10FFFF]
    lines = [t % chr(c) for c in some for t in ("%s", "a%sb", "1%s!")] + [f"!x\u0323{chr(c)}\u0301 '{chr(c)}S" for c in some]
    assert [x.tolist() for x in encoder(lines)] == [e.ids for e in library.encode_batch(lines, add_special_tokens=False)]
    rng = random.Random(6)
    mixed = ["".join(chr(rng.choice(odd)) if rng.random() < 0.3 else rng.choice(ALPHABET) for _ in range(rng.randint(1, 20))) for _ in range(5000)]
    assert [x.tolist() for x in encoder(mixed)] == [e.ids for e in library.encode_batch(mixed, add_special_tokens=False)]


def test_added_tokens_with_other_rules_are_refused():
    with open(WORD, encoding="utf-8") as f:
        text = f.read()
    with pytest.raises(ValueError, match="added tokens"):
        MergeTable(text.replace('"lstrip":false', '"lstrip":true', 1).replace('"lstrip": false', '"lstrip": true', 1))


def test_decode_alone(spark):
    df = spark.createDataFrame([(1, [320, 49407]), (2, []), (3, None), (4, [None, 320, 10**6])], "id long, ids array<int>")
    got = {r.id: r.text for r in bpe_codec.decode(df, WORD).collect()}
    assert got == {1: "a</w> <|endoftext|>", 2: "", 3: "", 4: "a</w>"}


def test_counts_like_the_library(spark):
    library, rows = Tokenizer.from_file(BYTE), [*enumerate(texts(seed=3)), (-1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("over_limit", F.lit("clash"))
    got = {r.doc_id: r for r in token_counts.count_tokens(df, BYTE, limit=20).collect()}
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 20), t


def test_long_texts_are_cut_at_safe_places(spark, monkeypatch):
    monkeypatch.setattr(text_batches, "CHUNK_CHARS", 50)
    long = " ".join(texts(300, 5)) + "x" * 200 + "  y z\n" * 50
    assert len([*text_batches.chunks(long)]) > 10 and "".join(text_batches.chunks(long)) == long
    with open(BYTE, encoding="utf-8") as f:
        count = token_counts.Counter(MergeTable(f.read()))
    assert count([long]) == [len(Tokenizer.from_file(BYTE).encode(long, add_special_tokens=False).ids)]
    with open(WORD, encoding="utf-8") as f:
        encoder = bpe_codec.Encoder(MergeTable(f.read()), differences())
    assert encoder([long])[0].tolist() == Tokenizer.from_file(WORD).encode(long, add_special_tokens=False).ids


def test_what_a_worker_forgets_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe_codec, "REMEMBERED", 50)
    with open(WORD, encoding="utf-8") as f:
        encoder = bpe_codec.Encoder(MergeTable(f.read()), differences())
    some = texts(200, 8)
    assert [x.tolist() for x in encoder(some) for _ in (0,)] == [Tokenizer.from_file(WORD).encode(t, add_special_tokens=False).ids for t in some]
    assert [encoder([t])[0].tolist() for t in some] == [Tokenizer.from_file(WORD).encode(t, add_special_tokens=False).ids for t in some]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_codec.encode(empty, WORD, decoded="decoded").count() == 0
    assert token_counts.count_tokens(empty, BYTE).count() == 0
