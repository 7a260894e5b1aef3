import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from civicmesh.llm import warc


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def plain(rows):
    out, first = set(), {}
    for i, h in rows:
        first[sha(h)] = min(first.get(sha(h), i), i)
    for i, h in rows:
        n = len((h or "").encode())
        again = n >= 100 and i > first[sha(h)]
        out.add((i, n, sha(h), "revisit" if again else "response", first[sha(h)] if again else None))
    return out


ROWS = [
    (1, "<p>" + "x" * 97), (2, "<p>" + "x" * 97), (0, "<p>" + "x" * 96), (9, "<p>" + "x" * 96), (3, None), (4, ""), (5, "é漢😀" * 40), (6, "é漢😀" * 40),
    (7, "\r\n\r\nWARC/1.1\r\n\r\n" * 20), (8, "a\x00b\x1f\x8b" * 60), (10, "long " * 300_000), (11, "y" * 100), (12, "y" * 100), (13, "y" * 100),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, f"http://example.com/ü?a b\n{i}" if i and i % 2 else None, h) for i, h in rows], "page_id long, url string, html string").withColumns({"digest": F.lit("clash"), "first": F.lit(-1), "kind": F.lit("c")}).repartition(3)


def test_what_is_written_is_read_back(spark):
    got = warc.archive(frame(spark, ROWS), payloads=True).collect()
    assert {tuple(r)[:5] for r in got} == plain(ROWS) and len(got) == len(ROWS)
    html = dict(ROWS)
    assert all(bytes(r.payload) == ((html[r.page_id] or "").encode() if r.record_type == "response" else b"") for r in got)


def test_many_files_and_large_records(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "FILE_RECORDS", 3)
    monkeypatch.setattr(warc, "HOT", 2)  # three copies of a payload: broadcast; two: joined by hash
    rows = ROWS + [(20, "z" * (17 << 20)), (21, "z" * (17 << 20))]  # over 16 MiB: another last byte
    folders = warc.write(frame(spark, rows), f"file://{tmp_path}/w")
    assert {f.rpartition("/")[2] for f in folders} == {"class-0-0", "class-5-0", "class-7-0", "class-7-1"}
    assert {tuple(r) for r in warc.read(spark, folders, payloads=False).collect()} == plain(rows)


def test_repeated_rows_and_missing_ids(spark):
    rows = [(1, "q" * 200), (1, "q" * 200), (2, "q" * 200), (2, "r" * 200)]
    got = sorted(((r.page_id, r.record_type, r.refers_to is None) for r in warc.archive(frame(spark, rows + [(None, "s" * 200)])).collect()), key=lambda x: (x[0] is None, str(x)))
    # the row without an id is a record, too
    assert got[:-1] == [(1, "response", True), (1, "response", True), (2, "response", True), (2, "revisit", False)] and tuple(got[-1])[1:] == ("response", True)


def test_missing_ids_and_names_of_records(spark):
    rows = [(None, "q" * 200), (None, "q" * 200), (4, "q" * 200), (4, "q" * 200), (7, "q" * 200), (None, "s" * 200), (None, "s" * 200), (None, None)]
    folders = warc.write(frame(spark, rows), f"{warc.new_path(spark, 'names')}")
    got = sorted(warc.read(spark, folders).collect(), key=str)
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == sorted(
        [("4", "response", None)] * 2 + [("7", "revisit", 4)] + [("None", "revisit", 4)] * 2 + [("None", "response", None)] * 3, key=str
    )
    names, aims = [], []
    for r in spark.read.format("binaryFile").load(folders).select("content").collect():
        for h, _ in warc.read_records(r.content):
            names.append(h["warc-record-id"])
            aims += [h["warc-refers-to"]] if "warc-refers-to" in h else []
    assert len(names) == len({*names}) == len(rows) and {*aims} <= {*names} and len(aims) == 3


def test_files_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 20)
    rows = [(i, f"{i} " * 20_000) for i in range(40)] + [(100 + i, f"{i}") for i in range(500)]
    folders = warc.write(frame(spark, rows).coalesce(1), f"{warc.new_path(spark, 'bounded')}")
    files = spark.read.format("binaryFile").load(folders).select("content").collect()
    sizes = [sum(warc.payload_of(b)[0] for _, b in warc.read_records(r.content)) for r in files]
    assert len(sizes) >= 4 and max(sizes) <= 1 << 20


def test_empty_table(spark):
    assert warc.archive(frame(spark, [])).count() == 0


def members(*payloads):
    return [warc.member(warc.record(warc.record_id(i, i), f"http://x/{i}", p, hashlib.sha256(p).hexdigest(), None)) for i, p in enumerate(payloads)]


def test_reader_takes_one_member_after_the_other():
    made = members(b"", b"one", b"two" * 100_000)
    got = [*warc.read_records(b"".join(made))]
    assert [warc.payload_of(b) for _, b in got] == [(0, b""), (3, b"one"), (300_000, b"two" * 100_000)]
    assert all(h["content-length"] == str(len(b)) for h, b in got)
    assert gzip.decompress(made[1]).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    assert [*warc.read_records(b"")] == []


def damaged():
    one = warc.record(warc.record_id(1, 1), "http://x/", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    yield "digest", warc.member(one.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))
    n = len(warc.http_head(7)) + 7
    yield "shorter", warc.member(one.replace(b"Content-Length: %d" % n, b"Content-Length: %d" % (n + 70)))
    yield "two line ends", warc.member(one.replace(b"Content-Length: %d" % n, b"Content-Length: %d" % (n - 1)))
    yield "cut off", warc.member(one)[:-12]
    yield "does not begin", warc.member(b"HTTP/1.1 200\r\n\r\n")
    yield "longer", warc.member(one + b"more")


@pytest.mark.parametrize("what, data", [*damaged()])
def test_damage_is_found(what, data):
    with pytest.raises(warc.DigestError):
        [*warc.read_records(data)]
