import hashlib
import os
import random
import struct

import pytest
import zstandard

from vislens.llm import warc

SCHEMA = "page_id bigint, url string, html string, archive string, digest string"


def pages(n=300):
    rng = random.Random(1)
    shared = ["<html>" + "".join(rng.choice("abcdefgh <>/") for _ in range(2000)) for _ in range(4)]
    rows = [(i, f"http://h{i % 7}.example/{i}?a=%41&ü", rng.choice(shared) if rng.random() < 0.4 else "<html><body>" + f"page {i} " * rng.randint(0, 300), "x", "y") for i in range(n)]
    return rows + [(n, None, None, "x", "y"), (n + 1, "http://x/", "", "x", "y"), (n + 2, "http://é\r\n", "é" * 500, "x", "y"), (n + 3, "http://x/", "é" * 500, "x", "y"), (n + 4, "u", "a" * 999, "x", "y"), (n + 5, "u", "a" * 999, "x", "y")]


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path / "warc")


def expected(rows, least=1000):
    by = {}
    for r in rows:
        body = (r[2] or "").encode()
        by.setdefault(body, []).append(r[0])
    out = set()
    for p, u, h, *_ in rows:
        body = (h or "").encode()
        ids = [i for i in by[body] if i is not None]
        first = max(ids) if ids else None
        again = len(body) >= least and len(by[body]) > 1 and first is not None and p != first
        out.add((p, u, "revisit" if again else "response", len(body), hashlib.sha1(body).hexdigest(), first if again else None))
    return out


def test_archives_read_back_as_they_were(spark, folder):
    rows = pages()
    written = warc.write_warc(spark.createDataFrame(rows, SCHEMA), folder, archive_bytes=100_000).collect()
    assert len(written) > 2 and sum(r.n_records for r in written) == len(rows)
    got = warc.read_warc(spark, folder, with_payload=True).collect()
    assert {(r.page_id, r.url, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in got} == expected(rows)
    assert len(got) == len(rows)
    texts = {r[0]: (r[2] or "").encode() for r in rows}
    assert all(bytes(r.payload) == texts[r.page_id] if r.record_type == "response" else r.payload is None for r in got)


def test_dictionary_leads_and_records_are_frames_of_their_own(spark, folder):
    rows = pages(400)
    warc.write_warc(spark.createDataFrame(rows, SCHEMA), folder).collect()
    files = [os.path.join(folder, f) for f in os.listdir(folder)]
    assert all(f.endswith(".warc.zst") for f in files)
    data = open(files[0], "rb").read()
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and data[8:12] == b"\x37\xa4\x30\xec"
    known = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    first = zstandard.ZstdDecompressor(dict_data=known).decompressobj()
    record = first.decompress(data[8 + size :])
    assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and first.unused_data
    assert len(list(warc.read_archive(data))) == sum(1 for _ in rows)
    plain = sum(len(r) for r in warc.read_archive(data))
    assert len(data) < plain / 3


def test_small_uniform_and_damaged_archives():
    for records in ([], [b"x"], [b"a" * 100_000] * 3, [b"same"] * 50, [os.urandom(300_000)] * 2):
        assert list(warc.read_archive(warc.write_archive(records))) == records
    data = warc.write_archive([b"x" * 1000, b"y" * 1000])
    with pytest.raises(ValueError):
        list(warc.read_archive(data[:-3]))
    record = warc._record(1, "u", hashlib.sha1(b"abc").hexdigest(), 3, None, b"abc")
    assert warc.parse_record(record)[:6] == ("1", "u", "response", 3, hashlib.sha1(b"abc").hexdigest(), None)
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"\r\n\r\nabc", b"\r\n\r\nabd"))


def test_null_ids_repeated_rows_and_empty_tables(spark, folder, tmp_path):
    big = "z" * 1500
    rows = [(None, "u", big, "x", "y"), (5, "u", big, "x", "y"), (5, "u", big, "x", "y"), (4, "u", big, "x", "y"), (None, "u", "only" * 500, "x", "y"), (None, "v", "only" * 500, "x", "y")]
    warc.write_warc(spark.createDataFrame(rows, SCHEMA), folder).collect()
    got = sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in warc.read_warc(spark, folder).collect())
    assert got == [("4", "revisit", "5"), ("5", "response", "None"), ("5", "response", "None"), ("None", "response", "None"), ("None", "response", "None"), ("None", "revisit", "5")]
    assert warc.write_warc(spark.createDataFrame([], SCHEMA), str(tmp_path / "none")).count() == 0


def test_rows_alike_in_every_column_are_spread_over_archives(spark, folder):
    same = [(7, "http://x/", "same text " * 300, "x", "y")] * 600
    more = [(None, None, "same text " * 300, "x", "y")] * 200 + [(8, "http://x/", "same text " * 300, "x", "y")]
    written = warc.write_warc(spark.createDataFrame(same + more, SCHEMA).repartition(3), folder, archive_bytes=200_000).collect()
    sizes = sorted(r.n_records for r in written)
    assert len(sizes) > 8 and sizes[-1] < 250
    got = warc.read_warc(spark, folder).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == [(0, "revisit", 8)] * 200 + [(7, "revisit", 8)] * 600 + [(8, "response", 0)]
