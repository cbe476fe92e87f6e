"""WARC archives of individually compressed records with a dictionary in front.

An archive is a file of Zstandard frames. The first is a skippable frame that
holds a dictionary built from the archive's own records; each record follows as a
frame of its own that uses it, so any record can be read alone. Records whose
payload another record holds are revisits and store no payload.

Rows are dealt to archives by where they lie in their files, so rows alike in every
column are spread as others are; the number of archives follows from the bytes to
be stored, and there is a partition for each. So an archive and the task that
writes it are bounded however large the table is. Archives go to a folder that all executors share; a writer fills a
temporary name and renames it, so a task that runs again replaces its own file.
"""

from __future__ import annotations

import base64
import hashlib
import math
import os
import re
import struct
import uuid
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vislens.llm.rows import placed
from vislens.session import shared_dir

# Fixed values of the format.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payload bytes meant for one archive.
ARCHIVE_BYTES = 16 << 20
#: Bytes of a dictionary, and of the records that it is built from.
DICTIONARY_BYTES, SAMPLE_BYTES = 32 << 10, 2 << 20
LEVEL = 3


def _record(page_id, url, digest: str, size: int, refers_to, payload: bytes | None) -> bytes:
    """A WARC/1.1 record; without payload a revisit."""
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        # no crawl time is given; the format asks for one
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=URL_CHARS)}")
    if payload is None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: Characters of URLs that stay as they are; the per cent sign is quoted, so that the URL can be read back exactly.
URL_CHARS = ":/?#[]@!$&'()*+,;=-._~"


def dictionary_of(records: list[bytes]) -> bytes:
    """A dictionary built from evenly spaced records of at most SAMPLE_BYTES; empty if there are too few to build one."""
    total = sum(map(len, records))
    step = max(1, math.ceil(total / SAMPLE_BYTES))
    sample, held = [], 0
    for r in records[::step]:
        r = r[: SAMPLE_BYTES // 8]
        if held + len(r) > SAMPLE_BYTES:
            break
        sample.append(r)
        held += len(r)
    if len(sample) < 8:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, level=LEVEL, threads=0).as_bytes()
    except zstandard.ZstdError:  # too little or too uniform content
        return b""


def write_archive(records: list[bytes]) -> bytes:
    """The skippable dictionary frame (left out if there is no dictionary) and a frame for each record."""
    dictionary = dictionary_of(records)
    out = [struct.pack("<II", DICTIONARY_FRAME, len(dictionary)), dictionary] if dictionary else []
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True, write_checksum=True)
    out += [press.compress(r) for r in records]
    return b"".join(out)


def read_archive(data: bytes):
    """The records of an archive, one after the other."""
    known, at = None, 0
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        dictionary = data[8 : 8 + size]
        if dictionary[:4] == ZSTD_FRAME:  # the dictionary may itself be compressed
            dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
        known, at = zstandard.ZstdCompressionDict(dictionary), 8 + size
    open_ = zstandard.ZstdDecompressor(dict_data=known)
    view = memoryview(data)
    while at < len(data):
        one = open_.decompressobj()
        parts = [one.decompress(view[at : at + (1 << 16)])]
        end = at + (1 << 16)
        while not one.eof:
            if end >= len(data):
                raise ValueError("an archive ends within a record")
            parts.append(one.decompress(view[end : end + (1 << 16)]))
            end += 1 << 16
        at = min(end, len(data)) - len(one.unused_data)
        yield b"".join(parts)


def parse_record(record: bytes) -> tuple:
    """(page id, url, type, payload bytes, digest in hex, id that it refers to, payload or None); a damaged record raises an error."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http).group(1))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    number = lambda s: None if s == "<urn:page:none>" else s[len("<urn:page:") : -1]
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
    url = fields.get("WARC-Target-URI")
    refers = number(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return number(fields["WARC-Record-ID"]), None if url is None else unquote(url), kind, size, digest, refers, payload if kind == "response" else None


def _put(folder: str, name: str, data: bytes) -> str:
    """Writes a file in a shared folder under a temporary name, then renames it."""
    if urlsplit(folder).scheme in ("", "file"):
        path = os.path.join(urlsplit(folder).path, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        draft = f"{path}.{uuid.uuid4().hex}.part"
        with open(draft, "wb") as f:
            f.write(data)
        os.replace(draft, path)
        return path
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(f"{folder.rstrip('/')}/{name}")
    draft = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(draft) as f:
        f.write(data)
    store.move(draft, path)
    return path


def record_types(pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html", least: int = 1000, keep: tuple = ()) -> DataFrame:
    """(page_id, url, digest, size, *keep, refers_to): refers_to is null for responses.

    Of rows with equal payloads of `least` bytes or more, those with the largest
    id are responses and the others revisits; of null ids only, all are responses.
    Digests are grouped and joined, payloads stay where they are.
    """
    payload = _payload(body)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("bigint").alias("size"), *keep)
    shared = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    shared = shared.filter("n > 1").drop("n")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(shared, "digest", "left").withColumn("refers_to", F.when(other, F.col("first"))).drop("first")


def _payload(body: str):
    return F.coalesce(F.col(body).cast("binary"), F.lit(b""))


def write_warc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", body: str = "html", least: int = 1000, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes all rows to archives in `folder`; (archive, n_records, n_bytes) of each file. The folder must be shared by all executors.

    A null body is an empty payload, a null url has no target, a null id is
    written as none. Rows that repeat an id are records of their own. Other
    columns are not read. An empty table writes no file. Files are written when
    the result is computed. Payloads are moved once, to the task that writes
    them; which rows are revisits comes to meet them there.
    """
    total = pages.agg(F.sum(F.octet_length(_payload(body)) + 512)).first()[0] or 0
    n = max(1, math.ceil(total / archive_bytes))
    pages = placed(pages)
    archive = F.pmod("__place", F.lit(n)).alias("archive")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), _payload(body).alias("payload"), archive)
    again = record_types(pages, page_id, url, body, least, ("__place",)).filter("refers_to is not null").select("page_id", "digest", "refers_to", archive)

    def run(key, table, again):
        number = key[0].as_py()
        first = {(p, d): f for p, d, f in zip(*(again.column(c).to_pylist() for c in ("page_id", "digest", "refers_to")))}
        ids, urls = table.column("page_id").to_pylist(), table.column("url").to_pylist()
        digests = [hashlib.sha1(x.as_buffer()).hexdigest() for x in table.column("payload")]
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else 0, urls[i] or "", digests[i]))
        records = []
        for i in order:
            body = table.column("payload")[i].as_py()
            refers_to = first.get((ids[i], digests[i]))
            records.append(_record(ids[i], urls[i], digests[i], len(body), refers_to, body if refers_to is None else None))
        data = write_archive(records) if records else b""
        if records:
            _put(folder, f"pages-{number:08d}.warc.zst", data)
        return pa.table({"archive": pa.array([number], pa.int64()), "n_records": pa.array([len(records)], pa.int64()), "n_bytes": pa.array([len(data)], pa.int64())})

    both = rows.repartition(n, "archive").groupBy("archive").cogroup(again.repartition(n, "archive").groupBy("archive"))
    return both.applyInArrow(run, "archive bigint, n_records bigint, n_bytes bigint")


def read_warc(spark: SparkSession, folder: str, id_type: str = "bigint", with_payload: bool = False) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to[, payload]) of every record in the archives of `folder`.

    Payloads are checked against their digests. The archives are read by Spark,
    from wherever Spark can read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    if not with_payload:
        names, kinds = names[:-1], kinds[:-1]

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                held, size = [], 0
                for record in read_archive(data.as_py()):
                    held.append(parse_record(record)[: len(names)])
                    size += len(record) if with_payload else 200
                    if size > 8 << 20:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)

    schema = "page_id string, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to string" + ", payload binary" * with_payload
    found = files.mapInArrow(run, schema)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/warc"
