"""Web archives: records are written, revisits resolved by payload digest, deduplicated archives written and read back.

1. every task writes its pages as they come, one gzip member per record, and returns their headers,
2. headers alone are shuffled by digest; of records with equal payloads of at least
   ``MIN_REVISIT`` bytes the one with the largest page id is the original (between
   equal ids the one stored last), the others revisit it,
3. every archive is rewritten with fresh headers, revisits without payload,
4. the new archives are parsed and revisits joined with their originals.

A null payload is empty, a null url has no target header, a null page id is the
smallest. Every row makes one record, repeated rows too. Files carry a new name per
task attempt and only those named by a finished task's stored rows are read, so lost
executors leave nothing behind that counts.
"""
from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryscope.llm.common import file_system, shared_folder, stored

MIN_REVISIT = 1000
FIRST_LEVEL, LEVEL = 1, 4  # of compression: archives that are rewritten, archives that stay
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_HEADERS = "file string, start long, bytes long, page_id long, url string, digest string, payload_bytes long"
_RECORDS = "record_id string, record_type string, refers string, page_id long, payload_bytes long, payload_digest string"


def record_id(file: str, start: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{start}')}>"


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record(kind: str, rid: str, page_id: int | None, url: str | None, digest: str, payload: bytes, extra: tuple = ()) -> bytes:
    """One record; ``digest`` is the SHA-1 of the full payload in hex, ``payload`` is empty for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", DATE), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    fields += [("WARC-Target-URI", _clean(url))] if url is not None else []
    fields += [("X-Page-ID", str(page_id))] if page_id is not None else []
    fields += [*extra, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + len(payload)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + http + payload + b"\r\n\r\n"


def packed(data: bytes, level: int) -> bytes:
    """One gzip member."""
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def members(stream, piece: int = 1 << 20):
    """The gzip members of a stream, one after the other."""
    unpack, out = zlib.decompressobj(31), []
    while data := stream.read(piece):
        while data:
            out.append(unpack.decompress(data))
            data = b""
            if unpack.eof:
                yield b"".join(out)
                unpack, out, data = zlib.decompressobj(31), [], unpack.unused_data
    if any(out):
        raise ValueError("an archive ends inside a record")


def write_first(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One archive per task; returns a header row per record."""

    def work(batches):
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        name, out, at = f"first-{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            out = out or system.open_output_stream(f"{path}/{name}", compression=None)
            rows = []
            for page_id, u, payload in zip(*[c.to_pylist() for c in (b.column(0), b.column(1), b.column(2).cast(pa.binary()))]):
                payload = payload or b""
                digest = hashlib.sha1(payload).hexdigest()
                data = packed(record("response", record_id(name, at), page_id, u, digest, payload), FIRST_LEVEL)
                out.write(data)
                rows.append((name, at, len(data), page_id, u, digest, len(payload)))
                at += len(data)
            names = [f.split()[0] for f in _HEADERS.split(", ")]
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=names)
        if out:
            out.close()

    return pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(work, _HEADERS)


def resolve(headers: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Headers with the original (o_*) that a revisit refers to, null for responses."""
    large = headers.filter(F.col("payload_bytes") >= min_bytes)
    last = F.max(F.struct("page_id", "file", "start", "url")).alias("o")
    originals = large.groupBy("digest", "payload_bytes").agg(last, F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("digest").alias("d"), F.col("payload_bytes").alias("b"), "o")
    # the headers of a payload that a third of all pages share are on the side the skew join splits
    joined = headers.join(originals, (F.col("digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")), "left")
    other = F.col("o").isNotNull() & ~((F.col("o.file") == F.col("file")) & (F.col("o.start") == F.col("start")))
    return joined.select(*headers.columns, *[F.when(other, F.col(f"o.{c}")).alias(f"o_{c}") for c in ("page_id", "file", "start", "url")])


def write_deduplicated(decided: DataFrame, first: str, folder: str, level: int = LEVEL) -> DataFrame:
    """Rewrite every archive, one gzip member per record; returns (file, records)."""

    def work(batches):
        source, source_path = file_system(first)
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        name, n, out, now, reader = f"dedup-{uuid.uuid4().hex}.warc.gz", 0, None, None, None
        for b in batches:
            out = out or system.open_output_stream(f"{path}/{name}", compression=None)
            for r in b.to_pylist():
                if r["file"] != now:
                    reader, now = source.open_input_file(f"{source_path}/{r['file']}"), r["file"]
                rid = record_id(r["file"], r["start"])
                if r["o_file"] is None:
                    reader.seek(r["start"])
                    data = record("response", rid, r["page_id"], r["url"], r["digest"], parse(zlib.decompress(reader.read(r["bytes"]), 31))[1])
                else:
                    extra = (("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(r["o_file"], r["o_start"])), ("WARC-Refers-To-Date", DATE))
                    extra += (("WARC-Refers-To-Target-URI", _clean(r["o_url"])),) if r["o_url"] is not None else ()
                    data = record("revisit", rid, r["page_id"], r["url"], r["digest"], b"", extra)
                out.write(packed(data, level))
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "records"])

    # headers are small, the archives behind them are not: a task for each archive
    n_files = max(1, decided.select("file").distinct().count())
    dealt = decided.repartitionByRange(n_files, "file").sortWithinPartitions("file", "start")
    return dealt.mapInArrow(work, "file string, records long")


def read_records(files: DataFrame, folder: str) -> DataFrame:
    """A row per record of the archives named by ``files``."""

    def work(batches):
        system, path = file_system(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with system.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for data in members(stream):
                        fields, payload = parse(data)
                        first, page = fields["WARC-Type"] == "response", fields.get("X-Page-ID")
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        if first and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"a payload in {name} does not fit its digest")
                        rows.append((fields["WARC-Record-ID"], fields["WARC-Type"], fields.get("WARC-Refers-To"), int(page) if page else None, len(payload) if first else None, digest))
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = [f.split()[0] for f in _RECORDS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    n_files = max(1, files.count())
    return files.select("file").repartitionByRange(n_files, "file").mapInArrow(work, _RECORDS)


def resolved_records(records: DataFrame) -> DataFrame:
    """Revisits joined with the response they refer to: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    originals = records.filter("record_type = 'response'").select(F.col("record_id").alias("o"), F.col("page_id").alias("o_page"), F.col("payload_bytes").alias("o_bytes"))
    joined = records.join(originals, F.col("refers") == F.col("o"), "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "o_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("o_page").alias("refers_to"))


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> tuple[DataFrame, str]:
    """Write deduplicated archives; returns the stored list of files and their folder."""
    spark = pages.sparkSession
    first, folder = shared_folder(spark, "warc-first"), shared_folder(spark, "warc")
    headers = stored(write_first(pages, first, key, url, html), "warc-headers")
    return stored(write_deduplicated(resolve(headers), first, folder), "warc-files"), folder
