"""Dictionary-compressed WARC archives: writing and reading back.

An archive is a file of Zstandard frames: a leading skippable frame holds the dictionary, and each WARC record is a frame
of its own compressed with it, so any record can be read from its offset with the head of the file. The dictionary is
trained on records of the archive itself. Of pages with equal payloads of some length one is stored as response and the
others as revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, scratch_path

#: Magic number of the skippable frame that holds a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
DEDUP_BYTES = 1000
#: An archive closes once its records have this many bytes before compression.
ARCHIVE_BYTES = 16 << 20
#: The dictionary's size, and the bound of the records it is trained on, spread over the archive.
DICTIONARY_BYTES, TRAINING_BYTES = 64 << 10, 4 << 20
LEVEL = 6
#: Compressed bytes of archives that a reading task takes.
TASK_BYTES = 256 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"
_FEED = 16 << 10


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit without payload if ``refers_to`` is given; ``digest`` is the payload's hexadecimal SHA-1."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", _DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")))
    head.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if refers_to is not None:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary trained on records spread evenly over the list; of their plain bytes where they are too few to train on."""
    total = sum(map(len, records))
    step = max(1, -(-total // TRAINING_BYTES))
    samples = records[::step]
    try:
        return zstandard.train_dictionary(max(1024, min(DICTIONARY_BYTES, total // 20)), samples, k=256, d=8)
    except zstandard.ZstdError:
        plain = b"".join(s[:4096] for s in samples[:16])[:DICTIONARY_BYTES] or b"WARC/1.1"
        return zstandard.ZstdCompressionDict(plain.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    """The bytes of an archive of these records, behind a warcinfo record."""
    note = b"software: asterism\r\nformat: WARC File Format 1.1\r\n"
    info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, 'asterism')}>\r\nWARC-Date: {_DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(note)}\r\n\r\n".encode()
    known = dictionary(records)
    raw = known.as_bytes()
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True, write_checksum=True)
    frames = [packer.compress(r) for r in (info + note + b"\r\n\r\n", *records)]
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(raw)), raw, *frames])


def frames(data: bytes) -> Iterator[bytes]:
    """The decompressed frames of an archive."""
    at, known = 0, None
    magic, size = struct.unpack_from("<II", data) if len(data) >= 8 else (0, 0)
    if magic == DICTIONARY_MAGIC:
        raw = data[8 : 8 + size]
        trained = raw[:4] == b"\x37\xa4\x30\xec"
        known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
        at = 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    while at < len(data):
        one, parts = reader.decompressobj(), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("an archive ends within a frame")
            fed = data[at : at + _FEED]
            parts.append(one.decompress(fed))
            at += len(fed)
        at -= len(one.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", dedup_bytes: int = DEDUP_BYTES) -> DataFrame:
    """Write archives under ``path``, a shared folder, and return their manifest (file, records, bytes) from the shared scratch folder.

    Of payloads of ``dedup_bytes`` or more that are equal, the rows with the largest id are responses (repeated rows all
    are), the others revisits of it; null ids and null payloads (empty) are responses. The groups of two or more, a digest
    and an id each, are found by map-side maxima and written first, so that pages move only if there are too many to
    broadcast. Only files in the manifest count: a task that is run again writes files of new names.
    """
    raw = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    given = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), raw.alias("payload")).withColumn("digest", F.sha1("payload"))
    long = given.where(F.col("id").isNotNull() & (F.octet_length("payload") >= dedup_bytes)).select("id", "digest")
    copies = materialize(long.groupBy("digest").agg(F.max("id").alias("holder"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "holder"), "copies")
    refers = F.when(F.octet_length("payload") >= dedup_bytes, F.when(F.col("holder") != F.col("id"), F.col("holder")))
    ready = given.join(copies, "digest", "left").select("id", "url", "payload", "digest", refers.alias("refers_to"))
    fs, folder = _store(path)
    fs.create_dir(folder, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _store(path)
        run_id, number, held, size = uuid.uuid4().hex, 0, [], 0

        def close() -> pa.RecordBatch:
            name = f"{folder.rstrip('/')}/{run_id}-{number:05d}.warc.zst"
            data = archive(held)
            with fs.open_output_stream(name, compression=None) as out:
                out.write(data)
            return pa.RecordBatch.from_pydict({"file": [name], "records": [len(held)], "bytes": [len(data)]})

        for batch in batches:
            for key, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(record(key, url, payload, digest, refers_to))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    number, held, size = number + 1, [], 0
        if held:
            yield close()

    return materialize(ready.mapInArrow(run, "file string, records bigint, bytes bigint"), "manifest")


def read(manifest: DataFrame, path: str) -> DataFrame:
    """Rows (page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of the archives in a manifest; a revisit's payload is null.

    Digests of stored payloads are computed anew and must equal the header's. A task reads one archive after another, of
    ``TASK_BYTES`` in all where there are many; very long payloads are whole in memory with their archive.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _store(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(name, compression=None) as f:
                    data = f.read()
                rows, size = [], 0
                for raw in frames(data):
                    fields, block = parse(raw)
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    stored = fields["WARC-Type"] == "response"
                    if stored and (length != len(payload) or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"{name}: a payload differs from its digest")
                    url = fields.get("WARC-Target-URI")
                    url = url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                    rows.append((_page(fields["WARC-Record-ID"]), url, fields["WARC-Type"], length, digest, _page(fields.get("WARC-Refers-To")), payload if stored else None))
                    size += len(payload)
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files, size = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, min(files, max(partitions(manifest.sparkSession), -(-size // TASK_BYTES))))
    spread = manifest.select("file").repartition(tasks)
    return spread.mapInArrow(run, "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary")


def round_trip(pages: DataFrame, path: str | None = None, **columns: str) -> DataFrame:
    """Write ``pages`` as archives, in the shared scratch folder unless ``path`` is given, and read them back."""
    path = path or scratch_path(pages.sparkSession, "warc")
    return read(write(pages, path, **columns), path)
