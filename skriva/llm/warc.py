"""WARC records in seekable Zstandard bundles.

Each task writes the records of its partition into bundles. A bundle is a row of independent zstd frames, each
with whole WARC/1.1 records of about FRAME_BYTES, and ends with the seek table of the published seekable
format: a skippable frame with the compressed and the plain size of every frame, and a footer. The index maps each record
to its bundle, its frame, and its offset inside the plain frame; reading a record takes the footer, one frame
and one slice.

A bundle is written beside its place and renamed, under a name made of its partition and number, so a task that
runs again replaces it by the same bytes. The index is written by Spark's committer once the bundles are there.

Defined results: a null payload is an empty block and a null url leaves out WARC-Target-URI; null ids are kept;
equal rows give records with the same identifier, each at its own place; a record longer than a frame has a
frame of its own, however long; an empty table gives an empty index; further columns, also of names that differ by case only, are ignored. As pages
have no date, WARC-Date is that of the epoch. Line ends inside a
url are escaped, as a header can't hold them.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at, load, placed, shared_path

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256 << 10, 512 << 20, 3
DATE = "1970-01-01T00:00:00Z"
SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
INDEX = "id {id}, record_id string, bundle string, frame int, frame_offset long, record_offset long, record_length long, sha1 string"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, under the names that Hadoop's connectors give to the same stores; NotImplementedError, before any work, for others."""
    scheme, colon, rest = uri.partition(":")
    known = {"s3a": "s3", "s3n": "s3", "abfs": "abfss"}.get(scheme, scheme)
    try:
        return fs.FileSystem.from_uri(f"{known}{colon}{rest}")
    except (pa.ArrowInvalid, ValueError) as e:
        raise NotImplementedError(f"bundles can't be written to {scheme}: use file, hdfs, s3a, gs or abfss ({e})") from None


def record(row_id: object, url: str | None, payload: bytes | None, date: str = DATE) -> tuple[str, str, bytes]:
    """(identifier, SHA-1 of the payload, the record's bytes)."""
    body = payload or b""
    sha1 = hashlib.sha1(body).hexdigest()
    name = f"urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{row_id}\0{url}\0{sha1}'.encode()).digest(), version=3)}"
    target = "" if url is None else "WARC-Target-URI: " + url.replace("%0A", "%250A").replace("\r", "%0D").replace("\n", "%0A") + "\r\n"
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <{name}>\r\n{target}WARC-Date: {date}\r\nWARC-Payload-Digest: sha1:{sha1}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
    return name, sha1, head.encode() + body + b"\r\n\r\n"


def payload_of(raw: bytes) -> bytes:
    """The block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    size = next(int(line[15:]) for line in head.split(b"\r\n") if line.startswith(b"Content-Length:"))
    return rest[:size]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """frames: (compressed size, plain size)."""
    entries = b"".join(struct.pack("<II", a, b) for a, b in frames) + struct.pack("<IBI", len(frames), 0, FOOTER)
    return struct.pack("<II", SKIPPABLE, len(entries)) + entries


def read_seek_table(f: pa.NativeFile) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame of an open bundle."""
    size = f.size()
    f.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != FOOTER:
        raise ValueError("not a seekable bundle")
    f.seek(size - 9 - 8 * count)
    raw, out, at = f.read(8 * count), [], 0
    for a, b in struct.iter_unpack("<II", raw):
        out.append((at, a, b))
        at += a
    return out


class _Bundle:
    """One bundle while it is written. Only one frame is held in memory."""

    def __init__(self, system: fs.FileSystem, path: str):
        self.system, self.path, self.spare = system, path, f"{path}.{uuid.uuid4().hex}"
        self.out = system.open_output_stream(self.spare)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.held_size = self.at = self.plain = 0

    def add(self, raw: bytes) -> tuple[int, int]:
        """(frame, offset in it); frame_offset is self.at until the frame ends."""
        if self.held and self.held_size + len(raw) > FRAME_BYTES:
            self.end_frame()
        place = len(self.frames), self.held_size
        self.held.append(raw)
        self.held_size += len(raw)
        self.plain += len(raw)
        return place

    def end_frame(self) -> None:
        if self.held:
            data = self.packer.compress(b"".join(self.held))
            self.out.write(data)
            self.frames.append((len(data), self.held_size))
            self.at += len(data)
            self.held, self.held_size = [], 0

    def close(self) -> None:
        self.end_frame()
        self.out.write(seek_table(self.frames))
        self.out.close()
        self.system.move(self.spare, self.path)


def write_bundles(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write df's rows as bundles under path/bundles and their index at path/index; gives the index.

    (id, record_id, bundle, frame, frame_offset, record_offset, record_length, sha1): frame_offset is where the
    frame begins in the bundle, record_offset where the record begins in the plain frame.
    """
    schema = INDEX.format(id=df.schema[id_col].dataType.simpleString())
    filesystem(f"{path}/bundles")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = filesystem(f"{path}/bundles")
        system.create_dir(folder, recursive=True)
        task, number, bundle, rows = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            kind = batch.schema.field(0).type
            for row_id, url, payload in zip(*(c.to_pylist() for c in batch.columns)):
                name, sha1, raw = record(row_id, url, payload)
                if bundle is None:
                    bundle = _Bundle(system, f"{folder}/part-{task:06d}-{number:04d}.warc.zst")
                frame, offset = bundle.add(raw)
                rows.append((row_id, name, bundle.path.rpartition("/")[2], frame, bundle.at, offset, len(raw), sha1))
                if bundle.plain >= bundle_bytes:
                    bundle.close()
                    bundle, number = None, number + 1
            if rows:
                yield _index_batch(rows, kind)
                rows = []
        if bundle is not None:
            bundle.close()

    rows = placed(df).select(F.col(at(df, id_col)), F.col(at(df, url_col)).cast("string"), F.col(at(df, payload_col)).cast("binary"))
    rows.mapInArrow(pack, schema).write.parquet(f"{path}/index")
    remove_spare(f"{path}/bundles")
    return df.sparkSession.read.schema(schema).parquet(f"{path}/index")


def remove_spare(folder: str) -> None:
    """What tasks left that were lost before they could name their bundle."""
    system, place = filesystem(folder)
    for x in system.get_file_info(fs.FileSelector(place, allow_not_found=True)):
        if x.is_file and not x.path.endswith(".warc.zst"):
            system.delete_file(x.path)


def _index_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = ["id", "record_id", "bundle", "frame", "frame_offset", "record_offset", "record_length", "sha1"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_record(path: str, bundle: str, frame: int, offset: int, length: int) -> bytes:
    """One record, from one frame."""
    system, folder = filesystem(f"{path}/bundles")
    with system.open_input_file(f"{folder}/{bundle}") as f:
        begin, size, plain = read_seek_table(f)[frame]
        f.seek(begin)
        return zstandard.ZstdDecompressor().decompress(f.read(size), plain)[offset : offset + length]


def read_records(index: DataFrame, path: str) -> DataFrame:
    """The index with the payload of each of its records (column `payload`). Rows that follow each other in a frame share its reading."""
    schema = index.select("id", "record_id", "bundle", "frame", "frame_offset", "record_offset", "record_length", "sha1")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = filesystem(f"{path}/bundles")
        unpack = zstandard.ZstdDecompressor()
        name, f, table, held, plain = None, None, [], None, b""
        for batch in batches:
            out = []
            for bundle, frame, offset, length in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "record_offset", "record_length"))):
                if bundle != name:
                    if f is not None:
                        f.close()
                    f, name, held = system.open_input_file(f"{folder}/{bundle}"), bundle, None
                    table = read_seek_table(f)
                if frame != held:
                    begin, size, full = table[frame]
                    f.seek(begin)
                    plain, held = unpack.decompress(f.read(size), full), frame
                out.append(payload_of(plain[offset : offset + length]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "payload"])
        if f is not None:
            f.close()

    fields = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in schema.schema.fields)
    return schema.mapInArrow(fetch, f"{fields}, payload binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page packed, and read back through the seek tables: intact tells that the payload's digest is the one indexed."""
    path = shared_path(spark, "warc")
    index = write_bundles(load(spark, sf_dir, "pages"), path)
    back = read_records(index, path)
    return back.select(
        F.col("id").alias("page_id"), "record_id", "bundle", "frame", "frame_offset", "record_offset", "record_length", "sha1",
        F.length("payload").alias("payload_bytes"), (F.sha1("payload") == F.col("sha1")).alias("intact"),
    )
