"""Media columns: payloads packed into archives and read back through a custom Spark data source.

The source `media_archive` writes one or more ZIP archives per task (members are 8-bit mono WAV clips) and reads a
folder of archives by byte ranges: the driver lists the archives and cuts their lengths, each task reads an archive's
directory, takes the members whose header starts in its range, and streams their payloads as Arrow batches of bounded
size. A member is fetched by its own offset and retried alone, so a flaky store costs one member, not a range.

Defined cases: null or empty text is one block of padding; equal texts give equal stored bytes; a null doc_id stays
null; repeated doc_ids are separate members; an empty table writes no archive and reads as no rows.
"""

from __future__ import annotations

import hashlib
import io
import time
import uuid
import wave
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from corpusloom.llm.common import shared_dir

BLOCK = 576
RATE = 8000
SCHEMA = "doc_id long, media binary"
RANGE_BYTES = 32 << 20
ARCHIVE_BYTES = 256 << 20
BATCH_BYTES = 4 << 20


def filesystem(uri: str):
    """(filesystem, path) of a folder given as a path or URI that pyarrow knows (file, hdfs, s3, gs ...)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.FileSystem.from_uri("file://" + uri.removeprefix("file:")))


class Span(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class Written(WriterCommitMessage):
    def __init__(self, paths: list[str]):
        self.paths = paths


class ArchiveWriter(DataSourceWriter):
    def __init__(self, uri: str):
        self.uri = uri

    def write(self, rows):
        """Stream (doc_id, media) rows into archives of about ARCHIVE_BYTES; names are unique per attempt."""
        fs, root = filesystem(self.uri)
        fs.create_dir(root, recursive=True)
        paths: list[str] = []
        out = pack = None
        n = 0
        for doc_id, media in rows:
            if pack is None:
                paths.append(f"{root}/_{uuid.uuid4().hex}.zip")
                out = fs.open_output_stream(paths[-1])
                pack = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                n = 0
            name = zipfile.ZipInfo(f"{n}-{'' if doc_id is None else doc_id}.wav")
            name.compress_type = zipfile.ZIP_DEFLATED
            pack.writestr(name, bytes(media), compresslevel=1)
            n += 1
            if pack.start_dir >= ARCHIVE_BYTES:
                pack.close()
                out.close()
                out = pack = None
        if pack is not None:
            pack.close()
            out.close()
        return Written(paths)

    def commit(self, messages):
        """Give the archives of committed tasks their final names; others keep a name that readers skip."""
        fs, _ = filesystem(self.uri)
        for m in messages:
            for p in m.paths if m else []:
                head, _, tail = p.rpartition("/_")
                fs.move(p, f"{head}/{tail}")

    def abort(self, messages):
        fs, _ = filesystem(self.uri)
        for m in messages:
            for p in m.paths if m else []:
                fs.delete_file(p)


class ArchiveReader(DataSourceReader):
    def __init__(self, uri: str, range_bytes: int, attempts: int):
        self.uri, self.range_bytes, self.attempts = uri, range_bytes, attempts

    def partitions(self):
        from pyarrow import fs as pafs

        fs, root = filesystem(self.uri)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        files = [(f.path, f.size) for f in found if f.base_name.endswith(".zip") and not f.base_name.startswith("_")]
        spans = [Span(p, at, at + self.range_bytes) for p, size in sorted(files) for at in range(0, size, self.range_bytes)]
        return spans or [Span("", 0, 0)]

    def _member(self, fs, path: str, info: zipfile.ZipInfo) -> bytes:
        """One member, by its offset and checked against its CRC; read anew on its own after a failure."""
        for attempt in range(self.attempts):
            try:
                with fs.open_input_file(path) as f:
                    f.seek(info.header_offset)
                    head = f.read(30)
                    f.seek(info.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
                    body = f.read(info.compress_size)
                data = zlib.decompress(body, -15) if info.compress_type == zipfile.ZIP_DEFLATED else body
                if zlib.crc32(data) != info.CRC:
                    raise OSError(f"{path}: member at {info.header_offset} doesn't match its CRC")
                return data
            except (OSError, zlib.error):
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(0.1 * 2**attempt)
        raise AssertionError("attempts must be positive")

    def read(self, span):
        if not span.path:
            return
        fs, _ = filesystem(self.uri)
        with fs.open_input_file(span.path) as f, zipfile.ZipFile(f) as z:
            mine = sorted((i for i in z.infolist() if span.start <= i.header_offset < span.end), key=lambda i: i.header_offset)
        ids: list[int | None] = []
        media: list[bytes] = []
        held = 0
        for info in mine:
            data = self._member(fs, span.path, info)
            doc_id = info.filename.partition("-")[2].removesuffix(".wav")
            ids.append(int(doc_id) if doc_id else None)
            media.append(data)
            held += len(data)
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "media"])
                ids, media, held = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "media"])


class MediaArchive(DataSource):
    """Options: path (folder URI), range_bytes, attempts."""

    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), int(self.options.get("attempts", 4)))

    def writer(self, schema, overwrite):
        return ArchiveWriter(self.options["path"])


def to_wav(payload: bytes) -> bytes:
    """8-bit mono samples, one per byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as w:
        return w.readframes(w.getnframes())


def pad(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % BLOCK or (BLOCK if not raw else 0))


def feature(payload: bytes) -> str:
    """Mean, deviation, zero crossings around the mean and 8 level shares of the samples."""
    x = np.frombuffer(payload, np.uint8)
    mean = x.mean()
    side = x >= mean
    shares = np.bincount(x >> 5, minlength=8) / len(x)
    return f"{mean:.4f};{x.std():.4f};{int((side[1:] != side[:-1]).sum())};" + ",".join(f"{v:.4f}" for v in shares)


def pack(docs: DataFrame) -> DataFrame:
    """(doc_id, media) of every text: its UTF-8 bytes, padded, as a WAV clip."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column("text").cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([to_wav(pad(t or b"")) for t in texts], pa.binary())], ["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def write_archives(media: DataFrame, path: str) -> None:
    media.sparkSession.dataSource.register(MediaArchive)
    media.write.format("media_archive").mode("append").option("path", path).save()


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("path", path).option("range_bytes", range_bytes).load()


def describe(media: DataFrame) -> DataFrame:
    """Digests and features of stored clips, from the stored bytes alone. The padding byte never occurs in UTF-8."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, m in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                p = from_wav(m)
                rows.append((doc_id, len(p.rstrip(b"\xff")), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(p)))
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every text as a clip under the shared folder, read the clips back and describe them."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    write_archives(pack(docs), path)
    return describe(read_archives(spark, path))
