"""Token ids as seekable zstandard files: one independent frame per document, a seek table at the end.

File: the documents' frames in ascending id order; a skippable frame with the
document ids (int64 each); the seek table of the zstandard seekable format, a
skippable frame with compressed size, content size and checksum (low 32 bits of
xxh64 of the content) per frame, frame count, a flag byte and a magic number.
Any zstandard reader decompresses the whole file; ``SeekableFile`` reads the
table and decompresses only the frames asked for, checking each. Ids are
little-endian, 2 bytes when the vocabulary fits, else 4.

Documents are encoded and compressed where they are read; only frames are
shuffled, to files by ranges of ids, whose bounds come from the id column alone.
A file appears under its name when complete, and a repeated task writes the same
bytes, so lost executors do no harm. Files go to the shared folder.

Defined cases: null or empty text holds only the end id; rows that repeat an id
follow one another, ordered by length and content; null ids come first (stored as
the smallest 64-bit integer); an empty table writes no file; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phrasedex.session import shared_dir

from .common import id_bounds, parts_for, plan_bytes, table
from .encoding import encoder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
FILE_TEXT_BYTES = 16 << 20
#: Fixed values of the zstandard frame and seekable formats.
SKIPPABLE_IDS, SKIPPABLE_SEEK, SEEK_FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
NO_ID = -(2**63)


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class SeekableWriter:
    """Appends frames to a file; ``close`` writes ids and seek table and gives the file its name."""

    def __init__(self, uri: str, attempt: str):
        self.fs, self.path = _filesystem(uri)
        self.part = f"{self.path}.{attempt}.part"
        self.out = self.fs.open_output_stream(self.part)
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int] = []
        self.size = 0

    def add(self, doc_id: int, frame: bytes, content_size: int, checksum: int) -> None:
        self.out.write(frame)
        self.entries.append((len(frame), content_size, checksum))
        self.ids.append(doc_id)
        self.size += len(frame)

    def close(self) -> int:
        ids = struct.pack("<II", SKIPPABLE_IDS, 8 * len(self.ids)) + np.array(self.ids, "<i8").tobytes()
        entries = [*self.entries, (len(ids), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        body = np.array(entries, "<u4").tobytes() + struct.pack("<IBI", len(entries), 0x80, SEEK_FOOTER)
        self.out.write(ids)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(body)) + body)
        self.out.close()
        self.fs.move(self.part, self.path)
        return self.size + len(ids) + 8 + len(body)


class SeekableFile:
    """Random access to a file's documents; reads the seek table, then only the frames asked for."""

    def __init__(self, uri: str):
        fs, path = _filesystem(uri)
        self.f = fs.open_input_file(path)
        size = self.f.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_FOOTER or not flags & 0x80:
            raise ValueError(f"no seek table with checksums in {uri}")
        table_at = size - 9 - 12 * n
        self.entries = np.frombuffer(self._at(table_at, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.entries[:, 0])])
        self.doc_ids = np.frombuffer(self._at(int(self.offsets[n - 1]) + 8, int(self.entries[n - 1, 0]) - 8), "<i8")
        self.uri, self.zstd = uri, zstandard.ZstdDecompressor()

    def _at(self, offset: int, n: int) -> bytes:
        self.f.seek(offset)
        return self.f.read(n)

    def content(self, k: int) -> bytes:
        """Ids of the file's k-th document, as stored."""
        size, content_size, checksum = (int(x) for x in self.entries[k])
        raw = self.zstd.decompress(self._at(int(self.offsets[k]), size), max_output_size=content_size)
        if len(raw) != content_size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"checksum of frame {k} in {self.uri}")
        return raw

    def close(self) -> None:
        self.f.close()


def _frames(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, bounds: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, z = encoder(tokenizer), zstandard.ZstdCompressor(level=3)
        width = "<u2" if enc.vocab_size <= 65536 and end_id < 65536 else "<u4"
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            ids = b.column(0).fill_null(NO_ID)
            raw = [np.frombuffer(x + end, "<u4").astype(width).tobytes() for x in enc.encode(b.column(1).fill_null("").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.searchsorted(bounds, ids.to_numpy(zero_copy_only=False), side="right").astype(np.int32)),
                    ids,
                    pa.array([len(r) for r in raw], pa.int64()),
                    pa.array([xxhash.xxh64_intdigest(r) & 0xFFFFFFFF for r in raw], pa.int64()),
                    pa.array([z.compress(r) for r in raw], pa.binary()),
                ],
                ["shard", "doc_id", "size", "checksum", "frame"],
            )
        enc.rest()

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return source.mapInArrow(run, "shard int, doc_id long, size long, checksum long, frame binary")


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                      tokenizer: str = TOKENIZER, end_id: int = END_ID, file_text_bytes: int = FILE_TEXT_BYTES) -> DataFrame:
    """Write the files under ``path``; returns the manifest (shard, file, width, n_docs, n_tokens, n_bytes), stored beside them."""
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    n = parts_for(plan_bytes(docs), file_text_bytes)
    bounds = id_bounds(ids, "doc_id", n)
    with_vocab = 2 if encoder(tokenizer).vocab_size <= 65536 and end_id < 65536 else 4
    fs, folder = _filesystem(path)
    fs.create_dir(folder, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = str(TaskContext.get().taskAttemptId())
        out, shard, tokens = None, None, 0
        done: list[tuple] = []

        def close() -> None:
            if out is not None:
                done.append((shard, out.path.rsplit("/", 1)[1], with_vocab, len(out.ids), tokens, out.close()))

        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for s, doc_id, size, checksum, frame in zip(*cols):
                if s != shard:
                    close()
                    out, shard, tokens = SeekableWriter(f"{path}/tokens-{s:08d}.zst", attempt), s, 0
                out.add(doc_id, frame, size, checksum)
                tokens += size // with_vocab
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["shard", "file", "width", "n_docs", "n_tokens", "n_bytes"])

    frames = _frames(docs, id_col, text_col, tokenizer, end_id, bounds)
    ordered = frames.repartition(n, "shard").sortWithinPartitions("shard", "doc_id", "size", "checksum")
    schema = "shard long, file string, width long, n_docs long, n_tokens long, n_bytes long"
    ordered.mapInArrow(write, schema).write.parquet(f"{path}/_manifest")
    return spark.read.parquet(f"{path}/_manifest")


def read_token_files(manifest: DataFrame, path: str, wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the stored documents; ``wanted``: only these ids, other frames stay unread.

    ``start`` counts the ids of all documents before it, over all files. ids: little-endian unsigned 32-bit.
    """
    keep = None if wanted is None else np.array(sorted(wanted), np.int64)
    # One row per file: the running sum is over files.
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("before", before).select("shard", "file", "width", "before")
    spread = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                f = SeekableFile(f"{path}/{row['file']}")
                width = "<u2" if row["width"] == 2 else "<u4"
                n = len(f.doc_ids)
                starts = row["before"] + np.concatenate([[0], np.cumsum(f.entries[:n, 1] // row["width"])])
                picked = np.arange(n) if keep is None else np.flatnonzero(np.isin(f.doc_ids, keep))
                for k in range(0, len(picked), 512):
                    at = picked[k : k + 512]
                    ids = [np.frombuffer(f.content(int(i)), width).astype("<u4") for i in at]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([None if x == NO_ID else x for x in f.doc_ids[at].tolist()], pa.int64()),
                            pa.array(starts[at], pa.int64()),
                            pa.array([len(x) for x in ids], pa.int64()),
                            pa.array([x.tobytes() for x in ids], pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )
                f.close()

    return files.repartition(spread, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def token_file_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of ``docs`` written to token files and read back from them."""
    path = shared_dir(docs.sparkSession, "token-files")
    manifest = write_token_files(docs, path)

    @F.pandas_udf("long")
    def crc(ids: pd.Series) -> pd.Series:
        return ids.map(zlib.crc32).astype("int64")

    return read_token_files(manifest, path).select("doc_id", "start", "n_tokens", crc("ids").alias("ids_crc32"))


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    return token_file_digest(table(spark, sf_dir, "documents"))
