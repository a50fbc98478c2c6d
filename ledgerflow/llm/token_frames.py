"""Token ids in binary files: one independent zstandard frame per document, a trailing seek table, checksums per frame.

File layout (all integers little-endian):

* one zstandard frame per document, holding its ids as unsigned 32-bit integers;
* a skippable frame with the documents' ids: per document an int64 and, after all of them, one byte (1: the id is null);
* a skippable frame with the seek table of the zstandard seekable format: per frame its compressed size, its
  decompressed size and the low 32 bits of the XXH64 of its content, then the number of frames, a descriptor byte
  (128: checksums are there) and the format's magic number.

A reader takes the seek table from the file's end and decompresses only the frames of the documents it wants. The
skippable id frame comes as the last entry of the table with no content, so the sizes add up to the file's data.

Documents are dealt to files by ranges of (id, text hash), so files in name order hold all documents in ascending id
order, and no id, however often it repeats, makes one file large. Each task writes to a name of its own and renames it
when complete; a repeated task replaces the file by an equal one. Only one row per file comes to the driver.

Edge cases: a null or empty text has only the end id; a null id comes first; rows with equal ids are ordered by text
and all kept; an empty table gives no file rows; other columns are ignored. A document may hold 2^30 ids at most, the
format's limit for one frame.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm.common import input_bytes, new_path
from ledgerflow.llm.encoder import worker_encoder

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
FILE_BYTES = 64 << 20  # of text per file
# fixed values of the zstandard seekable format
SEEK_TABLE_MAGIC = 0x184D2A5E
ID_FRAME_MAGIC = 0x184D2A50
SEEKABLE_MAGIC = 0x8F92EAB1
_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])


class Corrupt(ValueError):
    """A frame's content doesn't have the checksum of the seek table."""


def file_system(uri: str):
    """(filesystem, path) of a uri that Spark wrote, local or remote."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri[len("file:/") :]
    return fs.FileSystem.from_uri(uri)


def write_frames(out, docs: Iterable[tuple[int | None, bytes]], level: int = 3) -> tuple[int, int]:
    """Write documents (id, content) to a binary stream; (documents, bytes of content)."""
    import xxhash
    import zstandard

    packer = zstandard.ZstdCompressor(level=level, write_checksum=False)
    entries, ids, nulls, total = [], [], bytearray(), 0
    for doc_id, content in docs:
        frame = packer.compress(content)
        out.write(frame)
        entries.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        ids.append(0 if doc_id is None else doc_id)
        nulls.append(doc_id is None)
        total += len(content)
    index = np.asarray(ids, "<i8").tobytes() + bytes(nulls)
    out.write(struct.pack("<II", ID_FRAME_MAGIC, len(index)) + index)
    entries.append((len(index) + 8, 0, 0))
    table = np.array(entries, dtype=_ENTRY).tobytes()
    out.write(struct.pack("<II", SEEK_TABLE_MAGIC, len(table) + 9) + table + struct.pack("<IBI", len(entries), 128, SEEKABLE_MAGIC))
    return len(ids), total


class FrameFile:
    """Random access to a file of frames."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 9)
        count, descriptor, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or descriptor != 128:
            raise Corrupt("no seek table with checksums at the end of the file")
        source.seek(size - 9 - _ENTRY.itemsize * count)
        table = np.frombuffer(source.read(_ENTRY.itemsize * count), _ENTRY)
        self.at = np.concatenate(([0], np.cumsum(table["packed"].astype(np.int64))))
        source.seek(int(self.at[count - 1]) + 8)
        index = source.read(int(table["packed"][count - 1]) - 8)
        self.table, n = table[:-1], count - 1
        ids = np.frombuffer(index[: 8 * n], "<i8")
        self.ids = [None if gone else int(i) for i, gone in zip(ids, index[8 * n :])]

    def __len__(self) -> int:
        return len(self.table)

    def content(self, k: int) -> bytes:
        """Of document k of the file, checked; only its frame is read and decompressed."""
        import xxhash
        import zstandard

        packed, size, check = (int(x) for x in self.table[k])
        self.source.seek(int(self.at[k]))
        got = zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=max(size, 1)) if size else b""
        if len(got) != size or xxhash.xxh64_intdigest(got) & 0xFFFFFFFF != check:
            raise Corrupt(f"frame {k} is damaged")
        return got


def write_token_files(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
    end_id: int = END_ID, file_bytes: int = FILE_BYTES, plain_specials: bool = True,
) -> list[tuple[str, int, int]]:
    """Encode and write all documents below ``path``; (file, documents, ids) per file in ascending order of the ids. With
    ``plain_specials``, special tokens' strings in a text are plain text; else they are what the library makes of them."""
    end = np.asarray([end_id], "<u4").tobytes()
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = worker_encoder(vocabulary, plain_specials), TaskContext.get()

        def contents() -> Iterator[tuple[int | None, bytes]]:
            for b in batches:
                for at in range(0, b.num_rows, 512):
                    some = b.slice(at, 512)
                    for doc_id, ids in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist())):
                        yield doc_id, ids + end

        target, where = file_system(path)
        target.create_dir(where, recursive=True)
        name = f"part-{task.partitionId():06d}.zst"
        own = f"{where}/_{name}.{task.taskAttemptId()}"
        with target.open_output_stream(own) as out:
            n, size = write_frames(out, contents())
        target.move(own, f"{where}/{name}")
        yield pa.record_batch([pa.array([name]), pa.array([n], pa.int64()), pa.array([size // 4], pa.int64())], names=["file", "n_docs", "n_ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    files = max(1, -(-input_bytes(rows, "text") // file_bytes), spark.sparkContext.defaultParallelism)
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(files, "doc_id", tie).sortWithinPartitions("doc_id", "text")
    done = dealt.mapInArrow(write, "file string, n_docs long, n_ids long").collect()
    return sorted((f"{path}/{r.file}", r.n_docs, r.n_ids) for r in done)


def read_token_files(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of the files; start counts the ids of all documents before."""
    rows, start = [], 0
    for name, _, ids in files:
        rows.append((name, start))
        start += ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(*(c.to_pylist() for c in b.columns)):
                source, where = file_system(name)
                with source.open_input_file(where) as f:
                    frames = FrameFile(f)
                    for lo in range(0, len(frames), 256):
                        ks = range(lo, min(lo + 256, len(frames)))
                        ids = [frames.content(k) for k in ks]
                        sizes = np.asarray([len(x) // 4 for x in ids], np.int64)
                        starts = base + np.concatenate(([0], np.cumsum(sizes)[:-1]))
                        base += int(sizes.sum())
                        yield pa.record_batch(
                            [pa.array([frames.ids[k] for k in ks], pa.int64()), pa.array(starts), pa.array(sizes), pa.array(ids, pa.binary())],
                            names=["doc_id", "start", "n_tokens", "ids"])

    listed = spark.createDataFrame(rows, "file string, start long").repartition(max(1, len(rows)))
    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, **how) -> DataFrame:
    """Write all documents to new files in the shared folder, read them back: (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    files = write_token_files(docs, new_path(spark, "token_frames"), **how)
    return read_token_files(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
