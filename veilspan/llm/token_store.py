"""Token ids in files of independent zstandard frames.

A file holds documents in ascending order of id. Each document is one frame or, beyond ``FRAME_IDS`` ids, several; an
empty one is a frame of no bytes. A frame stands by itself, so a reader decompresses the requested documents only. Frames are followed by an
index of documents and a seek table, both in skippable frames, so any zstandard tool can read the file too. The seek
table is the last thing in the file and ends with its own size.

    frame*            ids as little-endian unsigned 32-bit integers
    documents         skippable frame 0x184D2A50: for each document its id (signed 64-bit; the smallest value: null) and number of frames (32-bit)
    seek table        skippable frame 0x184D2A5E: for each frame its compressed size, size and checksum (XXH64, low half), each 32-bit;
                      then the number of frames (32-bit), a descriptor byte (0x80: with checksums) and the number 0x8F92EAB1
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.base import groups_by_size, pick, resident, scratch
from veilspan.llm.bpe import ChunkStore

# Fixed values of the seekable zstandard format, and of this format's index.
SEEK_FRAME, SEEK_END, DOCUMENTS_FRAME, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50, 0x80

FRAME_IDS = 1 << 20
LEVEL = 3
END_ID = 2
CHUNK_CHARS = 2_000_000
REMEMBERED_CHUNKS = 1_200_000
LAID_CHUNKS = 2_000
NO_ID = -(1 << 63)


class StoreError(ValueError):
    """A file isn't whole, or a frame's checksum differs."""


class Writer:
    """Writes one file. Memory: the current document and 12 bytes for each frame."""

    def __init__(self, sink, level: int = LEVEL) -> None:
        self.sink, self.pack = sink, zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.documents: list[bytes] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if doc_id == NO_ID:
            raise ValueError(f"the id {NO_ID} stands for a null in the file")
        count = 0
        for start in range(0, max(len(ids), 1), 4 * FRAME_IDS):
            raw = ids[start : start + 4 * FRAME_IDS]
            packed = self.pack.compress(raw)
            self.sink.write(packed)
            self.frames.append(struct.pack("<III", len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            count += 1
        self.documents.append(struct.pack("<qI", NO_ID if doc_id is None else doc_id, count))

    def close(self) -> None:
        index = b"".join(self.documents)
        self.sink.write(struct.pack("<II", DOCUMENTS_FRAME, len(index)) + index)
        table = b"".join(self.frames) + struct.pack("<IBI", len(self.frames), WITH_CHECKSUMS, SEEK_END)
        self.sink.write(struct.pack("<II", SEEK_FRAME, len(table)) + table)


class Reader:
    """Reads one file through a seekable source; only the index and the requested frames are read."""

    def __init__(self, source) -> None:
        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        end = source.seek(0, os.SEEK_END)
        if end < 17:
            raise StoreError("too short for a seek table")
        frames, kind, mark = struct.unpack("<IBI", self._at(end - 9, 9))
        if mark != SEEK_END or kind != WITH_CHECKSUMS:
            raise StoreError("no seek table with checksums at the end")
        start = end - 9 - 12 * frames
        self.frames = np.frombuffer(self._at(start, 12 * frames), "<u4").reshape(-1, 3)
        self.starts = np.concatenate(([0], np.cumsum(self.frames[:, 0], dtype=np.int64)))
        magic, size = struct.unpack("<II", self._at(int(self.starts[-1]), 8))
        if magic != DOCUMENTS_FRAME:
            raise StoreError("no index of documents after the frames")
        index = np.frombuffer(self._at(int(self.starts[-1]) + 8, size), np.dtype([("id", "<i8"), ("n", "<u4")]))
        self.ids = [None if x == NO_ID else int(x) for x in index["id"]]
        self.first = np.concatenate(([0], np.cumsum(index["n"], dtype=np.int64)))

    def _at(self, position: int, size: int) -> bytes:
        self.source.seek(position)
        raw = self.source.read(size)
        if len(raw) != size:
            raise StoreError("the file ends too early")
        return raw

    def __len__(self) -> int:
        return len(self.ids)

    def document(self, number: int) -> np.ndarray:
        """Ids of the document that stands at ``number`` in the file."""
        parts = []
        for frame in range(int(self.first[number]), int(self.first[number + 1])):
            packed, size, check = (int(x) for x in self.frames[frame])
            try:
                raw = self.unpack.decompress(self._at(int(self.starts[frame]), packed), max_output_size=size) if size else b""
            except zstandard.ZstdError as error:
                raise StoreError(f"frame {frame} can't be read") from error
            if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
                raise StoreError(f"frame {frame} differs from its checksum")
            parts.append(np.frombuffer(raw, "<u4"))
        return np.concatenate(parts) if len(parts) > 1 else parts[0]


class LibraryEncoder:
    """A tokenizer file of the tokenizers library, with the ids of chunks of text remembered.

    The library's byte-level pattern cuts a chunk alike wherever it stands, so it is asked for each chunk once. Texts that hold an added token go
    through it whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED_CHUNKS, special_as_text: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        self.added = [] if special_as_text else [token.content for token in self.library.get_added_tokens_decoder().values()]
        self.store = ChunkStore(self.learn, self._whole, remembered)
        self.sizes = np.zeros(self.library.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            self.sizes[i] = len(token)  # a byte-level token has a character for each byte

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks. Those that begin with a space are laid end to end, which cuts them alike."""
        out: list[bytes] = [b""] * len(chunks)
        laid = [i for i, chunk in enumerate(chunks) if chunk[:1] == " "]
        single = [i for i, chunk in enumerate(chunks) if chunk[:1] != " "]
        for i, found in zip(single, self.library.encode_batch_fast([chunks[i] for i in single], add_special_tokens=False), strict=True):
            out[i] = np.array(found.ids, "<u4").tobytes()
        if laid:
            ids, sizes = self.laid_ids([chunks[i] for i in laid], np.fromiter((len(chunks[i].encode()) for i in laid), np.int64, len(laid)))
            raw, start = ids.tobytes(), 0
            for i, end in zip(laid, (4 * np.cumsum(sizes)).tolist(), strict=True):
                out[i] = raw[start:end]
                start = end
        return out

    def laid_ids(self, chunks: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of each chunk's) of chunks that begin with a space; ``lengths``: their bytes, which tell where one's ids end."""
        places = range(0, len(chunks), LAID_CHUNKS)
        found = self.library.encode_batch_fast(["".join(chunks[k : k + LAID_CHUNKS]) for k in places], add_special_tokens=False)
        ids = np.array([i for run in found for i in run.ids], "<u4") if len(found) < 2 else np.concatenate([np.array(run.ids, "<u4") for run in found])
        reached, ends = np.cumsum(self.sizes[ids]), np.cumsum(lengths)
        at = np.searchsorted(reached, ends)
        if len(ids) != int(at[-1]) + 1 or (reached[at] != ends).any():
            raise ValueError("the vocabulary isn't byte-level: its tokens don't add up to the text")
        return ids, np.diff(at, prepend=-1)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        whole = [i for i, text in enumerate(texts) if text and any(token in text for token in self.added)]
        kept = list(texts)
        for i in whole:
            kept[i] = None
        out = self.store.encode(kept)
        for i in whole:
            out[i] = self._whole(texts[i])
        return out


def library_encoder(path: str) -> LibraryEncoder:
    return resident(("encoder", path), lambda: LibraryEncoder(path))


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ``docs`` to files below ``folder`` (a shared one) and returns their manifest: (shard, path, n_docs, n_tokens, start), by shard.

    Rows are dealt out by ranges of the id, null ids first, rows with one id by text; each range becomes a file. A file is
    written under a name of the attempt and renamed when whole, so a repeated task leaves one file. The manifest has a row for each
    file; it alone comes to the driver, for the number of ids before each file.
    """
    spark = docs.sparkSession
    kind = dict(pick(docs, doc_id=id_col).dtypes)["doc_id"]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"the file holds whole numbers as ids; {id_col!r} is {kind}")
    ordered = pick(docs, doc_id=id_col, text=text_col).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, shard = library_encoder(tokenizer), TaskContext.get().partitionId()
        system, root = _file_system(folder)
        writer = sink = None
        end = end_id.to_bytes(4, "little")
        n_docs = n_tokens = 0
        path, attempt = f"{root}/{shard:06d}.ids", f"{root}/.{shard:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(1).cast(pa.binary())]
            for first, last in groups_by_size(sizes, CHUNK_CHARS):
                part = batch.slice(first, last - first)
                if writer is None:
                    system.create_dir(root, recursive=True)
                    writer = Writer(sink := system.open_output_stream(attempt))
                for doc_id, ids in zip(part.column(0).to_pylist(), own.encode(part.column(1).to_pylist()), strict=True):
                    writer.add(doc_id, ids + end)
                    n_docs, n_tokens = n_docs + 1, n_tokens + len(ids) // 4 + 1
        if writer is not None:
            writer.close()
            sink.close()
            if system.get_file_info(path).type != fs.FileType.NotFound:
                system.delete_file(path)  # of an attempt that was lost; some stores don't rename onto a file
            system.move(attempt, path)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64())})

    rows = sorted(ordered.mapInArrow(run, "shard int, path string, n_docs long, n_tokens long").collect())
    starts = np.cumsum([0, *(row.n_tokens for row in rows)]).tolist()
    return spark.createDataFrame([(*row, start) for row, start in zip(rows, starts, strict=False)], "shard int, path string, n_docs long, n_tokens long, start long")


def batches(reader: Reader, start: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, start, ids) of a file's documents, about ``CHUNK_CHARS`` bytes of ids at once or one document's."""
    held, size = [], 0
    for number, doc_id in enumerate(reader.ids):
        ids = reader.document(number).tobytes()
        held.append((doc_id, start, ids))
        start, size = start + len(ids) // 4, size + len(ids)
        if size > CHUNK_CHARS or len(held) >= 256:
            yield _documents(held)
            held, size = [], 0
    if held:
        yield _documents(held)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the files, ids as little-endian unsigned 32-bit integers; ``start``: ids before it."""

    def run(given: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(folder)
        for batch in given:
            for row in batch.to_pylist():
                with system.open_input_file(row["path"]) as source:
                    yield from batches(Reader(source), row["start"])

    files = max(1, manifest.count())
    return manifest.select("path", "start").repartition(files, "path").mapInArrow(run, "doc_id long, start long, ids binary")


def _documents(rows: list[tuple[int | None, int, bytes]]) -> pa.RecordBatch:
    ids, starts, raw = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "start", "ids"])


def lookup(folder_uri: str, path: str, numbers: list[int]) -> list[np.ndarray]:
    """Ids of the documents that stand at ``numbers`` in a file; other documents aren't decompressed."""
    system, _ = _file_system(folder_uri)
    with system.open_input_file(path) as source:
        reader = Reader(source)
        return [reader.document(number) for number in numbers]


def checksum(ids: bytes) -> int:
    return zlib.crc32(ids)


def new_folder(spark: SparkSession) -> str:
    return scratch(spark, "tokens")


def store_and_read(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, ids) of each row, written to new files below the shared folder and read back from them.

    A null or empty text has the end id alone. Rows with one id stand side by side, in the order of their texts; null ids come
    first. Ids are whole numbers above the smallest long, which stands for a null; others are an error. An empty table gives no file and no rows. Further columns are ignored, whatever their names. Texts are taken whole: memory
    follows the longest text and ``CHUNK_CHARS``.
    """
    folder = new_folder(docs.sparkSession)
    return read(write(docs, tokenizer, folder, end_id, id_col, text_col), folder)
