"""Token ids as binary files of independent zstandard frames with a seek table.

A file holds, in this order: the frames, one or more per document; a skippable
frame that lists the documents (ids, null marks, frames of each); a skippable
frame that is a seek table of the zstandard seekable format, with a checksum of
each frame's content. Any zstandard reader can read the whole file; a reader of
some documents reads the two tables and decompresses their frames only.

Rows are put into ranges of ascending doc_id, one file each, nulls first; a task
writes under a name of its own and renames when done, so a repeated task leaves
a whole file, whichever attempt wins. Files go to the folder given, which all
executors share.

The tokenizer is used as its file has it: the name of an added token in a text is that
token. Texts are cut only where no such name can hold a cut; with a tokenizer whose names do, whole texts are encoded.

Defined results: a null text is an empty one and has the end id only; rows with
one doc_id follow each other, ordered by text; an empty table makes no file.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.common import prepare
from sensorloom.session import cut_lineage

END_ID = 0
LEVEL = 3
FRAME_BYTES = 1 << 22
# Chunks met first are remembered, the frequent ones among them; up to about 300 MB.
CACHED = 1_200_000
REMEMBERED = 64
# Fixed values of the zstandard formats.
SEEK_TABLE_FRAME = 0x184D2A5E
DOCUMENT_FRAME = 0x184D2A50
SEEKABLE = 0x8F92EAB1
CHECKSUMS = 0x80
# White space as the tokenizer's pattern has it. It never joins a space to what
# stands before it, so a text may be cut before any run of spaces. Nor does it join a letter to
# a mark after it, so that a word is one chunk whatever mark ends it; Latin letters will do for that.
_GAP = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LETTERS = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
_CHUNK = re.compile(f"[{_GAP}]*+(?:[{_LETTERS}]++(?=[.,;:!?])|[^{_GAP}]++)|[{_GAP}]+")

_END = struct.pack("<I", END_ID)
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Encodes texts in chunks, each different chunk once while it is remembered."""

    def __init__(self, path: str):
        # Tasks share the machine's cores already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        added = self.tokenizer.get_added_tokens_decoder().values()
        # No name may hold a cut, nor take the spaces after it.
        self.cuts = all(_CHUNK.findall(t.content) == [t.content.strip()] and not t.rstrip for t in added)

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        return _ENCODERS[path]

    def encode(self, text: str | None) -> bytes:
        """The ids of a text and the end id, 4 bytes each, little-endian."""
        if not self.cuts:
            return self._ids([text or ""])[0] + _END
        chunks = _CHUNK.findall(text or "")
        parts = list(map(self.known.get, chunks))
        if None in parts:
            new = list(dict.fromkeys([c for c, p in zip(chunks, parts) if p is None]))
            found = dict(zip(new, self._ids(new)))
            parts = [found[c] if p is None else p for c, p in zip(chunks, parts)]
            for c, ids in found.items():
                if len(self.known) >= CACHED:
                    break
                if len(c) <= REMEMBERED:
                    self.known[c] = ids
        return b"".join(parts) + _END

    def _ids(self, texts: list[str]) -> list[bytes]:
        # Places in the text are not asked for, which makes it the faster call.
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class Writer:
    """Writes one file to an open binary stream."""

    def __init__(self, out):
        self.out = out
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int] = []
        self.nulls: list[bool] = []
        self.counts: list[int] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        starts = range(0, len(ids), FRAME_BYTES)
        for at in starts:
            part = ids[at : at + FRAME_BYTES]
            frame = self.pack.compress(part)
            self.out.write(frame)
            self.frames.append((len(frame), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(starts))
        self.tokens += len(ids) // 4

    def close(self) -> None:
        documents = struct.pack("<I", len(self.ids))
        documents += np.array(self.ids, dtype="<i8").tobytes()
        documents += np.array(self.nulls, dtype="u1").tobytes()
        documents += np.array(self.counts, dtype="<u4").tobytes()
        listed = _skippable(DOCUMENT_FRAME, documents)
        self.out.write(listed)
        # The document list is an entry of its own, so that sizes add up to the file.
        table = np.array([*self.frames, (len(listed), 0, 0)], dtype="<u4").tobytes()
        table += struct.pack("<IBI", len(self.frames) + 1, CHECKSUMS, SEEKABLE)
        self.out.write(_skippable(SEEK_TABLE_FRAME, table))


class Reader:
    """Reads a file's tables, and then single documents."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        head = end - 9 - 12 * n - 8
        mark, size = struct.unpack("<II", self._at(head, 8))
        if mark != SEEK_TABLE_FRAME or size != 12 * n + 9:
            raise ValueError("broken seek table")
        self.table = np.frombuffer(self._at(head + 8, 12 * n), dtype="<u4").reshape(n, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        listed = self._at(int(self.starts[n - 1]), int(self.table[n - 1, 0]))
        mark, _, n_docs = struct.unpack_from("<III", listed)
        if mark != DOCUMENT_FRAME:
            raise ValueError("broken document list")
        ids = np.frombuffer(listed, dtype="<i8", count=n_docs, offset=12)
        nulls = np.frombuffer(listed, dtype="u1", count=n_docs, offset=12 + 8 * n_docs)
        counts = np.frombuffer(listed, dtype="<u4", count=n_docs, offset=12 + 9 * n_docs)
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, nulls)]
        self.first = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        self.unpack = zstandard.ZstdDecompressor()

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def document(self, i: int) -> bytes:
        """The ids of the i-th document, checked."""
        parts = []
        for f in range(int(self.first[i]), int(self.first[i + 1])):
            packed, plain, checksum = (int(v) for v in self.table[f])
            part = self.unpack.decompress(self._at(int(self.starts[f]), packed))
            if len(part) != plain or xxhash.xxh64_intdigest(part) & 0xFFFFFFFF != checksum:
                raise ValueError(f"frame {f} is damaged")
            parts.append(part)
        return b"".join(parts)

    def find(self, doc_id: int | None) -> list[int]:
        return [i for i, d in enumerate(self.doc_ids) if d == doc_id]


def write(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Writes the files; returns (part, file, n_docs, n_tokens), one row per file.

    ``tokenizer`` is the path of a file of the tokenizers library.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        part = context.partitionId()
        encoder = Encoder.of(tokenizer)
        writer = None
        unfinished = f"{root}/unfinished-{part:06d}-{context.taskAttemptId()}"
        for batch in batches:
            for doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text"))):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    writer = Writer(fs.open_output_stream(unfinished, compression=None))
                writer.add(doc_id, encoder.encode(text))
        if writer is None:
            return
        writer.close()
        writer.out.close()
        name = f"part-{part:06d}-{context.taskAttemptId()}.ids.zst"
        fs.move(unfinished, f"{root}/{name}")
        yield pa.RecordBatch.from_pylist(
            [{"part": part, "file": name, "n_docs": len(writer.ids), "n_tokens": writer.tokens}],
            schema=pa.schema(
                [("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]
            ),
        )

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text"))
    ordered = ordered.sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    files = ordered.mapInArrow(run, "part int, file string, n_docs long, n_tokens long")
    return cut_lineage(files, "token-files")


def read(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, ids) of every document, from the files listed."""
    prepare(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(*(batch.column(c).to_pylist() for c in ("file", "start"))):
                with fs.open_input_file(f"{root}/{name}") as source:
                    yield from _documents(Reader(source), start)

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    # One row per file; a fixed count keeps small rows from ending up in one task.
    spread = placed.select("file", "start").repartition(max(1, files.count()))
    return spread.mapInArrow(run, "doc_id long, start long, ids binary")


def _documents(reader: Reader, start: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])
    rows, held = [], 0
    for i, doc_id in enumerate(reader.doc_ids):
        ids = reader.document(i)
        rows.append({"doc_id": doc_id, "start": start, "ids": ids})
        start += len(ids) // 4
        held += len(ids)
        if held >= FRAME_BYTES:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def digest(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Writes all documents and describes each one as read back from the files."""
    found = read(write(docs, folder, tokenizer), folder)
    return found.select(
        "doc_id",
        "start",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.crc32("ids").cast("long").alias("ids_crc32"),
    )
