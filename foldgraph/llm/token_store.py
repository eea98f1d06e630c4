"""Token-ID files: independent zstandard frames with a trailing seek table.

Layout of a file (the seekable form of zstandard, readable by any decoder):

* frames, each holding the ids (little-endian unsigned 32-bit) of a run of whole
  documents, compressed on its own;
* a skippable frame 0x184D2A50 with the document index, itself compressed: doc_id
  (int64), frame (uint32), first id within the frame (uint64), ids (uint64);
* a skippable frame 0x184D2A5E, the seek table: compressed size, size and checksum
  (low 32 bits of XXH64 of the uncompressed data) of each data frame, then the
  number of frames, a descriptor byte (0x80: with checksums) and 0x8F92EAB1.

A reader takes the table from the end of the file and decompresses just the frames
of the documents it is asked for, checking each against its checksum.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, small_batches

_SKIP_INDEX, _SKIP_TABLE, _MAGIC, _CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("sum", "<u4")])
_DOC = np.dtype([("doc_id", "<i8"), ("frame", "<u4"), ("first", "<u8"), ("n", "<u8")])
#: Stands for a null key in the index (the smallest int64); read back as null.
NO_KEY = -(1 << 63)
#: A frame is closed when it holds this many bytes of ids; one longer document has a frame of its own.
FRAME_BYTES = 1 << 18
#: Entries of a worker's memo of encoded words, after which it starts afresh.
MEMO = 1_000_000


class StoreError(ValueError):
    """A file that is cut short, or a frame that its checksum doesn't match."""


# ---------------------------------------------------------------- file format


def _sum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """Writes documents in the order given; ``close`` adds the index and the seek table."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 1):
        self.out, self.most = out, frame_bytes
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int]] = []
        self.open: list[bytes] = []
        self.held = 0

    def add(self, doc_id: int, ids: bytes) -> None:
        if self.held and self.held + len(ids) > self.most:
            self._flush()
        self.docs.append((doc_id, len(self.frames), self.held // 4, len(ids) // 4))
        self.open.append(ids)
        self.held += len(ids)

    def _flush(self) -> None:
        if self.open:
            data = b"".join(self.open)
            packed = self.pack(data)
            self.out.write(packed)
            self.frames.append((len(packed), len(data), _sum(data)))
            self.open, self.held = [], 0

    def close(self) -> None:
        self._flush()
        index = self.pack(np.array(self.docs, _DOC).tobytes())
        self.out.write(struct.pack("<II", _SKIP_INDEX, len(index)) + index)
        table = np.array(self.frames, _ENTRY).tobytes()
        self.out.write(struct.pack("<II", _SKIP_TABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), _CHECKSUMS, _MAGIC))


class Reader:
    """Reads a seekable binary file; holds its tables and one decompressed frame."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, os.SEEK_END)
        if end < 17:
            raise StoreError("too short for a seek table")
        count, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != _MAGIC or flags != _CHECKSUMS:
            raise StoreError("no seek table at the end")
        start = end - 9 - count * _ENTRY.itemsize
        head = struct.unpack("<II", self._at(start - 8, 8)) if start >= 8 else None
        if head != (_SKIP_TABLE, count * _ENTRY.itemsize + 9):
            raise StoreError("the seek table is damaged")
        self.frames = np.frombuffer(self._at(start, count * _ENTRY.itemsize), _ENTRY)
        self.begin = np.concatenate(([0], np.cumsum(self.frames["packed"], dtype=np.int64)))
        kind, size = struct.unpack("<II", self._at(int(self.begin[-1]), 8))
        if kind != _SKIP_INDEX or self.begin[-1] + 8 + size != start - 8:
            raise StoreError("the document index is damaged")
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.docs = np.frombuffer(self.unpack(self._at(int(self.begin[-1]) + 8, size)), _DOC)
        self.last = (-1, b"")

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        data = self.file.read(size)
        if len(data) != size:
            raise StoreError("the file is cut short")
        return data

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            x = self.frames[k]
            try:
                data = self.unpack(self._at(int(self.begin[k]), int(x["packed"])), max_output_size=max(1, int(x["size"])))
            except zstandard.ZstdError as e:
                raise StoreError(f"frame {k} can't be decompressed") from e
            if len(data) != x["size"] or _sum(data) != x["sum"]:
                raise StoreError(f"frame {k} doesn't match its checksum")
            self.last = (k, data)
        return self.last[1]

    def ids(self, row: int) -> bytes:
        """The ids of the document in row ``row`` of the index."""
        d = self.docs[row]
        first = 4 * int(d["first"])
        return self.frame(int(d["frame"]))[first : first + 4 * int(d["n"])] if d["n"] else b""

    def find(self, doc_ids: Iterable[int]) -> Iterator[tuple[int, bytes]]:
        """``(doc_id, ids)`` of the requested documents, in file order."""
        for row in np.flatnonzero(np.isin(self.docs["doc_id"], np.fromiter(doc_ids, np.int64))).tolist():
            yield int(self.docs["doc_id"][row]), self.ids(row)


# ---------------------------------------------------------------- tokens


# The split pattern of byte-level pre-tokenizers; the standard library's form of it, which
# cuts alike where a text has no character but these (no digits of other scripts, no odd spaces).
_BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BYTE_LEVEL_PLAIN = re.compile(r" ?[^\W\d_]+| ?\d+|'(?:[stmd]|re|ve|ll)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_NOT_PLAIN = re.compile(r"[^\t-\r -~\u00c0-\u02af]")


class WordEncoder:
    """Encodes with the tokenizers library, each distinct word of the texts once.

    The byte-level pre-tokenizer cuts a text into words that never merge with each
    other, and cuts each of those words into itself; so the ids of a text are the
    ids of its words in order.
    """

    def __init__(self, path: str, pattern: str, memo: int = MEMO):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.has_added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        any_split, plain_split = regex.compile(pattern).findall, _BYTE_LEVEL_PLAIN.findall
        self.split = (lambda t: any_split(t) if _NOT_PLAIN.search(t) else plain_split(t)) if pattern == _BYTE_LEVEL else any_split
        self.memo, self.most = {}, memo
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)  # by id: does it begin with a space?
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True

    def _learn(self, words: list[str]) -> None:
        """Words of a space and letters are encoded as one text; only their first ids begin with a space."""
        plain = [w for w in words if w[0] == " " and w[1:].isalpha()]
        for i in range(0, len(plain), 4000):
            part = plain[i : i + 4000]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, "<u4")
            first = np.flatnonzero(self.spaced[ids])
            if len(first) != len(part):
                raise AssertionError("the pre-tokenizer doesn't cut as the pattern does")
            data, at = ids.tobytes(), [*(4 * first).tolist(), 4 * len(ids)]
            self.memo.update(zip(part, map(data.__getitem__, map(slice, at[:-1], at[1:])), strict=True))
        rest = list(set(words).difference(plain))
        for i in range(0, len(rest), 1000):
            part = rest[i : i + 1000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.memo[w] = struct.pack(f"<{len(e.ids)}I", *e.ids)

    def encode_all(self, texts: list[str | None], chars: int = 1 << 20) -> Iterator[bytes]:
        """The ids of each text; words that are new to the memo are learned about ``chars`` of text at a time."""
        held: list[list[str]] = []
        whole: dict[int, str] = {}
        size = 0
        for k, text in enumerate(texts):
            added = self.has_added(text or "")
            if added:
                whole[len(held)] = text
            held.append([] if added else self.split(text or ""))
            size += len(text or "")
            if size >= chars or k == len(texts) - 1:
                if new := set().union(*held).difference(self.memo):
                    if len(self.memo) + len(new) > self.most:
                        self.memo.clear()
                        new = set().union(*held)
                    self._learn(list(new))
                memo = self.memo
                for i, words in enumerate(held):
                    yield self._packed(whole[i]) if i in whole else b"".join([memo[w] for w in words])
                held, whole, size = [], {}, 0

    def _packed(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))


@lru_cache(maxsize=2)
def _worker_encoder(path: str, pattern: str) -> WordEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path, pattern)


# ---------------------------------------------------------------- shared folder


def _file_system(uri: str):
    """pyarrow's file system and path for a Hadoop-style URI."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def write_store(docs: DataFrame, out_dir: str, tokenizer: str, pattern: str, end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write ``docs`` in ascending key order to ``out_dir`` (which executors share).

    Returns the catalogue ``(file, part, n_docs, n_tokens, start)``, one row per
    file, ``start`` the number of ids in all earlier files.  Each range partition
    is one file.  A task writes under a name of its own and renames when complete,
    so a task that is run again replaces its file whole.  Documents with a null key
    come first and are stored under ``NO_KEY``; null texts are empty.  Rows that repeat a
    key follow each other, ties by text.  An empty table makes an empty catalogue.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # Cut into ranges before encoding, on keys alone: only (key, text) moves, once.
    ranged = rows.repartitionByRange(F.col("k")).sortWithinPartitions("k", "t")
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        part = ctx.partitionId()
        encoder = _worker_encoder(tokenizer, pattern)
        system, folder = _file_system(out_dir)
        name = f"{folder}/part-{part:06d}.tok"
        draft = f"{folder}/.{part:06d}-{ctx.taskAttemptId()}-{uuid.uuid4().hex}"
        n_docs = n_tokens = 0
        writer = out = None
        for batch in batches:
            texts = batch["t"].to_pylist()
            for k, ids in zip(batch["k"].to_pylist(), encoder.encode_all(texts), strict=True):
                if writer is None:
                    system.create_dir(folder, recursive=True)
                    out = system.open_output_stream(draft)
                    writer = Writer(out)
                writer.add(NO_KEY if k is None else k, ids + end)
                n_docs, n_tokens = n_docs + 1, n_tokens + len(ids) // 4 + 1
        if writer is not None:
            writer.close()
            out.close()
            system.move(draft, name)
            yield pa.RecordBatch.from_pydict({"file": [name], "part": pa.array([part], pa.int32()), "n_docs": [n_docs], "n_tokens": [n_tokens]})

    files = ranged.mapInArrow(write, "file string, part int, n_docs bigint, n_tokens bigint")
    # One row per file: a bounded list, on which the running sum is exact.
    done = sorted((r.asDict() for r in files.collect()), key=lambda r: r["part"])
    start = 0
    for r in done:
        r["start"], start = start, start + r["n_tokens"]
    return _catalogue(spark, done)


def _catalogue(spark: SparkSession, files: list[dict]) -> DataFrame:
    schema = "file string, part int, n_docs bigint, n_tokens bigint, start bigint"
    text = json.dumps(files)
    one = spark.range(1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':')}>>".replace(",:", ","))).alias("f"))
    return one.select("f.*").repartition(max(1, len(files)))


def read_store(catalogue: DataFrame, wanted: Iterable[int] | None = None) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` from the files of a catalogue.

    ``start`` counts the ids of all documents before.  With ``wanted`` only the
    frames that hold those documents are decompressed.
    """
    chosen = None if wanted is None else sorted(set(wanted))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch["file"].to_pylist(), batch["start"].to_pylist(), strict=True):
                system, path = _file_system(name)
                with system.open_input_file(path) as file:
                    r = Reader(file)
                    before = start + np.concatenate(([0], np.cumsum(r.docs["n"], dtype=np.int64)))
                    rows = range(len(r.docs)) if chosen is None else np.flatnonzero(np.isin(r.docs["doc_id"], chosen)).tolist()
                    for i in range(0, len(rows), 256):
                        part = rows[i : i + 256]
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array([None if k == NO_KEY else k for k in r.docs["doc_id"][list(part)].tolist()], pa.int64()), "start": pa.array(before[list(part)]),
                            "n_tokens": pa.array(r.docs["n"][list(part)].astype(np.int64)), "ids": pa.array([r.ids(k) for k in part], pa.binary()),
                        })

    return catalogue.select("file", "start").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def store_and_read(docs: DataFrame, tokenizer: str, pattern: str, **options) -> DataFrame:
    """Write ``docs`` into a new folder below the shared one and read everything back."""
    folder = fresh_path(docs.sparkSession, "tokens")
    return read_store(write_store(docs, folder, tokenizer, pattern, **options))
