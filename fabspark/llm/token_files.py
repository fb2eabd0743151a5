"""Token ids in fixed-width bit-packed files, written and read by Spark jobs.

File layout (little endian), one file for up to ``file_tokens`` tokens:

    magic "TBP1" | bits u32 | block u32 | part u32 | before u64 | n_docs u64 | n_tokens u64
    doc ids i64[n_docs] | doc id is null u8[n_docs] | token counts u64[n_docs]
    block offsets u64[n_blocks + 1] (bytes in the payload)
    payload: blocks of ``block`` ids, each id in ``bits`` bits (low bit first),
    every block padded to a whole byte | one closing newline byte

``part`` numbers the writing task in doc_id order and ``before`` counts the
tokens of that task's earlier files, so a document's place in the whole corpus
follows from one total a task. A block is found by its offset and unpacked with
numpy alone. Spark's text writer commits the files (one row, one file), so lost
tasks leave no partial file; they are read back with the ``binaryFile`` source.

Defined cases: null and empty texts hold the end id only; null doc_ids come
first; repeated rows are separate documents; documents are never split; extra
columns are ignored; an empty table gives no rows.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_dir
from .bpe import encoder
from .textkit import small_batches

HEADER = struct.Struct("<4sIIIQQQ")
MAGIC = b"TBP1"


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids[:, None].astype(np.uint64) >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(payload: bytes, n: int, bits: int) -> np.ndarray:
    """``n`` ids as uint32; each is cut out of the five bytes around it."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, dtype=f"<u{bits // 8}", count=n).astype("<u4")
    raw = np.zeros(len(payload) + 5, dtype=np.uint64)
    raw[:len(payload)] = np.frombuffer(payload, dtype=np.uint8)
    at = np.arange(n, dtype=np.int64) * bits
    byte = at >> 3
    word = sum(raw[byte + k] << np.uint64(8 * k) for k in range(5))
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype("<u4")


def build_file(docs: list[tuple[int | None, bytes]], bits: int, block: int, part: int, before: int) -> bytes:
    ids = np.frombuffer(b"".join(d[1] for d in docs), dtype="<u4")
    packed = [pack_bits(ids[i:i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in packed], dtype=np.int64))).astype("<u8")
    return b"".join([
        HEADER.pack(MAGIC, bits, block, part, before, len(docs), len(ids)),
        np.array([d[0] or 0 for d in docs], dtype="<i8").tobytes(),
        np.array([d[0] is None for d in docs], dtype=np.uint8).tobytes(),
        np.array([len(d[1]) // 4 for d in docs], dtype="<u8").tobytes(),
        offsets.tobytes(), *packed])


class TokenFile:
    """Random access to a file's bytes: documents by place, tokens by range."""

    def __init__(self, content: bytes):
        magic, self.bits, self.block, self.part, self.before, n, self.n_tokens = HEADER.unpack_from(content)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEADER.size
        ids = np.frombuffer(content, "<i8", n, at)
        null = np.frombuffer(content, np.uint8, n, at + 8 * n)
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, null)]
        self.counts = np.frombuffer(content, "<u8", n, at + 9 * n).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        at += 17 * n
        blocks = -(-self.n_tokens // self.block)
        self.offsets = np.frombuffer(content, "<u8", blocks + 1, at).astype(np.int64)
        self.payload = memoryview(content)[at + 8 * (blocks + 1):]

    def tokens(self, start: int, n: int) -> np.ndarray:
        """Ids ``start .. start + n``; only the blocks that hold them are unpacked."""
        if not n:
            return np.empty(0, dtype="<u4")
        first, last = start // self.block, (start + n - 1) // self.block
        out = [unpack_bits(self.payload[self.offsets[k]:self.offsets[k + 1]],
                           min(self.block, self.n_tokens - k * self.block), self.bits)
               for k in range(first, last + 1)]
        return np.concatenate(out)[start - first * self.block:][:n]

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.counts[k]))


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 2,
                      block: int = 4096, file_tokens: int = 8_000_000) -> None:
    """Encode every text in doc_id order and write the files under ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        bits = bits_for(max(enc.vocabulary(), end_id + 1))
        end = np.array([end_id], dtype="<u4").tobytes()
        held: list[tuple[int | None, bytes]] = []
        size = before = 0
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = enc.ids(text.as_py()) + end
                if held and size + len(ids) // 4 > file_tokens:
                    yield pa.RecordBatch.from_arrays([pa.array([build_file(held, bits, block, part, before)], pa.binary())], names=["content"])
                    before, held, size = before + size, [], 0
                held.append((doc, ids))
                size += len(ids) // 4
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([build_file(held, bits, block, part, before)], pa.binary())], names=["content"])

    small_batches(docs.sparkSession)
    ordered = (docs.select(F.col("doc_id").cast("long"), "text")
                   .repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text")))
    (ordered.mapInArrow(run, "content binary").select(F.col("content").cast("string").alias("value"))
            .write.option("maxRecordsPerFile", 1).mode("errorifexists").text(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                f = TokenFile(content.as_py())
                crc = [zlib.crc32(f.document(k)) for k in range(len(f.doc_ids))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f.doc_ids, pa.int64()), pa.array(f.starts + f.before, pa.int64()),
                     pa.array(f.counts, pa.int64()), pa.array(crc, pa.int64()),
                     pa.array([f.part] * len(crc), pa.int32())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "part"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    rows = files.select("content").mapInArrow(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, part int")
    # a task's tokens: the end of its last document, read from the headers only
    totals = files.select("content").mapInArrow(_header_totals, "part int, n_tokens bigint")
    running, offsets = 0, []
    for r in totals.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():   # one row a writing task
        offsets.append((r["part"], running))
        running += r["n"]
    before = spark.createDataFrame(offsets, "part int, _before bigint")
    return rows.join(F.broadcast(before), "part").select(
        "doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")


def _header_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column("content"):
            head = HEADER.unpack_from(content.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([head[3]], pa.int32()), pa.array([head[6]], pa.int64())],
                                             names=["part", "n_tokens"])


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back."""
    spark = docs.sparkSession
    path = shared_dir(spark, "token-files")
    write_token_files(docs, path, **options)
    return read_token_files(spark, path)
