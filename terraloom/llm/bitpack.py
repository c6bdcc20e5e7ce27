"""Token ids in fixed-width bit-packed shards, read back at random or as a whole.

A shard holds the documents of one range of ids, in ascending order::

    "TLBP" | version u8 | bits u8 | 0 u16 | ids in a block u32
    blocks: 32 ids fill exactly `bits` 32-bit words, the lowest bits first
    table of documents: id i64 each, then start u64 each (counted within the shard)
    table of blocks: byte offset u64 each
    documents u64 | ids u64 | offset of the documents' table u64 | of the blocks' u64

All numbers are little-endian.  The offsets let a reader take any span of ids by
fetching the blocks that it touches; numpy unpacks a block with 2 x 32 shifts.

Null text counts as empty and gets the end id only; a very long one is encoded
whole, and its ids may fill many blocks.  Repeated ids keep all their
rows, ordered by a hash of the text.  Null ids come first, as -2**63.  An empty
table gives no shards.  Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.encoder import encoder
from terraloom.llm.shared import materialise, new_path

MAGIC, VERSION, BLOCK_IDS = b"TLBP", 1, 32_768
HEAD, FOOT = struct.Struct("<4sBBHI"), struct.Struct("<QQQQ")
NO_ID = -(2**63)
#: Widths at which an id is an integer of its own.
WHOLE = {8: "u1", 16: "<u2", 32: "<u4"}
MANIFEST = "shard long, path string, n_docs long, n_ids long"


def bits_for(vocabulary: int) -> int:
    """The least width that holds ids from 0 to ``vocabulary`` - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids (below 2**bits) as 32-bit words; the last group of 32 is filled with 0."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} doesn't fit in {bits} bits")
    if bits in WHOLE:  # the same bytes, as no id lies across two words
        return np.concatenate([ids.astype(WHOLE[bits]), np.zeros(-len(ids) % 32, WHOLE[bits])]).tobytes()
    rows = np.zeros((-(-len(ids) // 32), 32), np.uint64)
    rows.ravel()[: len(ids)] = ids
    words = np.zeros((len(rows), bits), np.uint64)
    for j in range(32):
        word, shift = divmod(j * bits, 32)
        moved = rows[:, j] << np.uint64(shift)
        words[:, word] |= moved & np.uint64(0xFFFFFFFF)
        if shift + bits > 32:
            words[:, word + 1] |= moved >> np.uint64(32)
    return words.astype("<u4").tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in WHOLE:
        return np.frombuffer(data, WHOLE[bits])[:n].astype(np.uint32)
    words = np.frombuffer(data, "<u4").reshape(-1, bits).astype(np.uint64)
    rows, mask = np.empty((len(words), 32), np.uint32), np.uint64((1 << bits) - 1)
    for j in range(32):
        word, shift = divmod(j * bits, 32)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 32:
            value = value | words[:, word + 1] << np.uint64(32 - shift)
        rows[:, j] = value & mask
    return rows.ravel()[:n]


class ShardWriter:
    def __init__(self, out, bits: int):
        self.out, self.bits, self.at = out, bits, HEAD.size
        self.docs: list[int] = []
        self.starts: list[int] = []
        self.blocks: list[int] = []
        self.n, self.held, self.parts = 0, 0, []
        out.write(HEAD.pack(MAGIC, VERSION, bits, 0, BLOCK_IDS))

    def _flush(self, rest: bool) -> None:
        ids = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint32)
        end = len(ids) if rest else len(ids) // BLOCK_IDS * BLOCK_IDS
        for lo in range(0, end, BLOCK_IDS):
            data = pack_bits(ids[lo : min(lo + BLOCK_IDS, end)], self.bits)
            self.blocks.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.parts, self.held = [ids[end:]], len(ids) - end

    def add(self, docs: list[int], sizes: np.ndarray, ids: np.ndarray) -> None:
        """Documents, the number of ids of each, and their ids one after another."""
        self.docs += docs
        self.starts += (self.n + np.cumsum(sizes) - sizes).tolist()
        self.n += len(ids)
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= 16 * BLOCK_IDS:
            self._flush(False)

    def close(self) -> None:
        self._flush(True)
        docs_at = self.at
        self.out.write(np.array(self.docs, "<i8").tobytes() + np.array(self.starts, "<u8").tobytes())
        self.out.write(np.array(self.blocks, "<u8").tobytes())
        self.out.write(FOOT.pack(len(self.docs), self.n, docs_at, docs_at + 16 * len(self.docs)))
        self.out.close()


class ShardReader:
    """Random access to a shard: ``docs``, ``starts`` (with the end), ``ids(lo, hi)``."""

    def __init__(self, path: str):
        store, name = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(name)
        size = self.file.size()
        magic, version, self.bits, _, self.block = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError(f"not a shard of version {VERSION}: {path}")
        n, self.n, docs_at, self.blocks_at = FOOT.unpack(self.file.read_at(FOOT.size, size - FOOT.size))
        table = self.file.read_at(16 * n, docs_at)
        self.docs = np.frombuffer(table[: 8 * n], "<i8")
        self.starts = np.append(np.frombuffer(table[8 * n :], "<u8"), self.n).astype(np.int64)
        self.blocks = np.append(np.frombuffer(self.file.read_at(size - FOOT.size - self.blocks_at, self.blocks_at), "<u8"), docs_at).astype(np.int64)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        if hi <= lo:
            return np.zeros(0, np.uint32)
        first, last = lo // self.block, (hi - 1) // self.block
        data = self.file.read_at(int(self.blocks[last + 1] - self.blocks[first]), int(self.blocks[first]))
        # all blocks but a shard's last are full, so they unpack as one
        return unpack_bits(data, self.bits, min(self.n, (last + 1) * self.block) - first * self.block)[lo - first * self.block : hi - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def with_ends(ids: np.ndarray, ends: np.ndarray, end_id: int) -> np.ndarray:
    """The ids of texts (``ends`` are their offsets), each text followed by ``end_id``."""
    out = np.empty(len(ids) + len(ends) - 1, np.uint32)
    last = np.zeros(len(out), bool)
    last[ends[1:] + np.arange(len(ends) - 1)] = True
    out[last] = end_id
    out[~last] = ids
    return out


def write_shards(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, vocabulary: int | None = None, tokenizer: str | None = None) -> DataFrame:
    """Encode all documents and write them in ascending order of id; returns the
    manifest (MANIFEST), in which shards are numbered in that order.

    Ids are as wide as the tokenizer's vocabulary (or ``vocabulary``) needs; one that
    doesn't fit is an error.

    Each attempt of a task writes a file of its own, and the manifest, which is
    stored beside the shards, names the files of the attempts that counted.
    """
    root = path or new_path(docs.sparkSession, "shards")
    bits = bits_for(max(end_id + 1, vocabulary or encoder(tokenizer).size))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, coder, name = None, encoder(tokenizer), ""
        for batch in batches:
            for part, ids, ends in coder.batches(batch, "text"):
                if writer is None:
                    store, folder = fs.FileSystem.from_uri(root)
                    store.create_dir(folder, recursive=True)
                    name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
                    writer = ShardWriter(store.open_output_stream(f"{folder}/{name}"), bits)
                writer.add(part.column("id").to_pylist(), np.diff(ends) + 1, with_ends(ids, ends, end_id))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": TaskContext.get().partitionId(), "path": f"{root}/{name}", "n_docs": len(writer.docs), "n_ids": writer.n}])

    ordered = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text")).repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    return materialise(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_shards(manifest: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """One row for each stored document: doc_id, start (ids of all documents before
    it), n_tokens, ids_crc32 (of its ids as little-endian 32-bit integers), and with
    ``with_ids`` the ids themselves."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    before = F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")  # a row for each shard only
    placed = manifest.select("path", before.alias("before"), "n_docs")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = ShardReader(row["path"])
                step = max(1, 2_000_000 // max(1, shard.n // max(1, len(shard.docs))))
                for lo in range(0, len(shard.docs), step):
                    starts = shard.starts[lo : lo + step + 1]
                    ids = shard.ids(int(starts[0]), int(starts[-1]))
                    data, at = memoryview(ids.astype("<u4").tobytes()), (starts - starts[0]).tolist()
                    out = {"doc_id": pa.array([None if x == NO_ID else x for x in shard.docs[lo : lo + step].tolist()], pa.int64()), "start": pa.array(starts[:-1] + row["before"]), "n_tokens": pa.array(np.diff(starts)), "ids_crc32": pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at, at[1:])], pa.int64())}
                    if with_ids:
                        out["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_pydict(out)

    tasks = max(1, min(manifest.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism))
    return placed.repartition(tasks).mapInArrow(read, schema)
