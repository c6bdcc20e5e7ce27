"""Fill training sequences with documents that lie close together.

A document's text is hashed into a vector of byte 4-gram counts, the vector is
projected to three dimensions by a fixed random matrix, and the point becomes a
key along a Hilbert curve.  Documents are dealt out by ranges of that key and
laid end to end along the curve; a sequence ends after 2048 ids, and the next
piece of the same document opens the next one.  So only the last sequence of a
range is short, and it is padded to the next power of two.

Ties of the key, as between copies, are ordered and split by a hash of the id.
Null text counts as empty: the document is its end id alone.  Repeated rows are
packed as often as they occur.  An empty table gives no pieces; columns other
than the id and the text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.encoder import encoder

SEQUENCE, END_ID = 2048, 1
DIMS, LEVEL_BITS, BUCKETS, SEED = 3, 16, 256, 7
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_size long"


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Key along the Hilbert curve of each row of non-negative integers below 2**bits.

    The coordinates' bits are turned, plane by plane from the top, into the curve's
    orientation, then Gray-decoded across the dimensions and interleaved.
    """
    x = [points[:, d].astype(np.uint64) for d in range(points.shape[1])]
    one, zero = np.uint64(1), np.uint64(0)
    for plane in range(bits - 1, 0, -1):
        low = np.uint64((1 << plane) - 1)
        for d in range(len(x)):
            is_set = (x[d] >> np.uint64(plane) & one).astype(bool)
            swap = np.where(is_set, zero, (x[0] ^ x[d]) & low)
            x[0] = np.where(is_set, x[0] ^ low, x[0] ^ swap)
            x[d] = x[d] ^ swap if d else x[0]
    for d in range(1, len(x)):
        x[d] = x[d] ^ x[d - 1]
    turn = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> np.uint64(plane) & one, np.uint64((1 << plane) - 1), zero)
    key = np.zeros_like(turn)
    for plane in range(bits - 1, -1, -1):
        for v in x:
            key = key << one | (v ^ turn) >> np.uint64(plane) & one
    return key.astype(np.int64)


def vector(data: np.ndarray) -> np.ndarray:
    """Unit vector of hashed byte 4-gram counts of one text (uint8)."""
    if len(data) < 4:
        return np.zeros(BUCKETS)
    b = data.astype(np.uint32)
    gram = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    v = np.bincount(gram * np.uint32(2_654_435_761) >> np.uint32(24), minlength=BUCKETS).astype(float)
    return v / np.linalg.norm(v)


def curve_keys(column: pa.Array) -> np.ndarray:
    """Hilbert key of every text of a column."""
    texts = column.cast(pa.large_string())
    vectors = np.stack([vector(np.frombuffer(x.as_buffer(), np.uint8)) if x.is_valid else np.zeros(BUCKETS) for x in texts]) if len(texts) else np.zeros((0, BUCKETS))
    axes = np.random.default_rng(SEED).standard_normal((BUCKETS, DIMS))
    cells = (np.tanh(vectors @ axes) + 1) / 2 * (2**LEVEL_BITS - 1)
    return hilbert(cells.astype(np.int64), LEVEL_BITS)


def along_curve(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and curve, dealt out by ranges of the curve and sorted along it."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(curve_keys(part.column("text")), pa.int64())], ["doc_id", "text", "curve"])

    points = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(keyed, "doc_id long, text string, curve long")
    order = [F.col("curve"), F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text")]
    return points.repartitionByRange(*order).sortWithinPartitions(*order)


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """All documents as pieces of sequences (PIECES, and with ``with_ids`` their ids).

    sequence_size is what the piece's sequence is padded to: ``size``, or for the
    last sequence of a range the least power of two that holds it.
    """
    schema = PIECES + ", ids array<int>" * with_ids

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sequence, used = encoder(tokenizer), TaskContext.get().partitionId() << 40, 0
        open_, done, end = [], [], np.array([end_id], "<u4").tobytes()

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*(r[:8] for r in rows))]
            if with_ids:
                columns.append(pa.array([np.frombuffer(r[8], "<u4").astype(np.int32) for r in rows], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            for part, ids, ends in coder.batches(batch, "text"):
                data, at = memoryview(ids.astype("<u4", copy=False).tobytes()), ends.tolist()
                for doc, lo, hi in zip(part.column("doc_id").to_pylist(), at, at[1:]):
                    own, start = bytes(data[4 * lo : 4 * hi]) + end, 0
                    total = hi - lo + 1
                    while start < total:
                        n = min(total - start, size - used)
                        piece = own[4 * start : 4 * (start + n)]
                        open_.append((doc, start, n, zlib.crc32(piece), total, sequence, used, size, piece if with_ids else None))
                        start, used = start + n, used + n
                        if used == size:
                            done += open_
                            open_, used, sequence = [], 0, sequence + 1
                if len(done) >= 4096:
                    yield out(done)
                    done = []
        done += [(*p[:7], min(size, 1 << (used - 1).bit_length()), p[8]) for p in open_]
        if done:
            yield out(done)

    return along_curve(docs, id_col, text_col).mapInArrow(fill, schema)
