"""Packing of token sequences into training windows by Karmarkar-Karp differencing.

Every document is encoded, closed with an end id and cut: whole windows stand alone, the rest waits in a block. A block
(a bounded number of tokens of one task) is packed by multiway differencing: partial partitions start as one piece
each; the two with the largest imbalance are merged, the fullest bin of the one onto the emptiest of the other, until
one partition of near-equal windows is left. When its fullest window exceeds the capacity, the window count rises and
the block is packed again. A task packs its own input split, so that nothing is shuffled and a lost task repeats alone.

Cases: a null or empty text is the end id alone; ties go by input order; repeated rows are packed once each; an empty
table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from selectra.llm.word_pieces import word_encoder

#: tokens of a window, the longest piece that is packed, and the windows that a block fills
WINDOW, PIECE, BLOCK_WINDOWS = 4096, 512, 256
END_ID = 2

SCHEMA = ("doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, "
          "`offset` bigint")


def differencing(sizes: list[int], bins: int) -> list[list[int]]:
    """The pieces (by index) of each of the bins, with near-equal sums."""
    if bins == 1:
        return [list(range(len(sizes)))]
    order = itertools.count()
    # a partial partition: sums of its occupied bins in descending order, and the pieces in them
    heap = [(-size, next(order), np.array([size]), [[i]]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, high, high_in = heapq.heappop(heap)
        _, _, low, low_in = heapq.heappop(heap)
        spare = max(0, len(high) + len(low) - bins)  # so many bins have to be shared
        shared = high[len(high) - spare:] + low[len(low) - spare:][::-1]
        sums = np.concatenate([high[:len(high) - spare], shared, low[:len(low) - spare]])
        joined = [a + b for a, b in zip(high_in[len(high) - spare:], low_in[len(low) - spare:][::-1])]
        inside = high_in[:len(high) - spare] + joined + low_in[:len(low) - spare]
        by_size = np.argsort(-sums, kind="stable")
        sums = sums[by_size]
        spread = int(sums[0]) - (int(sums[-1]) if len(sums) == bins else 0)
        heapq.heappush(heap, (-spread, next(order), sums, [inside[i] for i in by_size]))
    return heap[0][3] if heap else []


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Pieces by window: as few windows as differencing can fill within the capacity."""
    count = max(1, -(-sum(sizes) // capacity))
    while True:
        packed = differencing(sizes, count)
        if all(sum(sizes[i] for i in window) <= capacity for window in packed):
            return packed
        count += 1


def _packed(batches: Iterator[pa.RecordBatch], path: str, window: int, piece: int, block_windows: int, end_id: int):
    encode, end = word_encoder(path), np.array([end_id], dtype="<u4").tobytes()
    first = TaskContext.get().partitionId() << 32
    sequence = itertools.count(first)
    waiting, tokens, out = [], 0, []

    def place(pieces):
        number, offset = next(sequence), 0
        for doc_id, start, ids, total in pieces:
            out.append((doc_id, start, len(ids) // 4, ids, total, number, offset))
            offset += len(ids) // 4

    def pack():
        for members in windows_of([len(p[2]) // 4 for p in waiting], window) if waiting else []:
            place([waiting[i] for i in members])
        waiting.clear()

    def flush():
        columns = list(zip(*out)) or [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], list(names))
        out.clear()
        return batch

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = encode(text.as_py() or "") + end
            total, whole = len(ids) // 4, len(ids) // 4 // window * window
            for start in range(0, whole, window):
                place([(doc_id, start, ids[4 * start:4 * (start + window)], total)])
            for start in range(whole, total, piece):
                part = ids[4 * start:4 * (start + piece)]
                waiting.append((doc_id, start, part, total))
                tokens += len(part) // 4
            if tokens >= block_windows * window:
                pack()
                tokens = 0
            if len(out) >= 4096:
                yield flush()
    pack()
    yield flush()


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, piece: int = PIECE,
                   block_windows: int = BLOCK_WINDOWS, end_id: int = END_ID) -> DataFrame:
    """Windows of training ids as one row per piece: where it lies in its document and in its window, and its ids
    (little-endian unsigned 32-bit). ``tokenizer`` is the path of the vocabulary file on every executor."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(lambda b: _packed(b, tokenizer, window, piece, block_windows, end_id), SCHEMA)


def digest(packed: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")
