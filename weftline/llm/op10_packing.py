"""Packing of token streams into windows by Karmarkar-Karp multiway differencing.

Each document's ids and an end id are cut into full windows, and what is left into parts of at most a quarter window.
Parts gather into pools of about `windows` windows. In a pool every part starts as a partial partition; the two partial
partitions of largest imbalance are merged, the largest sums of one with the smallest of the other, until one is left:
near-equal windows. Where the largest exceeds the capacity, the window count rises by one and the pool is differenced
again. The slack left in a pool is under one window, so padding is about 1 / windows of the parts.

No shuffle: a pool belongs to one input partition and holds at most `windows` windows of ids' metadata. sequence_id is
unique: input partition above, counter below; it depends on how the input is split.

Null or empty text: the end id alone. Null ids and repeated rows are packed like others; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from weftline.llm.bpe import tokenizer_path, vocabulary
from weftline.llm.shared import ids_and_text, table

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differenced(sizes: list[int], k: int) -> list[tuple[int, list[int]]]:
    """k windows as (sum, indexes of sizes), by repeatedly merging the two partial partitions of largest spread."""
    if k == 1:
        return [(sum(sizes), list(range(len(sizes))))]
    # A partial partition: its sums above the smallest, descending, each with a nested pair of indexes; zeros are implied.
    heap = [(-n, i, [(n, i)]) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) + len(b) <= k:
            both = a + b
        else:
            over = len(a) + len(b) - k
            m = len(a) - over  # a's smallest `over` sums meet b's smallest, in opposite order
            both = a[:m] + [(x + y, (p, q)) for (x, p), (y, q) in zip(a[m:], reversed(b[-over:]))] + b[:-over]
        both.sort(key=lambda x: -x[0])
        spread = both[0][0] - (both[-1][0] if len(both) == k else 0)
        heapq.heappush(heap, (-spread, tie, both))
        tie += 1

    def leaves(tree) -> list[int]:
        out, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                out.append(x)
        return out

    return [(n, leaves(tree)) for n, tree in heap[0][2]]


def balanced(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most capacity: the count rises while the largest exceeds it. No size may be over capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differenced(sizes, k)
        if max(n for n, _ in found) <= capacity:
            return [w for _, w in found]
        k += 1


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, windows: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: its document's id, start, length, CRC-32 of its ids, the document's tokens, window, offset there."""
    part, room = max(1, capacity // 4), windows * capacity - capacity // 4
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def packed(batches):
        words, end = vocabulary(path), end_id.to_bytes(4, "little")
        context = TaskContext.get()
        serial = (context.partitionId() if context else 0) << 40
        out, pool, held = [], [], 0

        def emptied():
            nonlocal serial, held
            for window in balanced([p[2] for p in pool], capacity) if pool else ():
                at = 0
                for i in sorted(window):
                    out.append((*pool[i], serial, at))
                    at += pool[i][2]
                serial += 1
            pool.clear()
            held = 0

        def rows():
            found = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)
            out.clear()
            return found

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = words.encode(text or "") + end
                n, at = len(ids) // 4, 0
                while n - at >= capacity:
                    out.append((doc, at, capacity, zlib.crc32(ids[4 * at : 4 * (at + capacity)]), n, serial, 0))
                    serial, at = serial + 1, at + capacity
                while at < n:
                    size = min(part, n - at)
                    if held + size > room:
                        emptied()
                    pool.append((doc, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), n))
                    held, at = held + size, at + size
                if len(out) > 20_000:
                    yield rows()
        emptied()
        if out:
            yield rows()

    return ids_and_text(docs, id_col, text_col).mapInArrow(packed, SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
