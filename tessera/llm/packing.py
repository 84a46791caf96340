"""Packing tokenised documents into sequences by multiway Karmarkar-Karp differencing.

1. One pass without a shuffle tokenises every document, ends it with ``end_id`` and
   cuts it into full windows of ``capacity`` ids plus one tail; only the measures
   of the pieces are kept: checksums, and those of a tail's beginnings at every ``STEP`` ids, so that it can be cut later.
2. Full windows are sequences of their own. Tails are dealt evenly over tasks and
   differenced in batches of ``BATCH``: every tail starts as a partial partition
   (one load, the other windows empty); again and again the two partitions with the
   largest imbalance are merged, largest loads onto smallest. The batch starts
   with as few windows as its ids allow; while a load exceeds the capacity, the
   window count rises by one and the batch is differenced anew.
3. The windows are near-equal, so each has a small gap. The emptiest windows of a batch are taken apart to fill the
   gaps of the others: whole pieces where they fit, else a piece is cut. What is left of the last one
   waits for the task's next batch.

A task holds one batch at a time, whatever the input; no key decides where a tail
goes, so repeated or hot documents cannot crowd one task.

Defined cases: null or empty text is one piece holding only ``end_id``; equal rows
(even with equal ids) are packed one by one; an empty table gives no rows.
"""

from __future__ import annotations

import dataclasses
import functools
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm.bpe import codec, vocabulary
from tessera.llm.common import materialize, small_batches

CAPACITY = 4096
#: Tails differenced together, and tails dealt to one task (about).
BATCH = 512
TASK_TAILS = 1 << 15
#: A tail can be cut at multiples of so many ids.
STEP = 64

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
MARKED = PIECES + ", marks binary"


def _times(matrix: list[int], vector: int) -> int:
    """A matrix over GF(2), its columns as integers, times a vector."""
    out = 0
    while vector:
        low = vector & -vector
        out ^= matrix[low.bit_length() - 1]
        vector ^= low
    return out


@functools.cache
def _zeros(n: int) -> list[int]:
    """What n more zero bytes do to the register of CRC-32, as a matrix over GF(2)."""
    if n == 1:  # one byte: eight steps of the register
        out = []
        for bit in range(32):
            r = 1 << bit
            for _ in range(8):
                r = r >> 1 ^ (0xEDB88320 if r & 1 else 0)
            out.append(r)
        return out
    half = _zeros(n // 2)
    twice = [_times(half, c) for c in half]
    return [_times(_zeros(1), c) for c in twice] if n % 2 else twice


def crc_after(whole: int, first: int, rest_bytes: int) -> int:
    """The CRC-32 of what follows a beginning of known CRC-32, from that of the whole."""
    return whole ^ _times(_zeros(rest_bytes), first) if rest_bytes else 0


@dataclasses.dataclass
class Piece:
    """Consecutive ids of a document; ``begin`` are ids cut off before, ``marks`` the checksums at multiples of STEP from the tail's own start."""

    doc: int | None
    start: int
    length: int
    crc: int
    tokens: int
    marks: np.ndarray
    begin: int = 0
    before: int = 0

    def cut(self, n: int) -> tuple[Piece, Piece] | None:
        """The first ids, n or a few fewer, and the rest; None if there is no place to cut."""
        at = (self.begin + n) // STEP * STEP
        size = at - self.begin
        if size <= 0 or size >= self.length:
            return None
        upto = int(self.marks[at // STEP - 1])
        first = crc_after(upto, self.before, 4 * size)
        rest = crc_after(self.crc, first, 4 * (self.length - size))
        return (
            dataclasses.replace(self, length=size, crc=first),
            dataclasses.replace(self, start=self.start + size, length=self.length - size, crc=rest, begin=at, before=upto),
        )


def fill(windows: list[list[Piece]], capacity: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Windows whose gaps are filled from the emptiest ones, and the pieces left over (less than a window)."""
    load = lambda w: sum(p.length for p in w)
    windows = sorted(windows, key=lambda w: -load(w))
    spare = sorted(windows.pop(), key=lambda p: -p.length) if windows else []
    at = 0
    while at < len(windows):
        gap = capacity - load(windows[at])
        while gap > 0 and spare:
            piece = best_piece(spare, gap)
            if piece is None:
                break
            windows[at].append(piece)
            gap -= piece.length
        if not spare and at + 1 < len(windows):
            spare = sorted(windows.pop(), key=lambda p: -p.length)
            continue  # the same window may still have a gap
        at += 1
    return windows, spare


def best_piece(spare: list[Piece], gap: int) -> Piece | None:
    """Takes the piece, or the beginning of the longest, that leaves the least of a gap when a cut of the longest follows; None if nothing fits."""
    longest = spare[0]

    def left(room: int) -> int:
        """What stays of some room after a cut of the longest piece."""
        size = (longest.begin + room) // STEP * STEP - longest.begin
        return room - size if 0 < size < longest.length else room

    choices = [(gap - p.length if p is longest else left(gap - p.length), i) for i, p in enumerate(spare) if p.length <= gap]
    if left(gap) < min(choices, default=(gap, 0))[0]:
        first, spare[0] = longest.cut(gap)
        spare.sort(key=lambda p: -p.length)
        return first
    return spare.pop(min(choices)[1]) if choices else None


def difference(sizes: list[int], k: int) -> list[tuple[int, list[int]]]:
    """k near-equal windows as (load, indexes of sizes); empty windows are left out.

    A partition is the list of its non-empty windows, largest load first. Ties in
    imbalance go to the partition made earlier, so the result is determined.
    """
    heap = [(-s if k > 1 else 0, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over <= 0:
            both = a + b
        else:
            # a's smallest `over` windows meet b's smallest `over`, in opposite order
            keep, rest = len(a) - over, len(b) - over
            met = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[keep:], reversed(b[rest:]), strict=True)]
            both = a[:keep] + b[:rest] + met
        both.sort(key=lambda w: -w[0])
        least = both[-1][0] if len(both) == k else 0
        heapq.heappush(heap, (least - both[0][0], made, both))
        made += 1
    return heap[0][2] if heap else []


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """As few near-equal windows as differencing can fill without exceeding capacity."""
    if any(s > capacity for s in sizes):
        raise ValueError("a piece exceeds the capacity")
    k = max(1, -(-sum(sizes) // capacity))
    while sizes:
        windows = difference(sizes, k)
        if windows[0][0] <= capacity:
            return windows
        k += 1
    return []


def pieces(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces: full windows and one tail, with the checksum of their ids."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    small_batches(docs.sparkSession)
    end = np.array([end_id], dtype=np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(shared.value)
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = memoryview(bpe.encode(text.as_py()).tobytes() + end)
                n = len(raw) // 4
                for at in range(0, n - capacity + 1, capacity):
                    rows.append((doc, at, capacity, zlib.crc32(raw[4 * at : 4 * (at + capacity)]), n, None))
                if n % capacity:
                    at, crc, marks = n - n % capacity, 0, []
                    for cut in range(4 * at, 4 * (n - STEP) + 1, 4 * STEP):
                        crc = zlib.crc32(raw[cut : cut + 4 * STEP], crc)
                        marks.append(crc)
                    whole = zlib.crc32(raw[4 * (at + STEP * len(marks)) :], crc)
                    rows.append((doc, at, n % capacity, whole, n, np.array(marks, dtype="<u4").tobytes()))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.record_batch([pa.array(c, pa.binary() if i == 5 else pa.int64()) for i, c in enumerate(columns)], names=[x.split()[0] for x in MARKED.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, MARKED)


def assign(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and offset for a materialised table of pieces (``pieces``)."""
    tasks = max(1, -(-table.count() // TASK_TAILS))
    names = [x.split()[0] for x in PIECES.split(", ")] + ["sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        used = 0
        waiting: list[Piece] = []

        def packed(last: bool) -> list[tuple]:
            """Packs what waits; what does not fill a window waits again, unless this is the last batch."""
            nonlocal used
            windows, left = fill([[waiting[i] for i in members] for _, members in pack([p.length for p in waiting], capacity)], capacity)
            waiting[:] = left
            if last and left:
                windows.append(left)
                waiting.clear()
            out = []
            for window in windows:
                offset = 0
                for p in window:
                    out.append((p.doc, p.start, p.length, p.crc, p.tokens, base + used, offset))
                    offset += p.length
                used += 1
            return out

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=names)

        for b in batches:
            out = []
            for doc, start, length, crc, tokens, marks in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if length == capacity:
                    out.append((doc, start, length, crc, tokens, base + used, 0))
                    used += 1
                else:
                    waiting.append(Piece(doc, start, length, crc, tokens, np.frombuffer(marks, dtype="<u4")))
                    if len(waiting) >= BATCH:
                        out += packed(False)
            yield batch(out)
        if waiting:
            yield batch(packed(True))

    # dealt round robin, in sorted order: the same rows reach the same task when it is run again
    return table.repartition(tasks).mapInArrow(run, PIECES + ", sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    return assign(materialize(pieces(docs, path, end_id, capacity), "pieces"), capacity)
