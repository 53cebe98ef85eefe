"""Best-fit packing of token sequences after dominance reduction.

Sizes are whole numbers from 1 to the capacity, so an instance of any number
of documents is fully described by one count per size. Documents are tokenised
and cut into pieces where they lie (no shuffle); only the counts, at most
``capacity`` rows, reach the driver. The driver reduces and packs *counts* (a
group of equal sequences is one pattern with a multiplicity), and executors
turn each piece's rank among the pieces of its size into a sequence and an
offset. Nothing but (row id, size) is ever shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import namedtuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartograph.llm.common import Scratch

CAPACITY = 1024
END_ID = 2

PIECES_SCHEMA = ("doc_id bigint, part int, row_no bigint, piece int, start bigint, length bigint, "
                 "nth bigint, ids binary")

Packing = namedtuple("Packing", "pieces placements sequences lower_bound")


# ---------------------------------------------------------------- packing of counts

def _smallest(sizes: list[int], counts: dict[int, int], k: int) -> int | None:
    """Sum of the k smallest remaining items, or None if there are fewer."""
    total = 0
    for s in sizes:
        take = min(k, counts[s])
        total += take * s
        k -= take
        if not k:
            return total
    return None


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, tuple[int, ...]]], dict[int, int]]:
    """Martello-Toth reduction: fix sequences that some optimal packing holds.

    Takes item sizes from the largest down. For the largest remaining item x,
    with room r = capacity - x, these sets dominate every other set with x:

    * nothing fits beside x: {x};
    * an item of exactly r: {x, r};
    * no two items fit together: {x, y}, y the largest that fits;
    * no three items fit together and the best pair sums to at most y: {x, y}.

    When none holds for x, the next size is tried; a fixed set shrinks the
    instance, so passes repeat until one fixes nothing. Returns the fixed
    (multiplicity, sizes) patterns and the counts left over.
    """
    counts = {s: c for s, c in counts.items() if c > 0}
    sizes = sorted(counts)
    fixed: list[tuple[int, tuple[int, ...]]] = []

    def take(items: tuple[int, ...]) -> None:
        """Fix as many copies of the set as the counts allow."""
        need = {s: items.count(s) for s in items}
        m = min(counts[s] // k for s, k in need.items())
        fixed.append((m, items))
        for s, k in need.items():
            counts[s] -= k * m
            if not counts[s]:
                del counts[s]
                del sizes[bisect_left(sizes, s)]

    def best_partner(x: int, room: int) -> int | None:
        """Largest item that fits beside one x."""
        k = bisect_left(sizes, room + 1) - 1
        while k >= 0:
            s = sizes[k]
            if s != x or counts[s] > 1:
                return s
            k -= 1
        return None

    def best_pair(x: int, room: int) -> int:
        """Largest sum of two items that fit beside one x (0 if none)."""
        have = [s for s in sizes if s != x or counts[s] > 1]
        best, i, j = 0, 0, len(have) - 1
        while i <= j:
            a, b = have[i], have[j]
            if a + b > room:
                j -= 1
                continue
            if a != b or counts[a] - (a == x) > 1:
                best = max(best, a + b)
            i += 1
        return best

    while True:
        before = len(fixed)
        for x in sorted(sizes, reverse=True):
            while counts.get(x):
                room = capacity - x
                y = best_partner(x, room)
                if y is None:
                    take((x,))
                    continue
                if y == room:
                    take((x, y))
                    continue
                pair = _smallest(sizes, counts, 2)
                if pair is None or pair > room:
                    take((x, y))
                    continue
                triple = _smallest(sizes, counts, 3)
                if (triple is None or triple > room) and best_pair(x, room) <= y:
                    take((x, y))
                    continue
                break
        if len(fixed) == before:
            return fixed, counts


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing over counts; equal sequences are handled as one group."""
    rooms: list[int] = []                                     # sorted rooms that have groups
    groups: dict[int, list[tuple[int, tuple[int, ...]]]] = {}  # room -> [(multiplicity, sizes)]

    def put(room: int, m: int, items: tuple[int, ...]) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((m, items))

    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            k = bisect_left(rooms, s)
            if k == len(rooms):
                room, m, items = capacity, left, ()
            else:
                room = rooms[k]
                m, items = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    del rooms[k]
            each = room // s                # the best fit stays the best until s no longer fits
            full = min(m, left // each)
            if full:
                put(room - each * s, full, items + (s,) * each)
                left -= full * each
                m = m - full if items else 0
            if left and left < each and (m or not items):
                put(room - left * s, 1, items + (s,) * left)
                left, m = 0, m - 1 if items else 0
            if m and items:
                put(room, m, items)
    return [g for room in rooms for g in groups[room]]


def pack_counts(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(multiplicity, sizes) patterns that hold every item: reduction, then best fit."""
    fixed, rest = reduce_dominated(counts, capacity)
    return fixed + best_fit(rest, capacity)


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, list[tuple[int, int, int]]]:
    """size -> [(first rank, first sequence, offset)], ranks ascending."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for m, items in patterns:
        offset = 0
        for s in items:
            out.setdefault(s, []).append((used.get(s, 0), base, offset))
            used[s] = used.get(s, 0) + m
            offset += s
        base += m
    return out


# ---------------------------------------------------------------- Spark side

def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID,
                 ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ids, place in the document, and ``nth`` among the task's pieces of its size.

    Only documents longer than the capacity are cut; their first piece takes
    the remainder. ``part`` and ``row_no`` identify a piece; both are fixed
    once the result is written.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from cartograph.llm.tokens import encoder

        bpe = encoder(ranks)
        part = TaskContext.get().partitionId()
        nth = [0] * (capacity + 1)
        row = 0
        names = ["doc_id", "part", "row_no", "piece", "start", "length", "nth", "ids"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

        def flush(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        rows, held = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = bpe.packed(text.as_py())
                ids.append(end_id)
                raw, n = np.frombuffer(ids, dtype="u4").astype("<u4").tobytes(), len(ids)
                start, doc, k = 0, doc.as_py(), 0
                while start < n:
                    length = n % capacity or capacity if start == 0 else capacity
                    rows.append((doc, part, row, k, start, length, nth[length],
                                 raw[4 * start:4 * (start + length)]))
                    nth[length] += 1
                    row, k, start = row + 1, k + 1, start + length
                held += len(raw)
                if held > 8_000_000:
                    yield flush(rows)
                    rows, held = [], 0
        if rows:
            yield flush(rows)

    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, PIECES_SCHEMA)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int, int]:
    """(part, row_no, sequence_id, offset) of every piece; number of sequences; a lower bound on it.

    ``pieces`` must be a written table. The rank of a piece among all pieces
    of its size is its ``nth`` in its part plus the pieces of that size in
    earlier parts.
    """
    per_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = per_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = {int(r["length"]): int(r["n"]) for r in
              per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}   # at most `capacity` rows
    patterns = pack_counts(counts, capacity)
    table = slots(patterns)                   # bounded by the capacity, not by the data
    tokens = sum(s * c for s, c in counts.items())

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ranges = {s: tuple(np.array(c, dtype=np.int64) for c in zip(*v)) for s, v in table.items()}
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for s in np.unique(length):
                at = np.flatnonzero(length == s)
                first, sequence, offset = ranges[int(s)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                seq[at] = sequence[k] + rank[at] - first[k]
                off[at] = offset[k]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(seq), pa.array(off)],
                names=["part", "row_no", "sequence_id", "offset"])

    ranked = (pieces.select("part", "row_no", "length", "nth").join(base.select("part", "length", "base"), ["part", "length"])
              .select("part", "row_no", "length", (F.col("base") + F.col("nth")).alias("rank")))
    placed = ranked.mapInArrow(run, "part int, row_no bigint, sequence_id bigint, offset bigint")
    return placed, sum(m for m, _ in patterns), -(-tokens // capacity)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, ranks: str | None = None,
         id_col: str = "doc_id", text_col: str = "text") -> Packing:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    ``pieces`` has the ids (little-endian unsigned 32-bit) of every piece and
    ``placements`` its sequence and offset, both keyed by (part, row_no).
    Null and empty texts are one end token. Rows that repeat are packed as
    often as they occur. An empty table gives empty results. Other columns
    are not read.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.write(token_pieces(docs, capacity, end_id, ranks, id_col, text_col), "pieces")
    placements, n, bound = place(pieces, capacity)
    return Packing(pieces, placements, n, bound)


def sequences(packing: Packing) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids), pieces in offset order."""
    parts = (packing.pieces.select("part", "row_no", "ids").join(packing.placements, ["part", "row_no"])
             .groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p")))
    return parts.select("sequence_id", F.aggregate(
        "p", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))


def packed_pieces(docs: DataFrame) -> DataFrame:
    """The contract's digest: one row per piece, ids as a checksum."""
    p = pack(docs)
    digest = p.pieces.select("part", "row_no", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return (digest.join(p.placements, ["part", "row_no"])
            .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))
