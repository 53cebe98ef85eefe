"""SimHash near-duplicates through pivot distance tables.

1. Fingerprint: words (A-Z lower-cased), shingles of ``shingle`` words, XXH64
   (seed 42) of each, repeats included; a bit is 1 if it is set in over half
   of the hashes. Equal fingerprints collapse to one row before any join.
2. Pair space: the 64 bits are cut into ``max_bits + 2`` blocks. Fingerprints
   that differ in at most ``max_bits`` bits agree on two blocks or more, so
   they meet under at least one of the keys (pair of blocks, bits of both).
   Random fingerprints almost never share such a key (25 bits), so the number
   of pairs follows the number of fingerprints. Nothing is lost and no cap
   applies.
3. Pivot tables: Hamming distances of every fingerprint to ``PIVOTS`` reference
   fingerprints. By the triangle inequality a pair is discarded when any
   coordinate differs by more than ``max_bits``. Within a key, fingerprints are
   sorted by their first coordinate, so that a large group of one key is
   compared in a sliding band of that coordinate instead of in full; the other
   coordinates thin the band out.
4. Verification: exact bit distance of the survivors.

The pivot tables alone cannot bound the work: distances of random 64-bit
fingerprints to any pivot concentrate around 32 with deviation 4, so one
coordinate keeps 46 % of all pairs, and 2.8e10 pairs would have to be listed
for 236,000 fingerprints. Hence step 2 in front of them.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartograph.llm.common import Scratch, components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
PIVOTS = 16
BAND = 4096         # fingerprints compared at once inside one key


def pivots(n: int = PIVOTS):
    """Reference fingerprints: all zeros, then fixed pseudo-random bits."""
    import numpy as np

    ref = np.random.default_rng(20).integers(0, 2**64, size=n, dtype=np.uint64)
    ref[0] = 0
    return ref


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp bigint): the 64-bit fingerprint of every row, whole texts, no shuffle.

    Null, empty and blank texts have no words and get fingerprint 0. Fewer
    words than ``shingle`` are one shingle.
    """
    narrow = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return with_fingerprints(narrow, shingle, f"`{id_col}` {dict(narrow.dtypes)[id_col]}, fp bigint")


def with_fingerprints(rows: DataFrame, shingle: int, schema: str) -> DataFrame:
    """``rows`` with the fingerprint in place of their last column, the text."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

        def shingle_hashes(text):
            words = text.encode().translate(lower).split()
            if not words:
                return []
            joined = b" ".join(words)
            if len(words) <= shingle:
                return [xxh64_intdigest(joined, SEED)]
            ends = np.cumsum([len(w) + 1 for w in words])          # each word's end, plus one
            starts = np.concatenate(([0], ends[:-shingle])).tolist()
            return [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())]

        def fold(hashes):
            ones, n = np.zeros(64, np.int64), len(hashes)
            for k in range(0, n, 65536):                           # bounded buffers for very long texts
                h = np.array(hashes[k:k + 65536], dtype="<u8")
                ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])

        for batch in batches:
            out = []
            for text in batch.column(batch.num_columns - 1):
                text = text.as_py()
                hashes = shingle_hashes(text) if text else []
                out.append(fold(hashes) if hashes else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.int64())], names=[*batch.schema.names[:-1], "fp"])

    return rows.mapInArrow(run, schema)


def block_masks(max_bits: int = MAX_BITS) -> list[int]:
    """One mask per pair of the ``max_bits + 2`` blocks."""
    n = max_bits + 2
    cuts = [64 * k // n for k in range(n + 1)]
    blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:])]
    return [x | y for x, y in combinations(blocks, 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_pairs(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): linked fingerprints, enough of them to join every linked group.

    ``distinct`` has one row per fingerprint (``fp``). Every pair within
    ``max_bits`` is joined by a path of returned pairs; inside one key only a
    spanning forest of the verified pairs is returned.
    """
    masks = block_masks(max_bits)
    keys = F.explode(F.array(*[
        F.struct(F.lit(k).alias("tab"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits"))
        for k, m in enumerate(masks)]))
    keyed = distinct.select("fp", keys.alias("k")).select("k.tab", "k.bits", "fp")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ref = pivots()

        def within_key(fp):
            """Spanning forest of the verified pairs among the fingerprints of one key."""
            table = np.bitwise_count(fp[:, None] ^ ref[None, :]).astype(np.int8)
            order = np.argsort(table[:, 0], kind="stable")
            fp, table = fp[order], table[order]
            first = table[:, 0].astype(np.int64)
            root = np.arange(len(fp))

            def find(i):
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            out = []
            reach = np.searchsorted(first, first + max_bits, side="right")     # band of the first coordinate
            for i in range(len(fp)):
                for lo in range(i + 1, int(reach[i]), BAND):
                    hi = min(lo + BAND, int(reach[i]))
                    keep = lo + np.flatnonzero(
                        np.abs(table[lo:hi] - table[i]).max(axis=1) <= max_bits)
                    keep = keep[np.bitwise_count(fp[keep] ^ fp[i]) <= max_bits]
                    for j in keep.tolist():
                        x, y = find(i), find(j)
                        if x != y:
                            root[x] = y
                            out.append((fp[i], fp[j]))
            return out

        def pairs_of(tab, bits, fp):
            """All keys of the rows given; rows of one key are adjacent."""
            edge = np.flatnonzero((tab[1:] != tab[:-1]) | (bits[1:] != bits[:-1])) + 1
            lo = np.concatenate(([0], edge))
            size = np.diff(np.append(lo, len(fp)))
            a, b = [], []
            for n in np.unique(size[(size > 1) & (size <= 8)]):     # small keys: all at once
                at = lo[size == n]
                for i, j in combinations(range(int(n)), 2):
                    x, y = fp[at + i], fp[at + j]
                    ok = np.ones(len(x), bool)
                    for p in ref:                                  # coordinates, one pivot after another
                        dx, dy = np.bitwise_count(x[ok] ^ p).astype(np.int8), np.bitwise_count(y[ok] ^ p).astype(np.int8)
                        ok[ok] = np.abs(dx - dy) <= max_bits
                    x, y = x[ok], y[ok]
                    near = np.bitwise_count(x ^ y) <= max_bits
                    a.append(x[near])
                    b.append(y[near])
            for start, n in zip(lo[size > 8], size[size > 8]):
                found = within_key(fp[start:start + n])
                if found:
                    x, y = zip(*found)
                    a.append(np.array(x, np.uint64))
                    b.append(np.array(y, np.uint64))
            if not a:
                return None
            a, b = np.concatenate(a), np.concatenate(b)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        rest = None                                    # rows of the last key so far
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            cols[2] = cols[2].astype(np.int64).view(np.uint64)
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            tab, bits, fp = cols
            change = np.flatnonzero((tab[1:] != tab[:-1]) | (bits[1:] != bits[:-1]))
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut and (out := pairs_of(tab[:cut], bits[:cut], fp[:cut])) is not None:
                yield out
            rest = [x[cut:] for x in cols]
        if rest is not None and (out := pairs_of(*rest)) is not None:
            yield out

    by_key = keyed.repartition("tab", "bits").sortWithinPartitions("tab", "bits", "fp")
    return by_key.mapInArrow(run, "a bigint, b bigint").distinct()


def _marked(docs: DataFrame, shingle: int, max_bits: int, id_col: str, text_col: str) -> DataFrame:
    """(id_col, h, fp, group, component_id): ``h`` the row's text hash, ``group`` a fingerprint that names its group."""
    scratch = Scratch(docs.sparkSession, "simhash")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col), F.xxhash64(text).alias("h"), text.alias("text"))
    marked = scratch.write(with_fingerprints(rows, shingle, f"`{id_col}` {dict(rows.dtypes)[id_col]}, h bigint, fp bigint"), "fingerprints")
    distinct = scratch.write(marked.groupBy("fp").agg(F.min(id_col).alias("low")), "distinct")
    tied = components(near_pairs(distinct.select("fp"), max_bits), scratch)
    groups = distinct.join(tied, distinct["fp"] == tied["node"], "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("group"))
    lowest = groups.groupBy("group").agg(F.min("low").alias("component_id"))
    per_fp = groups.join(lowest, "group").select("fp", "group", "component_id")
    return marked.join(per_fp, "fp").select(id_col, "h", "fp", "group", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp, component_id): groups of rows whose fingerprints are linked within ``max_bits``.

    ``component_id`` is the smallest id of the group (null only if all its ids
    are null). Texts without words share fingerprint 0 and are linked like any
    other. Repeated rows get the same group. An empty table gives no rows.
    """
    return _marked(docs, shingle, max_bits, id_col, text_col).select(id_col, "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: fingerprint as 16 lower-case hexadecimal digits."""
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of every group of linked fingerprints: that of the smallest id (null last), then text hash.

    All columns of ``docs`` are kept. An id with several texts is judged text
    by text: it stays once for every group that one of its texts represents.
    Repeated rows stay once. An empty table gives no rows.
    """
    marked = _marked(docs, shingle, max_bits, "doc_id", "text")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h"))
    kept = marked.groupBy("group").agg(first.alias("r")).select(F.col("r.doc_id").alias("of"), F.col("r.h").alias("text_hash")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("of"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    # a merge join at every size: what it would broadcast grows with the documents
    on = rows["of"].eqNullSafe(kept["of"]) & (rows["text_hash"] == kept["text_hash"])
    return (rows.join(kept.hint("merge"), on, "left_semi").dropDuplicates(["of", "text_hash"])
            .select(*[F.col("row")[c].alias(c) for c in docs.columns]))
