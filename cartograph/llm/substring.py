"""Substring dedup: word windows that occur earlier, found by repeated-phrase automata.

A window is ``WINDOW`` consecutive words of one document. Every word covered by
a window that also starts earlier (smaller doc_id, or same document and
earlier start) is removed. Steps:

1. Anchors. Each window is represented by its least-hashed phrase of
   ``PHRASE`` words (a minimizer). Equal windows have the same anchor at the
   same place, and neighbouring windows mostly share one, so about one phrase
   in seven is an anchor. Counting anchors by hash finds the recurring ones.
2. Confirmation. The words of recurring anchors are fetched from the documents
   and counted as texts; only phrases that really occur twice go on.
3. Automata. Documents are dealt to shards by hash, and every shard gets the
   confirmed phrases that occur in it, compiled into one Aho-Corasick
   automaton. All documents stream through the automaton of their shard, which
   locates every occurrence of every recurring phrase.
4. Blocks. The windows around one located occurrence form a block; blocks are
   grouped by anchor and content. Blocks after the first of their group are
   copies through and through. Where one anchor has blocks of different
   content, the windows of each group's first block are compared one by one.
5. Removal of the covered words, shard by shard.

Documents are written once into a table bucketed by shard; steps 2, 3 and 5
read it without moving texts again. Shards are cut to a fixed amount of text,
so their number follows the input. Groups are reduced by aggregation before
anything is joined, so a passage that a third of all documents share costs one
row per occurrence and no group is ever held in one task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartograph.llm.common import Scratch, release

WINDOW = 20
PHRASE = 8
SHARD_BYTES = 4_000_000
MAX_FILES = 20_000
LAST = 2**63 - 1
KEPT_POWERS = 1_600_000   # powers kept for a step of text
STEP = 1_500_000          # bytes of text scanned at once (a longer document is scanned whole)


class Words:
    """Words of consecutive documents: places in the texts' bytes, document, and first word of every document."""

    def __init__(self, raw, offsets):
        import numpy as np

        n = len(raw)
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        word = ~blank
        before = np.concatenate(([False], word[:-1])) if n else word
        after = np.concatenate((word[1:], [False])) if n else word
        self.raw = raw
        self.start = np.flatnonzero(word & (~before | edge[:n]))
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(offsets)))     # first word of each document
        self._spaced = None

    def spaced(self, keep=None):
        """(bytes, ends): the words, or those to ``keep``, with a space before each and after the last, and where they end."""
        import numpy as np

        if keep is None and self._spaced is not None:
            return self._spaced
        start, end = (self.start, self.end) if keep is None else (self.start[keep], self.end[keep])
        size = end - start
        ends = np.cumsum(size + 1)
        out = np.full(int(ends[-1]) + 1 if len(ends) else 1, 32, np.uint8)
        step = np.arange(int(size.sum()))
        inner = np.repeat(np.cumsum(size) - size, size)
        out[step - inner + np.repeat(ends - size, size)] = self.raw[step - inner + np.repeat(start, size)]
        if keep is None:
            self._spaced = out, ends
        return out, ends


def mix(x):
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict = {}


def powers(base: int, n: int):
    """The first ``n`` powers of ``base`` modulo 2 ** 64; those of one step of text are worked out once a worker."""
    import numpy as np

    def made(n):
        p = np.full(n, base, np.uint64)
        p[:1] = 1
        return np.cumprod(p, dtype=np.uint64)

    if n > KEPT_POWERS:
        return made(n)
    if base not in _POWERS:
        _POWERS[base] = made(KEPT_POWERS)
    return _POWERS[base][:n]


def leftmost_least(x, span: int):
    """For each of ``span`` consecutive values of ``x``, the place of the least, of equal ones the first."""
    import numpy as np

    best, at, size = x, np.arange(len(x), dtype=np.int32 if len(x) < 1 << 31 else np.int64), 1
    while size < span:
        step = min(size, span - size)
        n = max(0, len(best) - step)
        less = best[step:] < best[:n]
        at = np.where(less, at[step:], at[:n])
        best = np.minimum(best[step:], best[:n])
        size += step
    return at


class Hashed(Words):
    """Words of consecutive documents and their hashes."""

    def __init__(self, raw, offsets):
        import numpy as np

        super().__init__(raw, offsets)
        n = len(raw)
        base, back = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(base, n), dtype=np.uint64, out=total[1:])
        self.value = mix((total[self.end] - total[self.start]) * powers(back, n)[self.start]
                         + (self.end - self.start).astype(np.uint64)) if len(self.start) else np.zeros(0, np.uint64)


class Scan(Hashed):
    """Words, phrase hashes and anchors of consecutive documents."""

    def __init__(self, raw, offsets, window: int, phrase: int):
        import numpy as np

        super().__init__(raw, offsets)
        m = len(self.value)
        step, undo = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
        self.undo = powers(undo, m + 1)
        self.sum = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.value * powers(step, m), dtype=np.uint64)))
        self.window, self.phrase = window, phrase

        w = max(0, m - window + 1)
        self.valid = self.doc[:w] == self.doc[window - 1:] if w else np.zeros(0, bool)
        n = max(0, m - phrase + 1)
        self.phrases = mix((self.sum[phrase:] - self.sum[:n]) * self.undo[:n] + np.uint64(phrase)) if n else np.zeros(0, np.uint64)
        self.arg = leftmost_least(self.phrases, window - phrase + 1)[:w]      # anchor position of each window

    def hashes(self, at, length):
        """Hashes of the ``length`` words from each position on."""
        import numpy as np

        return mix((self.sum[at + length] - self.sum[at]) * self.undo[at] + np.asarray(length).astype(np.uint64))

    def anchors(self):
        """Positions of anchors, ascending."""
        import numpy as np

        at = self.arg[self.valid].astype(np.int64)         # never falls from one window to the next
        new = np.ones(len(at), bool)
        np.not_equal(at[1:], at[:-1], out=new[1:])
        return at[new]

    def texts(self, at, length: int):
        """Arrow strings: from each position on, ``length`` words joined by single spaces, with one on either side."""
        import numpy as np
        import pyarrow as pa

        out, ends = self.spaced()
        start, stop = np.concatenate(([0], ends))[at], ends[at + length - 1] + 1
        edge = np.concatenate((np.zeros(1, np.int64), np.cumsum(stop - start)))
        data = out[np.arange(edge[-1]) - np.repeat(edge[:-1] - start, stop - start)]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(edge), pa.py_buffer(data))


def scans(column, window: int, phrase: int, step: int = STEP):
    """(first row, Scan) over an Arrow string array, whole documents at a time."""
    return parts(column, lambda raw, offsets: Scan(raw, offsets, window, phrase), step)


def parts(column, make, step: int = STEP):
    """(first row, ``make`` of bytes and offsets) over an Arrow string array, whole documents at a time."""
    import numpy as np

    from cartograph.llm.chars import bytes_of

    raw, offsets = bytes_of(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + step, side="right")) - 1)
        yield lo, make(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi


def _signed(x):
    import numpy as np

    return x.view(np.int64)


def find_anchors(shards: DataFrame, window: int, phrase: int) -> DataFrame:
    """(anchor, b, n): hashes of anchors per shard; a row counts the occurrences of one batch."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            shard = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, s in scans(batch.column(1), window, phrase):
                at = s.anchors()
                b, a = shard[lo + s.doc[at]], _signed(s.phrases[at])
                order = np.lexsort((a, b))
                b, a = b[order], a[order]
                head = np.flatnonzero(np.concatenate((np.ones(min(len(a), 1), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
                n = np.diff(np.append(head, len(a)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[head]), pa.array(b[head].astype(np.int32)), pa.array(n.astype(np.int64))],
                    names=["anchor", "b", "n"])

    return shards.select("b", "text").mapInArrow(run, "anchor bigint, b int, n bigint")


def fetch_phrases(shards: DataFrame, wanted: DataFrame, window: int, phrase: int) -> DataFrame:
    """(b, anchor, phrase, n): the words behind recurring anchors, per shard."""
    def run(docs, want):
        import numpy as np
        import pyarrow as pa

        hashes = np.unique(want.column("anchor").to_numpy().astype(np.int64))
        found = [pa.table({"anchor": pa.array([], pa.int64()), "phrase": pa.array([], pa.large_string()), "n": pa.array([], pa.int64())})]
        text = docs.column("text").combine_chunks()
        for _, s in scans(text, window, phrase) if len(hashes) else ():
            at = s.anchors()
            value = _signed(s.phrases[at])
            spot = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
            hit = hashes[spot] == value
            part = pa.table({"anchor": value[hit], "phrase": s.texts(at[hit], phrase)})
            found.append(part.group_by(["anchor", "phrase"]).aggregate([([], "count_all")]).rename_columns(["anchor", "phrase", "n"]))
        count = pa.concat_tables(found).group_by(["anchor", "phrase"]).aggregate([("n", "sum")])
        b = want.column("b")[0].as_py() if len(want) else 0
        return pa.table({"b": pa.array(np.full(len(count), b), pa.int32()), "anchor": count.column("anchor"),
                         "phrase": count.column("phrase").cast(pa.string()), "n": count.column("n_sum")})

    return shards.select("b", "text").groupBy("b").cogroup(wanted.groupBy("b")).applyInArrow(
        run, "b int, anchor bigint, phrase string, n bigint")


class Letters:
    """Words as two letters each, so that an automaton of phrases has two nodes a word and not one a byte.

    First and second letters are different ones, so that a match begins at a
    word; a word that no phrase holds is twice the letter 0, which none has.
    """

    def __init__(self, values):
        import numpy as np

        self.known = np.unique(values)
        self.base = int(np.ceil(np.sqrt(len(self.known))))

    def __call__(self, values) -> str:
        import numpy as np

        at = np.minimum(np.searchsorted(self.known, values), len(self.known) - 1).astype(np.int32)
        some = self.known[at] == values
        out = np.empty((len(at), 2), "<u4")
        out[:, 0] = np.where(some, 1 + at // self.base, 0)
        out[:, 1] = np.where(some, 1 + self.base + at % self.base, 0)
        # code points for surrogates are no letters
        return (out + (out >= 0xD800) * np.uint32(0x800)).astype("<u4").tobytes().decode("utf-32-le")


def locate(shards: DataFrame, phrases: DataFrame, window: int, phrase: int) -> DataFrame:
    """(anchor, content, b, d, h, start, n, windows): blocks around every occurrence of a phrase.

    A block is ``n`` windows from word ``start`` on with one anchor occurrence;
    ``windows`` has their 64-bit hashes.
    """
    names = ["anchor", "content", "b", "d", "h", "start", "n", "windows"]

    def run(docs, confirmed):
        import ahocorasick
        import numpy as np
        import pyarrow as pa

        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        out = []
        if len(docs) and len(confirmed):
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            values = np.concatenate([x.value for _, x in parts(confirmed.column("phrase").combine_chunks(), Hashed)])
            letters = Letters(values)
            spelt = letters(values)
            for i in range(0, len(spelt), 2 * phrase):
                automaton.add_word(spelt[i:i + 2 * phrase], 1)
            automaton.make_automaton()
            d, h = (docs.column(c).to_numpy() for c in ("d", "h"))
            b = docs.column("b")[0].as_py()
            for lo, s in scans(docs.column("text").combine_chunks(), window, phrase):
                found = np.zeros(len(s.start) + 1, bool)        # a recurring phrase starts at this word
                # a phrase across documents marks a word that no valid window has as its anchor
                ends = np.fromiter((e for e, _ in automaton.iter(letters(s.value))), np.int64)
                found[ends // 2 - phrase + 1] = True
                win = np.flatnonzero(s.valid & found[s.arg])
                if not len(win):
                    continue
                arg = s.arg[win].astype(np.int64)
                head = np.flatnonzero(np.concatenate(([True], (arg[1:] != arg[:-1]) | (win[1:] != win[:-1] + 1))))
                count = np.diff(np.append(head, len(win)))
                at, anchor_at = win[head], arg[head]
                content = s.hashes(at, count + window - 1) ^ (anchor_at - at).astype(np.uint64)
                hashes = s.hashes(win, window).tobytes()
                doc = s.doc[at]
                out.append(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((
                    _signed(s.phrases[anchor_at]), _signed(content), np.full(len(at), b, np.int32), d[lo + doc], h[lo + doc],
                    (at - s.first[doc]).astype(np.int32), count.astype(np.int32),
                    [hashes[8 * i:8 * (i + c)] for i, c in zip(head.tolist(), count.tolist())]), types)], names=names))
        return pa.Table.from_batches(out, pa.schema(list(zip(names, types))))

    return shards.select("b", "d", "h", "text").groupBy("b").cogroup(phrases.groupBy("b")).applyInArrow(
        run, "anchor bigint, content bigint, b int, d bigint, h bigint, start int, n int, windows binary")


def copied_spans(blocks: DataFrame, scratch: Scratch, window: int) -> DataFrame:
    """(b, d, h, start, stop): words of windows that also start earlier; ``blocks`` are dropped once read.

    Each join is written on its own, so that its shuffles are gone before the next.
    """
    place = F.struct("d", "h", "start")
    firsts = scratch.write(blocks.groupBy("anchor", "content").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("times")), "firsts")
    release(scratch.spark)
    copies = scratch.write(blocks.join(firsts.where("times > 1").drop("times"), ["anchor", "content"])
                           .where(place != F.col("first"))
                           .select("b", "d", "h", "start", (F.col("start") + F.col("n") + window - 1).alias("stop")), "copies")
    release(scratch.spark)
    # anchors whose blocks differ: the first block of each content, window by window
    mixed = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("anchor")
    heads = firsts.join(mixed, "anchor", "left_semi").select("anchor", "content", "first.*")
    windows = scratch.write(
        blocks.join(heads, ["anchor", "content", "d", "h", "start"], "left_semi").select("anchor", "b", "d", "h", F.explode(F.transform(
            F.sequence(F.lit(0), F.col("n") - 1),
            lambda i: F.struct((F.col("start") + i).alias("start"), F.substring("windows", i * 8 + 1, F.lit(8)).alias("w")))).alias("x"))
        .select("anchor", "x.w", "b", "d", "h", "x.start"), "windows")
    scratch.drop("blocks")
    scratch.drop("firsts")
    release(scratch.spark)
    low = windows.groupBy("anchor", "w").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    single = scratch.write(windows.join(low, ["anchor", "w"]).where(place != F.col("first"))
                           .select("b", "d", "h", "start", (F.col("start") + window).alias("stop")), "spans")
    scratch.drop("windows")
    release(scratch.spark)
    return copies.unionByName(single)


def cut_out(shards: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every row of the shards without the words of its spans."""
    def run(docs, gone):
        import numpy as np
        import pyarrow as pa

        by: dict[tuple[int, int], list[int]] = {}
        keys = list(zip(*(gone.column(c).to_numpy().tolist() for c in ("d", "h")))) if len(gone) else []
        start, stop = (gone.column(c).to_numpy().tolist() for c in ("start", "stop"))
        for k, key in enumerate(keys):
            by.setdefault(key, []).append(k)
        words_, removed, kept = [], [], []
        d, h = (docs.column(c).to_numpy().tolist() for c in ("d", "h"))
        for lo, s in parts(docs.column("text").combine_chunks(), Words):
            n = len(s.first) - 1
            hit = np.zeros(len(s.start) + 1, np.int64)
            for i, key in enumerate(zip(d[lo:lo + n], h[lo:lo + n])):
                for k in by.get(key, ()):
                    hit[s.first[i] + start[k]] += 1
                    hit[s.first[i] + stop[k]] -= 1
            left = np.cumsum(hit[:-1]) == 0
            flat, ends = s.spaced(left)
            count = np.concatenate(([0], np.cumsum(left)))[s.first]       # words left before each document
            edge = np.concatenate(([0], ends))[count].tolist()
            words_ += np.diff(s.first).tolist()
            removed += (np.diff(s.first) - np.diff(count)).tolist()
            kept += [flat[x + 1:y].tobytes().decode() for x, y in zip(edge, edge[1:])]
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(words_, pa.int64()),
                         "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    return shards.groupBy("b").cogroup(spans.groupBy("b")).applyInArrow(
        run, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def dedup_passages(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) per input row.

    ``kept`` are the words left, joined by single spaces. Null and empty texts
    have no words. Null ids come after all others; rows with one id and
    different texts follow the order of their text hash; rows with the same id
    and text are one document and get the same result. An empty table gives no
    rows. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("d"),
                       F.xxhash64(text).alias("h"), text.alias("text"))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = max(8, -(-volume // SHARD_BYTES))
    files = min(n_shards, MAX_FILES)
    rows = rows.withColumn("b", F.pmod(F.xxhash64("d", "h", F.lit("shard")), F.lit(n_shards)).cast("int"))
    table = f"shards_{uuid.uuid4().hex[:12]}"
    (rows.repartition(files, "b").write.bucketBy(files, "b").option("path", f"{scratch.root}/shards")
     .option("compression", "zstd").saveAsTable(table))
    release(spark)
    shards = spark.table(table)

    anchors = scratch.write(find_anchors(shards, window, phrase), "anchors")
    release(spark)
    # a shard has a row of an anchor for every batch, so the window over an anchor sees a few rows a shard
    wanted = scratch.write(anchors.withColumn("n", F.sum("n").over(Window.partitionBy("anchor"))).where("n > 1").select("anchor", "b"), "wanted")
    scratch.drop("anchors")
    release(spark)
    fetched = scratch.write(fetch_phrases(shards, wanted, window, phrase), "phrases")
    scratch.drop("wanted")
    release(spark)
    confirmed = fetched.groupBy("anchor", "phrase").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", "phrase")
    by_shard = fetched.select("b", "anchor", "phrase").join(confirmed, ["anchor", "phrase"], "left_semi").select("b", "phrase")
    blocks = scratch.write(locate(shards, by_shard, window, phrase), "blocks")
    scratch.drop("phrases")
    release(spark)
    spans = copied_spans(blocks, scratch, window)
    kept = cut_out(shards, spans)
    spark.sql(f"DROP TABLE {table}")        # only the catalog entry: an external table's files stay
    return kept


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return dedup_passages(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
