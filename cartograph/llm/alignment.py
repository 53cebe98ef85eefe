"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, by merge-path partitioning.

Every text is encoded by a byte-level BPE (A) and a sentence-piece BPE (B).
Where tokens of both end at the same byte, the text is cut into groups; every A
token of a group is linked with every B token of it.

1. Pieces. The ends of a document's A and B tokens are two ascending lists to
   be merged. Binary searches on the merge's diagonals cut it, without merging,
   into pieces of ``PIECE`` ends each, so a long document becomes many rows of
   equal work. A document of one piece is finished where it is read. Equal ends
   are never cut apart.
2. Overlaps. Pieces of long documents are dealt to tasks, and each finds the
   ends its A and B slices share. What lies before the first and behind the
   last of them is its part of a group that it does not hold whole.
3. Stitching. These parts, and only these, meet per document and are joined to
   whole groups. Everything is now a run: tokens that begin and end at a
   group's border. A run keeps its distinct linked id pairs and how often each
   is linked.
4. Counts. Runs belong to shards of bounded text. A shard sends one row per id
   pair, with the number of its documents that hold it linked; documents in
   several runs send (document, pair) and are counted once.
5. Results. Every shard gets the corpus-wide counts of its own pairs back and
   adds them up for its runs.

A group with many tokens is never expanded into its pairs of occurrences, only
into pairs of distinct ids with their multiplicity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartograph.llm.common import Scratch

PIECE = 32_768            # A and B ends merged in one piece
SHARD_BYTES = 8_000_000   # text whose tokens are looked up together
RUNS_PER_SHARD = 64       # of one long document
CHUNK = 1_000_000         # bytes of text whose groups are found at once
WIDE = 64                 # a group with more links is reduced to distinct ids first

FOUND = ("n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, groups_sha256 string, "
         "pairs binary, times binary")
READ = "uid bigint, doc_id bigint, shard bigint, piece int, n_pieces int, a binary, b binary, a0 bigint, b0 bigint, " + FOUND


def diagonals(ea, eb, work: int):
    """(i, j): cuts of the merge of two ascending lists after every ``work`` elements, from (0, 0) to the end."""
    import numpy as np

    n, m = len(ea), len(eb)
    k = np.arange(work, n + m, work)
    lo, hi = np.maximum(0, k - m), np.minimum(k, n)
    while (lo < hi).any():
        mid = (lo + hi) >> 1
        busy = lo < hi
        at, to = mid[busy], k[busy] - 1 - mid[busy]
        taken = ea[at] <= eb[to]
        lo[busy] = np.where(taken, at + 1, lo[busy])
        hi[busy] = np.where(taken, hi[busy], at)
    i, j = lo, k - lo
    # an end of A at the border keeps its equal in B
    tie = (i > 0) & (j < m)
    tie[tie] = ea[i[tie] - 1] == eb[j[tie]]
    j = j + tie
    return np.concatenate(([0], i, [n])), np.concatenate(([0], j, [m]))


class Tokens:
    """Both encoders and the byte strings of their ids."""

    def __init__(self, a_path: str | None = None, b_path: str | None = None):
        import numpy as np
        import public_tokenizers
        import sentencepiece

        from cartograph.llm.tokens import encoder

        self.encode_a = encoder(a_path).encoding.encode_ordinary
        model = sentencepiece.SentencePieceProcessor(model_file=b_path or public_tokenizers.path("piece_bpe_32k.model"))
        self.encode_b = model.encode
        bpe = encoder(a_path).encoding
        self.a = [b""] * bpe.n_vocab
        for token in bpe.token_byte_values():
            self.a[bpe.encode_single_token(token)] = token
        self.b = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i)
                  else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a, self.b))
        self.kind = "<u2" if max(len(self.a), len(self.b)) <= 1 << 16 else "<u4"
        self.pairs = len(self.a) * len(self.b)
        self.pair_kind = "<u4" if self.pairs <= 1 << 32 else "<u8"

    def pair(self, a, b):
        return a * len(self.b) + b

    def encode(self, texts: list):
        """(A ids, B ids) of every text; none where joined bytes differ from space + text."""
        import numpy as np

        none = np.zeros(0, self.kind)
        for text, b in zip(texts, self.encode_b([x or "" for x in texts], num_threads=1)):
            if not text:
                yield none, none
                continue
            want = b" " + text.encode()
            a = self.encode_a(" " + text)
            if b"".join(map(self.a.__getitem__, a)) != want or b"".join(map(self.b.__getitem__, b)) != want:
                yield none, none
            else:
                yield np.array(a, self.kind), np.array(b, self.kind)


_TOKENS: dict[tuple, Tokens] = {}


def tokens(paths: tuple = (None, None)) -> Tokens:
    """One per Python worker and pair of files."""
    if paths not in _TOKENS:
        _TOKENS[paths] = Tokens(*paths)
    return _TOKENS[paths]


def pieces(docs: DataFrame, paths: tuple = (None, None), work: int = PIECE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """READ: every row of ``docs``, encoded and cut on the diagonals.

    A row of one piece (or without tokens) comes with its groups found. Longer
    ones are a row per piece with its ids; ``a0`` and ``b0`` are the bytes
    before the piece's first A and B token.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))

    def run(batches):
        import numpy as np

        from cartograph.llm.chars import slices

        t = tokens(paths)
        for batch in batches:
            uid, doc = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, shard in slices(batch.column(2), shard_bytes):
                for mid, texts in slices(shard, CHUNK):
                    at = lo + mid
                    single, cut = [], []
                    for k, (a, b) in enumerate(t.encode(texts.to_pylist()), at):
                        if len(a) + len(b) <= work:
                            single.append((k, a, b))
                            continue
                        ea, eb = np.cumsum(t.a_len[a]), np.cumsum(t.b_len[b])
                        i, j = diagonals(ea, eb, work)
                        cut += [(k, p, len(i) - 1, a[i[p]:i[p + 1]].tobytes(), b[j[p]:j[p + 1]].tobytes(),
                                 int(ea[i[p] - 1]) if i[p] else 0, int(eb[j[p] - 1]) if j[p] else 0) for p in range(len(i) - 1)]
                    if single:
                        index, a, b = zip(*single)
                        n = len(single)
                        yield _batch(READ, uid=[uid[k] for k in index], doc_id=[doc[k] for k in index], shard=[uid[lo]] * n,
                                     piece=[0] * n, n_pieces=[1] * n, **found(t, a, b, True))
                    for k in range(0, len(cut), 64):
                        index, piece, n_pieces, a, b, a0, b0 = zip(*cut[k:k + 64])
                        yield _batch(READ, uid=[uid[x] for x in index], doc_id=[doc[x] for x in index], piece=piece,
                                     n_pieces=n_pieces, a=a, b=b, a0=a0, b0=b0)

    return rows.mapInArrow(run, READ)


def _batch(schema: str, **columns):
    """A record batch of ``schema``; columns that are not given are null."""
    import pyarrow as pa

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    n = len(next(iter(columns.values()), ()))
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[f] if f in columns else [None] * n, kinds[k]) for f, k in fields],
                                      names=[f for f, _ in fields])


def found(t: Tokens, a, b, whole: bool) -> dict:
    """The columns FOUND of consecutive runs; the groups as text only of runs that are part of a document."""
    from hashlib import sha256

    import numpy as np

    g = Groups(t, a, b)
    key, times = g.links()
    texts = g.texts()
    cut = np.searchsorted(key, np.arange(len(a) + 1) * t.pairs)
    pair, times = (key % t.pairs).astype("<u8"), times.astype("<u4" if not len(times) or times.max() < 1 << 32 else "<u8")
    return {"n_a": g.n_a, "n_b": g.n_b, "n_groups": g.n_groups, "n_links": g.n_links,
            "groups": [None if whole else x.decode() for x in texts],
            "groups_sha256": [(sha256(x).hexdigest() if x else "") if whole else None for x in texts],
            "pairs": [pair[x:y].astype(t.pair_kind).tobytes() for x, y in zip(cut, cut[1:])],
            "times": [times[x:y].tobytes() for x, y in zip(cut, cut[1:])]}


def overlaps(cut: DataFrame, paths: tuple = (None, None)) -> DataFrame:
    """Every piece as head (up to the first shared end), whole groups, and tail (behind the last shared end).

    A piece without a shared end is all head and does not close a group. The
    head of a piece that begins at a group's border is part of its whole groups.
    """
    schema = ("uid bigint, doc_id bigint, piece int, closes boolean, head_a binary, head_b binary, a binary, b binary, "
              "tail_a binary, tail_b binary")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        t = tokens(paths)
        types = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), *[pa.binary()] * 6]
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                a, b = np.frombuffer(row["a"], t.kind), np.frombuffer(row["b"], t.kind)
                ea, eb = row["a0"] + np.cumsum(t.a_len[a]), row["b0"] + np.cumsum(t.b_len[b])
                _, ia, ib = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
                key = (row["uid"], row["doc_id"], row["piece"])
                if not len(ia):
                    out.append((*key, False, row["a"], row["b"], b"", b"", b"", b""))
                    continue
                inner = row["a0"] == row["b0"]
                x, y = (0, 0) if inner else (int(ia[0]) + 1, int(ib[0]) + 1)
                u, v = int(ia[-1]) + 1, int(ib[-1]) + 1
                out.append((*key, True, *(s.tobytes() for s in (a[:x], b[:y], a[x:u], b[y:v], a[u:], b[v:]))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), types)], names=names)

    return cut.select("uid", "doc_id", "piece", "a", "b", "a0", "b0").repartition("uid", "piece").mapInArrow(run, schema)


def stitched(parts: DataFrame) -> DataFrame:
    """Groups that several pieces share, whole: (uid, doc_id, seq, a, b). ``seq`` puts them between the pieces' own runs."""
    def run(table):
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: r["piece"])
        out, a, b, seq = [], [], [], -1
        for r in rows:
            a.append(r["head_a"])
            b.append(r["head_b"])
            if r["closes"]:
                if any(a):
                    out.append((r["uid"], r["doc_id"], seq, b"".join(a), b"".join(b)))
                a, b, seq = [r["tail_a"]], [r["tail_b"]], 2 * r["piece"] + 1
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 5, (
            pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["uid", "doc_id", "seq", "a", "b"])

    return parts.groupBy("uid").applyInArrow(run, "uid bigint, doc_id bigint, seq int, a binary, b binary")


def runs(docs: DataFrame, scratch: Scratch, paths: tuple = (None, None), work: int = PIECE,
         shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """Runs of whole groups: those of documents in one run, and those of documents in several."""
    read = scratch.write(pieces(docs, paths, work, shard_bytes), "read")
    names = [c.split()[0] for c in FOUND.split(", ")]
    single = read.where("n_pieces = 1").select("uid", "doc_id", F.lit(0).alias("seq"), F.lit(True).alias("whole"), "shard", *names)
    parts = scratch.write(overlaps(read.where("n_pieces > 1"), paths), "parts")
    own = parts.where("octet_length(a) > 0").select("uid", "doc_id", (F.col("piece") * 2).alias("seq"), "a", "b")
    joined = stitched(parts.select("uid", "doc_id", "piece", "closes", "head_a", "head_b", "tail_a", "tail_b"))
    shard = F.xxhash64("uid", F.floor(F.col("seq") / RUNS_PER_SHARD))
    several = own.unionByName(joined).select("uid", "doc_id", "seq", F.lit(False).alias("whole"), shard.alias("shard"), "a", "b")
    schema = "uid bigint, doc_id bigint, seq int, whole boolean, shard bigint, " + FOUND

    def run(batches):
        import numpy as np

        t = tokens(paths)
        for batch in batches:
            # each stretch of runs has a bounded number of ids, or is one run
            size = np.cumsum([len(x) for x in batch.column(5).to_pylist()])
            for lo, hi in spans(size // CHUNK):
                part = batch.slice(lo, hi - lo).to_pydict()
                ids = ([np.frombuffer(x, t.kind) for x in part.pop(c)] for c in ("a", "b"))
                yield _batch(schema, **part, **found(t, *ids, False))

    return single, scratch.write(several.mapInArrow(run, schema), "several")


class Groups:
    """Groups and links of consecutive runs."""

    def __init__(self, t: Tokens, a: list, b: list):
        import numpy as np

        self.t = t
        self.n_a, self.n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        self.a, self.b = (np.concatenate(side).astype(np.int64) if len(side) else np.zeros(0, np.int64) for side in (a, b))
        runs_ = len(self.n_a)
        # runs cover equal bytes in A and B, so ends counted through all runs stay comparable
        ea, eb = np.cumsum(t.a_len[self.a]), np.cumsum(t.b_len[self.b])
        ends = np.zeros(int(ea[-1]) + 1 if len(ea) else 1, np.uint8)
        ends[ea] = 1
        ends[eb] += 2
        self.last_a, self.last_b = ends[ea] == 3, ends[eb] == 3
        self.of_a, self.of_b = np.cumsum(self.last_a) - self.last_a, np.cumsum(self.last_b) - self.last_b
        n = int(self.last_a.sum())
        self.in_a, self.in_b = np.bincount(self.of_a, minlength=n), np.bincount(self.of_b, minlength=n)
        self.run = np.repeat(np.arange(runs_), self.n_a)[self.last_a]
        self.n_groups = np.bincount(self.run, minlength=runs_)
        self.n_links = np.zeros(runs_, np.int64)
        np.add.at(self.n_links, self.run, self.in_a * self.in_b)

    def links(self):
        """(key, times): the runs' distinct linked pairs, ascending by run and pair, and how often each is linked."""
        import numpy as np

        t = self.t
        size = self.in_a * self.in_b
        cum_b = np.concatenate(([0], np.cumsum(self.in_b)))
        near = size[self.of_a] <= WIDE
        a, group = self.a[near], self.of_a[near]
        n = self.in_b[group]
        start = np.cumsum(n) - n
        b = self.b[np.arange(int(n.sum())) - np.repeat(start, n) + np.repeat(cum_b[group], n)]
        key, times = np.unique(np.repeat(self.run[group] * t.pairs + t.pair(a, 0), n) + b, return_counts=True)
        wide = np.flatnonzero(size > WIDE).tolist()
        if wide:
            cum_a = np.concatenate(([0], np.cumsum(self.in_a)))
            keys, more = [key], [times]
            for g in wide:
                x, nx = np.unique(self.a[cum_a[g]:cum_a[g + 1]], return_counts=True)
                y, ny = np.unique(self.b[cum_b[g]:cum_b[g + 1]], return_counts=True)
                keys.append(self.run[g] * t.pairs + t.pair(x[:, None], y[None, :]).ravel())
                more.append((nx[:, None] * ny[None, :]).ravel())
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            times = np.zeros(len(key), np.int64)
            np.add.at(times, at, np.concatenate(more))
        return key, times

    def texts(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every run."""
        import numpy as np

        cum_b = np.concatenate(([0], np.cumsum(self.in_b)))
        cum_a = np.concatenate(([0], np.cumsum(self.in_a)))
        va, vb = len(self.t.a), len(self.t.b)
        code = np.empty(len(self.a) + len(self.b), np.int64)
        code[np.arange(len(self.a)) + cum_b[self.of_a]] = self.a + va * self.last_a
        code[np.arange(len(self.b)) + cum_a[self.of_b + 1]] = self.b + 2 * va + vb * self.last_b
        if not hasattr(self.t, "written"):
            self.t.written = [b"%d%c" % (i, s) for n, s in ((va, ord(",")), (va, ord("|")), (vb, ord(",")), (vb, ord(";")))
                              for i in range(n)]
        table, out, lo = self.t.written, [], 0
        for n in (self.n_a + self.n_b).tolist():
            out.append(b"".join(map(table.__getitem__, code[lo:lo + n].tolist()))[:-1])
            lo += n
        return out


def linked_pairs(rows: DataFrame, paths: tuple = (None, None)) -> DataFrame:
    """(shard, uid, pair, n): id pairs linked in the runs.

    For documents in one run, ``uid`` is null and ``n`` counts the shard's
    documents of a batch; else there is a row per document and pair.
    """
    schema = "shard bigint, uid bigint, pair bigint, n bigint"

    def run(batches):
        import numpy as np

        t = tokens(paths)
        for batch in batches:
            shard, uid, whole = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            blobs = batch.column(3).to_pylist()
            # a batch may hold many shards, one after the other, and many runs of one document
            for lo, hi in spans(shard, np.where(whole, 0, uid)):
                pair = np.concatenate([np.frombuffer(x, t.pair_kind) for x in blobs[lo:hi]])
                one, n = np.unique(pair, return_counts=True)
                if not whole[lo]:
                    n[:] = 1
                for k in range(0, len(one), 100_000):
                    m = len(one[k:k + 100_000])
                    yield _batch(schema, shard=[shard[lo]] * m, uid=[None if whole[lo] else uid[lo]] * m,
                                 pair=one[k:k + 100_000].astype(np.int64), n=n[k:k + 100_000])

    return rows.select("shard", "uid", "whole", "pairs").mapInArrow(run, schema)


def spans(*keys):
    """(start, end) of stretches of equal keys."""
    import numpy as np

    n = len(keys[0])
    cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1 if n else np.zeros(0, int)
    return list(zip([0, *cut.tolist()], [*cut.tolist(), n])) if n else []


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n): documents of the corpus that hold a pair linked."""
    alone = found.where("uid is null").select("pair", "n")
    several = found.where("uid is not null").select("uid", "pair").distinct().select("pair", F.lit(1).cast("bigint").alias("n"))
    return alone.unionByName(several).groupBy("pair").agg(F.sum("n").alias("n"))


def measured(rows: DataFrame, facts: DataFrame, paths: tuple = (None, None)) -> DataFrame:
    """Per run: what was found, and the sums of its pairs' counts."""
    kept = [c.split()[0] for c in FOUND.split(", ")][:6]
    schema = ("uid bigint, doc_id bigint, seq int, whole boolean, " + ", ".join(FOUND.split(", ")[:6])
              + ", n_best bigint, count_sum bigint")

    def run(table, known):
        import numpy as np
        import pyarrow as pa

        t = tokens(paths)
        order = np.argsort(known.column("pair").to_numpy())
        pairs, n, best = (known.column(c).to_numpy()[order] for c in ("pair", "n", "best"))
        n_best, count_sum = [], []
        for x, y in zip(table.column("pairs").to_pylist(), table.column("times").to_pylist()):
            pair = np.frombuffer(x, t.pair_kind)
            times = np.frombuffer(y, "<u4" if len(y) == 4 * len(pair) else "<u8").astype(np.int64)
            at = np.searchsorted(pairs, pair)
            n_best.append(int(times[best[at] == n[at]].sum()) if len(pair) else 0)
            count_sum.append(int((times * n[at]).sum()) if len(pair) else 0)
        return (table.select(["uid", "doc_id", "seq", "whole", *kept]).append_column("n_best", pa.array(n_best, pa.int64()))
                .append_column("count_sum", pa.array(count_sum, pa.int64())))

    return rows.groupBy("shard").cogroup(facts.groupBy("shard")).applyInArrow(run, schema)


def align(docs: DataFrame, paths: tuple = (None, None), work: int = PIECE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The contract's columns, one row per row of ``docs``; ``paths`` are the files of A and B.

    Null and empty texts, and texts that B does not give back byte by byte,
    have no tokens: zeros and an empty digest. Rows with one doc_id, equal ones
    too, are documents of their own. Other columns are not read. An empty table
    gives no rows. Texts may have any length: one is encoded in one task, and
    its pieces are dealt to many.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    single, several = runs(docs, scratch, paths, work, shard_bytes)
    size = len(tokens(paths).b)
    found = scratch.write(linked_pairs(single, paths).unionByName(linked_pairs(several, paths)), "found")
    counts = scratch.write(pair_counts(found), "counts")
    a_id = F.floor(F.col("pair") / F.lit(size))
    top = counts.groupBy(a_id.alias("a_id")).agg(F.max("n").alias("best"))
    facts = (found.select("shard", "pair").distinct().join(counts, "pair").withColumn("a_id", a_id).join(top, "a_id")
             .select("shard", "pair", "n", "best"))
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    out = scratch.write(measured(single.unionByName(several), facts, paths), "measured")
    scratch.drop("read")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "groups"))), lambda s: s["groups"]), ";")
    long = (out.where("not whole").groupBy("uid", "doc_id")
            .agg(*[F.sum(c).alias(c) for c in columns], F.sha2(text, 256).alias("groups_sha256")))
    keep = ["doc_id", *columns, "groups_sha256"]
    return out.where("whole").select(*keep).unionByName(long.select(*keep))
