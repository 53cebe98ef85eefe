"""Language-model scores from a hierarchical Pitman-Yor model of word pairs.

Restaurants: one per context word (and one for a text's begin), all sharing
one parent restaurant over single words, whose base is uniform over the
training vocabulary and one unknown word. A dish of a context restaurant is the
next word; its customers are the pair's training occurrences, and every table
sends one customer to the parent. With c customers and t tables of a dish, C
and T of its restaurant, discount d and concentration h

    P(w | u) = (c - d t + (h + d T) P(w)) / (h + C)

and P(w) likewise with the uniform base. Seating is sampled, and predictive
probabilities are averaged over ``samples`` of it.

Sampling. A Gibbs sweep visits every dish as a block: its customers leave and
are seated again one after another, at a table of the dish or a new one, as the
Chinese restaurant process does given all other tables. Seating one by one
cannot know who is still to come; a Metropolis step corrects for that and keeps
the block's conditional distribution. Beyond 32 customers of a dish, they come
in groups of 1/16 of those seated already, each with the chance at the group's
middle, so that a dish costs work by the logarithm of its customers (tests:
mean tables within 3 % of the exact law).
Dishes are visited in parallel; the parent's probabilities and the other tables
of a restaurant are those of the last exchange: at first every dish has one table,
and each of ``rounds`` rounds of sampling is followed by an exchange. A dish
of one customer has one table and needs no sampling.

Spark. Texts are read once: words become ids within a shard of text, a shard's
words are dealt to buckets by a hash of the word, where they are counted over
shards, and from then on a token is a 32-bit number. A shard sends
the distinct pairs of its texts, dealt to buckets by a hash of the pair, so no
context and no word is a hot key. A bucket counts its pairs, samples the tables
of those seen twice or more, and exchanges sums by context and by word with
all other buckets through one aggregation and one join. Shards are told the
pairs that are not theirs alone, by place among those they asked for, and score
their texts. Numbers travel as compressed columns, many rows in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartograph.llm.common import Scratch, release

FOLDS = 10
SHARD_BYTES = 16_000_000     # text whose words share one dictionary
BUCKET = 1_000_000           # pairs of shards counted together, and words of shards
WORD_BYTES = 16              # a bucket of words has this many bytes for each of its words, or fewer
SWEEPS = 3                   # before each sample
SAMPLES = 3
ROUNDS = 2                   # of sampling in the buckets, an exchange before and after each: the second sees sampled tables
ROOT_ROWS = 250_000          # words seated at once in the parent
STRENGTH = 1.0               # concentration of both levels
BLOCK = 16                   # beyond 2 * BLOCK customers, one in BLOCK of those seated come at once
BEGIN, END, UNKNOWN, FIRST = 0, 1, 2, 3
NEVER = (1 << 32) - 1        # number of a word without training occurrences
BUNDLE = 500_000             # rows of a task that are bundled at once


def rates(c, others, p, tables, seated, discount: float, strength: float):
    """(weight of a new table, all weights, log tilt) of dishes with so many ``tables`` and ``seated`` customers."""
    import numpy as np

    all_tables = strength + discount * (others + tables)
    new, stay = all_tables * p, seated - discount * tables
    ahead = np.log((c - discount * tables) / stay)
    gap = np.maximum(discount * (1 - p), 1e-6)
    later = -new * np.expm1(-gap * ahead) / gap               # tables expected later
    tilt = np.minimum(later * np.log1p(discount / all_tables) - discount * ahead, 0)
    new = new * np.exp(tilt)
    return new, stay + new, tilt


def early(c, others, p, discount: float, strength: float):
    """``rates`` and the log of all weights for the second and third customers of every dish.

    The second finds one table, the third one or two: no seating changes them, so they are worked out once for all.
    """
    import numpy as np

    def now(n, tables):
        k = int(np.searchsorted(-c, -n, side="left"))             # dishes with more than n customers
        new, total, tilt = rates(c[:k], others[:k], p[:k], tables, n, discount, strength)
        return new, total, tilt, np.log(total)

    return {(n, tables): now(n, tables) for n, tables in ((1, 1.0), (2, 1.0), (2, 2.0)) if len(c) and c[0] > n}


def seat(c, others, p, discount: float, strength: float, rng, opening):
    """(tables, log weight) of dishes whose customers are seated from nothing.

    ``c`` are the dishes' customers in descending order, ``others`` the
    restaurant's tables of other dishes, ``p`` the parent's probability of the
    dish, ``opening`` what ``early`` gives for them. The chance of a new table
    is tilted by what the table means for the customers still to come: less
    weight at old tables, more at new ones. The log weight is that of the
    seating over the chance of drawing it.
    """
    import numpy as np

    t, weight = np.ones(len(c)), np.zeros(len(c))
    n, rising = 1, -c
    while k := int(np.searchsorted(rising, -n, side="left")):         # dishes with more than n customers
        def now(tables, seated):
            return rates(c[:k], others[:k], p[:k], tables, seated, discount, strength)

        if n == 1:
            new, total, tilt, logs = opening[1, 1.0]
            opened = rng.random(k) * total < new
            weight[:k] += logs - opened * tilt
        elif n == 2:
            two = t[:k] == 2
            new, total, tilt, logs = (np.where(two, b, a) for a, b in zip(opening[2, 1.0], opening[2, 2.0]))
            opened = rng.random(k) * total < new
            weight[:k] += logs - opened * tilt
        elif n < 2 * BLOCK:
            new, total, tilt = now(t[:k], n)
            opened = rng.random(k) * total < new
            weight[:k] += np.log(total) - opened * tilt
        else:       # a block is seated with the chance at its middle
            step = np.minimum(n // BLOCK, c[:k] - n)
            new, total, tilt = now(t[:k], n)
            middle = n + (step - 1) / 2
            new, total, _ = now(t[:k] + step * new / total / 2, middle)
            opened = rng.binomial(step, np.minimum(new / total, 1))
            new, total, tilt = now(t[:k] + opened / 2, middle)
            weight[:k] += step * np.log(total) - opened * tilt
        t[:k] += opened
        n += max(1, n // BLOCK)
    return t.astype(np.int64), weight


def sample_tables(c, others, p, discount: float, strength: float, rng, sweeps: int, samples: int):
    """Tables per sample and dish: ``samples`` rows, ``sweeps`` block updates before each."""
    import numpy as np

    order = np.argsort(-c, kind="stable")
    c, others, p = c[order], others[order], p[order]
    opening = early(c, others, p, discount, strength)
    t, weight = seat(c, others, p, discount, strength, rng, opening)
    out = np.empty((samples, len(c)), np.int64)
    for s in range(samples):
        for _ in range(sweeps):
            new, other = seat(c, others, p, discount, strength, rng, opening)
            take = np.log(rng.random(len(c))) < other - weight
            t, weight = np.where(take, new, t), np.where(take, other, weight)
        out[s, order] = t
    return out


def by_few(numbers):
    """Stable order of small numbers from 0 on: numpy sorts 16 bits by counting."""
    import numpy as np

    few = not len(numbers) or int(numbers.max()) < 1 << 16
    return np.argsort(numbers.astype(np.uint16) if few else numbers, kind="stable")


def squeeze(*columns) -> bytes:
    """Columns of numbers as bytes: the numbers' first bytes together, then their second ones, each compressed."""
    import struct

    import numpy as np
    import pyarrow as pa

    codec, out = pa.Codec("zstd", compression_level=1), []
    for a in columns:
        for plane in np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T:
            raw = plane.tobytes()
            small = codec.compress(raw, asbytes=True) if len(raw) > 16 else raw
            small = small if len(small) < len(raw) else raw
            out += [struct.pack("<II", len(raw), len(small)), small]
    return b"".join(out)


def spread(blob: bytes, *types) -> list:
    """The columns that ``squeeze`` was given, of these types."""
    import struct

    import numpy as np
    import pyarrow as pa

    codec, at, out = pa.Codec("zstd"), 0, []
    for t in types:
        planes = []
        for _ in range(np.dtype(t).itemsize):
            n, size = struct.unpack_from("<II", blob, at)
            raw = blob[at + 8:at + 8 + size]
            at += 8 + size
            planes.append(np.frombuffer(raw if size == n else codec.decompress(raw, n, asbytes=True), np.uint8))
        out.append(np.ascontiguousarray(np.stack(planes, axis=1)).view(t).ravel())
    return out


def bundle(first, *others) -> bytes:
    """``squeeze`` with the first column, in ascending order, as differences."""
    import numpy as np

    return squeeze(np.diff(first, prepend=first.dtype.type(0)), *others)


def unbundle(blobs: list, *types) -> list:
    """The columns of several bundles, one after another."""
    import numpy as np

    got = [spread(x, *types) for x in blobs]
    return [np.concatenate([np.cumsum(g[k], dtype=t) if k == 0 else g[k] for g in got]) if got else np.zeros(0, t)
            for k, t in enumerate(types)]


def bundled(df: DataFrame, kind: int, *types) -> DataFrame:
    """(key, kind, x): the rows of ``df`` by its first column, many rows of a task in one bundle of the other columns."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def out(table):
            key, *cols = (table.column(k).to_numpy() for k in range(table.num_columns))
            cols = [c.astype(t) for c, t in zip(cols, types)]
            order = np.argsort(cols[0])
            order = order[by_few(np.searchsorted(np.unique(key), key)[order])]
            key, cols = key[order], [c[order] for c in cols]
            cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            stop = np.append(cut[1:], len(key))
            return pa.RecordBatch.from_arrays(
                [pa.array(key[cut]), pa.array(np.full(len(cut), kind, np.int32)),
                 pa.array([bundle(*(c[a:b] for c in cols)) for a, b in zip(cut, stop)], pa.binary())], names=["key", "kind", "x"])

        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= BUNDLE:
                yield out(pa.Table.from_batches(held))
                held, rows = [], 0
        if held:
            yield out(pa.Table.from_batches(held))

    return df.mapInArrow(run, "key bigint, kind int, x binary")


def tokenised(docs: DataFrame, folds: int = FOLDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Documents by place in their shard (kind 0), and the shards' words with training counts (kind 1).

    The word numbers of all documents of a shard are with its first one. A
    shard's words are one row: their training counts, lengths and bytes.
    """
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"),
                       held.alias("held"), F.col("text").cast("string").alias("text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        from cartograph.llm.chars import bytes_of, slices

        names = ["kind", "shard", "doc_id", "held", "ids", "local", "n", "size"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.int64(), pa.int64()]
        def full(batches):
            """The rows in shards of about ``shard_bytes``, filled across batches."""
            rest = []
            for batch in batches:
                held, rest = pa.Table.from_batches([*rest, batch]).combine_chunks(), []
                for rows in held.to_batches():
                    cut = [rows.slice(lo, len(texts)) for lo, texts in slices(rows.column(3), shard_bytes)]
                    yield from rest + cut[:-1]
                    rest = cut[-1:]
            yield from rest

        for batch in full(batches):
            uid, doc, out_ = (batch.column(k).to_pylist() for k in range(3))
            texts = batch.column(3)
            if n := len(texts):
                # Arrow's blanks are U+0009-U+000D and space; it gives empty words at blank edges
                lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
                flat, of = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
                some = pc.greater(pc.binary_length(flat), 0)
                of = of[some.to_numpy(zero_copy_only=False)]
                code = flat.filter(some).dictionary_encode()
                ids, (raw, at) = code.indices.to_numpy().astype("<u4"), bytes_of(code.dictionary)
                edge, m = np.searchsorted(of, np.arange(n + 1)), len(at) - 1
                held = np.array(out_, bool)
                trained = np.bincount(ids[~held[of]], minlength=m).astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((
                    [0] * n, [uid[0]] * n, doc, held, [squeeze(ids)] + [None] * (n - 1),
                    np.arange(n), np.diff(edge), [None] * n), types)], names=names)
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((
                    1, uid[0], None, None, squeeze(trained, np.diff(at).astype("<u4"), raw), None, m, len(raw)), types)], names=names)

    return rows.mapInArrow(run, "kind int, shard bigint, doc_id bigint, held boolean, ids binary, local int, n bigint, size bigint")


def word_hash(raw, size):
    """A 64-bit hash of each word: ``size`` bytes of ``raw`` each, one word after another."""
    import numpy as np

    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    ends = np.cumsum(size, dtype=np.int64)
    out = np.empty(len(size), np.uint64)
    up = down = np.ones(1, np.uint64)
    lo = 0
    while lo < len(size):              # words of about a million bytes, or one word
        start = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, start + 1_000_000, side="right")))
        part = raw[start:int(ends[hi - 1])].astype(np.uint64)
        if len(up) <= len(part):
            up, down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(part), x, np.uint64)))) for x in (base, inverse))
        sums = np.cumsum((part + np.uint64(1)) * up[:len(part)])
        sums = np.concatenate((np.zeros(1, np.uint64), sums))
        cut = np.concatenate(([0], ends[lo:hi] - start))
        out[lo:hi] = (sums[cut[1:]] - sums[cut[:-1]]) * down[cut[:-1]]
        lo = hi
    return out


def dealt(words: DataFrame, n_buckets: int) -> DataFrame:
    """(shard, bucket, x): every shard's words by bucket: places in the shard, training counts, lengths and bytes."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, size, raw = spread(blob, "<u4", "<u4", np.uint8)
                if not len(n):
                    continue
                b = bucket_of(word_hash(raw, size), n_buckets)
                order = by_few(b)
                at = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
                word = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(raw)])
                raw = np.frombuffer(word.take(pa.array(order)).buffers()[2], np.uint8)
                b, n, size = b[order], n[order], size[order]
                at = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
                cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
                stop = np.append(cut[1:], len(b))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(cut), shard)), pa.array(b[cut]), pa.array([
                        bundle(order[x:y].astype("<u4"), n[x:y], size[x:y], raw[at[x]:at[y]]) for x, y in zip(cut, stop)], pa.binary())],
                    names=["shard", "bucket", "x"])
        tidy()

    return words.mapInArrow(run, "shard bigint, bucket bigint, x binary")


def lexicon(words: DataFrame) -> DataFrame:
    """Per bucket of words: what shards are told of theirs (kind 0), words that occur twice or more (1), totals (2).

    ``number`` numbers a bucket's words with training occurrences in their
    order, ``c`` is the corpus-wide training count. A shard's ``x`` has its
    words' places, numbers (``NEVER`` for words without) and counts; the totals
    are words, occurrences and words that occur once.
    """
    import pyarrow as pa

    names = ["kind", "bucket", "shard", "number", "c", "single", "x"]
    types = [pa.int32(), *[pa.int64()] * 5, pa.binary()]

    def run(table):
        import numpy as np
        import pyarrow.compute as pc

        table = table.take(np.argsort(table.column("shard").to_numpy()))      # words are met in one order in every run
        got = [spread(x, "<u4", "<u4", "<u4", np.uint8) for x in table.column("x").to_pylist()]
        at = np.concatenate([np.zeros(1, np.int64), *(size for _, _, size, _ in got)]).cumsum()
        raw, n = np.concatenate([g[3] for g in got]), np.concatenate([g[1] for g in got])
        got = [np.cumsum(g[0], dtype="<u4") for g in got]
        code = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(raw)]).dictionary_encode()
        of = code.indices.to_numpy()
        c = np.bincount(of, weights=n, minlength=len(code.dictionary)).astype("<i8")
        seen = np.flatnonzero(c)
        seen = seen[pc.sort_indices(code.dictionary.take(pa.array(seen))).to_numpy()]
        del raw, n, code
        number = np.full(len(c), NEVER, "<u4")
        number[seen] = np.arange(len(seen))
        cut = np.cumsum([0, *map(len, got)])
        bucket, m, many = table.column("bucket")[0].as_py(), len(got), np.flatnonzero(c[seen] > 1)
        out = [([0] * m, [bucket] * m, table.column("shard").to_numpy(), [None] * m, [None] * m, [None] * m,
                [bundle(local, number[of[x:y]], c[of[x:y]]) for local, x, y in zip(got, cut, cut[1:])]),
               (np.full(len(many), 1), np.full(len(many), bucket), [None] * len(many), many, c[seen[many]], [None] * len(many), [None] * len(many)),
               ([2], [bucket], [None], [len(seen)], [int(c.sum())], [int((c == 1).sum())], [None])]
        tidy()
        return pa.concat_tables([pa.table([pa.array(x, t) for x, t in zip(cols, types)], names=names) for cols in out])

    return words.groupBy("bucket").applyInArrow(
        run, "kind int, bucket bigint, shard bigint, number bigint, c bigint, single bigint, x binary")


def told_words(lex: DataFrame, params: DataFrame, low) -> DataFrame:
    """(key, kind, id, x): for every shard, a bucket's words of its own that occur twice or more with their parameters."""
    def run(own, known):
        import numpy as np
        import pyarrow as pa

        known = known.take(np.argsort(known.column("id").to_numpy()))
        ids = known.column("id").to_numpy()
        cols = [known.column(k).to_numpy() for k in range(3, known.num_columns)]
        keys, blobs = [], []
        for bucket, shard, x in zip(*(own.column(c).to_pylist() for c in ("bucket", "shard", "x"))):
            _, number, c = spread(x, "<u4", "<u4", "<i8")
            some = np.flatnonzero(c > 1)
            if len(some):
                number = np.sort(number[some]).astype(np.int64) + low[bucket]
                at = np.searchsorted(ids, number)
                keys.append(shard)
                blobs.append(bundle(number.astype("<u4"), known.column("cu").to_numpy()[at], *(c[at] for c in cols)))
        tidy()
        m = len(keys)
        return pa.table([pa.array(keys, pa.int64()), pa.array([0] * m, pa.int32()), pa.array([None] * m, pa.int64()), pa.array(blobs, pa.binary())],
                        names=["key", "kind", "id", "x"])

    return lex.groupBy("bucket").cogroup(params.groupBy("part")).applyInArrow(run, "key bigint, kind int, id bigint, x binary")


def with_ends(values, words, end):
    """(values with ``end`` after each document's, documents' first places) of documents with so many ``words``."""
    import numpy as np

    sizes = np.asarray(words, np.int64) + 1
    ends = np.cumsum(sizes) - 1
    out = np.full(int(sizes.sum()), end, values.dtype)
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[keep] = values
    return out, ends + 1 - sizes


def pairs_of(ids, words, held):
    """(pair, training?, documents' first places) of consecutive documents' tokens: context in the upper 32 bits, word in the lower."""
    import numpy as np

    w, first = with_ends(ids, words, END)
    pair = np.zeros(len(w), np.uint64)
    pair[1:] = w[:-1]
    pair[first] = BEGIN
    pair <<= np.uint64(32)
    pair |= w
    return pair, np.repeat(~np.asarray(held, bool), np.asarray(words, np.int64) + 1), first


def distinct(pair):
    """(distinct pairs in ascending order, each pair's place among them): ``np.unique`` with fewer and smaller arrays."""
    import numpy as np

    order = np.argsort(pair)
    one = pair[order]
    head = np.ones(len(one), bool)
    np.not_equal(one[1:], one[:-1], out=head[1:])
    one = one[head]
    of = np.empty(len(order), np.int32)
    of[order] = np.cumsum(head, dtype=np.int32) - np.int32(1)
    return one, of


def tidy() -> None:
    """Give Arrow's unused memory back: a Python worker stays between tasks and stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


def bucket_of(pair, n: int):
    """Bucket of each pair: a multiplicative hash."""
    import numpy as np

    h = (pair ^ (pair >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def requests(one, n_buckets: int):
    """(places, cuts, buckets): distinct pairs of known words, by bucket and pair, and where each bucket's begin and end."""
    import numpy as np

    seen = np.flatnonzero(((one >> np.uint64(32)) != UNKNOWN) & ((one & np.uint64(0xFFFFFFFF)) != UNKNOWN))
    b = bucket_of(one[seen], n_buckets)
    order = by_few(b)
    b = b[order]
    cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, int)
    return seen[order], np.append(cut, len(b)), b[cut]


def coded(docs: DataFrame, lex: DataFrame, low, total: dict, n_buckets: int) -> DataFrame:
    """Documents with corpus-wide word ids and base scores (kind 0), and the shards' pairs by bucket (kind 1).

    A word's id is its number and ``low`` of its bucket.
    """
    schema = ("kind int, shard bigint, doc_id bigint, held boolean, n_tokens bigint, n_known bigint, base_score double, "
              "ids binary, pos int, bucket bigint, pairs binary")

    def run(rows, known):
        import numpy as np
        import pyarrow as pa

        told = [spread(x, "<u4", "<u4", "<i8") for x in known.column("x").to_pylist()]
        size = sum(len(local) for local, _, _ in told)
        table, count = np.zeros(size, np.uint32), np.zeros(size)
        for bucket, (local, number, c) in zip(known.column("bucket").to_pylist(), told):
            local = np.cumsum(local, dtype=np.int64)
            table[local], count[local] = np.where(number == NEVER, UNKNOWN, number + low[bucket]), c
        del told
        whole = np.log10(total["tokens"] + 0.1 * (total["vocabulary"] + 1))
        base, end = np.log10(count + 0.1) - whole, np.log10(total["documents"] + 0.1) - whole
        rows = rows.take(np.argsort(rows.column("local").to_numpy()))
        n, words, held = len(rows), rows.column("n").to_numpy(), rows.column("held").to_numpy(zero_copy_only=False)
        out = [pa.table([pa.array([], t) for t in types], names=names)]
        if n:
            shard = rows.column("shard")[0].as_py()
            local = spread(rows.column("ids")[0].as_py(), "<u4")[0]
            ids = table[local]
            base, first = with_ends(base[local], words, end)
            del local
            base = np.add.reduceat(base, first)
            known_, _ = with_ends(ids != UNKNOWN, words, total["documents"] > 0)
            out.append(pa.table([pa.array(c, t) for c, t in zip((
                [0] * n, [shard] * n, rows.column("doc_id").to_pylist(), held, words + 1, np.add.reduceat(known_, first, dtype=np.int64),
                base, [squeeze(ids)] + [None] * (n - 1), np.arange(n), [None] * n, [None] * n), types)], names=names))
            pair, train, _ = pairs_of(ids, words, held)
            del ids, known_, first
            one, of = distinct(pair)
            del pair
            times = np.bincount(of[train], minlength=len(one)).astype("<u4")
            del of, train
            asked, cut, buckets = requests(one, n_buckets)
            one, times = one[asked], times[asked]
            m = len(buckets)
            out.append(pa.table([pa.array(c, t) for c, t in zip((
                [1] * m, [shard] * m, *[[None] * m] * 7, buckets, [
                    bundle((one[x:y] >> np.uint64(32)).astype("<u4"), one[x:y].astype("<u4"), times[x:y])
                    for x, y in zip(cut, cut[1:])]), types)], names=names))
        tidy()
        return pa.concat_tables(out)

    import pyarrow as pa

    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.int32(),
             pa.int64(), pa.binary()]
    return docs.groupBy("shard").cogroup(lex.groupBy("shard")).applyInArrow(run, schema)


STATE = ("kind int, bucket bigint, id bigint, dishes bigint, customers bigint, twos bigint, tables array<bigint>, "
         "shard bigint, pairs binary, t binary, member binary, origin binary")


def _state_batch(**cols):
    """A table of STATE from the columns given."""
    import pyarrow as pa

    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    n = len(next(iter(cols.values())))
    fields = [f.split() for f in STATE.split(", ")]
    return pa.table([pa.array(cols[f] if f in cols else [None] * n, kinds[k]) for f, k in fields], names=[f for f, _ in fields])


def dishes(pairs: DataFrame) -> DataFrame:
    """Per bucket: its dishes of two customers or more (kind 0), and their contexts (1) and words (2).

    Kind 0 also has pairs with one customer that held-out texts hold, and what
    every shard is to be told: its number, how many pairs it asked for and how
    many of them are told (``origin``), one bit for each asked (``t``), and
    the dishes of those told (``member``).
    """
    def run(table):
        import numpy as np

        blobs = [unbundle([x], "<u4", "<u4", "<u4") for x in table.column("pairs").to_pylist()]
        sizes = [len(u) for u, _, _ in blobs]
        pair = np.concatenate([u.astype(np.uint64) << np.uint64(32) | w for u, w, _ in blobs])
        n = np.concatenate([k for _, _, k in blobs]).astype(np.int64)
        del blobs
        one, member = distinct(pair)
        del pair
        c = np.bincount(member, weights=n, minlength=len(one)).astype(np.int64)
        tell = (c[member] >= 2) | ((c[member] == 1) & (n == 0))
        kept = np.zeros(len(one), bool)
        kept[member[tell]] = True
        kept = np.flatnonzero(kept)
        cut = np.cumsum([0, *sizes])
        told = np.add.reduceat(tell, cut[:-1], dtype=np.int64)
        bits = b"".join(np.packbits(tell[a:z]).tobytes() for a, z in zip(cut, cut[1:]))
        member = np.searchsorted(kept, member[tell]).astype("<u4")
        one, c = one[kept], c[kept]
        many = c >= 2
        bucket = table.column("bucket")[0].as_py()
        out = [_state_batch(kind=[0], bucket=[bucket], customers=[int(c[many].sum())], dishes=[int(many.sum())],
                            twos=[int((c == 2).sum())],
                            pairs=[bundle((one >> np.uint64(32)).astype("<u4"), one.astype("<u4"), c.astype("<i8"))],
                            t=[squeeze(np.frombuffer(bits, np.uint8))], member=[bundle(member)],
                            origin=[squeeze(table.column("shard").to_numpy().astype("<i8"), np.array(sizes, "<i8"), told.astype("<i8"))])]
        for kind, key in ((1, one[many] >> np.uint64(32)), (2, one[many] & np.uint64(0xFFFFFFFF))):
            ids, at = np.unique(key.astype(np.int64), return_inverse=True)
            customers = np.bincount(at, weights=c[many], minlength=len(ids)).astype(np.int64)
            out.append(_state_batch(kind=np.full(len(ids), kind), bucket=np.full(len(ids), bucket), id=ids,
                                    dishes=np.bincount(at, minlength=len(ids)), customers=customers))
        import pyarrow as pa

        return pa.concat_tables(out)

    return pairs.groupBy("bucket").applyInArrow(run, STATE)


def sampled(state: DataFrame, facts: DataFrame, number: int, discount: float, strength: float,
            sweeps: int, samples: int, reply: bool) -> DataFrame:
    """One exchange's sampling in every bucket.

    Gives tables per sample by context (kind 1) and word (2), and the tables
    of every dish for the next exchange (3), or, with ``reply``, the dishes that
    each shard asked for with their tables added up over samples (4).
    """
    def run(own, known):
        import numpy as np
        import pyarrow as pa

        own = own.to_pylist()
        if not own:
            return _state_batch(kind=[])
        row = own[0]
        u, w, c = unbundle([row["pairs"]], "<u4", "<u4", "<i8")
        many = c >= 2
        u, w = u[many].astype(np.int64), w[many].astype(np.int64)
        kind, blobs = known.column("kind").to_numpy(), known.column("x").to_pylist()
        ids, value = unbundle([x for x, k in zip(blobs, kind) if k == 1], "<i8", "<f8")
        order = np.argsort(ids)
        ids, value = ids[order], value[order]

        found = [(which, *np.unique(key, return_inverse=True)) for which, key in ((1, u), (2, w))]
        seats, prob = (value[np.searchsorted(ids, one << 1 | which - 1)][at] for which, one, at in found)
        before = [x for x, k in zip(blobs, kind) if k == 0]
        t = np.frombuffer(before[0], "<i8") if before else np.ones(len(u), np.int64)
        rng = np.random.Generator(np.random.Philox(key=[row["bucket"], number]))
        out = [_state_batch(kind=[])]
        t = sample_tables(c[many], np.maximum(seats - t, 0), prob, discount, strength, rng, sweeps, samples) \
            if len(u) else np.zeros((samples, 0), np.int64)
        for which, one, at in found:
            sums = np.array([np.bincount(at, weights=t[s], minlength=len(one)) for s in range(samples)]).astype(np.int64)
            out.append(_state_batch(kind=np.full(len(one), which), id=one, tables=list(sums.T)))
        if not reply:
            out.append(_state_batch(kind=[3], bucket=[row["bucket"]], t=[t[-1].astype("<i8").tobytes()]))
            return pa.concat_tables(out)
        tables = np.full(len(c), samples, np.int64)
        tables[many] = t.sum(axis=0)
        member = unbundle([row["member"]], "<u4")[0]
        shards, asked, told = spread(row["origin"], "<i8", "<i8", "<i8")
        bits = spread(row["t"], np.uint8)[0]
        at, bit = np.cumsum([0, *told]), np.cumsum([0, *(-(-asked // 8))])
        some = np.flatnonzero(told)
        part = [member[at[s]:at[s + 1]] for s in some]
        out.append(_state_batch(kind=[4] * len(some), shard=shards[some], bucket=[row["bucket"]] * len(some), pairs=[
            squeeze(bits[bit[s]:bit[s + 1]], c[m], tables[m]) for s, m in zip(some, part)]))
        return pa.concat_tables(out)

    return state.groupBy("bucket").cogroup(facts.groupBy("key")).applyInArrow(run, STATE)


def rooted(words: DataFrame, sums: DataFrame, discount: float | None, total: dict, scratch: Scratch, name: str,
           sweeps: int, samples: int) -> tuple[DataFrame, dict]:
    """Parent restaurant: (id, cu, part, seats, k, tau) per word and the samples' totals, those of words that occur once added.

    ``seats`` are the tables of the word's context restaurant, ``k`` and
    ``tau`` the word's customers and tables in the parent, each per sample.
    """
    by = lambda kind, c: sums.where(F.col("kind") == kind).select(
        "id", F.col("customers").alias(f"{c}_customers"), F.col("tables").alias(f"{c}_tables"))
    none = F.array(*[F.lit(0).cast("bigint")] * samples)
    joined = (words.join(by(1, "u").hint("shuffle_hash"), "id", "left").join(by(2, "w").hint("shuffle_hash"), "id", "left")
              .select("id", "cu", "part",
                      F.transform(F.coalesce("u_tables", none), lambda t: t + F.col("cu") - F.coalesce("u_customers", F.lit(0))).alias("seats"),
                      F.transform(F.coalesce("w_tables", none), lambda t: t + F.col("cw") - F.coalesce("w_customers", F.lit(0))).alias("k")))
    joined = scratch.write(joined, f"{name}-sums")
    if discount is None:
        one, two = joined.agg(F.count_if(F.col("k")[0] == 1), F.count_if(F.col("k")[0] == 2)).first()
        discount = discount_of(one + total["single"], two)
    alpha = 1.0 / (total["vocabulary"] + 1)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def seated(table):
            k = table.column("k").combine_chunks().flatten().to_numpy().reshape(-1, samples)
            rng = np.random.Generator(np.random.Philox(key=[int(table.column("id")[0].as_py()), 1 << 40]))
            tau = np.zeros_like(k)
            for s in range(samples):
                some = np.flatnonzero(k[:, s] > 0)
                tau[some, s] = sample_tables(k[some, s], np.full(len(some), total["vocabulary"] - 1.0), np.full(len(some), alpha),
                                             discount, STRENGTH, rng, sweeps, 1)[0]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1, dtype=np.int32) * samples), pa.array(tau.ravel()))
            return table.append_column("tau", lists).combine_chunks().to_batches()[0]

        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= ROOT_ROWS:
                yield seated(pa.Table.from_batches(held))
                held, rows = [], 0
        if held:
            yield seated(pa.Table.from_batches(held))

    out = scratch.write(joined.mapInArrow(run, "id bigint, cu bigint, part bigint, seats array<bigint>, k array<bigint>, tau array<bigint>"), name)
    scratch.drop(f"{name}-sums")
    got = out.agg(*[F.coalesce(F.sum(F.col(c)[s]), F.lit(0)) for c in ("k", "tau") for s in range(samples)]).first()
    return out, {"discount": discount, "k": [x + total["single"] for x in got[:samples]],
                 "tau": [x + total["single"] for x in got[samples:]]}


def discount_of(one: int, two: int) -> float:
    """Discount from the number of dishes with one and with two customers."""
    return min(0.95, max(0.05, one / (one + 2 * two))) if one + two else 0.5


def word_probability(root: dict, total: dict, s: int, strength: float = STRENGTH):
    """Column: the parent's probability of a word in sample ``s``."""
    rest = (strength + root["discount"] * root["tau"][s]) / (total["vocabulary"] + 1)
    return (F.col("k")[s] - root["discount"] * F.col("tau")[s] + rest) / (strength + root["k"][s])


def single_probability(root: dict, total: dict, s: int, strength: float = STRENGTH) -> float:
    """The same of a word with one training occurrence: one customer at one table."""
    rest = (strength + root["discount"] * root["tau"][s]) / (total["vocabulary"] + 1)
    return (1 - root["discount"] + rest) / (strength + root["k"][s])


def unknown_probability(root: dict, total: dict, s: int, strength: float = STRENGTH) -> float:
    return (strength + root["discount"] * root["tau"][s]) / (total["vocabulary"] + 1) / (strength + root["k"][s])


def scored(docs: DataFrame, facts: DataFrame, model: dict, n_buckets: int) -> DataFrame:
    """Documents with the model's log10 probability: the averaged prediction of every token, added up."""
    samples = model["samples"]

    def run(rows, known):
        import numpy as np
        import pyarrow as pa

        kind, blobs = known.column("kind").to_numpy(), known.column("x").to_pylist()
        ids, cu, *values = unbundle([x for x, k in zip(blobs, kind) if k == 0], "<u4", "<i8", *["<f4"] * (2 * samples))
        order = np.argsort(ids)
        # begin, end and unknown first, as their ids are the smallest
        ids = np.concatenate((np.arange(FIRST, dtype=np.uint32), ids[order]))
        # and a word that no row tells of, which occurs once, last
        customers = np.concatenate((np.array(model["special_customers"], float), cu[order], [1]))
        seats = [np.concatenate(([x[s] for x in model["special_seats"]], values[s][order], [1])) for s in range(samples)]
        prob = [np.concatenate(([x[s] for x in model["special_prob"]], values[samples + s][order], [model["single_prob"][s]]))
                for s in range(samples)]

        def place(word):
            at = np.searchsorted(ids, word)
            at[ids[np.minimum(at, len(ids) - 1)] != word] = len(ids)
            return at

        rows = rows.take(np.argsort(rows.column("pos").to_numpy()))
        held, words = rows.column("held").to_numpy(zero_copy_only=False), rows.column("n_tokens").to_numpy() - 1
        del values, cu, order
        doc_ids = spread(rows.column("ids")[0].as_py(), "<u4")[0] if len(rows) else np.zeros(0, np.uint32)
        pairs, train, first = pairs_of(doc_ids, words, held)
        del doc_ids
        # the distinct pairs, in the order in which the buckets were asked for them
        own, of = distinct(pairs)
        del pairs
        c = np.zeros(len(own))
        c[of[train]] = 1
        del train
        t = c.copy()         # a training pair that is not told back occurs once in the corpus
        asked, cut, buckets = requests(own, n_buckets)
        places = {b: (x, y) for b, x, y in zip(buckets.tolist(), cut, cut[1:])}
        for b, blob, k in zip(known.column("id").to_pylist(), blobs, kind):
            if k == 1:
                x, y = places[b]
                bits, c_told, t_told = spread(blob, np.uint8, "<i8", "<i8")
                at = asked[x:y][np.unpackbits(bits, count=y - x).astype(bool)]
                c[at], t[at] = c_told, t_told / samples
        del asked, blobs
        d, h = model["discount"], model["strength"]
        value = np.empty(len(own))
        for lo in range(0, len(own), 500_000):
            p, part = own[lo:lo + 500_000], slice(lo, lo + 500_000)
            u, w = place((p >> np.uint64(32)).astype(np.uint32)), place(p.astype(np.uint32))
            back = sum((h + d * seats[s][u]) * prob[s][w] for s in range(samples)) / samples
            value[part] = np.log10((c[part] - d * t[part] + back) / (h + customers[u]))
        value = value[of]
        score = np.add.reduceat(value, first) if len(first) else np.zeros(0)
        tidy()
        return pa.table([rows.column(x) for x in ("doc_id", "held", "n_tokens", "n_known", "base_score")] + [pa.array(score, pa.float64())],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return docs.groupBy("shard").cogroup(facts.groupBy("key")).applyInArrow(
        run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")


def language_scores(docs: DataFrame, folds: int = FOLDS, shard_bytes: int = SHARD_BYTES, bucket: int = BUCKET,
                    sweeps: int = SWEEPS, samples: int = SAMPLES, strength: float = STRENGTH,
                    rounds: int = ROUNDS) -> DataFrame:
    """The contract's columns, one row per row of ``docs``.

    Null, empty and blank texts are one token, the end. A null id counts as
    empty text in the fold, which holds it out. Rows with one id, equal ones
    too, are documents of their own. Other columns are not read. An empty table
    gives no rows. Without training texts every token is the unknown one, of
    probability 1. Words may have any length; a text is read in one task.
    """
    import numpy as np
    import pyarrow as pa

    spark = docs.sparkSession
    scratch = Scratch(spark, "pitmanyor")
    read = tokenised(docs, folds, shard_bytes)
    read.write.option("compression", "zstd").partitionBy("kind").parquet(f"{scratch.root}/tokens")
    read = spark.read.schema(read.schema).parquet(f"{scratch.root}/tokens")
    own_words, own_bytes = read.where("kind = 1").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "size")]).first()
    word_buckets = int(max(1, -(-own_words // bucket), -(-own_bytes // (WORD_BYTES * bucket))))
    lex = scratch.write(lexicon(dealt(read.where("kind = 1").select("shard", "ids"), word_buckets)), "lexicon")
    scratch.drop("tokens/kind=1")
    release(spark)
    read = spark.read.schema(read.schema).parquet(f"{scratch.root}/tokens")
    n_docs, n_held, n_words = read.where("kind = 0").agg(
        F.count(F.lit(1)), F.coalesce(F.count_if("held"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # dense ids: one row per bucket of words
    parts = lex.where("kind = 2").select("bucket", "number", "c", "single").orderBy("bucket").collect()
    low, ids = np.zeros(word_buckets, np.int64), FIRST
    for p in parts:
        low[p["bucket"]] = ids
        ids += p["number"]
    if ids >= 1 << 32:
        raise ValueError("more than 2 ** 32 distinct words")
    trained = n_docs - n_held
    total = {"documents": trained, "tokens": sum(p["c"] for p in parts) + trained,
             "vocabulary": ids - FIRST + (trained > 0), "single": sum(p["single"] for p in parts)}
    start = F.broadcast(spark.createDataFrame(pa.table({"bucket": np.arange(word_buckets), "low": low})))
    of_shards = lex.where("kind = 0").select("bucket", "shard", "x")

    n_buckets = int(max(1, -(-(n_words + n_docs) // bucket)))
    out = coded(read.where("kind = 0").select("shard", "doc_id", "held", "ids", "local", "n"), of_shards, low, total, n_buckets)
    out.write.option("compression", "zstd").partitionBy("kind").parquet(f"{scratch.root}/coded")
    scratch.drop("tokens")
    release(spark)
    out = spark.read.schema(out.schema).parquet(f"{scratch.root}/coded")
    state = scratch.write(dishes(out.where("kind = 1").select("shard", "bucket", "pairs")), "dishes")
    scratch.drop("coded/kind=1")
    release(spark)

    packed = state.where("kind = 0").select("bucket", "pairs", "t", "member", "origin")
    wants = state.where("kind > 0").select(F.col("bucket").alias("bucket"), "kind", "id")
    customers, n_dishes, twos = state.where("kind = 0").agg(
        *[F.coalesce(F.sum(c), F.lit(0)) for c in ("customers", "dishes", "twos")]).first()
    discount = discount_of(total["tokens"] - customers, twos)
    special = spark.createDataFrame(pa.table({"id": [BEGIN, END], "cu": [trained, 0], "cw": [0, trained], "part": [-1, -1]}))
    # a word that occurs once has one table in its restaurant, one customer and one table in the parent: only counted
    words = lex.where("kind = 1").join(start, "bucket").select(
        (F.col("number") + F.col("low")).alias("id"), F.col("c").alias("cu"), F.col("c").alias("cw"), F.col("bucket").alias("part")).unionByName(special)
    # first exchange: all customers of a dish at one table
    in_dishes = state.where("kind > 0").groupBy("kind", "id").agg(
        F.sum("customers").alias("customers"), F.sum("dishes").alias("d"))
    sums = scratch.write(in_dishes.select("kind", "id", "customers", F.array("d").alias("tables")), "sums-0")
    seated = sums.select("kind", "id", "customers")
    params, root = rooted(words, sums, None, total, scratch, "root-0", sweeps, 1)
    tables = None
    for number in range(1, rounds + 1):
        last = number == rounds
        k = samples if last else 1
        value = F.when(F.col("kind") == 1, F.col("seats")[0].cast("double")).otherwise(word_probability(root, total, 0, strength))
        # a partition of words is small next to the requests for them: no sort of the requests
        facts = bundled(wants.join(params.hint("shuffle_hash"), "id").select(
            "bucket", (F.col("id") * 2 + F.col("kind") - 1).alias("id"), value.alias("value")), 1, "<i8", "<f8")
        if tables is not None:
            facts = facts.unionByName(tables)
        drawn = scratch.write(sampled(packed, facts, number, discount, strength, sweeps, k, last), f"drawn-{number}")
        tables = drawn.where("kind = 3").select(F.col("bucket").alias("key"), F.lit(0).alias("kind"), F.col("t").alias("x"))
        added = (drawn.where("kind in (1, 2)").groupBy("kind", "id")
                 .agg(F.array(*[F.sum(F.col("tables")[s]) for s in range(k)]).alias("tables")))
        params, root = rooted(words, added.join(seated, ["kind", "id"]), root["discount"], total, scratch, f"root-{number}", sweeps, k)
        scratch.drop(f"root-{number - 1}")
    scratch.drop("dishes")
    release(spark)

    probs = [word_probability(root, total, s, strength) for s in range(samples)]
    ends = {r["id"]: r for r in params.where(F.col("id") < FIRST).select("id", "seats", F.array(*probs).alias("p")).collect()}
    unknown = [unknown_probability(root, total, s, strength) for s in range(samples)]
    single = [float(np.float32(single_probability(root, total, s, strength))) for s in range(samples)]
    model = {"samples": samples, "single_prob": single, "discount": discount, "strength": strength,
             "special_seats": [list(ends[BEGIN]["seats"]), [0] * samples, [0] * samples],
             "special_prob": [[0.0] * samples, list(ends[END]["p"]) if trained else unknown, unknown],
             "special_customers": [trained, 0, 0]}

    of_words = told_words(of_shards, params.where(F.col("id") >= FIRST).select(
        "part", "id", "cu", *[F.col("seats")[s].cast("float").alias(f"s{s}") for s in range(samples)],
        *[probs[s].cast("float").alias(f"p{s}") for s in range(samples)]), low)
    of_pairs = drawn.where("kind = 4").select(F.col("shard").alias("key"), F.lit(1).alias("kind"), F.col("bucket").alias("id"),
                                              F.col("pairs").alias("x"))
    result = scored(out.where("kind = 0").select("shard", "doc_id", "held", "n_tokens", "n_known", "base_score", "ids", "pos"),
                    of_words.unionByName(of_pairs), model, n_buckets)
    return result.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total["tokens"]).cast("bigint").alias("train_tokens"),
                         "base_score", "score")
