"""Approximate nearest neighbours: hierarchical k-means tree, best-bin-first.

A tree of k-means centres is fitted on a bounded sample (``SAMPLE`` vectors) on
the driver. Every vector is indexed: tasks send it down the tree to a leaf. A
query walks the tree with one priority queue over all branches not taken,
nearest centre first, and visits leaves in that order. How many leaves is not
guessed: for a fixed set of calibration vectors the exact neighbours are found
by brute force over all vectors, and visits are widened until the share of
those neighbours that lie in visited leaves reaches ``RECALL``.

Queries meet vectors by leaf. A leaf with many vectors is split into blocks of
a fixed size and its queries are sent to each block; a block returns its
nearest few per query, so nothing grows with the size of a leaf.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartograph.llm.common import Scratch
from cartograph.llm.vectors import common_width, matrix, usable

SAMPLE = 20_000          # vectors the tree is fitted on, at most
CALIBRATION = 200        # vectors whose exact neighbours calibrate the visits
BRANCHES = 8
LEAF_ROWS = 256          # vectors aimed at per leaf
LEAF_SAMPLE = 8          # sampled vectors per leaf, at least
BLOCK_ROWS = 8_192
RECALL = 0.97
K = 10


class Tree:
    """Centres of all nodes; node 0 is the root, children of a node are consecutive."""

    def __init__(self, centres, children: list[tuple[int, int]], leaf: list[int]):
        self.centres, self.children, self.leaf = centres, children, leaf
        self.n_leaves = max(leaf) + 1

    @staticmethod
    def fit(x, leaf_size: int, branches: int = BRANCHES, seed: int = 7) -> "Tree":
        import numpy as np

        rng = np.random.default_rng(seed)
        centres, children, leaf, n_leaves = [x.mean(axis=0)], [(0, 0)], [-1], 0
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            part = x[rows]
            k = min(branches, len(np.unique(part, axis=0)), -(-len(rows) // leaf_size))
            if len(rows) <= leaf_size or k < 2:
                leaf[node], n_leaves = n_leaves, n_leaves + 1
                continue
            c = part[rng.choice(len(part), k, replace=False)]
            for _ in range(12):
                near = ((part ** 2).sum(1)[:, None] - 2 * part @ c.T + (c ** 2).sum(1)).argmin(1)
                c = np.array([part[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(k)])
            near = ((part ** 2).sum(1)[:, None] - 2 * part @ c.T + (c ** 2).sum(1)).argmin(1)
            used = [j for j in range(k) if (near == j).any()]
            if len(used) < 2:
                leaf[node], n_leaves = n_leaves, n_leaves + 1
                continue
            first = len(centres)
            children[node] = (first, first + len(used))
            for j in used:
                centres.append(c[j])
                children.append((0, 0))
                leaf.append(-1)
                todo.append((len(centres) - 1, rows[near == j]))
        return Tree(np.array(centres), children, leaf)

    def assign(self, x):
        """Leaf of each vector: the nearest child at every level."""
        import numpy as np

        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            lo, hi = self.children[node]
            if lo == hi:
                out[rows] = self.leaf[node]
                continue
            c = self.centres[lo:hi]
            near = ((c ** 2).sum(1) - 2 * x[rows] @ c.T).argmin(1)
            todo.extend((lo + j, rows[near == j]) for j in range(hi - lo) if (near == j).any())
        return out

    def visit(self, q):
        """Leaves in best-bin-first order."""
        heap = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            lo, hi = self.children[node]
            if lo == hi:
                yield self.leaf[node]
                continue
            for j, dist in enumerate(((self.centres[lo:hi] - q) ** 2).sum(axis=1).tolist()):
                heapq.heappush(heap, (dist, lo + j))


def nearest(q, q_ids, x, x_ids, k: int):
    """(query row, candidate row, distance) of the k nearest candidates per query, its own id left out."""
    import numpy as np

    rows, cols, dist = [], [], []
    for i in range(len(q)):
        d = np.sqrt(((x - q[i]) ** 2).sum(axis=1))
        d[x_ids == q_ids[i]] = np.inf
        n = min(k, len(d))
        cut = np.partition(d, n - 1)[n - 1]
        at = np.flatnonzero((d <= cut) & (d < np.inf))
        at = at[np.lexsort((x_ids[at], d[at]))][:k]
        rows += [i] * len(at)
        cols += at.tolist()
        dist += d[at].tolist()
    return rows, cols, dist


def build(vectors: DataFrame, scratch: Scratch, width: int, sample: int = SAMPLE) -> tuple[Tree, DataFrame, int]:
    """Fitted tree, index of every vector (id, vec, leaf), number of vectors."""
    n = vectors.count()
    share = min(1.0, 1.2 * sample / max(n, 1))
    h = F.pmod(F.xxhash64("id", "vec"), F.lit(1_000_003))
    picked = vectors.where(h < int(share * 1_000_003) + 1).select("vec", h.alias("h"), "id").orderBy("h", "id").limit(sample)
    table = picked.select("vec").toArrow().column("vec").combine_chunks()
    x = matrix(table, width)
    tree = Tree.fit(x, max(LEAF_SAMPLE, int(LEAF_ROWS * len(x) / n)))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.assign(matrix(b.column(1), width)).astype("int32"))],
                                             names=["id", "vec", "leaf"])

    kind = dict(vectors.dtypes)["vec"]
    return tree, scratch.write(vectors.select("id", "vec").mapInArrow(run, f"id bigint, vec {kind}, leaf int"), "index"), n


def calibrate(index: DataFrame, tree: Tree, width: int, k: int, recall: float, n: int, probes: int = CALIBRATION) -> int:
    """Leaf visits that reach the recall on the calibration vectors."""
    import numpy as np

    share = min(1.0, 1.5 * probes / n)
    h = F.pmod(F.xxhash64("id", F.lit("calibration")), F.lit(1_000_003))
    picked = index.where(h < int(share * 1_000_003) + 1).select("id", "vec", h.alias("h")).orderBy("h", "id").limit(probes).toArrow()
    q, q_ids = matrix(picked.column("vec").combine_chunks(), width), picked.column("id").to_numpy()
    if not len(q):
        return 1

    def exact(batches):                      # a stated set of at most `probes` vectors against all rows
        import pyarrow as pa

        for b in batches:
            x, ids, leaf = matrix(b.column(1), width), b.column(0).to_numpy(), b.column(2).to_numpy()
            r, c, d = nearest(q, q_ids, x, ids, k)
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(d, pa.float64()), pa.array(leaf[c].astype("int32")),
                                              pa.array(ids[c])], names=["q", "d", "leaf", "id"])

    found = index.mapInArrow(exact, "q int, d double, leaf int, id bigint")
    best = found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("d", "id"))).where(F.col("rank") <= k).collect()
    order = {}
    needed = []
    for row in best:
        if row["q"] not in order:
            order[row["q"]] = {leaf: i + 1 for i, leaf in enumerate(tree.visit(q[row["q"]]))}
        needed.append(order[row["q"]][row["leaf"]])
    needed = np.sort(np.array(needed, dtype=np.int64))
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else 1


def search(vectors: DataFrame, queries: DataFrame, k: int = K, recall: float = RECALL,
           id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors found for each query, nearest first.

    Distance is Euclidean, in double precision on the original vectors; ties go
    to the smaller id. Rows without an id, and vectors that are null, zero, not
    finite or of another length than most, take no part, as query or as
    candidate. A query id given several times is searched once, with the
    smallest of its vectors. Repeated rows are candidates of their own. With
    fewer than k candidates all are returned. Without usable rows the result
    is empty.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    width = common_width(vectors, vec_col)
    good = lambda df: df.where(F.col(id_col).isNotNull() & usable(F.col(vec_col)) & (F.size(vec_col) == width)).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"))
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not width:
        return spark.createDataFrame([], schema)
    tree, index, n = build(good(vectors), scratch, width)
    visits = calibrate(index, tree, width, k, recall, n)
    sizes = {r["leaf"]: r["n"] for r in index.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}   # rows: leaves

    asked = good(queries).groupBy("id").agg(F.min("vec").alias("vec"))
    own = index.select("id").join(asked.select("id"), "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    asked = asked.join(own, "id", "left").select("id", "vec", F.coalesce("own", F.lit(0)).alias("own"))

    def walk(batches):
        import pyarrow as pa

        for b in batches:
            q, own_ = matrix(b.column(1), width), b.column(2).to_numpy()
            row, leaf, block = [], [], []
            for i in range(len(q)):
                enough, seen = 4 * k + int(own_[i]), 0
                for v, node in enumerate(tree.visit(q[i])):
                    if v >= visits and seen >= enough:
                        break
                    size = sizes.get(node, 0)
                    seen += size
                    for s in range(-(-size // BLOCK_ROWS)):
                        row.append(i)
                        leaf.append(node)
                        block.append(s)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), pa.array(block, pa.int32()),
                                              b.column(0).take(at), b.column(1).take(at)], names=["leaf", "block", "id", "vec"])

    kind = dict(index.dtypes)["vec"]
    asked = asked.mapInArrow(walk, f"leaf int, block int, id bigint, vec {kind}")
    big = [(leaf, -(-n_ // BLOCK_ROWS)) for leaf, n_ in sizes.items() if n_ > BLOCK_ROWS]
    if big:
        blocks = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in big for v in pair]), F.col("leaf")), F.lit(1))
    else:
        blocks = F.lit(1)
    held = index.withColumn("block", F.pmod(F.xxhash64("id", "vec"), blocks).cast("int"))

    def meet(key, x, q):
        import pyarrow as pa

        r, c, d = [], [], []
        if len(x) and len(q):
            r, c, d = nearest(matrix(q.column("vec").combine_chunks(), width), q.column("id").to_numpy(),
                              matrix(x.column("vec").combine_chunks(), width), x.column("id").to_numpy(), k)
        return pa.table({"query_id": q.column("id").take(pa.array(r, pa.int64())),
                         "vec_id": x.column("id").take(pa.array(c, pa.int64())), "score": pa.array(d, pa.float64())})

    keys = ["leaf", "block"]
    found = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(meet, "query_id bigint, vec_id bigint, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame) -> DataFrame:
    """The contract's search: queries are the rows whose vec_id is divisible by 100."""
    return search(embeddings, embeddings.where("vec_id % 100 = 0"))
