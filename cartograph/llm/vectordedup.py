"""Embedding near-dedup by NN-descent.

Vectors of one label are linked when their cosine reaches ``COSINE``. Equal
vectors are collapsed to one node first. Then

1. Start: random hyperplane cells. Each of several trees cuts a label's
   centred vectors by as many hyperplanes as leave about ``CELL`` of them in a
   cell; the number of trees is set so that a pair at the threshold shares a
   cell in some tree with probability ``START``. Nearest members of its cells
   start a node's neighbour list.
2. Descent: neighbours of a common node are compared with one another (forward
   and reverse neighbours, a sample of fresh and of old ones per round), and
   better ones enter the lists; fresh ones that were not drawn stay fresh. A
   node whose whole list is above the threshold is saturated: its list is made
   ``DENSE`` long, and if that is saturated too, the node is dense.
3. The rounds end when one finds no new link and no list can be made longer;
   then recall is audited: a bounded set of nodes is compared with all nodes
   of its label. Below ``RECALL`` the search goes on with fresh trees; after
   ``ROUNDS`` rounds every node is taken as dense.
4. Links of dense nodes are counted exactly, block against block: vectors go to
   the leaders within reach (triangle inequality of angles), and a task returns
   sums per vector and a spanning forest instead of pairs.
5. Other pairs above the threshold stay; links count copies; components of the
   links and the forest are found by star contraction.

No step lists all pairs of a group: a cell above ``BLOCK`` is cut into blocks,
every two blocks are compared in a task of their own, and only nearest members
come out; local joins see at most ``4 * SIDE`` members per node and round.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartograph.llm.common import Scratch, components
from cartograph.llm.vectors import by_group, common_width, matrix, runs, usable

COSINE = 0.98
LIST = 10            # neighbours per node at the start
CELL = 96
BLOCK = 4096         # vectors compared in one task with as many others
ROWS = 512           # rows of a block's similarities held at once
START = 0.999
DENSE = 80           # a longer list is not kept: the node's links are counted exactly
LEADERS = 1024
SIDE = 20            # fresh and old members per direction in a local join
AUDIT = 300
RECALL = 0.995
ROUNDS = 14
MAX_PLANES = 32
EDGE = "a bigint, b bigint, sim double"


def _unit(x):
    import numpy as np

    return x / np.sqrt((x ** 2).sum(axis=1))[:, None]


def label_centres(nodes: DataFrame, width: int) -> DataFrame:
    """(label, n, centre): mean unit vector per label, summed in tasks first."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        total: dict[int, list] = {}
        for b in batches:
            label, x = b.column(0).to_numpy(), _unit(matrix(b.column(1), width))
            for one in np.unique(label):
                at = label == one
                n, s = total.get(int(one), (0, 0.0))
                total[int(one)] = (n + int(at.sum()), s + x[at].sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int64()), pa.array([n for n, _ in total.values()], pa.int64()),
             pa.array([s.tolist() for _, s in total.values()], pa.list_(pa.float64()))], names=["label", "n", "s"])

    parts = nodes.select("label", "vec").mapInArrow(run, "label bigint, n bigint, s array<double>")
    sums = parts.groupBy("label").agg(F.sum("n").alias("n"), F.collect_list("s").alias("s"))    # one row per task
    zero = F.array_repeat(F.lit(0.0), width)
    return sums.select("label", "n", F.transform(
        F.aggregate("s", zero, lambda acc, x: F.zip_with(acc, x, lambda u, v: u + v)),
        lambda v: v / F.col("n")).alias("centre"))


def planes_for(n):
    """Hyperplanes that leave about CELL of n vectors in a cell."""
    return F.least(F.lit(MAX_PLANES), F.greatest(F.lit(0), F.ceil(F.log2(n / F.lit(float(CELL)))))).cast("int")


def cell_candidates(nodes: DataFrame, centres: DataFrame, width: int, cosine: float, k: int, seed: int,
                    block: int = BLOCK) -> DataFrame:
    """(a, b, sim): for every node its k nearest members of each of its cells (of each block of a cell above ``block``)."""
    agree = 1 - math.acos(cosine) / math.pi
    plan = centres.withColumn("planes", planes_for(F.col("n"))).withColumn(
        "trees", F.when(F.col("planes") == 0, 1).otherwise(
            F.ceil(F.lit(math.log(1 - START)) / F.log(1 - F.pow(F.lit(agree), F.col("planes"))))).cast("int"))
    rows = nodes.join(plan, "label").select("label", "id", "vec", "centre", "planes", "trees")

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        normals: dict[int, object] = {}
        for b in batches:
            label, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            x = _unit(matrix(b.column(2), width)) - matrix(b.column(3), width)
            planes, trees = b.column(4).to_numpy(), b.column(5).to_numpy()
            row, tree, code = [], [], []
            for t in range(int(trees.max()) if len(trees) else 0):
                if t not in normals:
                    normals[t] = np.random.default_rng([seed, t]).normal(size=(width, MAX_PLANES))
                at = np.flatnonzero(trees > t)
                bits = (x[at] @ normals[t] > 0) & (np.arange(MAX_PLANES)[None, :] < planes[at][:, None])
                row.append(at)
                tree.append(np.full(len(at), t, np.int32))
                code.append((bits.astype(np.int64) << np.arange(MAX_PLANES)).sum(axis=1))
            if row:
                row, tree, code = np.concatenate(row), np.concatenate(tree), np.concatenate(code)
                yield pa.RecordBatch.from_arrays([pa.array(label[row]), pa.array(tree), pa.array(code), pa.array(ids[row]),
                                                  b.column(2).take(pa.array(row))], names=["label", "tree", "code", "id", "vec"])

    kind = dict(nodes.dtypes)["vec"]
    cells = rows.mapInArrow(cut, f"label bigint, tree int, code bigint, id bigint, vec {kind}")
    key = ["label", "tree", "code"]
    sizes = cells.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > block).select(
        *key, F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    # a member of block s goes to every pair of blocks that holds s
    own = F.pmod(F.xxhash64("id", "tree", F.lit(seed)), F.col("blocks")).cast("int")
    split = (cells.join(sizes, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own)
             .select(*key, "id", "vec", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
             .select(*key, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "vec"))

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        def nearest(ids, x, others, y, same):
            """The k nearest of ``others`` for each of ``ids``."""
            take = min(k, len(others) - same)
            for at in range(0, len(ids) if take > 0 else 0, ROWS):
                sim = x[at:at + ROWS] @ y.T
                if same:
                    sim[np.arange(len(sim)), at + np.arange(len(sim))] = -2
                top = np.argpartition(-sim, take - 1, axis=1)[:, :take]
                yield np.repeat(ids[at:at + ROWS], take), others[top.ravel()], np.take_along_axis(sim, top, axis=1).ravel()

        for b in by_group(batches, 5):
            at = runs(*(b.column(i).to_numpy() for i in range(5)))
            lo_, hi_, own_, ids = (b.column(i).to_numpy() for i in (3, 4, 5, 6))
            x = _unit(matrix(b.column(7), width))
            found = []
            for lo, hi in zip(at[:-1], at[1:]):
                one, x1 = ids[lo:hi], x[lo:hi]
                if lo_[lo] == hi_[lo]:
                    found += nearest(one, x1, one, x1, True)
                else:
                    left = own_[lo:hi] == lo_[lo]
                    found += nearest(one[left], x1[left], one[~left], x1[~left], False)
                    found += nearest(one[~left], x1[~left], one[left], x1[left], False)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*found)], names=["a", "b", "sim"])

    pair = [*key, "lo", "hi"]
    return split.repartition(*pair).sortWithinPartitions(*pair).mapInArrow(compare, EDGE)


def merge(offers: DataFrame, lists: DataFrame | None, nodes: DataFrame, waiting: DataFrame | None = None) -> DataFrame:
    """Best neighbours per node, as many as its list holds; ``fresh`` marks those the lists did not have and those in ``waiting``."""
    new = offers.select("a", "b", "sim", F.lit(1).alias("fresh"))
    both = new
    if lists is not None:
        old = lists.select("a", "b", "sim").join(waiting.withColumn("w", F.lit(1)), ["a", "b"], "left")
        both = old.select("a", "b", "sim", F.coalesce("w", F.lit(0)).alias("fresh")).unionByName(new)
    once = both.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    ranked = once.join(nodes.select(F.col("id").alias("a"), "k"), "a").withColumn(
        "rank", F.row_number().over(W.partitionBy("a").orderBy(F.desc("sim"), "b")))
    return ranked.where(F.col("rank") <= F.col("k")).select("a", "b", "sim", "fresh")


def draws(lists: DataFrame, round_no: int) -> DataFrame:
    """(hub, m, fresh, draw): members of every hub that has a fresh one, numbered at random among the fresh and the old."""
    edges = lists.select(F.col("a").alias("hub"), F.col("b").alias("m"), "fresh").unionByName(
        lists.select(F.col("b").alias("hub"), F.col("a").alias("m"), "fresh"))
    edges = edges.groupBy("hub", "m").agg(F.max("fresh").alias("fresh"))
    # hubs without a fresh member have nothing new to compare
    edges = edges.withColumn("live", F.max("fresh").over(W.partitionBy("hub"))).where("live = 1")
    draw = F.row_number().over(W.partitionBy("hub", "fresh").orderBy(F.xxhash64("hub", "m", F.lit(round_no))))
    return edges.select("hub", "m", "fresh", draw.alias("draw"))


def undrawn(drawn: DataFrame) -> DataFrame:
    """(a, b): both directions of fresh pairs that a local join left out."""
    left = drawn.where(f"fresh = 1 and draw > {2 * SIDE}")
    return left.select(F.col("hub").alias("a"), F.col("m").alias("b")).union(
        left.select(F.col("m").alias("a"), F.col("hub").alias("b"))).distinct()


def local_join(lists: DataFrame, drawn: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(a, b, sim): pairs of drawn neighbours of a common node that would improve a list; both directions."""
    edges = drawn.where(F.col("draw") <= 2 * SIDE).select("hub", "m", "fresh")
    floor = lists.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("low"))
    known = (nodes.join(floor, nodes["id"] == floor["a"], "left")
             .select(F.col("id").alias("m"), "vec", F.when(F.col("n") >= F.col("k"), F.col("low")).otherwise(F.lit(-2.0)).alias("floor")))
    members = edges.join(known, "m").select("hub", "m", "fresh", "floor", "vec")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in by_group(batches, 1):
            at = runs(b.column(0).to_numpy())
            ids, fresh, floor_ = (b.column(i).to_numpy() for i in (1, 2, 3))
            x = _unit(matrix(b.column(4), width))
            a, c, s = [], [], []
            for lo, hi in zip(at[:-1], at[1:]):
                if hi - lo < 2 or not fresh[lo:hi].any():
                    continue
                sim = x[lo:hi] @ x[lo:hi].T
                new = fresh[lo:hi].astype(bool)
                ok = (sim > floor_[lo:hi][:, None]) & (new[:, None] | new[None, :])
                np.fill_diagonal(ok, False)
                i, j = np.nonzero(ok)
                a.append(ids[lo + i])
                c.append(ids[lo + j])
                s.append(sim[i, j])
            if a:
                pair = np.zeros(sum(map(len, a)), [("a", np.int64), ("b", np.int64)])
                pair["a"], pair["b"] = np.concatenate(a), np.concatenate(c)
                _, first = np.unique(pair, return_index=True)        # hubs of one task often offer the same pair
                yield pa.RecordBatch.from_arrays([pa.array(pair["a"][first]), pa.array(pair["b"][first]),
                                                  pa.array(np.concatenate(s)[first])], names=["a", "b", "sim"])

    return members.repartition("hub").sortWithinPartitions("hub").mapInArrow(run, EDGE)


def audit(nodes: DataFrame, links: DataFrame, width: int, cosine: float, sample: int = AUDIT) -> float:
    """Share of true links of a bounded set of nodes that were found."""
    import numpy as np

    h = F.xxhash64("id", F.lit("audit"))
    chosen = nodes.select("id", "label", "vec").orderBy(h, "id").limit(sample).toArrow()
    if not chosen.num_rows:
        return 1.0
    q, q_ids, q_label = _unit(matrix(chosen.column("vec").combine_chunks(), width)), chosen.column("id").to_numpy(), chosen.column("label").to_numpy()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, label = b.column(0).to_numpy(), b.column(1).to_numpy()
            sim = q @ _unit(matrix(b.column(2), width)).T
            i, j = np.nonzero((sim >= cosine) & (q_label[:, None] == label[None, :]) & (q_ids[:, None] != ids[None, :]))
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(ids[j])], names=["a", "b"])

    true = nodes.select("id", "label", "vec").mapInArrow(run, "a bigint, b bigint")
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    total, found = true.join(both.withColumn("hit", F.lit(1)), ["a", "b"], "left").agg(
        F.count(F.lit(1)), F.count("hit")).first()
    return found / total if total else 1.0


def neighbour_graph(nodes: DataFrame, width: int, scratch: Scratch, cosine: float = COSINE,
                    k: int = LIST) -> tuple[DataFrame, DataFrame, float]:
    """Links found (a < b, sim), dense nodes (id), and the audited recall among the others. ``nodes``: id, label, vec.

    Links of dense nodes are not whole and must be counted by ``dense_links``.
    If the audit is still below ``RECALL`` after ``ROUNDS`` rounds, all nodes are dense.
    """
    centres = scratch.write(label_centres(nodes, width), "centres")
    sized = scratch.write(nodes.select("id", F.lit(k).cast("bigint").alias("k")), "sizes-0")
    with_k = lambda sizes: nodes.join(sizes, "id")
    state = scratch.write(merge(cell_candidates(nodes, centres, width, cosine, k, 0), None, sized), "lists-0")
    kept, last, r = ["lists-0"], -1, 0
    while True:
        r += 1
        n_links = state.where(F.col("sim") >= cosine).count()
        full = scratch.write(
            state.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("low")).join(
                sized.select(F.col("id").alias("a"), "k"), "a").where((F.col("n") >= F.col("k")) & (F.col("low") >= cosine))
            .select(F.col("a").alias("id"), (F.col("k") < DENSE).alias("grows")), f"full-{r}")
        fresh_trees = None
        if not full.where("grows").count() and n_links - last <= 0.00001 * n_links or r > ROUNDS:
            dense = full.select("id")
            links = state.where(F.col("sim") >= cosine).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim")
            links = links.groupBy("a", "b").agg(F.max("sim").alias("sim"))
            recall = audit(nodes.join(dense, "id", "left_anti"), links, width, cosine)
            if recall >= RECALL:
                return scratch.write(links, "links"), dense, recall
            if r > ROUNDS:
                return scratch.write(links, "links"), nodes.select("id"), recall
            fresh_trees = cell_candidates(nodes, centres, width, cosine, k, r)
        last = n_links
        drawn = scratch.write(draws(state, r), f"draws-{r}")
        offers = local_join(state, drawn, with_k(sized), width)
        if fresh_trees is not None:
            offers = offers.unionByName(fresh_trees)
        sized = scratch.write(sized.join(full, "id", "left").select(
            "id", F.when(F.col("grows"), F.greatest(F.col("k"), F.lit(DENSE))).otherwise(F.col("k")).alias("k")), f"sizes-{r}")
        state = scratch.write(merge(offers, state, sized, undrawn(drawn)), f"lists-{r}")
        scratch.drop(f"draws-{r}")
        kept.append(f"lists-{r}")
        if len(kept) > 2:
            scratch.drop(kept.pop(0))


def dense_links(nodes: DataFrame, dense: DataFrame, width: int, scratch: Scratch, cosine: float = COSINE,
                block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """All links that have a dense end: (id, others) with the linked rows of either end, and a spanning forest (a, b).

    ``nodes``: id, label, vec, copies. Every dense node has a home leader; a
    leader's group holds all nodes of the label that one of its dense nodes can
    reach. Dense nodes and members of a group are cut into blocks, and every
    two blocks are one task's work.
    """
    import numpy as np

    hot = scratch.write(nodes.select("id", "label", "vec").join(dense, "id", "left_semi"), "dense")
    chosen = hot.orderBy(F.xxhash64("id", F.lit("leader")), "id").limit(min(LEADERS, -(-hot.count() // DENSE))).toArrow()
    lead = _unit(matrix(chosen.column("vec").combine_chunks(), width)) if chosen.num_rows else np.zeros((0, width))
    lead_label = chosen.column("label").to_numpy()

    def to_leaders(label, x):
        return np.where(label[:, None] == lead_label[None, :], np.clip(x @ lead.T, -1, 1), -2)

    def homes_of(batches):
        import pyarrow as pa

        for b in batches:
            label, x = b.column(1).to_numpy(), _unit(matrix(b.column(2), width))
            home, angle = np.full(len(x), -1, np.int32), np.zeros(len(x))
            for at in range(0, len(x), ROWS):
                sim = to_leaders(label[at:at + ROWS], x[at:at + ROWS])
                best = sim.argmax(axis=1)
                top = sim[np.arange(len(sim)), best]
                home[at:at + ROWS] = np.where(top > -2, best, -1)      # a label without a leader has one group
                angle[at:at + ROWS] = np.arccos(np.maximum(top, -1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(home), pa.array(angle)],
                                             names=["id", "label", "home", "angle"])

    homes = scratch.write(hot.mapInArrow(homes_of, "id bigint, label bigint, home int, angle double"), "homes")
    floor = np.full(len(lead), 2.0)                                    # least cosine to the leader of a node within reach
    for row in homes.where("home >= 0").groupBy("home").agg(F.max("angle").alias("r")).collect():    # at most LEADERS
        floor[row["home"]] = np.cos(min(np.pi, row["r"] + np.arccos(cosine) + 1e-6)) - 1e-12

    def groups_of(batches):
        import pyarrow as pa

        for b in batches:
            label, x = b.column(1).to_numpy(), _unit(matrix(b.column(2), width))
            row, leader = [np.flatnonzero(~np.isin(label, lead_label))], []
            leader.append(np.full(len(row[0]), -1))
            for at in range(0, len(x), ROWS):
                i, j = np.nonzero(to_leaders(label[at:at + ROWS], x[at:at + ROWS]) >= floor[None, :])
                row.append(at + i)
                leader.append(j)
            row, leader = np.concatenate(row), np.concatenate(leader).astype(np.int32)
            out = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(leader)], names=[*out.schema.names, "leader"])

    kind = dict(nodes.dtypes)["vec"]
    members = scratch.write(
        nodes.select("id", "label", "vec", "copies").join(homes.select("label").distinct(), "label", "left_semi")
        .join(homes.select("id", "home"), "id", "left").select("id", "label", "vec", "copies", "home")
        .mapInArrow(groups_of, f"id bigint, label bigint, vec {kind}, copies bigint, home int, leader int"), "members")
    at_home = F.coalesce(F.col("home") == F.col("leader"), F.lit(False))
    key = ["label", "leader"]
    sizes = members.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("m"),
                                      F.ceil(F.count_if(at_home) / block).cast("int").alias("h")).where("h > 0")
    h_own, m_own = F.pmod(F.xxhash64("id", F.lit("h")), F.col("h")).cast("int"), F.pmod(F.xxhash64("id"), F.col("m")).cast("int")
    place = lambda h, m, side: F.struct(h.alias("hb"), m.alias("mb"), F.lit(side).alias("side"))
    as_member = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda h: place(h, m_own, 0))
    as_dense = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda m: place(h_own, m, 1))
    placed = (members.join(sizes, key).withColumn("at", F.explode(F.when(at_home, F.concat(as_member, as_dense)).otherwise(as_member)))
              .select(*key, "at.hb", "at.mb", "at.side", "id", "copies", F.col("home").isNotNull().alias("is_dense"), "vec"))

    def count(batches):
        import pyarrow as pa

        for b in by_group(batches, 4):
            at = runs(*(b.column(i).to_numpy() for i in range(4)))
            side_, ids_, copies_ = (b.column(i).to_numpy() for i in (4, 5, 6))
            dense_, x_ = b.column(7).to_numpy(zero_copy_only=False), _unit(matrix(b.column(8), width))
            out = []
            for lo, hi in zip(at[:-1], at[1:]):
                h, m = lo + np.flatnonzero(side_[lo:hi] == 1), lo + np.flatnonzero(side_[lo:hi] == 0)
                of_m, tree = np.zeros(len(m), np.int64), np.full(len(m), -1)      # tree: the forest's tree of each member
                for k in range(0, len(h), ROWS):
                    rows = h[k:k + ROWS]
                    near = (x_[rows] @ x_[m].T >= cosine) & (ids_[rows][:, None] != ids_[m][None, :])
                    of_m += copies_[rows] @ near
                    out.append((ids_[rows], np.full(len(rows), -1), near @ copies_[m]))
                    for i, row in zip(rows, near):
                        cols = np.flatnonzero(row)
                        if len(cols):
                            known, first = np.unique(tree[cols], return_index=True)
                            tie = np.concatenate((cols[first[known >= 0]], cols[tree[cols] < 0]))
                            out.append((np.full(len(tie), ids_[i]), ids_[m[tie]], np.zeros(len(tie), np.int64)))
                            tree[np.isin(tree, known[known >= 0])] = i
                            tree[cols] = i
                other = ~dense_[m] & (of_m > 0)                        # dense members are counted where they are at home
                out.append((ids_[m[other]], np.full(int(other.sum()), -1), of_m[other]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).astype(np.int64)) for v in zip(*out)], names=["a", "b", "n"])

    pair = [*key, "hb", "mb"]
    found = scratch.write(placed.repartition(*pair).sortWithinPartitions(*pair).mapInArrow(count, "a bigint, b bigint, n bigint"), "found")
    counts = found.where("b < 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    return counts, found.where("b >= 0").select("a", "b")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id",
                    vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, n_links, component_id, kept), one row per input row.

    Vectors that are null, zero, not finite or of another length than most,
    rows with a null label and rows with a null id link with nothing: no links,
    their own component, kept. Repeated rows are vectors of their own and link
    with one another. An empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession, "vectordedup")
    width = common_width(vectors, vec_col)
    part = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(F.col(vec_col)) & (F.size(vec_col) == width)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vec_col).alias("vec"),
                          F.coalesce(part, F.lit(False)).alias("part"))
    alone = rows.where("not part").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    if width:
        live = rows.where("part").select("id", "label", "vec")
        classes = scratch.write(
            live.groupBy("label", "vec").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"))
            .withColumn("node", F.monotonically_increasing_id()), "classes")
        links, dense, _ = neighbour_graph(classes.select(F.col("node").alias("id"), "label", "vec"), width, scratch, cosine)
        exact, forest = dense_links(classes.select(F.col("node").alias("id"), "label", "vec", "copies"), dense, width, scratch, cosine)
        for end in ("a", "b"):
            links = links.join(dense.withColumnRenamed("id", end), end, "left_anti")
        links = links.select("a", "b")
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        copies = classes.select(F.col("node").alias("b"), "copies")
        others = (both.join(copies, "b").select(F.col("a").alias("node"), F.col("copies").alias("n"))
                  .unionByName(exact.select(F.col("id").alias("node"), F.col("others").alias("n")))
                  .groupBy("node").agg(F.sum("n").alias("others")))
        tied = components(links.union(forest), scratch).select("node", F.col("component").alias("group"))
        grouped = (classes.select("label", "vec", "node", "low", "copies").join(tied, "node", "left").join(others, "node", "left")
                   .withColumn("group", F.coalesce("group", "node")))
        lowest = grouped.groupBy("group").agg(F.min("low").alias("component_id"))
        per_class = grouped.join(lowest, "group").select(
            "label", "vec", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
        alone = alone.unionByName(live.join(per_class, ["label", "vec"]).select("id", "n_links", "component_id"))
    return alone.select(F.col("id").alias(id_col), "n_links", "component_id",
                        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def digest(embeddings: DataFrame) -> DataFrame:
    """The contract's columns."""
    return near_duplicates(embeddings)
