"""Merkle dataset manifest with incremental witnesses.

Every document is a leaf. The leaves of a language, ascending by doc_id, form
one tree; the roots of the trees, ordered by language, form the tree on top.

A tree grows by appending. ``Appender`` takes nodes from left to right and
keeps the open subtrees, one per height, as a binary counter does. When a
subtree's sibling completes, the two merge and the witness of every node below
is extended by the other side's digest; until then its witness is partial.

Appending is spread over tasks in aligned blocks of ``2 ** HEIGHT`` consecutive
nodes: a block is appended in one task and leaves with a root and witnesses
that reach up to it. The block roots of a tree are then appended in the same
way, and so on until one block holds all; a node's witness is continued by its
block's. A tree of any size is therefore dealt to groups of fixed size, and
the one driver loop runs once per factor ``2 ** HEIGHT``.

Positions come from one range sort and the row counts of its partitions, never
from a window over a language.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartograph.llm.common import Scratch

HEIGHT = 12
TAMPER = 7
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _h(data: bytes) -> bytes:
    return sha256(data).hexdigest().encode()


def levels(n: int) -> int:
    """Levels between ``n`` nodes and the single node above them."""
    return max(n - 1, 0).bit_length()


class Appender:
    """Nodes appended left to right; witnesses grow as sibling subtrees complete.

    Digests are hexadecimal bytes. ``witness[k][i]`` is node i's sibling at
    height k (empty if it has none there).
    """

    def __init__(self):
        self.open: list[tuple[int, int, int, bytes]] = []      # height, first node, end, digest
        self.witness: list[list[bytes]] = []
        self.n = 0

    def _extend(self, height: int, first: int, end: int, digest: bytes) -> None:
        while len(self.witness) <= height:
            self.witness.append([])
        at = self.witness[height]
        at.extend([b""] * (first - len(at)))
        at[first:end] = [digest] * (end - first)

    def _add(self, height: int, first: int, end: int, digest: bytes) -> None:
        while self.open and self.open[-1][0] == height:
            _, left, mid, other = self.open.pop()
            self._extend(height, left, mid, digest)
            self._extend(height, first, end, other)
            height, first, digest = height + 1, left, _h(other + digest)
        self.open.append((height, first, end, digest))

    def append(self, node: bytes) -> None:
        self._add(0, self.n, self.n + 1, node)
        self.n += 1

    def finish(self, height: int) -> tuple[bytes, list[bytes]]:
        """(root at ``height``, witness of every node, siblings joined from below). Runs of one are hashed alone."""
        while self.open[-1][0] < height:
            k, first, end, digest = self.open.pop()
            self._add(k + 1, first, end, _h(digest))
        for at in self.witness:
            at.extend([b""] * (self.n - len(at)))
        return self.open[-1][3], [b"".join(w) for w in zip(*self.witness)] if self.witness else [b""] * self.n


def fold(node: bytes, witness: bytes, pos: int, n: int) -> tuple[bytes, bytes]:
    """(root, rest of the witness): the node at ``pos`` of ``n`` folded with its siblings."""
    k = 0
    while n > 1:
        if pos ^ 1 < n:
            other = witness[k:k + 64]
            node = _h(other + node if pos & 1 else node + other)
            k += 64
        else:
            node = _h(node)
        pos, n = pos >> 1, (n + 1) >> 1
    return node, witness[k:]


def numbered(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with ``pos`` (from 0) and ``n`` (rows) within their ``tree``, in ascending order, nulls first."""
    by = ["tree", *order]
    placed = scratch.write(
        rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("m", F.monotonically_increasing_id()), name)
    part = F.shiftright("m", 33)
    # one row per partition and tree
    counts = placed.groupBy("tree", part.alias("part")).agg(F.min("m").alias("low"), F.count(F.lit(1)).alias("k"))
    from pyspark.sql import Window

    w = Window.partitionBy("tree")
    before = counts.select("tree", "part", "low", F.sum("k").over(w).alias("n"),
                           (F.sum("k").over(w.orderBy("part")) - F.col("k")).alias("before"))
    return (placed.withColumn("part", part).join(before, ["tree", "part"])
            .withColumn("pos", F.col("before") + F.col("m") - F.col("low")).drop("part", "m", "low", "before"))


def append_blocks(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``nodes`` (with tree, pos, n and node) plus ``witness`` up to their block's root, and that root, ``top``."""
    names = nodes.columns

    def run(block):
        import pyarrow as pa
        import pyarrow.compute as pc

        block = block.take(pc.sort_indices(block.column("pos")))
        a = Appender()
        for node in block.column("node").to_pylist():
            a.append(node.encode())
        top, witness = a.finish(min(height, levels(block.column("n")[0].as_py())))
        return (block.select(names).append_column("witness", pa.array([w.decode() for w in witness], pa.string()))
                .append_column("top", pa.array([top.decode()] * len(block), pa.string())))

    schema = T.StructType([*nodes.schema.fields, T.StructField("witness", T.StringType()), T.StructField("top", T.StringType())])
    size = 1 << height
    return (nodes.withColumn("block", F.floor(F.col("pos") / size)).groupBy("tree", "block")
            .applyInArrow(lambda t: run(t), schema))


def with_witnesses(nodes: DataFrame, scratch: Scratch, name: str, height: int = HEIGHT) -> DataFrame:
    """``nodes`` plus ``witness`` up to the root of their tree, and that root, ``top``."""
    size = 1 << height
    low = scratch.write(append_blocks(nodes, height), f"{name}-blocks")
    if (nodes.agg(F.max("n")).first()[0] or 0) <= size:
        return low
    # the blocks' roots are appended as the nodes of a smaller tree
    block = F.floor(F.col("pos") / size)
    roots = low.where(F.col("pos") % size == 0).select(
        "tree", block.alias("pos"), F.ceil(F.col("n") / size).alias("n"), F.col("top").alias("node"))
    above = with_witnesses(roots, scratch, f"{name}-up", height).select(
        "tree", F.col("pos").alias("block"), F.col("witness").alias("more"), F.col("top").alias("tree_top"))
    return (low.withColumn("block", block).join(above, ["tree", "block"])
            .select(*nodes.columns, F.concat("witness", "more").alias("witness"), F.col("tree_top").alias("top")))


def leaf(n_chars: Column) -> Column:
    """A document's leaf, with ``n_chars`` as given."""
    def field(name: str) -> Column:
        value = (n_chars if name == "n_chars" else F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[field(c) for c in FIELDS]), 256)


def manifest(docs: DataFrame, tampered: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, probe, tree position and size, witness, subroot, and the same above.

    ``probe`` is the leaf to be verified: that of the document with n_chars + 1
    where ``tampered`` holds, else the leaf itself. ``witness`` joins the
    siblings from the leaf to the subroot, ``witness2`` from there to the root.

    Null languages form a tree of their own, the first one; null ids come
    first; rows of one id are ordered by their leaf; equal rows are leaves of
    their own, in any order. Null fields, texts included, count as ``-`` and
    empty ones as ``0:``. Columns besides the five fields are not read. An
    empty table gives no rows. n_chars of the largest whole number becomes
    null when tampered with.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    original = leaf(F.col("n_chars"))
    probe = original if tampered is None else F.when(tampered, leaf(F.expr("try_add(n_chars, 1)"))).otherwise(original)
    tree = F.when(F.col("lang").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("lang").cast("string")))
    leaves = scratch.write(docs.select(
        tree.alias("tree"), F.col("doc_id"), original.alias("node"), probe.alias("probe"),
        F.monotonically_increasing_id().alias("row")), "leaves")     # equal rows still spread over the range sort
    placed = numbered(leaves, ["doc_id", "node", "row"], scratch, "placed").drop("row")
    low = scratch.write(with_witnesses(placed, scratch, "leaf", height), "low")
    subroots = low.where("pos = 0").select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("top").alias("node"))
    tops = with_witnesses(numbered(subroots, ["of"], scratch, "subroots"), scratch, "top", height).select(
        F.col("of").alias("tree"), F.col("pos").alias("pos2"), F.col("n").alias("n2"),
        F.col("witness").alias("witness2"), F.col("top").alias("root"))
    return low.join(tops, "tree").select(
        "doc_id", F.col("node").alias("leaf"), "probe", "pos", "n", "witness", F.col("top").alias("subroot"),
        "pos2", "n2", "witness2", "root")


def folded(rows: DataFrame) -> DataFrame:
    """``rows`` of a manifest plus ``folded_root``: the probe folded with all its siblings, in tasks."""
    names = rows.columns

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cols = [b.column(names.index(c)).to_pylist() for c in ("probe", "witness", "pos", "n", "witness2", "pos2", "n2")]
            out = []
            for probe, w, pos, n, w2, pos2, n2 in zip(*cols):
                sub, _ = fold(probe.encode(), w.encode(), pos, n)
                out.append(fold(sub, w2.encode(), pos2, n2)[0].decode())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*names, "folded_root"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("folded_root", T.StringType())]))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns; a null id is not tampered with."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0, F.lit(False))
    return folded(manifest(docs, tampered)).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.concat("witness", "witness2"), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _crc32_sql(text: str) -> str:
    """DuckDB: unsigned CRC-32 of an ASCII text, four bits at a time."""
    table = []
    for k in range(16):
        for _ in range(4):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    half = lambda c, x: f"xor({c} >> 4, {table}[(xor({c}, {x}) & 15) + 1])"
    code = "list_transform(range(1, length({t}) + 1), lambda i: ord(substr({t}, i, 1))::BIGINT)".replace("{t}", text)
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {code}), lambda c, b: {half('(' + half('c', 'b') + ')', '(b >> 4)')}), 4294967295)"


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def _tree_sql(source: str, name: str) -> str:
    """Levels of the trees in ``source`` (tree, pos, n, node), from the leaves up."""
    return f"""{name} AS (SELECT 0 AS lvl, tree, pos, n, node FROM {source}
  UNION ALL SELECT lvl + 1, tree, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos))
            FROM {name} WHERE n > 1 GROUP BY lvl, tree, pos // 2, n)"""


_ORACLE_LEAF = "sha256({})".format(" || ".join(_field_sql(c) for c in FIELDS))
_ORACLE_PROBE = "sha256({})".format(" || ".join(_field_sql("n_chars + 1" if c == "n_chars" else c) for c in FIELDS))

ORACLE = f"""
WITH RECURSIVE docs AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS tree, {_ORACLE_LEAF} AS node,
    CASE WHEN doc_id IS NOT NULL AND {_crc32_sql('doc_id::VARCHAR')} % {TAMPER} = 0 THEN {_ORACLE_PROBE} ELSE {_ORACLE_LEAF} END AS probe
  FROM documents),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS pos,
    count(*) OVER (PARTITION BY tree) AS n FROM docs),
{_tree_sql('leaves', 'low')},
subroots AS MATERIALIZED (SELECT '' AS tree, tree AS of_tree, node, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos,
    count(*) OVER () AS n FROM low WHERE n = 1),
{_tree_sql('subroots', 'high')},
folding AS (SELECT doc_id, tree, pos AS leaf_pos, false AS above, 0 AS lvl, pos, n, probe AS node, '' AS proof FROM leaves
  UNION ALL
  SELECT f.doc_id, f.tree, f.leaf_pos, f.above OR f.n = 1,
         CASE WHEN f.n = 1 THEN 0 ELSE f.lvl + 1 END, CASE WHEN f.n = 1 THEN s.pos ELSE f.pos // 2 END,
         CASE WHEN f.n = 1 THEN s.n ELSE (f.n + 1) // 2 END,
         CASE WHEN f.n = 1 THEN f.node WHEN x.node IS NULL THEN sha256(f.node)
              WHEN f.pos % 2 = 0 THEN sha256(f.node || x.node) ELSE sha256(x.node || f.node) END,
         f.proof || CASE WHEN f.n = 1 THEN '' ELSE coalesce(x.node, '') END
  FROM folding f JOIN subroots s ON s.of_tree = f.tree
  LEFT JOIN (SELECT false AS above, * FROM low UNION ALL SELECT true, * FROM high) x
    ON f.n > 1 AND x.above = f.above AND x.tree = CASE WHEN f.above THEN '' ELSE f.tree END
       AND x.lvl = f.lvl AND x.pos = xor(f.pos, 1) AND x.n > 1
  WHERE NOT (f.above AND f.n = 1))
SELECT l.doc_id, l.node AS leaf, s.node AS subroot, r.node AS root, sha256(f.proof) AS proof_sha256,
       f.node AS folded_root, f.node = r.node AS verified
FROM folding f JOIN leaves l ON l.tree = f.tree AND l.pos = f.leaf_pos JOIN subroots s ON s.of_tree = f.tree
CROSS JOIN (SELECT node FROM high WHERE n = 1) r WHERE f.above AND f.n = 1
"""
