"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, target / size
of the source. Along the source's documents, ordered by size, the expected
copies are prefix-summed, one random offset per source is added, and a copy is
emitted at each integer boundary crossed. Ordering by size makes the taken
words follow the target closely: neighbours have almost equal sizes, so which
one of them is taken hardly matters.

The order is a global range sort, so one source with a third of all rows lies
in many partitions; prefix sums are local sums plus the totals of the
partitions before. Sums are kept in fixed point, so they do not depend on the
order of addition and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartograph.llm.common import Scratch, n_words

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
SEED = "mix"
ONE = 2**32        # fixed point: one copy


def unit_random(key: Column, seed: str) -> Column:
    """A number in [0, 1) from 32 bits of md5(seed, key); a null key has its own."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from one row per source.

    Weights repeat along the sources in code point order, null last. A target
    stops at ``max_copies`` times its source; what it leaves is reshared among
    the others by weight until none is above. With q = cap / weight ascending,
    the sources that stop are a prefix: those whose q is below the common rate
    (words per unit of weight) that is left for them and all later ones.
    Works on the table of sources only.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.select("source", "source_size", w.alias("w"))
    cap = F.col("source_size") * F.lit(float(max_copies))
    everyone = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    order = W.orderBy("q", F.col("source").isNull(), F.col("source").cast("binary"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    ranked = (s.withColumn("cap", cap).withColumn("q", F.col("cap") / F.col("w"))
              .withColumn("total", F.sum("source_size").over(everyone))
              .withColumn("rate", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                          / F.sum("w").over(after)))
    # the rates rise while sources stop and fall from the first one that does not
    level = F.max("rate").over(everyone)
    return (ranked.withColumn("level", level)
            .select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("w")).alias("target")))


def systematic(rows: DataFrame, expected: Column, group: str, order: list[Column], seed: str, scratch: Scratch) -> DataFrame:
    """Adds ``copies``: integer boundaries that each row's expected copies cross within its group.

    ``expected`` is a number of copies per row, 0 or more. ``order`` fixes the
    order within a group; rows that tie completely are interchangeable.
    """
    work = rows.withColumn("_e", F.round(expected * F.lit(float(ONE))).cast("decimal(38,0)"))
    by = [F.col(group).isNull(), F.col(group), *order]
    sorted_rows = work.repartitionByRange(*by).withColumn("_part", F.spark_partition_id())
    kept = scratch.write(sorted_rows, "ordered")
    per_part = kept.groupBy(group, "_part").agg(F.sum("_e").alias("_sum"))
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    start = per_part.select(F.col(group).alias("_group"), F.col("_part").alias("_p"),
                            F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy(group, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = kept.withColumn("_end", F.sum("_e").over(inside))
    placed = summed.join(start, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_p")))
    offset = unit_random(F.col(group), seed).cast("decimal(38,0)")
    whole = lambda x: F.floor(x / F.lit(ONE).cast("decimal(38,0)")).cast("bigint")
    end = F.col("_start") + F.col("_end") + offset
    return placed.withColumn("copies", whole(end) - whole(end - F.col("_e"))).drop(
        "_e", "_part", "_p", "_group", "_start", "_end")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """(doc_id, source, text_hash, size, source_size, target, copies), one row per input row.

    Size is the number of words; null, empty and blank texts have size 0, and
    take part in the order without adding words. A null source is a source of
    its own. Repeated rows are rows of their own. If no text has a word, every
    target is 0 and nothing is taken. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = scratch.write(docs.select(
        "doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")), "sizes")
    wanted = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_copies)
    rows = sized.join(wanted.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    expected = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    order = [F.col("size"), F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))),
             F.col("doc_id"), F.col("text_hash")]
    return systematic(rows, expected, "source", order, seed, scratch)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def emit(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """The mixed documents: each row as often as its copies, all columns kept."""
    m = mix(docs, weights, max_copies, seed)
    # rows that agree in all three are the same document; their copies are spread over them
    key = ["doc_id", "source", "text_hash"]
    per_key = (m.groupBy(*key).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
               .where("copies > 0").select(F.struct(*key).alias("key"), "copies", "rows"))
    rows = docs.select(F.struct("*").alias("row")).select("row", F.struct(
        F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"),
        F.xxhash64("row.text").alias("text_hash")).alias("key"))
    # a merge join at every size: what it would broadcast grows with the documents
    joined = rows.join(per_key.hint("merge"), "key")
    single = joined.where("rows = 1").select("row", F.col("copies").alias("n"))
    nth = F.row_number().over(W.partitionBy("key").orderBy(F.lit(1)))
    share = lambda k: F.floor(F.col("copies") * k / F.col("rows"))
    several = (joined.where("rows > 1").withColumn("k", nth)
               .select("row", (share(F.col("k")) - share(F.col("k") - 1)).alias("n")))
    return (single.unionByName(several).where("n > 0")
            .withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
            .select(*[F.col("row")[c].alias(c) for c in docs.columns]))
