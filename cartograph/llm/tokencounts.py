"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed changes:
an insert adds a document's tokens, a delete subtracts them, a revised count
does both. A batch of changes is summed by key and written to a folder of its
own, named after the batch id; the folder counts once its success marker is
there. A batch that is sent again is skipped, and one that broke off is
written anew, so retries never count twice. Totals add up committed batches;
nothing is ever recounted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograph.llm.common import Scratch
from cartograph.llm.tokens import MODEL

KEYS = ["source", "lang", "tokenizer"]
ESTIMATE = "bytes_by_4"
DELTA_SCHEMA = "source string, lang string, tokenizer string, docs bigint, tokens bigint"


def with_tokens(docs: DataFrame, ranks: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` (without the text) plus ``tokens``: whole texts, one pass, no shuffle. Null texts have none."""
    kept = [c for c in docs.columns if c != text_col]
    rows = docs.select(*kept, F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        import pyarrow as pa

        from cartograph.llm.tokens import encoder

        bpe = encoder(ranks)
        for b in batches:
            n = [len(bpe.ids(t.as_py())) for t in b.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(kept)], pa.array(n, pa.int64())], names=[*kept, "tokens"])

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([*docs.select(*kept).schema.fields, T.StructField("tokens", T.LongType())]))


def inserts(rows: DataFrame, tokenizer: str, tokens: Column) -> DataFrame:
    """+1 document and +tokens per row."""
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("bigint").alias("docs"),
                       tokens.cast("bigint").alias("tokens"))


def deletes(rows: DataFrame, tokenizer: str, tokens: Column) -> DataFrame:
    """-1 document and -tokens per row."""
    return inserts(rows, tokenizer, tokens).withColumn("docs", -F.col("docs")).withColumn("tokens", -F.col("tokens"))


def revisions(rows: DataFrame, old: tuple[str, Column], new: tuple[str, Column]) -> DataFrame:
    """A changed count (tokenizer, tokens): the old one goes, the new one comes."""
    return deletes(rows, *old).unionByName(inserts(rows, *new))


class Rollup:
    """Additive totals in one folder, a sub-folder per committed batch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        """Ids of committed batches, ascending."""
        fs, root = self._fs(), self._path("")
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
        return sorted(n.removeprefix("batch=") for n in names
                      if n.startswith("batch=") and fs.exists(self._path(f"{n}/_SUCCESS")))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch of signed changes once; False if it had been committed before."""
        if batch_id in self.committed():
            return False
        deltas = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        deltas.write.mode("overwrite").parquet(f"{self.root}/batch={batch_id}")
        return True

    def totals(self) -> DataFrame:
        """One row per key with documents: documents and tokens."""
        done = self.committed()
        if not done:
            return self.spark.createDataFrame([], DELTA_SCHEMA)
        deltas = self.spark.read.schema(DELTA_SCHEMA).parquet(*[f"{self.root}/batch={b}" for b in done])
        return (deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
                .where("docs != 0 or tokens != 0"))


def maintained(docs: DataFrame) -> DataFrame:
    """Totals of the table's documents after three batches, one of them sent twice.

    1. Insert every document under a quick estimate (bytes / 4, rounded down).
    2. Revise every count to the byte-level BPE's.
    3. Delete later copies of a text: one row of each distinct text stays, the
       one with the smallest (doc_id, source, lang), nulls last.

    Null texts count as empty; null sources and languages are keys of their
    own. Repeated rows are copies. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "tokencounts")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", "lang", "text", F.unhex(F.md5(text)).alias("content"),
                       F.floor(F.octet_length(text) / 4).alias("estimate"))
    counted = scratch.write(with_tokens(rows), "counted")
    rollup = Rollup(docs.sparkSession, f"{scratch.root}/rollup")
    old, new = (ESTIMATE, F.col("estimate")), (MODEL, F.col("tokens"))
    rollup.commit("0001-insert", inserts(counted, *old))
    rollup.commit("0002-revise", revisions(counted, old, new))
    rollup.commit("0002-revise", revisions(counted, old, new))
    # a group of copies is summed, not listed: all its rows go and the first comes back
    order = [x for c in ("doc_id", "source", "lang") for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]    # nulls last
    groups = counted.groupBy("content").agg(F.count(F.lit(1)).alias("n"), F.max("tokens").alias("tokens"),
                                            F.min(F.struct(*order)).alias("first"))
    again = groups.where("n > 1").select("first.source", "first.lang", "tokens")
    copies = counted.join(groups.where("n > 1").select("content"), "content", "left_semi")
    rollup.commit("0003-delete-copies", deletes(copies, *new).unionByName(inserts(again, *new)))
    return rollup.totals()
