"""Structured Streaming job: captured pages in, refreshed site maps out.

``readStream`` over the capture folder -> ``foreachBatch``:

1. extract titles/links of the new pages (narrow, JVM-side);
2. union with the stored index rows of the touched sites, keep the lowest
   ``page_id`` per URL;
3. overwrite only the touched sites' partitions of the index and of the
   documents (dynamic partition overwrite).

Exactly-once per batch comes from the streaming checkpoint plus idempotent
partition overwrites: a replayed batch rewrites the same partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograph.operators import sitemap as SM
from cartograph.session import ensure_checkpoint_dir
from cartograph.sources import pages as P

PAGES_SCHEMA = "page_id BIGINT, url STRING, html STRING"
INDEX_COLUMNS = ["url", "page_id", "site", "title_state", "title"]
INDEX_DDL = "url string, page_id bigint, site string, title_state string, title string"
BROADCAST_SITES = 100_000      # touched sites of one batch that may be broadcast (64-byte keys)


def _site_key(c):
    # partition values must be path-safe; the site itself stays a column
    return F.sha2(c, 256)


def _exists(spark: SparkSession, path: str) -> bool:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath)


def _apply_batch(spark: SparkSession, batch: DataFrame, index_path: str, docs_path: str,
                 max_pages: int | None) -> None:
    ensure_checkpoint_dir(spark)
    new = P.page_index(batch).select(*INDEX_COLUMNS).checkpoint(eager=True)
    if _exists(spark, index_path):
        # joined on the partition column, so that the scan is pruned to the touched sites;
        # any failure to read the index fails the batch
        touched = new.select(_site_key("site").alias("site_key")).distinct()
        stored = spark.read.schema(f"{INDEX_DDL}, site_key string").parquet(index_path)
        merged = stored.join(F.broadcast(touched) if touched.count() <= BROADCAST_SITES else touched, "site_key", "left_semi") \
            .select(*INDEX_COLUMNS).unionByName(new)
    else:
        merged = new
    first = merged.groupBy("url").agg(F.min("page_id").alias("page_id"))
    merged = merged.join(first, ["url", "page_id"], "left_semi").dropDuplicates(["url"])
    merged = merged.checkpoint(eager=True)  # cut lineage before overwriting what we read
    (merged.withColumn("site_key", _site_key("site")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("site_key").parquet(index_path))
    docs = SM.render_documents(SM.corpus_ranked(merged, max_pages))
    (docs.withColumn("site_key", _site_key("site")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("site_key").parquet(docs_path))


def start_refresh(spark: SparkSession, capture_dir: str, index_path: str, docs_path: str,
                  checkpoint_path: str, max_pages: int | None = None,
                  glob: str = "*.parquet", available_now: bool = True):
    """Start the refresh query; returns the StreamingQuery."""
    stream = (spark.readStream.schema(PAGES_SCHEMA).option("pathGlobFilter", glob)
              .option("maxFilesPerTrigger", 64).parquet(capture_dir))
    writer = (stream.writeStream.option("checkpointLocation", checkpoint_path)
              .foreachBatch(lambda df, _epoch: _apply_batch(spark, df, index_path, docs_path, max_pages)))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
