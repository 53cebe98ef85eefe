import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from cartograph.operators.numbering import row_number_by


def test_matches_window_row_number_with_a_hot_key(spark):
    rng = random.Random(3)
    rows = [(0, i, rng.random()) for i in range(3000)]  # hot key across many partitions
    rows += [(k, i, rng.random()) for k in range(1, 60) for i in range(rng.randint(1, 20))]
    df = spark.createDataFrame(rows, "run_id long, query_id long, v double")
    got = {(r.run_id, r.query_id): r.row_no for r in row_number_by(df, "run_id", ["query_id"], num_partitions=16).collect()}
    w = Window.partitionBy("run_id").orderBy("query_id")
    want = {(r.run_id, r.query_id): r.rn for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    assert got == want
