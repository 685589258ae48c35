import os

from pyspark.sql import functions as F

from attrition.operators import encode, models
from attrition.session import scratch_table_path
from attrition.streaming.scoring import run_to_table, score_stream


def test_stream_scores_equal_batch(spark):
    src = "/root/testdata/sf0.001/customer.parquet"
    batch = spark.read.parquet(src).withColumn("label", (F.col("c_acctbal") > 4000).cast("int"))
    scaler = encode.fit_minmax(batch, ["c_acctbal"])
    model = models.pipeline(["c_acctbal"], models.logistic(10.0, batch.count(), 50)).fit(scaler.transform(batch))
    stream = (spark.readStream.schema(spark.read.parquet(src).schema)
              .option("pathGlobFilter", "customer.parquet").parquet(os.path.dirname(src)))
    q = run_to_table(score_stream(stream, model, "c_custkey", 0.5, prep=scaler), "scored_customers",
                     scratch_table_path(spark, "stream-ckpt"))
    q.processAllAvailable()
    q.stop()
    got = {r["c_custkey"]: r["pred"] for r in spark.table("scored_customers").collect()}
    want = {r["c_custkey"]: r["pred"] for r in
            score_stream(batch, model, "c_custkey", 0.5, prep=scaler).collect()}
    assert got == want and len(got) == 150
