"""The daily crawl as a stream: micro-batches of records appended where their key is new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from adlattice.operators import ingest

SCHEMA = "id bigint, batch_no int, external_id string, source string, raw_data string, crawled_at timestamp_ntz, processed_at timestamp_ntz"


def read_records(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def first_seen(records: DataFrame, delay: str = "3 days") -> DataFrame:
    """The first record of each (source, external_id); state is dropped behind the watermark."""
    known = records.withColumn("external_id", ingest.external_id(F.col("external_id"), F.col("raw_data")))
    at = known.withColumn("seen_at", F.col("crawled_at").cast("timestamp")).withWatermark("seen_at", delay)
    return at.dropDuplicatesWithinWatermark(["source", "external_id"])


def crawl_counts(records: DataFrame, delay: str = "3 days", window: str = "1 day") -> DataFrame:
    """Records per board and day of crawl; late ones count until the watermark passes."""
    at = records.withColumn("seen_at", F.col("crawled_at").cast("timestamp")).withWatermark("seen_at", delay)
    return at.groupBy(F.window("seen_at", window), "source").agg(F.count(F.lit(1)).alias("n"))


def append_new(records: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch appends the records whose key is not stored yet (poll, anti-join, append), then stops.

    The store is partitioned by board, and a batch reads only the keys of its own boards.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        keys = ["source", "external_id"]
        known = batch.withColumn("external_id", ingest.external_id(F.col("external_id"), F.col("raw_data")))
        try:
            boards = [r[0] for r in batch.select("source").distinct().collect()]  # the few boards of the batch
            here = F.col("source").isin([b for b in boards if b is not None])
            stored = spark.read.schema(batch.schema).parquet(store).filter(here | F.col("source").isNull() if None in boards else here).select(*keys)
        except Exception as error:  # the store does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(error):
                raise
            stored = known.select(*keys).limit(0)
        # a record without any number has no key to compare, so it is always new
        fresh = ingest.insert_ignore(stored, known.filter("external_id IS NOT NULL"), keys, "id").unionByName(known.filter("external_id IS NULL"))
        fresh.write.mode("append").partitionBy("source").parquet(store)

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
