"""Readers: parquet tables of a data folder, JSON feeds, CSV batches, text files and JDBC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlattice.sources.ship import ship

POSTING_SCHEMA = T.StructType(
    [T.StructField("internal_id", T.LongType(), False)]
    + [T.StructField(n, T.StringType()) for n in ("id", "name", "description")]
    + [T.StructField("company_id", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("company_name", "location", "work_type", "salary_description", "date_posted", "date_scraped", "source")]
    + [T.StructField("source_id", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("other", "remark", "job_class", "job_subclass")]
    + [T.StructField(n, T.IntegerType()) for n in ("job_class_id", "job_subclass_id")]
)
FEED_SCHEMA = "id string, name string, company string, location string, salary string, description string, date_posted string, job_class string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder; column pruning and pushdown are left to Catalyst."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of a relational store. Pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions`` so that a large table is read in parallel; credentials come from the caller."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def feed_columns(raw: Column) -> dict[str, Column]:
    """Fields of one JSON record. ``company`` may be text or an object with a name; broken JSON gives NULLs."""
    item = F.from_json(raw, FEED_SCHEMA, {"mode": "PERMISSIVE"})
    whole = F.get_json_object(raw, "$").isNotNull()
    told = F.get_json_object(raw, "$.company")
    company = F.when(told.startswith("{"), F.get_json_object(told, "$.name")).otherwise(told)
    fields = {n: item[n] for n in ("id", "name", "location", "salary", "description", "date_posted", "job_class")}
    return {n: F.when(whole, c) for n, c in (fields | {"company": company}).items()}


def json_feed(spark: SparkSession, path: str) -> DataFrame:
    """A crawl result stored as one JSON array per file, as feed columns."""
    lines = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    packed = lines.select(F.to_json(F.struct(*lines.columns)).alias("raw"))
    return packed.select(*[c.alias(n) for n, c in feed_columns(F.col("raw")).items()])


def csv_postings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV batch with header and quoted fields, read with the fixed posting schema (no inference)."""
    return spark.read.csv(path, header=True, schema=POSTING_SCHEMA, escape="\\", multiLine=True)


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """Each file as one row ``(value)``; a missing path raises as Spark does."""
    return spark.read.text(path, wholetext=True)


def health(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """One row: ``ok``, or ``error`` with the kind of failure if a table of the folder cannot be read; no credentials, no
    paths. ``checked_at`` is the time of the query."""
    status, message = "ok", None
    try:
        if folder is not None:
            _ = spark.read.parquet(f"{folder}/jobs.parquet").schema
    except Exception as error:  # whatever keeps the table from being read is the answer
        status, message = "error", type(error).__name__
    row = spark.range(1).select(F.lit(status).alias("status"), F.lit(status == "ok").alias("connected"), F.lit(message).cast("string").alias("message"), F.lit(spark.version).alias("engine"))
    return row.withColumn("checked_at", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
