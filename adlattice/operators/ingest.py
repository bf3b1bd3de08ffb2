"""New-row detection, keyed updates and run counters as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlattice.operators.worklist import valid_detail


def unseen(new: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not stored; repeats within the batch stay, NULL keys stay."""
    return new.join(stored.select(key).distinct(), key, "left_anti")


def known(new: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    return new.join(stored.select(key).distinct(), key, "left_semi")


def append(stored: DataFrame, new: DataFrame) -> DataFrame:
    return stored.unionByName(new, allowMissingColumns=True)


def first_by_id(df: DataFrame) -> DataFrame:
    """The row an external id addresses: the lowest internal_id. Pre-aggregates, so a hot id does not gather."""
    return df.groupBy("id").agg(F.min("internal_id").alias("internal_id"))


def overlay(stored: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """Replace the given columns where a change for the row's internal_id supplies a value."""
    new = changes.select("internal_id", *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = stored.join(new, "internal_id", "left")
    return out.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in stored.columns])


def update_by_external_id(stored: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """Keyed update by external id; of rows that share it, the first changes."""
    target = first_by_id(stored.select("id", "internal_id")).join(changes, "id")
    return overlay(stored, target, columns)


def delete_rows(stored: DataFrame, gone: DataFrame) -> DataFrame:
    return stored.join(gone.select("internal_id"), "internal_id", "left_anti")


def apply_details(stored: DataFrame, details: DataFrame) -> DataFrame:
    """Lay a detail batch on the listing: a valid description replaces the stored one, others mark the row 'N/A'."""
    d = details.select("internal_id", F.when(valid_detail(F.col("description")), F.col("description")).otherwise("N/A").alias("_d"))
    return stored.join(d, "internal_id", "left").withColumn("description", F.coalesce("_d", "description")).drop("_d")


def insert_ignore(stored: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert where no stored row has the key; of repeats in the batch the lowest ``order`` wins, by a mergeable aggregate."""
    fresh = new.join(stored.select(*keys).distinct(), keys, "left_anti")
    others = [c for c in new.columns if c not in keys]
    return fresh.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("_row")).select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in new.columns])


def expired(runs: DataFrame, keys: list[str], run: str) -> DataFrame:
    """Keys that were present in some run but not in the last one, with the last run that had them."""
    last = runs.agg(F.max(run)).scalar()
    return runs.groupBy(*keys).agg(F.max(run).alias("last_seen")).filter(F.col("last_seen") < last)


def older_than(df: DataFrame, column: str, now: Column, days: int) -> DataFrame:
    """Rows older than so many days."""
    return df.filter(F.col(column) < now - F.make_dt_interval(days=F.lit(days)))


def latest_import(df: DataFrame, key: str, posted: str, order: str) -> DataFrame:
    """One row for each key: the one posted last, of equals the one imported last; rows without a date come first."""
    rank = F.struct(F.col(posted).isNotNull(), F.col(posted), F.col(order))
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), rank).alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in others])


def external_id(external: Column, raw: Column) -> Column:
    """A record's own number: the column, or where that is missing the one inside the record, even if it is cut off."""
    inner = F.nullif(F.regexp_extract(raw, r'"id"\s*:\s*"((?:[^"\\]|\\.)*)"', 1), F.lit(""))
    return F.coalesce(external, inner)


def run_counters(results: DataFrame, worker: str = "worker") -> DataFrame:
    ok = valid_detail(F.col("description")) & ~F.col("description").startswith("Error: ")
    return results.groupBy(worker).agg(F.count_if(ok).alias("succeeded"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed"))


def run_total(counters: DataFrame) -> DataFrame:
    return counters.agg(F.sum("succeeded").alias("succeeded"), F.sum("failed").alias("failed"), F.count(F.lit(1)).alias("workers"))
