"""Enrichment worklists, batch assignment, crawl units and run configuration."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = ("new", "N/A", "all")
METHODS = ("selenium", "scrapy")


def pending(kind: str = "new") -> Column:
    """``new``: never fetched. ``N/A``: also fetched without result. ``all``: every row."""
    d = F.col("description")
    fresh = d.isNull() | (d == "")
    return {"new": fresh, "N/A": fresh | (d == "N/A"), "all": F.lit(True)}[kind]


def valid_detail(c: Column) -> Column:
    return c.isNotNull() & (c != "") & (c != "N/A")


def enrichment_status(c: Column) -> Column:
    return F.when(c.isNull() | (c == ""), "new").when(c == "N/A", "empty").when(c.startswith("Error: "), "failed").otherwise("done")


def worklist(df: DataFrame, kind: str = "new", job_class: str | None = None, source: str | None = None, limit: int | None = 100) -> DataFrame:
    df = df.filter(pending(kind))
    if job_class:
        df = df.filter(F.lower("job_class") == job_class.lower())
    if source:
        df = df.filter(F.lower("source") == source.lower())
    df = df.select("internal_id", "id").orderBy(F.desc("internal_id"))
    return df.limit(limit) if limit else df


def contiguous_batches(df: DataFrame, workers: int, n: int, key: str = "internal_id") -> DataFrame:
    """Slices of ``ceil(n / min(workers, n))`` rows in descending key order, as ``batch_no`` from 0.

    Ranks come from a range partitioning (per-partition counts plus a running offset), so no single
    task sees all rows.
    """
    w = max(1, min(workers, n))
    size = max(1, math.ceil(n / w))
    ranked = global_rank(df, key)
    return ranked.withColumn("batch_no", F.floor((F.col("rank") - 1) / F.lit(size)).cast("bigint")).drop("rank")


def global_rank(df: DataFrame, key: str) -> DataFrame:
    """Rank from 1 in descending order of a unique key, distributed: rank within range blocks plus block offsets."""
    blocks = df.withColumn("_b", F.floor(F.col(key) / F.lit(4096)).cast("bigint"))
    counts = blocks.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    supers = counts.withColumn("_s", F.floor(F.col("_b") / F.lit(4096)).cast("bigint"))
    tops = supers.groupBy("_s").agg(F.sum("_n").alias("_sn"))
    # one row per 16.7 million key values remains here
    tops = tops.withColumn("_top", F.coalesce(F.sum("_sn").over(Window.orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("_s").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = supers.withColumn("_mid", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(tops, "_s").select("_b", (F.col("_mid") + F.col("_top")).alias("_off"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(F.desc(key))).cast("bigint")
    return blocks.withColumn("_r", rank).join(offsets, "_b").withColumn("rank", F.col("_r") + F.col("_off")).drop("_b", "_r", "_off")


def crawl_units(classes: DataFrame, start_page: int, end_page: int) -> DataFrame:
    """Every class with every page, by expanding a page sequence on the class rows."""
    return classes.select(F.col("name").alias("job_class"), F.explode(F.sequence(F.lit(start_page).cast("bigint"), F.lit(end_page).cast("bigint"))).alias("page"))


def find_platform(platforms: DataFrame, wanted: int | str) -> DataFrame:
    """By id, or by name without regard to case; no row means unknown (see :func:`known_platform`)."""
    by_id = F.col("id") == int(wanted) if str(wanted).strip().isdigit() else F.lit(False)
    return platforms.filter(by_id | (F.lower("name") == str(wanted).strip().lower()))


def known_platform(platforms: DataFrame, wanted: int | str) -> tuple[int, str]:
    """``(id, name)`` of a platform; an unknown one raises LookupError."""
    row = find_platform(platforms, wanted).select("id", "name").first()
    if row is None:
        raise LookupError(f"unknown platform {wanted}")
    return row["id"], row["name"]


def method_name_of(name: str) -> str:
    return name.strip().lower().replace(" ", "_").replace("-", "_")


def method_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[ -]", "_")


@dataclass
class RunConfig:
    """A crawl run. Values are normalised, not rejected: counts start at 1, an end page is no earlier than the start."""

    source_platform: str = "all"
    quantity: int | None = None
    start_page: int | None = None
    end_page: int | None = None
    workers: int = 1
    save: bool = False
    detail_filter: str = "new"
    method: str = "selenium"
    run_type: int = field(init=False, default=1)

    def __post_init__(self) -> None:
        self.workers = max(1, self.workers)
        if self.quantity is not None:
            self.run_type, self.quantity = 1, max(1, self.quantity)
        elif self.start_page is not None or self.end_page is not None:
            self.run_type = 2
            self.start_page = max(1, self.start_page or 1)
            self.end_page = max(self.start_page, self.end_page or self.start_page)
        else:
            self.run_type, self.quantity = 1, 1
        if self.detail_filter not in FILTERS:
            self.detail_filter = "new"
        if self.method not in METHODS:
            self.method = METHODS[0]

    @classmethod
    def from_args(cls, args: list[str]) -> RunConfig:
        pairs = dict(p.strip().split("=", 1) for p in " ".join(args).split(",") if "=" in p)
        return cls.from_dict({k.strip(): v.strip() for k, v in pairs.items()})

    @classmethod
    def from_dict(cls, values: dict[str, object]) -> RunConfig:
        kept: dict[str, object] = {}
        for name, value in values.items():
            if name in ("quantity", "start_page", "end_page", "workers"):
                try:
                    kept[name] = int(str(value))
                except ValueError:
                    continue
            elif name == "save":
                kept[name] = str(value).lower() == "true"
            elif name in ("source_platform", "detail_filter", "method"):
                kept[name] = str(value)
        return cls(**kept)  # type: ignore[arg-type]
