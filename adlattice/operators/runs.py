"""Crawl runs: a configuration, the platform's board, a worklist cut into workers' batches, changes and counters.

A run reads stored pages instead of the network and returns relations; nothing is written. ``detail_run`` keeps everything
in expressions; ``worker_run`` hands each row of a worker's batch to a function, as a board without expressions needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlattice.operators import ingest, worklist
from adlattice.operators.boards import Board, board
from adlattice.operators.worklist import RunConfig, valid_detail


@dataclass
class RunResult:
    """The stored postings after the run, what each worker or page did, and the summary row."""

    stored: DataFrame | None
    counters: DataFrame | None
    summary: DataFrame


def error_tag(kind: Column) -> Column:
    """What a row holds whose fetch failed: ``Error: <type>``."""
    return F.concat(F.lit("Error: "), kind)


def refused(stored: DataFrame, message: str) -> RunResult:
    said = stored.sparkSession.range(1).select(F.lit(False).alias("success"), F.lit(message).alias("message"))
    return RunResult(stored, None, said)


def summary_of(counters: DataFrame) -> DataFrame:
    """One row: success, rows processed, succeeded, failed."""
    total = ingest.run_total(counters)
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return total.select(F.lit(True).alias("success"), (n("succeeded") + n("failed")).alias("jobs_processed"), n("succeeded").alias("success_count"), n("failed").alias("failure_count"))


def running_totals(listed: DataFrame, page: str = "page") -> DataFrame:
    """Postings of each page and the total up to it. One row a page is all the ordered sum sees."""
    from pyspark.sql import Window

    per_page = listed.groupBy(page).agg(F.count(F.lit(1)).alias("jobs_found"))
    return per_page.withColumn("total_jobs", F.sum("jobs_found").over(Window.orderBy(page).rowsBetween(Window.unboundedPreceding, 0)))


def listing_run(config: RunConfig, stored: DataFrame, pages: DataFrame, today: str) -> RunResult:
    """Pages ``(page, html)`` from the start to the end page: new postings, and with ``save`` appended to the stored ones."""
    found = board(config.source_platform)
    if found is None:
        return refused(stored, f"Unsupported platform: {config.source_platform}")
    listed = found.search_jobs(pages.filter(F.col("page").between(config.start_page, config.end_page)), stored, today)
    after = ingest.append(stored, listed.drop("page")) if config.save else stored
    count = listed.agg(F.count(F.lit(1)).alias("jobs_scraped"))
    done = count.select(F.lit(True).alias("success"), "jobs_scraped", F.lit(config.end_page - config.start_page + 1).alias("pages_scraped"), F.lit(config.save).alias("save"))
    return RunResult(after, running_totals(listed), done)


def batches(config: RunConfig, stored: DataFrame, job_class: str | None = None) -> DataFrame:
    """The worklist ``(internal_id, id, worker)``: newest first, at most ``quantity``, in contiguous batches."""
    work = worklist.worklist(stored, config.detail_filter, job_class, config.source_platform, config.quantity)
    n = work.count()
    return worklist.contiguous_batches(work, config.workers, n).withColumn("worker", F.col("batch_no") + 1).drop("batch_no")


def laid_on(config: RunConfig, stored: DataFrame, results: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The stored postings with a run's results: valid texts and what came with them, else 'N/A' or the error."""
    if not config.save:
        return stored
    d = F.col("description")
    good = F.coalesce(valid_detail(d) & ~d.startswith("Error: "), F.lit(False))
    change = results.select("internal_id", F.when(F.coalesce(d.startswith("Error: "), F.lit(False)) | good, d).otherwise("N/A").alias("description"), *[F.when(good, F.col(c)).alias(c) for c in columns if c != "description"])
    return ingest.overlay(stored, change, list(columns))


def detail_run(config: RunConfig, stored: DataFrame, pages: DataFrame, job_class: str | None = None) -> RunResult:
    """Details of the worklist from stored pages ``(id, html)``; a posting without a page has no valid text."""
    found = board(config.source_platform)
    if found is None:
        return refused(stored, f"Unsupported platform: {config.source_platform}")
    work = batches(config, stored, job_class)
    results = work.join(found.get_job_details(pages.select("id", "html").dropDuplicates(["id"])), "id", "left")
    counters = ingest.run_counters(results)
    return RunResult(laid_on(config, stored, results, found.columns), counters, summary_of(counters))


Fetch = Callable[[str, str | None], dict[str, str] | None]


def worker_run(config: RunConfig, stored: DataFrame, pages: DataFrame, fetch: Fetch, columns: tuple[str, ...] = ("description",)) -> RunResult:
    """As :func:`detail_run`, but ``fetch(id, html)`` reads each row of a worker's batch in turn.

    A row for which it raises becomes ``Error: <type>``; None means no valid text. Rows stream through the worker in Arrow
    batches, so the size of its share does not matter.
    """
    work = batches(config, stored)
    told = work.join(pages.select("id", "html").dropDuplicates(["id"]), "id", "left").repartition(config.workers, "worker")

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            out = []
            for key, external, worker, page in zip(b["internal_id"], b["id"], b["worker"], b["html"], strict=True):
                try:
                    got = fetch(external, page) or {}
                except Exception as error:  # any failure of a row is its result
                    got = {"description": f"Error: {type(error).__name__}"}
                out.append((key, worker, *(got.get(c) for c in columns)))
            yield pd.DataFrame(out, columns=["internal_id", "worker", *columns])

    schema = "internal_id bigint, worker bigint, " + ", ".join(f"{c} string" for c in columns)
    results = told.select("internal_id", "id", "worker", "html").mapInPandas(rows, schema)
    counters = ingest.run_counters(results)
    return RunResult(laid_on(config, stored, results, columns), counters, summary_of(counters))


def create_run(values: dict[str, object]) -> Callable[..., RunResult]:
    """The run a configuration asks for: ``run(stored=..., pages=..., today=...)``, by quantity or by pages."""
    config = RunConfig.from_dict(values)

    def run(stored: DataFrame, pages: DataFrame, today: str = "") -> RunResult:
        return detail_run(config, stored, pages) if config.run_type == 1 else listing_run(config, stored, pages, today)

    return run


def run_from_args(args: list[str]) -> Callable[..., RunResult]:
    """As :func:`create_run`, from ``key=value`` arguments."""
    pairs = dict(p.strip().split("=", 1) for p in " ".join(args).split(",") if "=" in p)
    return create_run({k.strip(): v.strip() for k, v in pairs.items()})


__all__ = ["Board", "RunResult", "batches", "create_run", "detail_run", "listing_run", "run_from_args", "running_totals", "worker_run"]
