"""The board's request surface as functions that return relations (no HTTP server)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlattice.operators import ingest, search, terms
from adlattice.sources.tables import health, table

CAMEL = {
    "company_name": "companyName", "work_type": "workType", "salary_description": "salaryDescription", "date_posted": "datePosted", "date_scraped": "dateScraped", "job_class": "jobClass", "job_subclass": "jobSubclass",
    "company_id": "companyId", "source_id": "sourceId", "job_class_id": "jobClassId", "job_subclass_id": "jobSubclassId", "internal_id": "internalId",
}


class NotFound(LookupError):
    """No posting has the key asked for."""


def page_params(page: object = None, limit: object = None) -> tuple[int, int]:
    """Page and limit of a request: missing, zero or unreadable values become 1 and 20."""

    def read(value: object, default: int) -> int:
        try:
            return int(str(value)) or default
        except ValueError:
            return default

    return read(page, 1), read(limit, 20)


def clamp_page(page: int, total_pages: int) -> int:
    return max(1, min(page, max(1, total_pages)))


def showing(page: int, limit: int, total: int) -> tuple[int, int]:
    """First and last row number on a page, as in 'showing a to b of n'."""
    return (min(total, (page - 1) * limit + 1), min(total, page * limit)) if total else (0, 0)


def file_name(texts: list[str], day: str) -> str:
    """Export file name from the search terms and an ISO day or instant, of which the day is taken."""
    day = str(day).split("T")[0]
    parts = "_".join("".join(c if c.isalnum() else "-" for c in t) for t in texts)
    return f"job_search{'_' + parts if parts else ''}_{day}.csv"


# The labels of an export.
EXPORT = {"id": "ID", "name": "Job Title", "company_name": "Company", "location": "Location", "work_type": "Work Type", "salary_description": "Salary", "date_posted": "Date Posted", "source": "Source", "job_class": "Category", "description": "Description"}


def export(rows: DataFrame) -> DataFrame:
    """Rows as an export shows them: ten labels, 'N/A' for a missing category, blank for other missing values."""
    return rows.select(*[F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("N/A")).alias(n) if c == "job_class" else F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in EXPORT.items()])


def reordered(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns in the given order with blanks for missing texts."""
    return df.select(*columns).na.fill("")


# The columns a record is stored with; the row key comes with it when it is read.
STORED = ("id", "description", "company_name", "name", "location", "work_type", "salary_description", "date_posted", "date_scraped", "source", "other", "remark", "job_class", "job_subclass")


def to_stored(records: DataFrame) -> DataFrame:
    """A record as it is stored: no row key and none of the ids that ingest leaves empty."""
    return records.select(*STORED)


def to_record(rows: DataFrame) -> DataFrame:
    """A stored row as a record with its key, as JSON with every field."""
    return rows.select("internal_id", F.to_json(F.struct("internal_id", *STORED), {"ignoreNullFields": "false"}).alias("record"))


def camel_case(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in CAMEL.items() if k in df.columns})


@dataclass
class PostingApi:
    """Requests over one data folder. Changes return the new relation; nothing is written."""

    spark: SparkSession
    folder: str

    def _jobs(self) -> DataFrame:
        return table(self.spark, self.folder, "jobs")

    def jobs(self, query: str | None = None, mode: str | None = None, page: object = None, limit: object = None, job_class: str | None = None, source: str | None = None) -> tuple[DataFrame, DataFrame]:
        """``GET /jobs``: a page and its meta row."""
        no, size = page_params(page, limit)
        rows = search.keyword_search(self._jobs(), query, mode, job_class, source) if query else search.listing(self._jobs(), job_class, source)
        return camel_case(search.page(rows, no, size)), search.page_meta(rows, no, size)

    def search(self, include: list[str] = (), exclude: list[str] = (), exact: list[str] = (), exact_exclude: list[str] = (), page: object = None, limit: object = None, job_class: str | None = None, source: str | None = None) -> tuple[DataFrame, DataFrame]:
        """``POST /jobs/search``: four term lists; all empty means the plain listing."""
        no, size = page_params(page, limit)
        lists = ((include, False, False), (exclude, True, False), (exact, False, True), (exact_exclude, True, True))
        given = [terms.SearchTerm(t, x, e) for texts, x, e in lists for t in texts]
        rows = search.term_search(self._jobs(), given, job_class, source)
        return camel_case(search.page(rows, no, size)), search.page_meta(rows, no, size)

    def job_classes(self) -> DataFrame:
        return table(self.spark, self.folder, "job_class").select("name").orderBy(F.asc_nulls_last("name"))

    def sources(self) -> DataFrame:
        return table(self.spark, self.folder, "source_platform").select("name").orderBy(F.asc_nulls_last("name"))

    def get(self, key: int) -> DataFrame:
        row = self._jobs().filter(F.col("internal_id") == int(key))
        if row.isEmpty():
            raise NotFound(f"posting {key}")
        return camel_case(row)

    def create(self, values: dict[str, str]) -> DataFrame:
        jobs = self._jobs()
        one = self.spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {dict(jobs.dtypes)[k]}" for k in values))
        return ingest.append(jobs, one)

    def update(self, key: int, values: dict[str, str]) -> DataFrame:
        self.get(key)
        jobs = self._jobs()
        change = self.spark.createDataFrame([(int(key), *values.values())], "internal_id bigint, " + ", ".join(f"{k} {dict(jobs.dtypes)[k]}" for k in values))
        return ingest.overlay(jobs, change, list(values))

    def remove(self, key: int) -> DataFrame:
        self.get(key)
        return self._jobs().filter(F.col("internal_id") != int(key))

    def health(self) -> DataFrame:
        return health(self.spark)
