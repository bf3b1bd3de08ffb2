"""Cards, stubs and details of stored pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlattice.functions import dates, html
from adlattice.operators import ingest
from adlattice.operators.worklist import valid_detail
from adlattice.sources.tables import feed_columns

# Names of search parameters with the value each stands for, and the defaults.
SORT_MODES = {"listed_date": "ListedDate", "relevance": "KeywordRelevance"}
JOB_TYPES = {"full_time": "full-time", "part_time": "part-time", "contract": "contract-temp", "casual": "casual-vacation"}
CATEGORIES = {"software": "information-communication-technology", "finance": "accounting-finance"}
PAGE_SIZE = 25


def search_filters(category: Column, sort: Column, job_type: Column) -> list[Column]:
    """``category_path, job_type_path, sortmode`` of a request; unknown categories and orders give the default, unknown types none."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in JOB_TYPES.items() for x in kv]), job_type)
    return [lookup(category, CATEGORIES, CATEGORIES["software"]).alias("category_path"), kind.alias("job_type_path"), lookup(sort, SORT_MODES, SORT_MODES["listed_date"]).alias("sortmode")]


def lookup(c: Column, values: dict[str, str], default: str) -> Column:
    """A search parameter by name; unknown names and NULL give the default."""
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.element_at(table, F.lower(F.trim(c))), F.lit(default))


def listing_cards(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Cards of listing pages as rows; cards without an id go."""
    card = F.col("card")
    found = html.cards(pages, limit=limit).select(
        *[c for c in pages.columns if c != "html"],
        html.card_id(card).alias("id"),
        html.field(card, "jobTitle", "Unknown Title").alias("name"),
        html.field(card, "jobCompany", "Unknown Company").alias("company_name"),
        html.field(card, "jobLocation", "Unknown Location").alias("location"),
        html.field(card, "jobSalary", "N/A").alias("salary_description"),
        html.field(card, "jobListingDate", "N/A").alias("date_posted"),
    )
    return found.filter(F.col("id").isNotNull())


def dated_cards(pages: DataFrame, now: Column) -> DataFrame:
    """Cards with the instant they were posted; those whose date is missing or cannot be read go."""
    cards = listing_cards(pages).filter("date_posted <> 'N/A'")
    return cards.withColumn("posted_at", dates.short_relative(F.col("date_posted"), now)).filter("posted_at IS NOT NULL")


def listing_run(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """Cards whose id is not stored."""
    return ingest.unseen(listing_cards(pages), stored)


def id_stubs(pages: DataFrame, stored: DataFrame, today: str, source: str = "LinkedIn") -> DataFrame:
    """Rows that hold only an id, the board and the day, for boards whose listing shows ids alone."""
    ids = pages.select(F.explode(F.regexp_extract_all("html", F.lit(r'data-occludable-job-id="(\d+)"'), F.lit(1))).alias("id")).distinct()
    empty = ("name", "company_name", "location", "salary_description", "job_class")
    days = [F.lit(today).alias(c) for c in ("date_posted", "date_scraped")]
    return ingest.unseen(ids, stored).select("id", *[F.lit("N/A").alias(c) for c in empty], F.lit("").alias("description"), F.lit(source).alias("source"), *days)


def detail_fields(pages: DataFrame) -> DataFrame:
    """Text and class of detail pages: the first of the known blocks, else 'N/A'."""
    c = F.col("html")
    body = html.first_match(c, r'(?s)<div[^>]*data-automation="jobAdDetails"[^>]*>(.*?)</div>', r'(?s)<div[^>]*class="[^"]*description[^"]*"[^>]*>(.*?)</div>', default="N/A")
    kind = html.in_parentheses(html.collapse(html.strip_tags(F.regexp_extract(c, r'(?s)data-automation="job-detail-classifications"[^>]*>(.*?)</', 1))))
    return pages.select(*[x for x in pages.columns if x != "html"], html.collapse(html.strip_tags(body)).alias("description"), kind.alias("job_class"))


def essential(df: DataFrame) -> DataFrame:
    """Rows with id, title and company."""
    return df.filter((F.col("id") != "") & (F.col("name") != "") & (F.col("company_name") != ""))


def failed_ids(results: DataFrame, worker: str = "worker") -> DataFrame:
    """``(worker, id)`` for each id that gave no valid text; a worker may have any number of them."""
    bad = ~F.coalesce(valid_detail(F.col("description")) & ~F.col("description").startswith("Error: "), F.lit(False))
    return results.filter(bad).select(worker, "id")


def raw_to_clean(raw: DataFrame) -> DataFrame:
    """Crawl records not yet handled as clean rows: fields mapped, tags stripped, blanks collapsed; ``processed`` says whether
    the record could be read."""
    f = feed_columns(F.col("raw_data"))
    clean = {n: html.collapse(html.strip_tags(F.coalesce(f[p], F.lit("")))) for p, n in (("name", "name"), ("location", "location"), ("salary", "salary_description"), ("description", "description"))}
    rows = raw.filter("processed_at IS NULL")
    return rows.select(F.col("id").alias("raw_id"), F.coalesce("external_id", f["id"]).alias("id"), "source", *[c.alias(n) for n, c in clean.items()], F.get_json_object("raw_data", "$").isNotNull().alias("processed"))


def feed_postings(feed: DataFrame, now: Column) -> DataFrame:
    """Postings of a stored crawl result (columns of :func:`adlattice.sources.tables.feed_columns` and ``date_scraped``):
    defaults where a field is missing, ISO dates with ``now`` as fallback; rows without id or title go."""
    told = lambda c, default: F.coalesce(F.col(c), F.lit(default)).alias(c)
    rows = feed.select("id", told("name", "Unknown Title"), F.lit("").alias("description"), told("company", "Unknown Company").alias("company_name"), told("location", "Unknown Location"), told("salary", "N/A").alias("salary_description"), told("job_class", "N/A"), dates.iso_instant(F.col("date_scraped"), now).alias("date_scraped"))
    return rows.filter((F.col("id") != "") & (F.col("name") != ""))


def recent(df: DataFrame, column: str, now: Column, hours: int, limit: int | None = None, key: str = "id") -> DataFrame:
    """Rows of the last hours, at most ``limit`` of the newest."""
    df = df.filter(F.col(column) >= now - F.make_dt_interval(hours=F.lit(hours)))
    return df.orderBy(F.desc(column), F.desc(key)).limit(limit) if limit else df
