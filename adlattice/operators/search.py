"""Listing, keyword search, term search, paging and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlattice.operators import terms as t
from adlattice.operators.matching import found_skills


def visible() -> Column:
    """Rows a listing shows: ``description != 'N/A'``; NULL descriptions are hidden, '' and errors are shown."""
    return F.col("description") != "N/A"


def facets(df: DataFrame, job_class: str | None = None, source: str | None = None) -> DataFrame:
    if job_class:
        df = df.filter(F.col("job_class") == job_class)
    if source:
        df = df.filter(F.col("source") == source)
    return df


def listing(df: DataFrame, job_class: str | None = None, source: str | None = None) -> DataFrame:
    return facets(df.filter(visible()), job_class, source)


def keyword_search(df: DataFrame, query: str, mode: str | None = None, job_class: str | None = None, source: str | None = None, strict_compat: bool = True) -> DataFrame:
    """Keyword search. In strict mode class and source are ignored and OR mode also shows hidden rows."""
    terms = t.parse_query(query)
    if not terms:
        return listing(df, job_class, source)
    if t.query_mode(query, mode) == "OR":
        found = df.filter(t.matches_any(terms))
        return found if strict_compat else listing(found, job_class, source)
    found = df.filter(visible() & t.matches_all(terms))
    return found if strict_compat else facets(found, job_class, source)


def term_search(df: DataFrame, terms: list[t.SearchTerm], job_class: str | None = None, source: str | None = None) -> DataFrame:
    return listing(df, job_class, source).filter(t.compile_terms(terms))


def page(df: DataFrame, page: int = 1, limit: int = 20, key: str = "internal_id") -> DataFrame:
    """One page, newest first; the key is unique, so the page is well defined."""
    if page < 1 or limit < 1:
        raise ValueError("page and limit start at 1")
    return df.orderBy(F.desc(key)).offset((page - 1) * limit).limit(limit)


def pages(df: DataFrame, count: int, limit: int = 20, key: str = "internal_id") -> DataFrame:
    """The first pages together, as an export fetches them: one top-k instead of one sort a page."""
    return page(df, 1, count * limit, key)


def page_meta(df: DataFrame, page: int = 1, limit: int = 20) -> DataFrame:
    total = F.count(F.lit(1))
    return df.agg(total.alias("total")).select(
        "total", F.lit(page).cast("bigint").alias("page"), F.lit(limit).cast("bigint").alias("limit"), F.ceil(F.col("total") / F.lit(float(limit))).cast("bigint").alias("total_pages")
    )


def facet_names(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column, without NULL and '' (used where no dimension table exists)."""
    return df.select(F.col(column).alias("name")).filter(F.col("name") != "").distinct()


def python_search(df: DataFrame, text: str | None = None, location: str | None = None, company: str | None = None, source: str | None = None, job_class: str | None = None, limit: int = 100) -> DataFrame:
    """Library search: title or text, location, company (case-insensitive), exact source and class;
    newest scrape first with NULLs first, ties by row key."""
    if text:
        df = df.filter(F.col("name").ilike(f"%{text}%") | F.col("description").ilike(f"%{text}%"))
    if location:
        df = df.filter(F.col("location").ilike(f"%{location}%"))
    if company:
        df = df.filter(F.col("company_name").ilike(f"%{company}%"))
    df = facets(df, job_class, source)
    return df.orderBy(F.desc_nulls_first("date_scraped"), F.desc("internal_id")).limit(limit)


def facet_search(df: DataFrame, text: str | None = None, location: str | None = None, company: str | None = None, job_class: str | None = None, work_types: list[str] | None = None, posted_since: str | None = None, skills: list[str] | None = None, pay: DataFrame | None = None, pay_from: int | None = None, currency: str | None = None) -> DataFrame:
    """Rows that meet every facet given. ``skills``: any of them in the text as a whole word. ``pay`` holds yearly ranges
    ``(internal_id, currency, year_min, year_max)``; with ``pay_from`` a range must reach it."""
    if text:
        df = df.filter(F.col("name").ilike(f"%{text}%") | F.col("description").ilike(f"%{text}%"))
    for column, value in (("location", location), ("company_name", company)):
        if value:
            df = df.filter(F.col(column).ilike(f"%{value}%"))
    df = facets(df, job_class)
    if work_types:
        df = df.filter(F.col("work_type").isin(work_types))
    if posted_since:
        df = df.filter(F.col("date_posted") >= posted_since)
    if skills:
        df = df.filter(F.arrays_overlap(found_skills(F.col("description")), F.array(*[F.lit(x) for x in skills])))
    if pay is not None and pay_from is not None:
        reach = (F.col("year_max") >= pay_from) | (F.col("year_max") == -1)
        df = df.join(pay.filter(reach if currency is None else reach & (F.col("currency") == currency)).select("internal_id").distinct(), "internal_id", "left_semi")
    return df
