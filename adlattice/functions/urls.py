"""Addresses of the boards' pages as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE_SIZE = 25


def encoded(c: Column) -> Column:
    """Percent encoding as browsers do it for a component: a blank is ``%20``, and ``!'()~*`` stay."""
    out = F.url_encode(c)
    for code, sign in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def with_query(base: Column, parameters: dict[str, Column]) -> Column:
    """``base`` with its parameters; those without a value are left out, and a base that has a query gets more of it."""
    parts = F.array_compact(F.array(*[F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), encoded(v.cast("string")))) for k, v in parameters.items()]))
    sign = F.when(F.contains(base, F.lit("?")), "&").otherwise("?")
    return F.when(F.size(parts) > 0, F.concat(base, sign, F.array_join(parts, "&"))).otherwise(base)


def page_start(page: Column, size: int = PAGE_SIZE) -> Column:
    """Offset of a listing page that counts rows."""
    return (page - 1) * size


def class_listing(base: str, job_class: Column, page: Column, sort: Column, job_type: Column | None = None) -> Column:
    """Listing of a class by path, with the order and the page in the query."""
    path = F.concat(F.lit(f"{base}jobs-in-"), F.regexp_replace(F.lower(job_class), "[^a-z0-9]+", "-"))
    if job_type is not None:
        path = F.when(F.coalesce(job_type, F.lit("")) != "", F.concat(path, F.lit("/"), job_type)).otherwise(path)
    return with_query(path, {"sortmode": sort, "page": page})


def recent_listing(base: str, page: Column, hours: int = 48) -> Column:
    """Listing of the last hours, newest first, by offset."""
    return with_query(F.lit(f"{base}jobs/search/"), {"f_TPR": F.lit(f"r{hours * 3600}"), "sortBy": F.lit("DD"), "start": page_start(page)})


def term_listing(base: str, words: Column, place: Column, limit: int = PAGE_SIZE, radius: int = 25, sort: str = "relevance") -> Column:
    """Listing by words and place."""
    return with_query(F.lit(f"{base}/jobs"), {"q": words, "l": place, "radius": F.lit(radius), "sort": F.lit(sort), "limit": F.lit(limit)})


def detail_page(base: str, key: Column, style: str = "path") -> Column:
    """Address of one posting: ``job/<id>``, ``jobs/view/<id>/`` or ``viewjob?jk=<id>``."""
    return {"path": F.concat(F.lit(f"{base}job/"), key), "view": F.concat(F.lit(f"{base}jobs/view/"), key, F.lit("/")), "key": with_query(F.lit(f"{base}/viewjob"), {"jk": key})}[style]
