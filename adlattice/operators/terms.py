"""Search terms: parsing and compilation to one boolean column.

All include, exact, exclude and OR terms of a request become a single predicate, so a search is one
scan whatever the number of terms.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_COLUMNS = ("name", "description", "company_name")


@dataclass(frozen=True)
class SearchTerm:
    text: str
    exclude: bool = False
    exact: bool = False


def parse_query(query: str | None) -> list[str]:
    """Comma and slash both separate terms; blanks go."""
    return [t for t in (p.strip() for p in re.sub(r"\s*,\s*", "/", query or "").split("/")) if t]


def query_mode(query: str | None, mode: str | None = None) -> str:
    """An explicit mode wins; otherwise a slash in the query means OR."""
    return mode.upper() if mode else ("OR" if "/" in (query or "") else "AND")


def parse_term(text: str, exclude: bool = False) -> SearchTerm | None:
    """A leading ``=`` marks an exact term, whose text is kept verbatim; blank input gives None."""
    if not text.strip():
        return None
    return SearchTerm(text[1:], exclude, True) if text.startswith("=") else SearchTerm(text.strip(), exclude, False)


def partition_terms(terms: list[SearchTerm]) -> dict[str, list[str]]:
    names = {(False, False): "include", (True, False): "exclude", (False, True): "exact", (True, True): "exact_exclude"}
    out: dict[str, list[str]] = {n: [] for n in names.values()}
    for t in terms:
        out[names[t.exclude, t.exact]].append(t.text)
    return out


def remove_term(terms: list[SearchTerm], gone: SearchTerm) -> list[SearchTerm]:
    """Only the very same term goes; one that differs in text, exclude or exact stays."""
    return [t for t in terms if t != gone]


def matches(term: str) -> Column:
    """Case-insensitive substring of title, text or company; LIKE metacharacters in the term keep their meaning."""
    return reduce(lambda a, b: a | b, (F.coalesce(F.col(c).ilike(f"%{term}%"), F.lit(False)) for c in TEXT_COLUMNS))


def matches_any(terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, map(matches, terms), F.lit(False))


def matches_all(terms: list[str]) -> Column:
    return reduce(lambda a, b: a & b, map(matches, terms), F.lit(True))


def include(term: str) -> Column:
    """A plain term, or an OR group when it holds slashes."""
    parts = [p.strip() for p in term.split("/") if p.strip()] if "/" in term else [term]
    return matches_any(parts)


def exact(term: str) -> Column:
    """Case-sensitive substring of title, company and text joined by blanks; a missing part reads ``null``."""
    joined = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("null")) for c in ("name", "company_name", "description")])
    return joined.contains(term)


def compile_terms(terms: list[SearchTerm]) -> Column:
    lists = partition_terms(terms)
    parts = [include(t) for t in lists["include"]] + [exact(t) for t in lists["exact"]]
    parts += [~matches(t) for t in lists["exclude"]] + [~exact(t) for t in lists["exact_exclude"]]
    return reduce(lambda a, b: a & b, parts, F.lit(True))
